"""Stores, listings and requests read from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the shopper stands, and how far they go.
CENTRE = (43.238, 76.8829)
RADIUS_M = 5000
#: Columns that put listings in order.
ORDER = (
    "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice l_quantity l_discount l_tax l_shipdate l_returnflag l_linestatus"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key over as many tasks as a shuffle has: small rows of which much is made, such as pages,
    else come in few large splits. The number is given, so that tasks aren't put together by their bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key)


def shop_domain(key: Column) -> Column:
    return F.when(key % 7 != 0, F.concat(F.lit("shop"), (key % 12).cast("string"), F.lit(".example")))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped shops: id, pos, name, domain, shop_type, lat, lon."""
    k = F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("electronics", "computer", "mobile_phone", "hifi", "video_games", "camera", "appliance")))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("node/"), k.cast("string")).alias("id"),
        k.alias("pos"),
        F.concat(F.lit("Shop "), (k % 20).cast("string")).alias("name"),
        shop_domain(k).alias("domain"),
        F.get(kinds, (k % 7).cast("int")).alias("shop_type"),
        (F.lit(43.238) + ((k * 37) % 200 - 100) * 0.0005).alias("lat"),
        (F.lit(76.8829) + ((k * 91) % 200 - 100) * 0.0005).alias("lon"),
    )


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store three times, 45 m apart from one to the next."""
    step = F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    return stores(spark, sf_dir).select("*", step).withColumns(
        {"lat": F.col("lat") + F.col("k") * 0.0004, "pos": F.col("pos") * 3 + F.col("k")}
    ).drop("k")


def listings(spark: SparkSession, sf_dir: str, sized: bool = False) -> DataFrame:
    """Offers: title, price, old_price, domain, in_stock (NULL: unknown), at (their order)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    line = table(spark, sf_dir, "lineitem").select(*ORDER)
    size = F.when(F.col("p_size") % 3 == 0, " 128GB").when(F.col("p_size") % 3 == 1, " 256GB").otherwise("")
    title = [F.col("p_brand"), F.lit(" "), F.col("p_name"), *([size] if sized else [])]
    price = F.round("l_extendedprice").cast("long")
    stock = F.when(F.col("l_returnflag") == "R", False).when(F.col("l_linestatus") == "O", True)
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.struct(*ORDER).alias("at"),
        F.concat(*title).alias("title"),
        price.alias("price"),
        F.when(F.col("l_discount") > 0, F.round(price * (1 + F.col("l_discount"))).cast("long")).alias("old_price"),
        shop_domain(F.col("l_suppkey")).alias("domain"),
        stock.alias("in_stock"),
    )


SHOP = "CASE WHEN {0} % 7 <> 0 THEN 'shop' || ({0} % 12) || '.example' END"

STORES = f"""stores AS (
  SELECT 'node/' || s_suppkey AS id, s_suppkey AS pos, 'Shop ' || (s_suppkey % 20) AS name,
    {SHOP.format("s_suppkey")} AS domain,
    ['electronics', 'computer', 'mobile_phone', 'hifi', 'video_games', 'camera', 'appliance'][s_suppkey % 7 + 1] AS shop_type,
    43.238::DOUBLE + ((s_suppkey * 37) % 200 - 100) * 0.0005::DOUBLE AS lat,
    76.8829::DOUBLE + ((s_suppkey * 91) % 200 - 100) * 0.0005::DOUBLE AS lon
  FROM supplier)"""


def listings_sql(sized: bool = False) -> str:
    size = " || CASE p_size % 3 WHEN 0 THEN ' 128GB' WHEN 1 THEN ' 256GB' ELSE '' END" if sized else ""
    return f"""listings AS (
  SELECT row_number() OVER (ORDER BY {", ".join(ORDER)}) AS pos, p_brand || ' ' || p_name{size} AS title,
    round(l_extendedprice)::BIGINT AS price,
    CASE WHEN l_discount > 0 THEN round(round(l_extendedprice)::BIGINT * (1 + l_discount))::BIGINT END AS old_price,
    {SHOP.format("l_suppkey")} AS domain,
    CASE WHEN l_returnflag = 'R' THEN false WHEN l_linestatus = 'O' THEN true END AS in_stock
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
