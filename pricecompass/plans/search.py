"""Queries of the search: stores, matching, ranking; each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, matching, query, text
from ..functions import values as V
from ..operators import listings, ranking, stores
from ..operators.chunks import numbered, staged
from ..sources import bindings as B

ASK = "red widget"
ASK_SIZED = "red widget brand 128GB"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


LAT, LON = (f"{x}::DOUBLE" for x in B.CENTRE)
METRES = geo.haversine_sql(LAT, LON, "lat", "lon")
NEAR = f"""{B.STORES},
near AS (SELECT *, round({METRES})::BIGINT AS distance_m FROM stores),
inside AS (SELECT * FROM near WHERE distance_m <= {B.RADIUS_M})"""


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.in_radius(B.stores(spark, sf_dir), B.CENTRE, B.RADIUS_M)


@registered(f"WITH {NEAR} SELECT id, name, domain, distance_m FROM near")
def store_distance(spark, sf_dir):
    return stores.with_distance(B.stores(spark, sf_dir), B.CENTRE).select("id", "name", "domain", "distance_m")


@registered(f"WITH {NEAR} SELECT id, shop_type, distance_m FROM inside WHERE shop_type IN {V.SHOP_TYPES}")
def stores_in_radius(spark, sf_dir):
    return near(spark, sf_dir).where(F.col("shop_type").isin(*V.SHOP_TYPES)).select("id", "shop_type", "distance_m")


@registered(
    f"""WITH {NEAR} SELECT id, floor(lat / {V.CELL_DEG}::DOUBLE)::BIGINT AS cell_y, floor(lon / {V.CELL_DEG}::DOUBLE)::BIGINT AS cell_x,
  printf('stores:v2:%.3f:%.3f:{B.RADIUS_M}', round(lat * 1000) / 1000, round(lon * 1000) / 1000) AS cache_key FROM near"""
)
def store_cells(spark, sf_dir):
    key = F.format_string(f"stores:v2:%.3f:%.3f:{B.RADIUS_M}", F.round(F.col("lat") * 1000) / 1000, F.round(F.col("lon") * 1000) / 1000)
    return B.stores(spark, sf_dir).select(
        "id", geo.cell(F.col("lat")).alias("cell_y"), geo.cell(F.col("lon")).alias("cell_x"), key.alias("cache_key")
    )


_KEEP = geo.haversine_sql("k.lat", "k.lon", "p.lat", "p.lon")


@registered(
    f"""WITH {B.STORES},
pins AS (SELECT pos * 3 + k AS pos, name, lat + k * 0.0004::DOUBLE AS lat, lon FROM stores, (SELECT unnest(range(3)) AS k)),
d AS (SELECT *, round({METRES})::BIGINT AS distance_m, floor(lat / {V.CELL_DEG}::DOUBLE)::BIGINT AS y, floor(lon / {V.CELL_DEG}::DOUBLE)::BIGINT AS x FROM pins),
g AS (SELECT list({{'pos': pos, 'lat': lat, 'lon': lon, 'y': y, 'x': x}} ORDER BY distance_m, pos) AS pins FROM d GROUP BY lower(name)),
f AS (SELECT unnest(list_reduce(pins, lambda acc, p: CASE WHEN len(list_filter(acc, lambda k: abs(k.y - p.y) <= 2 AND abs(k.x - p.x) <= 2
  AND {_KEEP} < {V.SAME_PIN_M}::DOUBLE)) > 0 THEN acc ELSE list_append(acc, p) END, [pins[1]][1:0])) AS p
  FROM (SELECT list_transform(pins, lambda p: [p]) AS w, pins FROM g))
SELECT p.pos AS pos, d.name AS name, d.distance_m AS distance_m FROM f JOIN d ON d.pos = f.p.pos"""
)
def store_dedupe(spark, sf_dir):
    return stores.dedupe_pins(stores.with_distance(B.pins(spark, sf_dir), B.CENTRE)).select("pos", "name", "distance_m")


CHAINS = f"""{NEAR},
branches AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY distance_m, pos) AS branch FROM inside WHERE domain IS NOT NULL
  QUALIFY branch <= {V.MAX_BRANCHES}),
chains AS (SELECT domain, count(*) AS branches, min(distance_m) AS nearest_m FROM branches GROUP BY domain),
placed AS (SELECT *, domain IN ('shop1.example', 'shop5.example', 'shop7.example') AS known FROM chains),
ordered AS (SELECT *, row_number() OVER (ORDER BY known DESC, branches DESC, nearest_m, domain)::INT AS place FROM placed),
fair AS (SELECT *, row_number() OVER (PARTITION BY known ORDER BY place) AS k FROM ordered),
selected AS (SELECT * FROM fair WHERE known OR k <= {V.MAX_UNKNOWN} ORDER BY place LIMIT {V.MAX_DOMAINS})"""
KNOWN = ("shop1.example", "shop5.example", "shop7.example")
IGNORED = ("shop3.example", "shop9.example")


def chain_order(spark, sf_dir):
    return stores.ordered(stores.chains(near(spark, sf_dir)), F.col("domain").isin(*KNOWN))


@registered(f"WITH {CHAINS} SELECT domain, branches, nearest_m FROM chains")
def chain_groups(spark, sf_dir):
    return stores.chains(near(spark, sf_dir))


@registered(f"WITH {CHAINS} SELECT domain, id, distance_m FROM branches WHERE branch = 1")
def nearest_branch(spark, sf_dir):
    return stores.nearest_branches(near(spark, sf_dir), 1).select("domain", "id", "distance_m")


@registered(f"WITH {CHAINS} SELECT domain, id, branch::INT AS branch FROM branches")
def branch_cap(spark, sf_dir):
    return stores.nearest_branches(near(spark, sf_dir)).select("domain", "id", "branch")


@registered(f"WITH {CHAINS} SELECT domain, known, branches, nearest_m, place FROM ordered")
def domain_order(spark, sf_dir):
    return chain_order(spark, sf_dir)


@registered(f"WITH {CHAINS} SELECT domain, known, place FROM selected")
def domain_selection(spark, sf_dir):
    return stores.selected(chain_order(spark, sf_dir)).select("domain", "known", "place")


@registered(f"WITH {CHAINS} SELECT domain, place FROM ordered WHERE domain NOT IN (SELECT domain FROM selected)")
def skipped_domains(spark, sf_dir):
    order = chain_order(spark, sf_dir)
    return order.join(stores.selected(order).select("domain"), "domain", "left_anti").select("domain", "place")


@registered(f"WITH {CHAINS} SELECT domain, branches FROM chains WHERE domain NOT IN {IGNORED}")
def ignored_anti(spark, sf_dir):
    ignored = spark.createDataFrame([(d,) for d in IGNORED], "domain string")
    return stores.chains(near(spark, sf_dir)).join(F.broadcast(ignored), "domain", "left_anti").select("domain", "branches")


def labels(spark):
    """Known retailers: a fixed handful of rows."""
    return spark.createDataFrame([(d, f"Retailer {d[4:-8]}") for d in KNOWN], "domain string, label string")


_LABEL = "CASE WHEN domain IN ('shop1.example', 'shop5.example', 'shop7.example') THEN 'Retailer ' || regexp_extract(domain, '(\\d+)', 1) ELSE domain END"


@registered(f"WITH {CHAINS} SELECT domain, {_LABEL} AS label FROM chains")
def adapter_labels(spark, sf_dir):
    found = stores.chains(near(spark, sf_dir)).join(F.broadcast(labels(spark)), "domain", "left")
    return found.select("domain", F.coalesce("label", "domain").alias("label"))


# Matching

TOKENS = text.tokenize_sql("title")
#: Tokens of the two requests used here.
ASK_TOKENS, SIZED_TOKENS = ("red", "widget"), ("red", "widget", "brand")


def _match_sql(sized: bool) -> str:
    """The ladder for the two requests used here: neither names a brand, a variant or a category."""
    asked = SIZED_TOKENS if sized else ASK_TOKENS
    rules = " ".join(
        f"WHEN regexp_matches(low, {text.quoted(text.re2(s))}) THEN '{prefix}{label}'"
        for prefix, table in (("accessory: ", V.ACCESSORIES), ("", V.CONDITIONS))
        for label, (s, _) in table.items()
    )
    one = lambda t: (
        f"CASE WHEN list_contains(signs, '{t}') THEN 1.0::DOUBLE WHEN len(list_filter(tokens, lambda x: (starts_with(x, '{t}') "
        f"OR starts_with('{t}', x)) AND least(length(x), {len(t)}) >= 4)) > 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END"
    )
    cover = " + ".join(map(one, asked))
    size = "regexp_extract(title, '(\\d+)GB', 1)"
    wrong = f"WHEN {size} <> '' AND {size} <> '128' THEN 'wrong storage (' || {size} || 'GB, wanted 128GB)'" if sized else ""
    bonus = f"CASE WHEN {size} = '' THEN c0 - 0.1::DOUBLE ELSE least(1.0::DOUBLE, c0 + 0.1::DOUBLE) END" if sized else "c0"
    return f"""{B.listings_sql(sized)},
t0 AS (SELECT *, lower({text.normalise_sql("title")}) AS low, {TOKENS} AS tokens FROM listings),
t1 AS (SELECT *, {text.signatures_sql("tokens")} AS signs FROM t0),
t2 AS (SELECT *, ({cover}) / {len(asked)}::DOUBLE AS cover FROM t1),
t3 AS (SELECT *, 0.5::DOUBLE + 0.4::DOUBLE * cover AS c0, CASE WHEN length(title) < 3 THEN 'title too short' {rules}
  WHEN price < 5000 THEN 'price below other floor' WHEN price > 20000000 THEN 'price above other ceiling'
  WHEN cover < 0.66::DOUBLE THEN 'title does not match query' {wrong} END AS reject_reason FROM t2),
matched AS (SELECT pos, title, price, old_price, domain, in_stock, reject_reason IS NOT NULL AS rejected, reject_reason,
  CASE WHEN reject_reason IS NOT NULL THEN 0.0::DOUBLE ELSE {bonus} END AS confidence FROM t3)"""


MATCHED, MATCHED_SIZED = _match_sql(False), _match_sql(True)


def matched(spark, sf_dir, sized: bool = False) -> DataFrame:
    return matching.match(B.listings(spark, sf_dir, sized), query.parse(ASK_SIZED if sized else ASK))


@registered("SELECT DISTINCT " + f"title, {text.normalise_sql('title')} AS normal FROM (SELECT 'Айфон ' || p_size || ' самсунг А' || p_size || ' ' || p_name AS title FROM part)")
def normalise_text(spark, sf_dir):
    title = F.concat(F.lit("Айфон "), F.col("p_size").cast("string"), F.lit(" самсунг А"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"))
    return B.table(spark, sf_dir, "part").select(title.alias("title")).distinct().withColumn("normal", text.normalise(F.col("title")))


@registered(f"SELECT p_partkey, array_to_string({text.tokenize_sql('title')}, ' ') AS tokens FROM (SELECT p_partkey, p_brand || ' S' || p_size || '+ ' || p_name AS title FROM part)")
def tokenize(spark, sf_dir):
    title = F.concat("p_brand", F.lit(" S"), F.col("p_size").cast("string"), F.lit("+ "), "p_name")
    return B.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.tokenize(title), " ").alias("tokens"))


@registered(
    f"""WITH t AS (SELECT p_partkey, {text.tokenize_sql("p_brand || ' ' || p_name")} AS tokens FROM part)
SELECT p_partkey, array_to_string(list_sort({text.signatures_sql("tokens")}), ' ') AS signatures FROM t"""
)
def token_signatures(spark, sf_dir):
    signs = text.signatures(text.tokenize(F.concat("p_brand", F.lit(" "), "p_name")))
    return B.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(signs), " ").alias("signatures"))


_NAMES = ("iPhone", "MacBook", "Galaxy Tab", "Smart TV", "наушники", "Galaxy Watch", "монитор", "PS5", "GoPro", "DDR4", "shelf", "xiaomi redmi")
_NAMED = f"(SELECT p_partkey, {list(_NAMES)}[p_partkey % {len(_NAMES)} + 1] || ' ' || p_name AS title FROM part)"


def named(spark, sf_dir):
    word = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    return B.table(spark, sf_dir, "part").select("p_partkey", F.concat(word, F.lit(" "), F.col("p_name")).alias("title"))


@registered(f"SELECT p_partkey, {text.detect_category_sql('title')} AS category FROM {_NAMED}")
def detect_category(spark, sf_dir):
    return named(spark, sf_dir).select("p_partkey", text.detect_category(F.col("title")).alias("category"))


@registered(f"SELECT p_partkey, array_to_string({text.brands_in_sql('title')}, ' ') AS brands FROM {_NAMED}")
def brands_in(spark, sf_dir):
    return named(spark, sf_dir).select("p_partkey", F.array_join(text.brands_in(F.col("title")), " ").alias("brands"))


@registered(
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 ELSE 0 END::INT AS storage,
  CASE p_size % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END::INT AS ram FROM part"""
)
def capacities(spark, sf_dir):
    size = F.when(F.col("p_size") % 3 == 0, " 8/256GB").when(F.col("p_size") % 3 == 1, " 16 GB RAM 512 GB SSD").otherwise(" 32GB RAM")
    found = B.table(spark, sf_dir, "part").select("p_partkey", query.capacities(F.concat(F.lit("laptop "), "p_name", size), "laptop").alias("c"))
    return found.select("p_partkey", F.coalesce("c.storage", F.lit(0)).alias("storage"), "c.ram")


@registered(f"WITH {MATCHED} SELECT title, price, rejected, reject_reason, round(confidence, 6) AS confidence FROM matched")
def match_listings(spark, sf_dir):
    return matched(spark, sf_dir).select("title", "price", "rejected", "reject_reason", F.round("confidence", 6).alias("confidence"))


@registered(f"WITH {MATCHED_SIZED} SELECT title, price, rejected, reject_reason, round(confidence, 6) AS confidence FROM matched")
def match_sized(spark, sf_dir):
    return matched(spark, sf_dir, True).select("title", "price", "rejected", "reject_reason", F.round("confidence", 6).alias("confidence"))


@registered(f"WITH {MATCHED_SIZED} SELECT reject_reason, count(*) AS n FROM matched WHERE rejected GROUP BY reject_reason")
def reject_histogram(spark, sf_dir):
    return matched(spark, sf_dir, True).where("rejected").groupBy("reject_reason").agg(F.count("*").alias("n"))


@registered(f"WITH {MATCHED} SELECT DISTINCT title, round(cover, 6) AS coverage FROM t2")
def token_coverage(spark, sf_dir):
    rows = B.listings(spark, sf_dir).select("title").distinct()
    tokens = text.tokenize(F.col("title"))
    rows = rows.withColumn("tokens", tokens).withColumn("signs", text.signatures(F.col("tokens")))
    cover = matching.coverage(F.col("tokens"), F.col("signs"), ASK_TOKENS)
    return rows.select("title", F.round(cover, 6).alias("coverage"))


# Listings and ranking

_LISTED = B.listings_sql() + """,
offered AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'https://' || domain || '/p/' || (price % 50) END AS url FROM listings)"""


def offered(spark, sf_dir) -> DataFrame:
    """Listings with a url for every third, by the order of all (numbered without gathering them)."""
    return numbered(B.listings(spark, sf_dir), "at").withColumn(
        "url", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("https://"), "domain", F.lit("/p/"), (F.col("price") % 50).cast("string")))
    )


@registered(f"""WITH {_LISTED} SELECT pos, title, price, url FROM offered WHERE price > 0 AND length(title) BETWEEN 3 AND 300
  QUALIFY row_number() OVER (PARTITION BY coalesce(url, lower(title)), price ORDER BY pos) = 1""")
def listing_dedupe(spark, sf_dir):
    return listings.deduped(listings.sane(offered(spark, sf_dir)), "pos").select("pos", "title", "price", "url")


@registered(f"WITH {B.listings_sql()} SELECT lower(title) AS title, min(price) AS price, arg_min(domain, (price, pos)) AS domain FROM (SELECT * FROM listings WHERE domain IS NOT NULL) GROUP BY 1")
def min_price_by_title(spark, sf_dir):
    rows = B.listings(spark, sf_dir).where("domain is not null").groupBy(F.lower("title").alias("title"))
    return rows.agg(F.min("price").alias("price"), F.min_by("domain", F.struct("price", "at")).alias("domain"))


def _best(match_sql: str) -> str:
    step = (
        f"CASE WHEN b.pos IS NULL OR x.c > b.c + {V.TOLERANCE}::DOUBLE OR (abs(x.c - b.c) <= {V.TOLERANCE}::DOUBLE AND x.price < b.price) THEN x ELSE b END"
    )
    return f"""{match_sql},
ok AS (SELECT * FROM matched WHERE NOT rejected AND confidence >= {V.MIN_CONFIDENCE}::DOUBLE),
has_stock AS (SELECT *, bool_or(coalesce(in_stock, true)) OVER (PARTITION BY domain) AS s FROM ok),
can AS (SELECT * FROM has_stock WHERE NOT s OR coalesce(in_stock, true)),
folded AS (SELECT domain, list_reduce(list({{'pos': pos, 'c': confidence, 'price': price}} ORDER BY pos), lambda b, x: {step}) AS b FROM can GROUP BY domain),
best AS (SELECT can.* FROM folded JOIN can ON can.pos = b.pos)"""


@registered(f"WITH {_best(MATCHED)} SELECT domain, in_stock, count(*) AS n FROM can GROUP BY ALL")
def stock_preference(spark, sf_dir):
    rows = ranking.purchasable(matching.accepted(matched(spark, sf_dir)))
    return rows.groupBy("domain", "in_stock").agg(F.count("*").alias("n"))


@registered(f"WITH {_best(MATCHED_SIZED)} SELECT domain, title, price, round(confidence, 6) AS confidence FROM best")
def best_listing_fold(spark, sf_dir):
    best = ranking.best_by_domain(matched(spark, sf_dir, True))
    return best.select("domain", "title", "price", F.round("confidence", 6).alias("confidence"))


def _deals(match_sql: str) -> str:
    return f"""{_best(match_sql)}, {CHAINS},
closest AS (SELECT domain, arg_min({{'name': name, 'm': distance_m}}, (distance_m, pos)) AS b, count(*) AS branches FROM branches GROUP BY domain),
joined AS (SELECT best.domain, title, price, old_price, in_stock, confidence, b.name AS store, b.m AS distance_m, closest.branches FROM best JOIN closest ON best.domain = closest.domain),
cost AS (SELECT *, {geo.cost_sql("price", "distance_m")} FROM joined),
scored AS (SELECT *, {geo.SCORE_SQL} AS score, bool_or(in_stock IS DISTINCT FROM false) OVER () AS some_stock FROM cost),
deals AS (SELECT * EXCLUDE (some_stock), (row_number() OVER (ORDER BY CASE WHEN some_stock AND in_stock IS NOT DISTINCT FROM false THEN 1 ELSE 0 END, score, domain) - 1)::INT AS rank FROM scored)"""


DEALS, DEALS_SIZED = _deals(MATCHED), _deals(MATCHED_SIZED)


def deals(spark, sf_dir, sized: bool = False, found: DataFrame | None = None) -> DataFrame:
    best = ranking.best_by_domain(matched(spark, sf_dir, sized) if found is None else found)
    return ranking.deals(best, stores.nearest_branches(near(spark, sf_dir)))


@registered(f"WITH {NEAR} SELECT id, {geo.cost_sql('(pos * 1000)', 'distance_m')} FROM near")
def cost_model(spark, sf_dir):
    found = stores.with_distance(B.stores(spark, sf_dir), B.CENTRE)
    return found.withColumns(geo.cost_columns(F.col("pos") * 1000, F.col("distance_m"))).select(
        "id", "travel", "time_cost", "total", "distance_km", "minutes"
    )


@registered(f"WITH {DEALS_SIZED} SELECT domain, total, round(score, 6) AS score FROM deals")
def deal_score(spark, sf_dir):
    return deals(spark, sf_dir, True).select("domain", "total", F.round("score", 6).alias("score"))


@registered(f"WITH {DEALS} SELECT rank, domain, store, title, price, distance_m, travel, time_cost, total, distance_km, round(score, 6) AS score FROM deals")
def true_cost_ranking(spark, sf_dir):
    return deals(spark, sf_dir).select(
        "rank", "domain", "store", "title", "price", "distance_m", "travel", "time_cost", "total", "distance_km",
        F.round("score", 6).alias("score"),
    )


@registered(f"WITH {DEALS} SELECT domain, rank, total - first_value(total) OVER (ORDER BY rank) AS delta, rank = 0 AS is_best, coalesce(lead(total) OVER (ORDER BY rank) - total, 0) AS to_next FROM deals")
def delta_to_best(spark, sf_dir):
    order = Window.orderBy("rank")
    found = deals(spark, sf_dir)
    return found.select(
        "domain", "rank", (F.col("total") - F.first("total").over(order)).alias("delta"), (F.col("rank") == 0).alias("is_best"),
        F.coalesce(F.lead("total").over(order) - F.col("total"), F.lit(0)).alias("to_next"),
    )


_OFF = "round((1 - price / old_price) * 100)::BIGINT"


@registered(
    f"""WITH {DEALS_SIZED}, m AS (SELECT *, min(price) OVER () AS ms, min(total) OVER () AS mt FROM deals)
SELECT domain, concat_ws(' | ', CASE WHEN price = ms THEN 'Lowest sticker price found' END,
  CASE WHEN total = mt AND price <> ms THEN 'Cheaper overall once travel is counted (+' || {geo.kzt_sql("travel + time_cost")} || ' to get there and back)' END,
  CASE WHEN old_price > price AND {_OFF} >= 3 THEN 'Discounted ' || {_OFF} || '% from ' || {geo.kzt_sql("old_price")} END,
  CASE WHEN distance_km <= 2 THEN 'Walking distance' END,
  CASE WHEN branches > 1 THEN 'Same price at ' || branches || ' ' || store || ' branches; nearest shown' END,
  CASE WHEN confidence < 0.7::DOUBLE THEN 'Listing title is an approximate match — verify before travelling' END,
  CASE WHEN in_stock = false THEN 'Marked out of stock online' END) AS reasons FROM m"""
)
def deal_reasons(spark, sf_dir):
    return ranking.with_reasons(deals(spark, sf_dir, True)).select("domain", F.array_join("reasons", " | ").alias("reasons"))


@registered(f"SELECT o_orderkey, {geo.kzt_sql('o_totalprice')} AS shown FROM orders")
def format_kzt(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", geo.format_kzt(F.round("o_totalprice")).alias("shown"))


_KM = "regexp_replace(({0})::VARCHAR, '\\.0$', '')"


@registered(
    f"""WITH {DEALS},
one AS (SELECT count(*) AS n, arg_min(deals, rank) AS b, arg_min(deals, (price, rank)) AS s, arg_min(deals, (total, rank)) AS c,
  (SELECT total FROM deals WHERE rank = 1) AS t2, bool_and(in_stock IS NOT DISTINCT FROM false) AS none FROM deals)
SELECT CASE WHEN n = 0 THEN NULL
  WHEN n = 1 THEN 'Only one nearby shop had a readable listing: ' || b.store || ' at ' || {geo.kzt_sql("b.price")} || '.' || CASE WHEN b.in_stock = false THEN ' It is marked out of stock online.' ELSE '' END
  WHEN none THEN 'Every readable matching listing is marked out of stock; ' || b.store || ' has the lowest ranked unavailable option at ' || {geo.kzt_sql("b.price")} || '.'
  WHEN b.rank = c.rank AND b.rank <> s.rank THEN b.store || ' wins on total cost: ' || {geo.kzt_sql("b.price")} || ' at ' || {_KM.format("b.distance_km")} || ' km beats the ' || {geo.kzt_sql("s.price")}
    || ' at ' || s.store || ' once its ' || {_KM.format("s.distance_km")} || ' km distance is priced in (' || {geo.kzt_sql("s.total - b.total")} || ' better).'
  WHEN b.rank = c.rank THEN b.store || ' is the best-value option at ' || {geo.kzt_sql("b.price")} || ' (' || {geo.kzt_sql("b.total")} || ' including travel), ' || {geo.kzt_sql("t2 - b.total")} || ' below the next ranked option.'
  ELSE b.store || ' ranks first as the stronger available match at ' || {geo.kzt_sql("b.price")} || '; ' || c.store || ' has the lower estimated total at ' || {geo.kzt_sql("c.total")} || ', but '
    || CASE WHEN c.in_stock = false THEN 'is marked out of stock' WHEN c.confidence < b.confidence THEN 'is a lower-confidence match' ELSE 'has a weaker availability or match signal' END || '.' END
  || CASE WHEN b.in_stock IS NULL AND NOT (none AND n > 1) THEN ' Branch stock is unverified.' ELSE '' END AS verdict FROM one"""
)
def rule_verdict(spark, sf_dir):
    return ranking.verdict(deals(spark, sf_dir))


@registered(
    f"""WITH {DEALS} SELECT (SELECT count(*) FROM inside) AS stores_found, (SELECT count(*) FROM chains) AS domains_queried,
  (SELECT count(DISTINCT domain) FROM listings WHERE domain IN (SELECT domain FROM chains)) AS domains_succeeded,
  (SELECT count(*) FROM listings) AS listings_seen, (SELECT count(*) FROM ok) AS listings_matched,
  (SELECT count(*) FROM deals) AS deals_found, (SELECT min(price) FROM deals) AS cheapest_sticker, (SELECT min(total) FROM deals) AS cheapest_total"""
)
def search_summary(spark, sf_dir):
    inside, found = near(spark, sf_dir), staged(matched(spark, sf_dir), "matched")
    by_domain = found.groupBy("domain").agg(
        F.count("*").alias("seen"),
        F.count_if(~F.col("rejected") & (F.col("confidence") >= V.MIN_CONFIDENCE)).alias("matched"),
    )
    chains = stores.chains(inside).select(F.col("domain").alias("chain"))
    counts = by_domain.join(chains, F.col("domain") == F.col("chain"), "full").agg(
        F.count("chain").alias("domains_queried"),
        F.count_if(F.col("domain").isNotNull() & F.col("chain").isNotNull()).alias("domains_succeeded"),
        F.sum("seen").alias("listings_seen"),
        F.sum("matched").alias("listings_matched"),
    )
    ranked = deals(spark, sf_dir, found=found).agg(
        F.count("*").alias("deals_found"), F.min("price").alias("cheapest_sticker"), F.min("total").alias("cheapest_total")
    )
    return inside.agg(F.count("*").alias("stores_found")).join(counts).join(ranked)


@registered(f"WITH {DEALS}, t AS (SELECT * FROM deals WHERE rank < 6) SELECT a.rank AS rank, b.rank AS other, b.total - a.total AS gap FROM t a JOIN t b ON a.rank < b.rank")
def top6_pair_gaps(spark, sf_dir):
    top = deals(spark, sf_dir).where("rank < 6").select("rank", "total")
    other = top.select(F.col("rank").alias("other"), F.col("total").alias("t2"))
    return top.join(F.broadcast(other), F.col("rank") < F.col("other")).select("rank", "other", (F.col("t2") - F.col("total")).alias("gap"))
