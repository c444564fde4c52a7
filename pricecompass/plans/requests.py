"""Queries with tables of requests and of shoppers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions import values as V
from ..operators import requests, stores
from ..sources import bindings as B
from .search import ORACLES, QUERIES, registered  # noqa: F401

#: A request of each part: its name, with its brand, with a size, or for another size.
_ASKS = """CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || p_name WHEN 2 THEN p_name || ' 128GB' ELSE upper(p_name) || '  ' || p_brand || ' 256 гб' END"""
_TITLES = "p_brand || ' ' || p_name || CASE p_size % 5 WHEN 0 THEN ' 128GB' WHEN 1 THEN ' 256GB' WHEN 2 THEN ' case' WHEN 3 THEN ' used' ELSE '' END"


def asked(spark, sf_dir):
    k = F.col("p_partkey") % 4
    one = (
        F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_brand", F.lit(" "), "p_name")).when(k == 2, F.concat("p_name", F.lit(" 128GB")))
        .otherwise(F.concat(F.upper("p_name"), F.lit("  "), "p_brand", F.lit(" 256 гб")))
    )
    return B.table(spark, sf_dir, "part").select(one.alias("request"))


def offered(spark, sf_dir):
    k = F.col("p_size") % 5
    kind = F.when(k == 0, " 128GB").when(k == 1, " 256GB").when(k == 2, " case").when(k == 3, " used").otherwise("")
    return B.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" "), "p_name", kind).alias("title"))


_TOKENS = text.tokenize_sql("replace(replace(request, '128GB', ''), '256 гб', '')")
_WORTH = """CASE WHEN len(list_filter(forms, lambda f: list_contains(signs, f))) > 0 THEN 1.0::DOUBLE
  WHEN len(list_filter(tokens, lambda x: (starts_with(x, t) OR starts_with(t, x)) AND least(length(x), length(t)) >= 4)) > 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END"""


@registered(
    f"""WITH r0 AS (SELECT DISTINCT {_ASKS} AS request FROM part),
r AS (SELECT request, {_TOKENS} AS asked, CASE WHEN request LIKE '%128GB' THEN 128 WHEN request LIKE '%256 гб' THEN 256 END AS wanted FROM r0),
e AS (SELECT request, i, asked[i] AS t, [asked[i]] || CASE WHEN i > 1 THEN [asked[i - 1] || asked[i]] ELSE [] END || CASE WHEN i < len(asked) THEN [asked[i] || asked[i + 1]] ELSE [] END AS forms,
  [asked[i]] || CASE WHEN i > 1 THEN [asked[i - 1] || asked[i]] ELSE [] END AS model FROM r, unnest(range(1, len(asked) + 1)) AS u(i)),
t0 AS (SELECT DISTINCT {_TITLES} AS title FROM part), t1 AS (SELECT title, {text.tokenize_sql("title")} AS tokens FROM t0),
t AS (SELECT title, tokens, {text.signatures_sql("tokens")} AS signs, CASE WHEN title LIKE '%128GB' THEN 128 WHEN title LIKE '%256GB' THEN 256 END AS storage FROM t1
  WHERE title NOT LIKE '% case' AND title NOT LIKE '% used'),
w AS (SELECT request, title, avg({_WORTH}) AS cover, bool_or(regexp_matches(t, '[0-9]') AND len(list_filter(model, lambda f: list_contains(signs, f))) = 0) AS lacks FROM e, t GROUP BY ALL),
c AS (SELECT w.request, w.title, 0.5::DOUBLE + 0.4::DOUBLE * w.cover AS c0, r.wanted, t.storage FROM w JOIN r USING (request) JOIN t USING (title)
  WHERE NOT lacks AND cover >= 0.66::DOUBLE AND (wanted IS NULL OR storage IS NULL OR wanted = storage))
SELECT request, title, round(CASE WHEN wanted IS NULL THEN c0 WHEN storage IS NULL THEN c0 - 0.1::DOUBLE ELSE least(1.0::DOUBLE, c0 + 0.1::DOUBLE) END, 6) AS confidence FROM c"""
)
def request_matches(spark, sf_dir):
    """All requests of a table against all titles at once."""
    fits = requests.judged(asked(spark, sf_dir), offered(spark, sf_dir)).where(F.col("reason").isNull() & (F.col("confidence") >= V.MIN_CONFIDENCE))
    return fits.select("request", "title", F.round("confidence", 6).alias("confidence"))


@registered(
    f"""WITH {B.STORES} SELECT id, 'https://www.openstreetmap.org/?mlat=' || lat || '&mlon=' || lon || '#map=18/' || lat || '/' || lon AS map_url FROM stores"""
)
def store_maps(spark, sf_dir):
    return B.stores(spark, sf_dir).select("id", geo.map_url(F.col("lat"), F.col("lon")).alias("map_url"))


_SPOT = "(({0} * 37) % 3401) / 20.0::DOUBLE - 85.0::DOUBLE AS {1}lat, (({0} * 91) % 7201) / 20.0::DOUBLE - 180.0::DOUBLE AS {1}lon"


def _spot(k):
    return ((k * 37) % 3401) / F.lit(20.0) - 85.0, ((k * 91) % 7201) / F.lit(20.0) - 180.0


def _turned(lon):
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


_REACH = f"""WITH s AS (SELECT s_suppkey, {_SPOT.format("(s_suppkey % 200)", "")} FROM supplier),
b AS (SELECT c_custkey, {V.RADIUS_STOPS}[c_custkey % {len(V.RADIUS_STOPS)} + 1] AS radius_m, {_SPOT.format("(c_custkey % 200)", "b")} FROM customer),
c AS (SELECT c_custkey, radius_m, blat + ((c_custkey * 13) % 201 - 100) * 0.001::DOUBLE AS clat, blon + ((c_custkey * 29) % 201 - 100) * 0.002::DOUBLE AS l FROM b),
d AS (SELECT c_custkey, radius_m, clat, CASE WHEN l > 180 THEN l - 360 WHEN l < -180 THEN l + 360 ELSE l END AS clon FROM c)
SELECT c_custkey AS shopper, s_suppkey, round({geo.haversine_sql("clat", "clon", "lat", "lon")})::BIGINT AS distance_m FROM d, s WHERE distance_m <= radius_m"""


@registered(_REACH)
def shoppers_reach(spark, sf_dir):
    """All customers, each with a radius of their own, against all suppliers, spread over the earth."""
    asking, standing = spread(spark, sf_dir)
    return stores.within_reach(asking, standing).select("shopper", "s_suppkey", "distance_m")


@registered(_REACH)
def cells_reach(spark, sf_dir):
    """The same from answers that customers of one cell share."""
    asking, standing = spread(spark, sf_dir)
    return stores.within_cells(asking, standing).select("shopper", "s_suppkey", "distance_m")


def spread(spark, sf_dir):
    """Customers who ask and suppliers who stand, all over the earth."""
    k = F.col("s_suppkey")
    lat, lon = _spot(k % 200)
    standing = B.table(spark, sf_dir, "supplier").select("s_suppkey", lat.alias("lat"), lon.alias("lon"))
    k = F.col("c_custkey")
    lat, lon = _spot(k % 200)
    radius = F.get(F.array(*map(F.lit, V.RADIUS_STOPS)), (k % len(V.RADIUS_STOPS)).cast("int"))
    asking = B.table(spark, sf_dir, "customer").select(
        k.alias("shopper"), (lat + ((k * 13) % 201 - 100) * F.lit(0.001)).alias("lat"), _turned(lon + ((k * 29) % 201 - 100) * F.lit(0.002)).alias("lon"), radius.alias("radius_m")
    )
    return asking, standing
