"""Queries on what a search ends with: its time, its notices, what is remembered, what a request says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, notices, query, web
from ..functions import values as V
from ..functions.text import quoted
from ..operators import budgets, coverage, discovery, stores
from ..sources import bindings as B
from .search import CHAINS, MATCHED_SIZED, ORACLES, QUERIES, chain_order, matched, registered  # noqa: F401
from .web import fetch_classify, pick, pick_sql

#: First 32 bits of IPv6 networks and of some neighbours, which addresses are taken around.
V6_HEADS = (0, 0x64FF9B, 0x1000000, 0x20010000, 0x20010DB8, 0x20020000, 0x2002FFFF, 0xFC000000, 0xFE000000, 0xFE800000, 0xFEC00000, 0xFF000000, 0x2A001450)


@registered(
    f"""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey * 2654435761) % 4294967296
    ELSE greatest({list(V6_HEADS)}[o_orderkey % {len(V6_HEADS)} + 1]::BIGINT + (o_orderkey // 52) % 3 - 1, 0) END AS h FROM orders),
g AS (SELECT *, k // 156 % 3 AS g2, k // 468 % 2 AS g5 FROM a)
SELECT k AS o_orderkey, CASE k % 3 WHEN 0 THEN printf('%x:%x:%x:0:0:%x:%x:%x', h // 65536, h % 65536, g2, g5, k % 65536, k % 9 + 1)
    WHEN 1 THEN printf('%x:%x:%x::%x:%x:%x', h // 65536, h % 65536, g2, g5, k % 65536, k % 9 + 1)
    ELSE printf('[%X:%04X:%X::%X:%X:%X]', h // 65536, h % 65536, g2, g5, k % 65536, k % 9 + 1) END AS ip,
  (h = 0 AND g2 = 0 AND g5 = 0) OR (h = 6619035 AND (g2 = 1 OR g2 = 0 AND g5 = 0)) OR (h = 16777216 AND g2 = 0) OR h IN (536936448, 536939960)
    OR h // 65536 = 8194 OR h // 33554432 = 126 OR h // 4194304 = 1018 OR h // 16777216 = 255 AS reserved FROM g"""
)
def ip_reserved(spark, sf_dir):
    """IPv6 addresses all over the space and at the edges of the reserved networks, in full, shortened and in brackets."""
    k = F.col("o_orderkey")
    around = F.greatest(F.get(F.array(*(F.lit(h).cast("long") for h in V6_HEADS)), (k % len(V6_HEADS)).cast("int")) + F.floor(k / 52) % 3 - 1, F.lit(0))
    h = F.when(k % 4 == 0, (k * F.lit(2654435761)) % F.lit(4294967296)).otherwise(around)
    groups = [F.floor(h / 65536), h % 65536, F.floor(k / 156) % 3, F.floor(k / 468) % 2, k % 65536, k % 9 + 1]
    short = lambda form: F.format_string(form, *groups)
    ip = F.when(k % 3 == 0, short("%x:%x:%x:0:0:%x:%x:%x")).when(k % 3 == 1, short("%x:%x:%x::%x:%x:%x")).otherwise(short("[%X:%04X:%X::%X:%X:%X]"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", ip.alias("ip"), web.reserved_ip(ip).alias("reserved"))


_LEADS = ["Apple", "Samsung", "lenovo", "XIAOMI", "Bosch"]
_RAMS, _STORAGES = (4, 8, 12, 16), (64, 128, 256, 512)


@registered(
    f"""WITH r AS (SELECT p_partkey, p_partkey % 6 AS kind, replace(p_name, 'new ', '') AS name, lower({pick_sql("(p_partkey // 6)", _LEADS)}) AS lead,
  {list(_RAMS)}[p_size % 4 + 1] AS r, {list(_STORAGES)}[p_size // 4 % 4 + 1] AS s, (p_size % 3 + 1) * 1024 AS t FROM part)
SELECT p_partkey, CASE kind WHEN 0 THEN lead || ' ' || name WHEN 1 THEN lead || ' smartphone ' || name WHEN 2 THEN 'чехол ' || name
    WHEN 3 THEN 'ноутбук ' || name WHEN 4 THEN 'rtx 4070 ' || name ELSE lead || ' ' || name END AS search_term,
  CASE WHEN kind IN (0, 1, 5) THEN lead END AS brand, CASE kind WHEN 4 THEN r WHEN 5 THEN t ELSE s END::INT AS storage, CASE WHEN kind IN (1, 3) THEN r END::INT AS ram,
  CASE kind WHEN 1 THEN 'smartphone' WHEN 2 THEN 'other' WHEN 3 THEN 'laptop' WHEN 4 THEN 'component' END AS category, search_term AS tokens,
  CASE WHEN kind = 2 THEN 'case' END AS accessory FROM r"""
)
def parse_requests(spark, sf_dir):
    """Requests for each part in six manners: with a brand, as a phone, a case, a laptop, a component, with terabytes."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    lead, r, s = pick(F.floor(k / 6), _LEADS), of(_RAMS, size), of(_STORAGES, F.floor(size / 4))
    asked = [
        ("  Купить %s %s %dGB ", lead, name, s), ("%s smartphone %s %d/%d", lead, name, r, s), ("чехол для %s %d гб", name, s),
        ("ноутбук %s %dGB RAM %dGB SSD", name, r, s), ("RTX 4070 %s %d GB", name, r), ("%s %s %dTB", lead, name, size % 3 + 1),
    ]
    raw = F.get(F.array(*(F.format_string(form, *parts) for form, *parts in asked)), (k % 6).cast("int"))
    rows = B.table(spark, sf_dir, "part").select("p_partkey", query.parsed(raw).alias("r"))
    fields = ("search_term", "brand", "storage", "ram", "category", "accessory")
    return rows.select("p_partkey", F.concat_ws(" ", "r.tokens").alias("tokens"), *(F.col(f"r.{n}") for n in fields))


FAILURES = [None, "blocked", None, "no-listings"]


@registered(
    f"""WITH a AS (SELECT o_orderkey, o_orderkey // 8 AS search_id, 'shop' || (o_orderkey % 8) || '.example' AS domain, o_orderkey % 3 = 0 AS known,
  (o_orderkey // 8 % 5) * 12000 + (o_orderkey % 8) * 500 AS queued_ms, CASE WHEN o_orderkey % 29 <> 0 THEN (o_orderkey * 7919) % 40000 END AS took,
  CASE WHEN {pick_sql("o_orderkey", FAILURES)} IS NULL THEN o_orderkey % 9 ELSE 0 END AS n, {pick_sql("o_orderkey", FAILURES)} AS why FROM orders),
b AS (SELECT *, CASE WHEN known THEN {budgets.KNOWN_MS} ELSE {budgets.UNKNOWN_MS} END AS own FROM a),
c AS (SELECT *, took IS NULL OR took > own AS late FROM b),
d AS (SELECT *, queued_ms + CASE WHEN late THEN own ELSE took END <= {budgets.SEARCH_MS} AS in_time FROM c)
SELECT search_id, domain, in_time, NOT EXISTS (SELECT 1 FROM d AS o WHERE o.search_id = d.search_id AND o.in_time) AS search_failed,
  CASE WHEN late OR NOT in_time THEN 0 ELSE n END AS found, CASE WHEN late OR NOT in_time THEN 'timeout' ELSE why END AS failure,
  CASE WHEN NOT in_time THEN {budgets.SEARCH_MS} WHEN late THEN own ELSE took END AS took_ms FROM d"""
)
def partial_results(spark, sf_dir):
    k = F.col("o_orderkey")
    why = pick(k, FAILURES)
    attempts = B.table(spark, sf_dir, "orders").select(
        F.floor(k / 8).alias("search_id"), F.concat(F.lit("shop"), (k % 8).cast("string"), F.lit(".example")).alias("domain"), (k % 3 == 0).alias("known"),
        (F.floor(k / 8) % 5 * 12000 + k % 8 * 500).alias("queued_ms"), F.when(k % 29 != 0, k * 7919 % 40000).alias("took_ms"),
        F.when(why.isNull(), k % 9).otherwise(0).alias("found"), why.alias("failure"),
    )
    ended = budgets.partial_results(attempts)
    return ended.select("search_id", "domain", "in_time", "search_failed", "found", "failure", "took_ms")


_AGE = f"(o_orderkey * 104729) % {40 * budgets.DAY_MS}"


@registered(
    f"""SELECT o_orderkey, {_AGE} <= CASE WHEN o_orderkey % 4 = 0 THEN {budgets.NONE_MS} ELSE {budgets.FOUND_MS} END AS fresh FROM orders"""
)
def template_freshness(spark, sf_dir):
    k = F.col("o_orderkey")
    template = F.when(k % 4 != 0, F.concat(F.lit("https://shop.example/s?q={q}&n="), k.cast("string")))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", budgets.template_fresh(template, k * 104729 % (40 * budgets.DAY_MS)).alias("fresh"))


_MINUTES = "(o_orderkey * 7919) % 600"


@registered(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 7 = 0 THEN CASE WHEN {_MINUTES} <= 30 THEN 'skip' ELSE 'ask' END
  WHEN {_MINUTES} <= 360 THEN 'use' ELSE 'ask' END AS action FROM orders"""
)
def template_memory(spark, sf_dir):
    k = F.col("o_orderkey")
    template = F.when(k % 4 != 0, F.concat(F.lit("https://shop.example/s?q={q}&n="), k.cast("string")))
    blocked = F.when(k % 3 != 0, k % 7 == 0).when(k % 7 == 0, True)
    return B.table(spark, sf_dir, "orders").select("o_orderkey", budgets.template_in_memory(template, blocked, k * 7919 % 600 * 60_000).alias("action"))


_STAYS = f"e.size <= {budgets.MOST_BYTES} - w.held AND w.n < {budgets.MOST_FILES}"


@registered(
    f"""WITH RECURSIVE f AS (SELECT o_orderkey % 5 AS directory, o_orderkey AS path, ((o_orderkey * 7919) % 1000) * 100000000 // 11 AS age_ms,
  CASE WHEN o_orderkey % 5 < 2 THEN (o_orderkey * 31) % 60000 ELSE (o_orderkey * 7907) % 2900000 END AS size FROM orders),
e AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY age_ms, path) AS k FROM f WHERE age_ms <= {budgets.FILE_AGE_MS}),
w AS (SELECT directory, path, k, true AS kept, 1 AS n, size AS held FROM e WHERE k = 1
  UNION ALL SELECT e.directory, e.path, e.k, {_STAYS}, w.n + ({_STAYS})::INT, CASE WHEN {_STAYS} THEN w.held + e.size ELSE w.held END
  FROM w JOIN e ON e.directory = w.directory AND e.k = w.k + 1)
SELECT directory, path, kept FROM w UNION ALL SELECT directory, path, false FROM f WHERE age_ms > {budgets.FILE_AGE_MS}"""
)
def cache_prune(spark, sf_dir):
    k = F.col("o_orderkey")
    files = B.table(spark, sf_dir, "orders").select(
        (k % 5).alias("directory"), k.alias("path"), F.floor(k * 7919 % 1000 * 100000000 / 11).alias("age_ms"),
        F.when(k % 5 < 2, k * 31 % 60000).otherwise(k * 7907 % 2900000).alias("size"),
    )
    return budgets.pruned(files)


@registered(
    """WITH d AS (SELECT o_orderkey, (o_orderkey * 13) % 900 + 100 AS price, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey * 17) % 1000 + 100 END AS old,
  (o_orderkey % 64) / 64.0::DOUBLE AS c FROM orders)
SELECT o_orderkey, CASE WHEN old > price THEN '−' || floor((1 - price::DOUBLE / old) * 100 + 0.5)::BIGINT || '%' END AS discount,
  CASE WHEN c < 0.6 THEN 'Low match confidence (' || floor(c * 100 + 0.5)::BIGINT || '%) — this may be a different variant.' END AS hint FROM d"""
)
def deal_notices(spark, sf_dir):
    k = F.col("o_orderkey")
    old = F.when(k % 6 > 0, k * 17 % 1000 + 100)
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", notices.discount_badge(k * 13 % 900 + 100, old).alias("discount"), notices.low_confidence_hint(k % 64 / 64).alias("hint")
    )


@registered(
    f"""WITH s AS (SELECT o_orderkey, o_orderkey % 7 AS d, o_orderkey % 11 AS n, o_orderkey % 13 AS shops, o_orderkey % 5 AS m, (o_orderkey * 37) % 4000 * 2 + 1 AS ms,
  CASE WHEN o_orderkey % 3 = 0 THEN 'No shop' END AS verdict, CASE WHEN o_orderkey % 4 > 0 THEN 'red widget' END AS asked FROM orders),
t AS (SELECT *, CASE d WHEN 1 THEN '' ELSE 's' END AS ds, CASE n WHEN 1 THEN '' ELSE 's' END AS ns, CASE shops WHEN 1 THEN '' ELSE 's' END AS ss FROM s)
SELECT o_orderkey, coalesce(verdict, 'Checked ' || d || ' retailer site' || ds || ' near you and read ' || n || ' listing' || ns || {quoted(', but none matched "')} || coalesce(asked, '') || '".') AS empty,
  'Searched ' || shops || ' mapped shop' || ss || ' across ' || d || ' retailer site' || ds || ' in ' || CASE WHEN ms < 1000 THEN ms || ' ms' ELSE printf('%.1fs', ms / 1000.0::DOUBLE) END
    || '. Read ' || n || ' listing' || ns || ', ' || m || ' matched after filtering out accessories and other models.' AS coverage FROM t"""
)
def search_notices(spark, sf_dir):
    k = F.col("o_orderkey")
    verdict, asked = F.when(k % 3 == 0, "No shop"), F.when(k % 4 > 0, "red widget")
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", notices.empty_text(verdict, k % 7, k % 11, asked).alias("empty"),
        notices.coverage_text(k % 13, k % 7, k * 37 % 4000 * 2 + 1, k % 11, k % 5).alias("coverage"),
    )


_CITIES = ", ".join(f"('{c}', {lat}::DOUBLE, {lon}::DOUBLE)" for c, lat, lon in V.CITIES)


_CITY_M = geo.haversine_sql("c.lat", "c.lon", "s.lat", "s.lon")


@registered(
    f"""WITH {B.STORES}, c AS (SELECT * FROM (VALUES {_CITIES}) AS v(city, lat, lon)),
d AS (SELECT city, round({_CITY_M})::BIGINT AS m FROM c, stores s)
SELECT city, c.lat, c.lon, radius_m, (SELECT count(*) FROM d WHERE d.city = c.city AND d.m <= radius_m) AS stores
FROM c, (SELECT unnest({V.RADIUS_STOPS}) AS radius_m)"""
)
def search_choices(spark, sf_dir):
    """Where a search may start and how far it may go, with the stores that each choice reaches: a range join on cells, then
    partial sums of a row for each city and radius."""
    cities = spark.createDataFrame(V.CITIES, "city string, lat double, lon double")
    asking = cities.select(F.col("city").alias("shopper"), "lat", "lon", F.lit(max(V.RADIUS_STOPS)).alias("radius_m"))
    met = stores.within_reach(asking, B.stores(spark, sf_dir).select("id", "lat", "lon"))
    reached = met.groupBy("shopper").agg(*(F.count_if(F.col("distance_m") <= r).alias(f"r{r}") for r in V.RADIUS_STOPS))
    counts = F.array(*(F.struct(F.lit(r).alias("radius_m"), F.coalesce(f"r{r}", F.lit(0)).alias("stores")) for r in V.RADIUS_STOPS))
    joined = cities.join(reached, F.col("city") == F.col("shopper"), "left")
    return joined.select("city", "lat", "lon", F.inline(counts))


#: Retailers that something is known of: domain, label, template, blocked, drawn by the client, note.
ADAPTERS = [
    ("shop1.example", "Retailer 1", "/search?q={q}", False, False, None), ("shop5.example", "Retailer 5", "/?s={q}", False, False, None),
    ("shop7.example", "Retailer 7", "/search/?query={q}", False, False, None), ("shop2.example", "Retailer 2", None, True, False, "Blocks automated requests (HTTP 403)."),
    ("shop4.example", "Retailer 4", None, True, False, None), ("shop8.example", "Retailer 8", None, False, True, "Search results are rendered by JavaScript."),
    ("shop10.example", "Retailer 10", None, False, True, None),
]


def adapters(spark) -> DataFrame:
    return spark.createDataFrame(ADAPTERS, "domain string, label string, template string, blocked boolean, client_rendered boolean, note string")


def last_fetches(spark, sf_dir) -> DataFrame:
    """(domain, failure): how the last fetch from each of the mapped shops ended."""
    rows = fetch_classify(spark, sf_dir).withColumn("domain", F.concat(F.lit("shop"), (F.col("o_orderkey") % 12).cast("string"), F.lit(".example")))
    return rows.groupBy("domain").agg(F.max_by(F.struct("failure"), "o_orderkey").alias("x")).select("domain", "x.failure")


_KNOWN_SQL = ", ".join("(" + ", ".join("NULL" if x is None else quoted(x) if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in ADAPTERS)
_GAP_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.GAP_REASONS.items())


@registered(
    f"""WITH {CHAINS}, adapters(domain, label, template, blocked, client_rendered, note) AS (VALUES {_KNOWN_SQL}),
fetched AS (SELECT 'shop' || (o_orderkey % 12) || '.example' AS domain, failure FROM ({ORACLES["fetch_classify"]})
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY o_orderkey DESC) = 1),
state AS (SELECT coalesce(a.label, s.domain) AS label, a.note, CASE WHEN a.blocked THEN 'blocked' WHEN a.client_rendered THEN 'js-rendered'
  WHEN f.domain IS NULL THEN 'unreachable' ELSE f.failure END AS failure FROM selected s LEFT JOIN adapters a USING (domain) LEFT JOIN fetched f USING (domain)),
s AS (SELECT coalesce(a.label, o.domain) AS label, row_number() OVER (ORDER BY place) AS n, count(*) OVER () AS total
  FROM ordered o LEFT JOIN adapters a USING (domain) WHERE o.domain NOT IN (SELECT domain FROM selected))
SELECT label, coalesce(note, CASE failure {_GAP_SQL} END) AS reason FROM state WHERE failure IN {tuple(V.GAP_REASONS)}
UNION ALL SELECT label, '{V.SKIPPED_REASON}' FROM s WHERE n <= {V.MAX_GAPS}
UNION ALL SELECT (total - {V.MAX_GAPS}) || ' more mapped retailers', '{V.MORE_REASON}' FROM s WHERE n = {V.MAX_GAPS} + 1"""
)
def coverage_gaps(spark, sf_dir):
    """Retailers near a shopper that the search doesn't cover: by what is known of them and by their last fetch."""
    order = chain_order(spark, sf_dir)
    chosen = stores.selected(order)
    skipped = order.join(chosen.select("domain"), "domain", "left_anti").join(F.broadcast(adapters(spark).select("domain", "label")), "domain", "left")
    attempted = coverage.states(chosen, adapters(spark), last_fetches(spark, sf_dir))
    return coverage.gaps(attempted, skipped.withColumn("label", F.coalesce("label", "domain")))


@registered(
    f"""WITH {MATCHED_SIZED}, r AS (SELECT domain, pos, substr(title, 1, {coverage.TITLE_CHARS}) AS title, price, confidence, rejected, reject_reason FROM matched),
p AS (SELECT *, (row_number() OVER (PARTITION BY domain, rejected ORDER BY pos))::INT AS place FROM r),
c AS (SELECT domain, reject_reason, count(*) AS n FROM r WHERE rejected GROUP BY ALL)
SELECT domain, CASE WHEN rejected THEN 'sample' ELSE 'kept' END AS kind, place, title, price, round(confidence, 6) AS confidence, reject_reason AS reason, 1::BIGINT AS n
FROM p WHERE place <= CASE WHEN rejected THEN {coverage.MOST_SAMPLES} ELSE {coverage.MOST_KEPT} END
UNION ALL SELECT domain, 'rejected', (row_number() OVER (PARTITION BY domain ORDER BY n DESC, reject_reason))::INT, NULL, NULL, NULL, reject_reason, n FROM c"""
)
def match_report(spark, sf_dir):
    """What a request keeps and rejects of each retailer's listings."""
    return coverage.match_report(matched(spark, sf_dir, True)).withColumn("confidence", F.round("confidence", 6))


_COMMON = len(discovery.COMMON_TEMPLATES)
#: How a candidate answers, by a number from 0 to 22 that follows from its shop and place.
_ANSWER = "(k * 31 + g * 17 + k // 7 * g) % 23"
_LAST_COMMON = _COMMON // discovery.AT_A_TIME


@registered(
    f"""WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 5 THEN 'blocked' WHEN p_partkey % 13 = 4 THEN 'unreachable' END AS home FROM part),
c AS (SELECT k, g, {_ANSWER} AS h, CASE WHEN g < {_COMMON} THEN {list(discovery.COMMON_TEMPLATES)}[g + 1] ELSE '/find/' || (g - {_COMMON}) || '?text={{q}}' END AS template
  FROM p, (SELECT unnest(range({_COMMON + discovery.MOST_DECLARED})) AS g) WHERE g < {_COMMON} OR g - {_COMMON} < k % 6),
b AS (SELECT k, CASE WHEN g < {_COMMON} THEN g // 2 ELSE {_LAST_COMMON} + 1 + (g - {_COMMON}) // 2 END AS step, bool_or(h = 0) AS refused,
  count(*) FILTER (h BETWEEN 1 AND 4) AS dead, arg_min(template, g) FILTER (h = 6) AS hit, bool_or(h = 5) AS drawn, count(*) AS n FROM c GROUP BY ALL),
w AS (SELECT k, home, 0::BIGINT AS step, 0::BIGINT AS dead, 0::BIGINT AS tried, false AS drawn, NULL::VARCHAR AS outcome, NULL::VARCHAR AS template FROM p
  UNION ALL SELECT w.k, home, w.step + 1, w.dead + CASE WHEN go THEN b.dead ELSE 0 END, w.tried + CASE WHEN go THEN b.n ELSE 0 END, w.drawn OR (go AND b.drawn),
    CASE WHEN w.step = {_LAST_COMMON} THEN CASE WHEN home = 'blocked' THEN 'blocked' END WHEN go AND b.refused THEN 'blocked' WHEN go AND b.hit IS NOT NULL THEN 'found' END,
    CASE WHEN go AND NOT b.refused THEN b.hit END
  FROM (SELECT w.*, coalesce(w.dead < 2 AND b.k IS NOT NULL AND (w.step < {_LAST_COMMON} OR home IS NULL), false) AS go, b
    FROM w LEFT JOIN b ON b.k = w.k AND b.step = w.step WHERE w.step < {_LAST_COMMON} + 3 AND w.outcome IS NULL) w)
SELECT 'shop' || k || '.example' AS domain, coalesce(outcome, CASE WHEN drawn THEN 'js-rendered' ELSE 'no-search-endpoint' END) AS outcome, template, tried
FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY step DESC) = 1"""
)
def search_endpoints(spark, sf_dir):
    """A shop for each part, whose home page declares a common template and up to five of its own."""
    k = F.col("p_partkey")
    own = F.transform(F.slice(F.sequence(F.lit(0), F.lit(5)), F.lit(1), (k % 6).cast("int")), lambda j: F.format_string('<form action="/find/%d"><input name="text"></form>', j))
    html = F.concat(F.lit('<form action="/search"><input name="q"></form>'), F.array_join(own, ""))
    homes = B.spread(B.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        F.concat(F.lit("shop"), k.cast("string"), F.lit(".example")).alias("domain"), F.when(k % 11 == 5, "blocked").when(k % 13 == 4, "unreachable").alias("failure"), html.alias("html")
    )
    n, g = F.regexp_extract("domain", r"(\d+)", 1).cast("long"), F.col("place").cast("long")
    h = (n * 31 + g * 17 + F.floor(n / 7) * g) % 23
    failure = F.when(h == 0, "blocked").when(h.between(1, 3), "timeout").when(h == 4, "unreachable")
    probes = discovery.candidates(homes).select("domain", "place", "template", failure.alias("failure"), (h == 6).alias("accepted"), (h == 5).alias("client_rendered"))
    return discovery.endpoints(probes, homes)
