"""Queries on addresses, requests, fetches, prices and event state, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, web
from ..functions import values as V
from ..functions.text import quoted
from ..operators import events, ranking
from ..sources import bindings as B
from .search import DEALS, ORACLES, QUERIES, deals, registered  # noqa: F401


def pick(key: Column, choices: list[str | None]) -> Column:
    return F.get(F.array(*(F.lit(c).cast("string") for c in choices)), (key % len(choices)).cast("int"))


def pick_sql(key: str, choices: list[str | None]) -> str:
    return f"[{', '.join('NULL' if c is None else quoted(c) for c in choices)}][({key} % {len(choices)} + 1)::INT]"


@registered(
    """WITH n AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS n, printf('%.2f', o_totalprice) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(d::DOUBLE + 0.5)::BIGINT WHEN 2 THEN n + 1 ELSE n END AS price FROM n"""
)
def parse_price(spark, sf_dir):
    n = F.round("o_totalprice").cast("long")
    raw = (
        F.when(F.col("o_orderkey") % 4 == 0, F.format_string("%.2f", "o_totalprice"))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.translate(F.format_number(n, 0), ",", "\u00a0"), F.lit("&nbsp;₸")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(n.cast("string"), F.lit(",50")))
        .otherwise(F.format_number(n, 0))
    )
    return B.table(spark, sf_dir, "orders").select("o_orderkey", web.parse_price(raw).alias("price"))


#: What a listing may say of its stock, and what that means.
STOCK_PHRASES: dict[str, bool | None] = {
    "https://schema.org/InStock": True, "https://schema.org/OutOfStock": False, "нет в наличии": False, "Есть в наличии": True, "data-available='false'": False,
    "available: true": True, "unavailable": False, "now available": True, "soon": None, "не в наличии": False, "SoldOut": False, "LimitedAvailability": True,
    "ask in the shop": None,
}
_STATES = f"[{', '.join('NULL' if s is None else str(s).lower() for s in STOCK_PHRASES.values())}]"


@registered(
    f"""WITH p AS (SELECT o_orderkey, {_STATES}[o_orderkey % {len(STOCK_PHRASES)} + 1] AS a, {_STATES}[o_orderkey // {len(STOCK_PHRASES)} % {len(STOCK_PHRASES)} + 1] AS b FROM orders)
SELECT o_orderkey, CASE WHEN a IS FALSE OR b IS FALSE THEN false WHEN a OR b THEN true END AS in_stock FROM p"""
)
def availability(spark, sf_dir):
    """Texts with two phrases around an order's priority: a denial outweighs a statement."""
    k, phrases = F.col("o_orderkey"), list(STOCK_PHRASES)
    raw = F.concat_ws(" | ", pick(k, phrases), F.lower("o_orderpriority"), pick(F.floor(k / len(phrases)), phrases))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", web.availability(raw).alias("in_stock"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


@registered(
    rf"""SELECT page_id, kind, CASE WHEN kind < 4 THEN regexp_replace(lower({_HOST}), '^www\.', '') END AS domain
FROM pages, (SELECT unnest(range(7)) AS kind)"""
)
def url_normalise(spark, sf_dir):
    """Website tags in seven spellings of each page's address, the last three of them no website."""
    url, host = F.col("url"), _host(F.col("url"))
    spelt = [
        url, F.concat(F.lit("  "), host, F.lit(" ")), F.concat(F.lit("HTTPS://WWW."), F.upper(F.regexp_replace(host, r"^www\.", "")), F.lit("/X?y=1")),
        F.concat(host, F.lit(":8080/a")), F.concat(F.lit("ftp://"), host), F.concat(F.lit("http://user@"), host, F.lit("/")),
        F.concat(F.lit("https://"), host, F.lit("/"), F.repeat(F.lit("x"), F.lit(4096))),
    ]
    each = B.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*spelt)).alias("kind", "raw"))
    return each.select("page_id", F.col("kind").cast("long").alias("kind"), web.normalised_domain(F.col("raw")).alias("domain"))


_NETS = " OR ".join(
    "n BETWEEN {0} AND {1}".format(low, low + (1 << (32 - int(bits))) - 1)
    for base, bits in (net.split("/") for net in V.RESERVED_V4)
    for low in [sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split(".")))]
)


_PUBLIC_KINDS = (0, 1, 2)


@registered(
    f"""WITH a AS (SELECT page_id, kind, (page_id * 2654435761 + 12345) % 4294967296 AS n FROM pages, (SELECT unnest(range(12)) AS kind))
SELECT page_id, kind, CASE WHEN kind >= 10 THEN NOT ({_NETS}) ELSE kind IN {_PUBLIC_KINDS} END AS public FROM a"""
)
def safe_url(spark, sf_dir):
    """Each page's address as it is and with its scheme's port, then in ways that may not be fetched, then under IPv4 hosts."""
    n = (F.col("page_id") * F.lit(2654435761) + 12345) % F.lit(4294967296)
    ip = F.concat_ws(".", *((F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)))
    host = _host(F.col("url"))
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    forms = [
        F.col("url"), at("http://", host, ":80/x"), at("HTTPS://", host, ":443"), at("https://", host, ":8443/x"), at("https://u:p@", host, "/"),
        at("ftp://", host, "/x"), at("http://", host, ".internal/x"), at("http://shop", F.col("page_id").cast("string"), "/"), at("http://localhost/?", host),
        at("https://", host, "/", F.repeat(F.lit("x"), F.lit(4096))), at("http://", ip, "/x"), at("https://", ip, ":443/"),
    ]
    each = B.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("kind", "raw"))
    return each.select("page_id", F.col("kind").cast("long").alias("kind"), web.public_url(F.col("raw")).alias("public"))


@registered(
    f"""WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders)
SELECT o_orderkey, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip, ({_NETS}) AS reserved FROM a"""
)
def ipv4_reserved(spark, sf_dir):
    n = (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)
    ip = F.concat_ws(".", *((F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", ip.alias("ip"), web.reserved_v4(ip).alias("reserved"))


_LATS, _LONS, _RADII = ["43.25", '"43"', "95", "-90", "null"], ["76.9", "181", "true", "-180"], ["2530", "100", "25001", "300", "949.5", '"500"', "25000"]
_ITEMS = ['"red widget"', '" x "', '"?!"', "7", f'"{"long " * 30}"', '"  PS5 "', '"айфон 15"']
_BODY = [("lat", 1, _LATS), ("lon", 5, _LONS), ("radiusM", 20, _RADII), ("item", 140, _ITEMS)]
_BODY_SQL = " || ', ' || ".join(f"""'"{n}": ' || {pick_sql(f"(o_orderkey // {step})", c)}""" for n, step, c in _BODY)
_NUMBER = "CASE WHEN json_type(body, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (body->>'$.{0}')::DOUBLE END"


@registered(
    f"""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN '[1]' WHEN o_orderkey % 89 = 0 THEN '{{oops' ELSE '{{' || {_BODY_SQL} || '}}' END AS body FROM orders),
p AS (SELECT o_orderkey, json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '0' END) = 'OBJECT' AS is_object,
  CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS body FROM b),
v AS (SELECT *, {_NUMBER.format("lat")} AS la, {_NUMBER.format("lon")} AS lo, {_NUMBER.format("radiusM")} AS r,
  trim(CASE WHEN json_type(body, '$.item') = 'VARCHAR' THEN body->>'$.item' ELSE '' END) AS it FROM p),
e AS (SELECT *, CASE WHEN NOT is_object THEN 'Body must be a JSON object'
  WHEN NOT coalesce(la BETWEEN -90 AND 90, false) THEN {quoted(web.REQUEST_ERRORS[0])} WHEN NOT coalesce(lo BETWEEN -180 AND 180, false) THEN {quoted(web.REQUEST_ERRORS[1])}
  WHEN NOT coalesce(r BETWEEN 300 AND 25000, false) THEN {quoted(web.REQUEST_ERRORS[2])} WHEN length(it) < 2 THEN {quoted(web.REQUEST_ERRORS[3])}
  WHEN length(it) > 120 THEN {quoted(web.REQUEST_ERRORS[4])} WHEN NOT regexp_matches(it, '[\\p{{L}}\\p{{N}}]') THEN {quoted(web.REQUEST_ERRORS[5])} END AS error FROM v)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN la END AS lat, CASE WHEN error IS NULL THEN lo END AS lon,
  CASE WHEN error IS NULL THEN (round(r / 100) * 100)::BIGINT END AS radius_m, CASE WHEN error IS NULL THEN it END AS item FROM e"""
)
def validate_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    parts = [F.concat(F.lit(f'"{n}": '), pick(F.floor(k / step), c)) for n, step, c in _BODY]
    body = F.when(k % 97 == 0, "[1]").when(k % 89 == 0, "{oops").otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", web.validated(body).alias("v")).select("o_orderkey", "v.*")


_STATUS, _TYPES, _BODIES = ["200", "204", "301", "403", "404", "429", "500", "503", None], ["text/html; charset=utf-8", "application/json", "image/png", None], ["<p>shop</p>", "Just a moment...", ""]


@registered(
    f"""WITH f AS (SELECT o_orderkey, {pick_sql("o_orderkey", _STATUS)}::INT AS status, {pick_sql("(o_orderkey // 9)", _TYPES)} AS kind,
  {pick_sql("(o_orderkey // 36)", _BODIES)} AS body, (o_orderkey % 7) * 1500000 AS size FROM orders)
SELECT o_orderkey, CASE WHEN status IS NULL THEN 'unreachable' WHEN status IN (403, 429, 503) THEN 'blocked'
  WHEN NOT regexp_matches(coalesce(kind, ''), '(?i)text/html|application/xhtml|application/json') THEN 'no-listings' WHEN size > {web.PAGE_BYTES} THEN 'response-too-large'
  WHEN regexp_matches(substr(body, 1, 4000), '(?i){V.CHALLENGE}') THEN 'blocked' WHEN status NOT BETWEEN 200 AND 299 THEN 'unreachable' END AS failure FROM f"""
)
def fetch_classify(spark, sf_dir):
    k = F.col("o_orderkey")
    found = web.fetch_outcome(pick(k, _STATUS).cast("int"), pick(F.floor(k / 9), _TYPES), (k % 7) * 1500000, pick(F.floor(k / 36), _BODIES))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", found.alias("failure"))


@registered(
    """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 4 OR text IS NULL THEN NULL WHEN turn % 2 = 1 THEN text
  ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^ ', '')), chr(10)) END AS data FROM conversations"""
)
def sse_parse(spark, sf_dir):
    """Each turn of a conversation as a server-sent record with a data line a line, under all three line ends; one in five has no data."""
    k = F.col("conv_id") + F.col("turn")
    mark = F.when(F.col("turn") % 2 == 1, "data: ").otherwise("data:")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(mark, x))
    none = F.array().cast("array<string>")
    head = F.array(F.lit(": a comment"), F.concat(F.lit("event: "), "role"), F.concat(F.lit("id: "), F.col("turn").cast("string")), F.lit("database: 1"))
    kept = F.when(k % 5 == 4, none).otherwise(F.coalesce(lines, none))
    end = F.when(k % 3 == 0, "\n").when(k % 3 == 1, "\r\n").otherwise("\r")
    record = F.aggregate(F.concat(head, kept), F.lit(""), lambda acc, x: F.concat(acc, x, end))
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", web.sse_data(record).alias("data"))


HOUR_US = 3_600_000_000


def _windows_sql(hours: int) -> str:
    """Each event with the start of the window it is in, and its place there."""
    return f"""RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, us, k, us AS start, 0::BIGINT AS nth FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.user_id, e.us, e.k, CASE WHEN w.start + {hours * HOUR_US} <= e.us THEN e.us ELSE w.start END,
    CASE WHEN w.start + {hours * HOUR_US} <= e.us THEN 0 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)"""


@registered(
    f"""WITH {_windows_sql(72)} SELECT event_id, user_id, nth < 8 AS allowed, greatest(8 - nth - 1, 0)::BIGINT AS remaining,
  CASE WHEN nth < 8 THEN 0 ELSE greatest(ceil((start + {72 * HOUR_US} - us) / 1000000.0::DOUBLE), 1) END::BIGINT AS retry_s FROM w"""
)
def rate_limit_anchored(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return events.rate_limited(rows, "user_id", "ts", "event_id", 8, 72 * HOUR_US).select("event_id", "user_id", "allowed", "remaining", "retry_s")


@registered(f"WITH {_windows_sql(6)} SELECT event_id, user_id, nth > 0 AS hit FROM w")
def ttl_hits(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return events.cached(rows, "user_id", "ts", "event_id", 6 * HOUR_US).select("event_id", "user_id", "hit")


@registered(
    """SELECT 'shop' || (user_id % 12) || '.example' AS domain, arg_max(event_type, (ts, event_id)) AS state, arg_min(event_id, (ts, event_id)) AS first_event
FROM events GROUP BY 1"""
)
def progress_fold(spark, sf_dir):
    domain = F.concat(F.lit("shop"), (F.col("user_id") % 12).cast("string"), F.lit(".example"))
    rows = B.table(spark, sf_dir, "events").select(domain.alias("domain"), "ts", "event_id", F.col("event_type").alias("state"))
    return events.latest(rows, "domain", ["ts", "event_id"], ["state"]).select("domain", "state", F.col("first.event_id").alias("first_event"))


@registered(
    """WITH m AS (SELECT o_orderkey, round(o_orderkey * 61000 / 60000.0::DOUBLE)::BIGINT AS minutes FROM orders),
h AS (SELECT *, round(minutes / 60.0::DOUBLE)::BIGINT AS hours FROM m)
SELECT o_orderkey, CASE WHEN minutes < 60 THEN minutes || ' min' WHEN hours < 48 THEN hours || ' h' ELSE round(hours / 24.0::DOUBLE)::BIGINT || ' days' END AS age FROM h"""
)
def format_age(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", geo.format_age(F.col("o_orderkey") * 61000).alias("age"))


@registered(
    """WITH d AS (SELECT o_orderkey, (o_orderkey * 7) % 20000 AS m FROM orders)
SELECT o_orderkey, CASE WHEN m < 950 THEN (round(m / 10.0::DOUBLE) * 10)::BIGINT || ' m' ELSE printf('%.1f km', round(m / 100.0::DOUBLE) / 10) END AS shown FROM d"""
)
def format_distance(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", geo.format_distance((F.col("o_orderkey") * 7) % 20000).alias("shown"))


@registered(
    f"""WITH {DEALS} SELECT domain, rank, CASE WHEN in_stock IS NULL THEN 'Best listed option' WHEN in_stock THEN 'Best overall' ELSE 'Best unavailable listing' END AS badge
FROM deals WHERE rank = 0"""
)
def best_badge(spark, sf_dir):
    return deals(spark, sf_dir).where("rank = 0").select("domain", "rank", ranking.badge(F.col("in_stock")).alias("badge"))
