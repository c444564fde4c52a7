"""Queries on map responses, snapshots, search pages, answers and request guards, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, guards, text
from ..operators import discovery, ingestion
from ..operators.chunks import micros
from ..sources import bindings as B
from .search import NEAR, ORACLES, QUERIES, registered  # noqa: F401
from .web import pick, pick_sql

#: Elements of a response; each fourth response remarks on a failure.
ON_RESPONSE = 50


def responses(spark, sf_dir) -> DataFrame:
    """Map responses written from supplier: names, websites and places under various keys."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    shop = B.stores(spark, sf_dir).select("pos", "lat", "lon")
    when = lambda ok, *parts: F.when(ok, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    tags = F.struct(
        when(k % 5 == 0, "  Shop ", s, " ").alias("name"),
        when(k % 5 == 1, "Лавка ", s).alias("name:ru"),
        when(k % 5 == 3, "Brand ", s).alias("brand"),
        when(k % 3 == 0, "HTTPS://www.Shop", s, ".example:8080/x").alias("website"),
        when(k % 3 == 1, "shop", s, ".example").alias("contact:website"),
        when(k % 2 == 0, "computer").alias("shop"),
        when(k % 4 == 0, "+7 ", s).alias("phone"),
        when(k % 4 == 1, " 8", s, " ").alias("contact:phone"),
        when(k % 7 == 0, "24/7").alias("opening_hours"),
        when(k % 3 == 0, "Abay").alias("addr:street"),
        when(k % 6 == 0, s).alias("addr:housenumber"),
        when(k % 2 == 0, "Almaty").alias("addr:city"),
    )
    lat = F.when(k % 11 == 0, F.lit(95.0)).otherwise(F.col("lat"))
    centre = F.when(k % 3 == 2, F.struct(lat.alias("lat"), "lon"))
    element = F.struct(
        F.lit("node").alias("type"), k.alias("id"), F.when(k % 3 != 2, lat).alias("lat"), F.when(k % 3 != 2, F.col("lon")).alias("lon"),
        centre.alias("center"), tags.alias("tags"),
    )
    rows = shop.select(F.col("pos").alias("s_suppkey"), "lat", "lon").select(F.floor(k / ON_RESPONSE).alias("response_id"), element.alias("el"))
    remark = F.when(F.col("response_id") % 4 == 3, "runtime error: Query timed out")
    return rows.groupBy("response_id").agg(F.collect_list("el").alias("elements")).select(
        "response_id", F.to_json(F.struct(remark.alias("remark"), "elements")).alias("body")
    )


@registered(
    f"""WITH {NEAR}
SELECT id, CASE pos % 5 WHEN 0 THEN 'Shop ' WHEN 1 THEN 'Лавка ' ELSE 'Brand ' END || pos AS name,
  CASE WHEN pos % 3 < 2 THEN 'shop' || pos || '.example' END AS domain,
  CASE pos % 3 WHEN 0 THEN 'https://www.shop' || pos || '.example:8080' WHEN 1 THEN 'https://shop' || pos || '.example' END AS website,
  CASE WHEN pos % 2 = 0 THEN 'computer' ELSE 'unknown' END AS shop_type, distance_m,
  nullif(concat_ws(', ', nullif(concat_ws(' ', CASE WHEN pos % 3 = 0 THEN 'Abay' END, CASE WHEN pos % 6 = 0 THEN pos::VARCHAR END), ''),
    CASE WHEN pos % 2 = 0 THEN 'Almaty' END), '') AS address,
  CASE pos % 4 WHEN 0 THEN '+7 ' || pos WHEN 1 THEN '8' || pos END AS phone, CASE WHEN pos % 7 = 0 THEN '24/7' END AS opening_hours
FROM near WHERE pos // {ON_RESPONSE} % 4 <> 3 AND pos % 11 <> 0 AND pos % 5 IN (0, 1, 3)"""
)
def store_ingest(spark, sf_dir):
    found = ingestion.stores_of(ingestion.elements_of(responses(spark, sf_dir)), B.CENTRE)
    return found.select("id", "name", "domain", "website", "shop_type", "distance_m", "address", "phone", "opening_hours")


@registered(
    f"""WITH {NEAR} SELECT id, pos % 13 NOT IN (1, 2, 3, 4, 5) AS sound FROM near"""
)
def cached_stores(spark, sf_dir):
    """Stores of a snapshot, some of them with a fault."""
    k = F.col("pos")
    near = ingestion.with_distance(B.stores(spark, sf_dir), B.CENTRE)
    none = F.lit(None).cast("string")
    store = {
        "id": F.col("id"), "name": F.when(k % 13 == 1, F.lit("")).otherwise(F.col("name")), "domain": F.col("domain"), "website": none,
        "shop_type": F.when(k % 13 != 2, F.col("shop_type")), "lat": F.when(k % 13 == 3, F.lit(-90.5)).otherwise(F.col("lat")),
        "lon": F.when(k % 13 == 4, F.lit(float("nan"))).otherwise(F.col("lon")), "distance_m": F.col("distance_m"), "address": none,
        "phone": F.when(k % 13 == 5, F.repeat(F.lit("8"), F.lit(81))), "opening_hours": none,
    }
    return near.select("id", ingestion.sound(store).alias("sound"))


#: The clock of the snapshot query, and how old a snapshot may be.
NOW_MS, FRESH_MS = 1_705_276_800_000, 24 * 3_600_000


@registered(
    f"""WITH s AS (SELECT 'cell' || (user_id % 50) AS cell, epoch_us(ts) // 1000 AS saved_ms, CASE WHEN event_id % 7 <> 0 THEN event_type || event_id END AS stores FROM events),
n AS (SELECT cell, arg_min(struct_pack(s := saved_ms, v := stores), (-saved_ms, stores)) AS x FROM s
  WHERE saved_ms BETWEEN 0 AND {NOW_MS + ingestion.AHEAD_MS} AND stores IS NOT NULL GROUP BY cell)
SELECT cell, x.s AS saved_ms, x.v AS stores, CASE WHEN {NOW_MS} - x.s > {FRESH_MS} THEN {NOW_MS} - x.s END AS stale_age_ms FROM n"""
)
def snapshot_choice(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events")
    cell = F.concat(F.lit("cell"), (F.col("user_id") % 50).cast("string"))
    value = F.when(F.col("event_id") % 7 != 0, F.concat("event_type", F.col("event_id").cast("string")))
    snapshots = rows.select(cell.alias("cell"), F.floor(micros(rows, "ts") / 1000).alias("saved_ms"), value.alias("stores"))
    return ingestion.freshest(snapshots, "cell", "saved_ms", "stores", NOW_MS, FRESH_MS)


_TEMPLATES = ["/search?q={q}", "/s/{q}/{q}", "/find", "search?q={q}", None]


@registered(
    f"""WITH t AS (SELECT p_partkey, {pick_sql("p_partkey", _TEMPLATES)} AS template, p_name || ' (~50%!)' AS ask FROM part),
e AS (SELECT *, replace(replace(replace(replace(replace(url_encode(ask), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS q FROM t)
SELECT p_partkey, coalesce(template LIKE '/%{{q}}%', false) AS usable,
  CASE WHEN template IS NOT NULL THEN 'https://shop.example' || CASE template WHEN '/s/{{q}}/{{q}}' THEN '/s/' || q || '/{{q}}' ELSE replace(template, '{{q}}', q) END END AS url FROM e"""
)
def search_urls(spark, sf_dir):
    template = pick(F.col("p_partkey"), _TEMPLATES)
    url = discovery.search_url(F.lit("https://shop.example"), template, F.concat("p_name", F.lit(" (~50%!)")))
    return B.table(spark, sf_dir, "part").select("p_partkey", discovery.usable_template(template).alias("usable"), url.alias("url"))


@registered(
    f"""WITH t AS (SELECT p_partkey, {text.tokenize_sql("CASE p_partkey % 3 WHEN 0 THEN 'x 15' WHEN 1 THEN 'x' ELSE p_brand || ' ' || p_name END")} AS tokens, p_name FROM part),
f AS (SELECT p_partkey, list_filter(tokens, lambda x: length(x) >= 3 OR (length(x) = 2 AND regexp_matches(x, '\\d')))[1:3] AS long,
  list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 3)[1:2] AS words FROM t)
SELECT p_partkey, array_to_string(CASE WHEN len(long) > 0 THEN long ELSE words END, ',') AS terms FROM f"""
)
def relevance_terms(spark, sf_dir):
    asked = F.when(F.col("p_partkey") % 3 == 0, "x 15").when(F.col("p_partkey") % 3 == 1, "x").otherwise(F.concat("p_brand", F.lit(" "), "p_name"))
    terms = discovery.relevance_terms(text.tokenize(asked), F.col("p_name"))
    return B.table(spark, sf_dir, "part").select("p_partkey", F.array_join(terms, ",").alias("terms"))


#: What stands after a price, and whether it makes it one in tenge.
AFTER_PRICE = {"₸": True, "&nbsp;₸": True, "</b><i> </i>тг": True, " тенге": True, " KZT": False, " тгк": False, "$": False}
_IN_TENGE = tuple(k for k, counts in enumerate(AFTER_PRICE.values()) if counts)


@registered(f"SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber % {len(AFTER_PRICE)} IN {_IN_TENGE}) AS prices FROM lineitem GROUP BY l_orderkey")
def price_counts(spark, sf_dir):
    """A page for each order, its lines as tiles that write their currency in seven ways."""
    line = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    price = F.translate(F.format_number(F.round("l_extendedprice").cast("long"), 0), ",", "\u00a0")
    tile = F.concat(F.lit("<div><b>"), price, pick(F.col("l_linenumber"), list(AFTER_PRICE)), F.lit("</b></div>"))
    page = line.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(tile)), "").alias("html"))
    return page.select("l_orderkey", discovery.count_prices(F.col("html")).cast("long").alias("prices"))


@registered(
    """WITH p AS (SELECT p_partkey AS k, p_name, p_size FROM part)
SELECT k AS p_partkey, CASE k % 7 WHEN 0 THEN '/find/' || k || '?q={q}' WHEN 1 THEN '/?s={q}' WHEN 2 THEN '/s?text={q}&n=' || k || '|/s?text={q}'
  WHEN 3 THEN '/a?b=' || p_size || '&' || replace(p_name, ' ', '%20') || '={q}'
  WHEN 4 THEN '/search/' || p_size || '?' || string_split(p_name, ' ')[1] || '={q}|/search/' || p_size || '?' || string_split(p_name, ' ')[2] || '={q}'
  ELSE '' END AS templates FROM p"""
)
def form_templates(spark, sf_dir):
    """Home pages with forms of each part: by the input's name, its hint, the form's address, a published action; posted, unclosed."""
    k, n, name = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_name")
    word = lambda at: F.get(F.split(name, " "), F.lit(at))
    forms = [
        ('<form action="/find/%s"><input name="q"><input type="hidden" name="search"></form>', k),
        ('<form method="POST" action="/%s"><input name="q"></form><form><input name="s" type=""></form>', k),
        ('{"target": "https://shop.example/s?text={search_term_string}&n=%s"} <form action="/s"><input name="text"></form>', k),
        ('<form action="/a?b=%s"><input name="%s" placeholder="Поиск"><input name="mail"></form>', n, name),
        ('<form action="/search/%s"><input name="%s"><input name="%s"></form>', n, word(0), word(1)),
        ('<form action="/find/%s"><input name="q">', k), ('<form action="/order/%s"><input name="%s"></form>', k, name),
    ]
    html = F.get(F.array(*(F.format_string(form, *parts) for form, *parts in forms)), (F.col("p_partkey") % len(forms)).cast("int"))
    found = discovery.templates(html, F.lit("https://shop.example"))
    return B.table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "|").alias("templates"))


#: Where a search may land: address, whether that is the place asked for, and where its links lead to.
LANDINGS = [
    ("https://shop.example/search?q=x", True, "/product/"), ("https://other.example/search", False, "/product/"), ("https://shop.example/", False, "/product/"),
    ("https://shop.example/search", True, "/blog/"), ("https://www.shop.example/find?q=x", True, "https://www.shop.example/p/"),
    ("https://shop.example/search", True, "https://far.example/p/"),
]


@registered(
    f"""WITH o AS (SELECT l_orderkey AS k, l_orderkey % {len(LANDINGS)} AS kind, count(*) AS prices,
    count(*) FILTER (WHERE p_name LIKE '%widget' AND l_linenumber % 3 > 0) AS fitting FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT k AS l_orderkey, CASE WHEN kind IN {tuple(k for k, (_, there, link) in enumerate(LANDINGS) if there and "/p" in link and "far" not in link)} AND prices >= 3 AND fitting >= 2 THEN 'accepted'
  WHEN kind IN {tuple(k for k, (_, there, _) in enumerate(LANDINGS) if there)} AND k // {len(LANDINGS)} % 3 = 0 AND prices < 3 THEN 'client_rendered' ELSE '' END AS verdict FROM o"""
)
def search_judged(spark, sf_dir):
    """A page for each order, its lines as cards, two in three of them a "15"; who asked for widget 15 may have landed elsewhere."""
    part = B.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    line = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    k, number = F.col("l_orderkey"), F.when(F.col("l_linenumber") % 3 > 0, 15).otherwise(16)
    link, price = pick(k, [to for *_, to in LANDINGS]), F.translate(F.format_number(F.round("l_extendedprice").cast("long"), 0), ",", " ")
    card = F.format_string('<div><a href="%sred-%d-a-%d">%s %d</a> %s ₸</div>', link, "l_linenumber", "l_linenumber", "p_name", number, price)
    pages = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"))
    html = F.concat(F.when(F.floor(k / len(LANDINGS)) % 3 == 0, '<div class="filter"></div>').otherwise(""), "cards")
    landed = pick(k, [url for url, *_ in LANDINGS])
    v = discovery.judged(html, landed, F.lit("https://www.shop.example/search?q=x"), ("widget", "15"))
    shown = F.when(v["accepted"], "accepted").when(v["client_rendered"], "client_rendered").otherwise("")
    return pages.select("l_orderkey", shown.alias("verdict"))


_OBJECT, _TERM = "p_partkey % 5 < 3", "p_partkey // 5 % 2 = 0"


@registered(
    f"""SELECT p_partkey, CASE WHEN {_OBJECT} AND {_TERM} THEN p_name || ' new' ELSE 'phone' END AS search_term,
  CASE WHEN p_partkey // 10 % 2 = 0 THEN 'samsung' WHEN {_OBJECT} THEN lower(p_brand) END AS brand, CASE WHEN {_OBJECT} AND p_size % 4 > 0 THEN lower(p_type) END AS model,
  CASE WHEN {_OBJECT} AND p_partkey // 20 % 3 = 0 AND p_size * 400 <= 16384 THEN p_size * 400 END::INT AS storage_gb, CASE WHEN {_OBJECT} AND p_size * 20 <= 512 THEN p_size * 20 END::INT AS ram_gb,
  CASE WHEN {_OBJECT} AND p_size % 2 = 0 THEN 'laptop' END AS category, CASE WHEN {_OBJECT} THEN 'llm' ELSE 'rules' END AS via FROM part"""
)
def query_enrichment(spark, sf_dir):
    """Answers on each part, bare, fenced and in prose, or none; sizes too large, broken or quoted, terms that lack a word."""
    k, size, none = F.col("p_partkey"), F.col("p_size"), F.lit(None)
    said = F.struct(
        F.concat(F.lit(" "), F.when(F.floor(k / 5) % 2 == 0, F.initcap("p_name")).otherwise(F.reverse("p_name")), F.lit(" NEW ")).alias("searchTerm"),
        F.col("p_brand").alias("brand"), F.when(size % 4 > 0, F.concat(F.lit(" "), "p_type")).otherwise(" ").alias("model"),
        F.when(size % 2 == 0, "laptop").otherwise("spaceship").alias("category"), (size * 20).alias("ramGb"),
    )
    storage = F.when(F.floor(k / 20) % 3 == 0, (size * 400).cast("string")).when(F.floor(k / 20) % 3 == 1, F.concat(size.cast("string"), F.lit(".5")))
    storage = F.coalesce(storage, F.concat(F.lit('"'), size.cast("string"), F.lit('"')))
    whole = F.concat(F.regexp_replace(F.to_json(said), r"\}$", ""), F.lit(', "storageGb": '), storage, F.lit("}"))
    fenced, prose = F.concat(F.lit("Sure:\n```json\n"), whole, F.lit("\n``` {done}")), F.concat(F.lit("so "), whole, F.lit(" it is"))
    answer = F.when(k % 5 == 0, whole).when(k % 5 == 1, fenced).when(k % 5 == 2, prose).when(k % 5 == 3, F.concat("p_name", F.lit(": } no object {")))
    base = {
        "search_term": F.lit("phone"), "brand": F.when(F.floor(k / 10) % 2 == 0, "samsung"), "model": none.cast("string"),
        "storage_gb": none.cast("int"), "ram_gb": none.cast("int"), "category": none.cast("string"), "required_tokens": F.split("p_name", " "),
    }
    filled = answers.enriched(base, answer)
    return B.table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in filled.items()))


@registered("""SELECT o_orderkey, (o_orderkey % 9) IN (0, 3, 7) AND (o_orderkey // 9 % 3 = 0 OR o_orderkey // 27 % 2 = 1) AS grounded FROM orders""")
def verdict_grounding(spark, sf_dir):
    """Verdicts on two deals, one kind in nine each: some name another shop, price or number."""
    k, p = F.col("o_orderkey"), F.round("o_totalprice").cast("long")
    price = lambda n: F.translate(F.format_number(n, 0), ",", " ")
    kinds = [
        F.concat(F.lit("Shop A sells it for "), price(p), F.lit(" ₸, 4.2 km or 9 minutes away.")), F.concat(F.lit("Shop B sells it for "), price(p), F.lit(" ₸.")),
        F.concat(F.lit("Shop A sells it for "), price(p + 1), F.lit(" ₸.")), F.concat(F.lit("Shop A: "), price(p), F.lit(" KZT, which saves 5 400 тенге.")),
        F.concat(F.lit("Shop A: "), price(p), F.lit(" ₸ and 9 ₸.")), F.concat(F.lit("Shop A: "), price(p), F.lit(" ₸, 77 more.")),
        F.concat(F.lit("Shop A: "), price(p), F.lit(" ₸" + " so" * 50)), F.concat(F.lit("shop a, "), price(p), F.lit(" ₸, in all "), price(p + 800), F.lit(" ₸.")),
        F.concat(F.lit("Shop A: "), price(p), F.lit(" ₸.")),
    ]
    said = F.get(F.array(*kinds), (k % 9).cast("int"))
    said = F.concat(said, F.when(F.floor(k / 27) % 2 == 1, " Maybe out of stock: verify.").otherwise(""))
    stock = F.when(F.floor(k / 9) % 3 == 0, True).when(F.floor(k / 9) % 3 == 1, False)

    def deal(name: str, more: int, trip: int, in_stock: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), F.lit("red widget").alias("title"), (p + more).alias("price"), in_stock.alias("in_stock"), F.lit(4.2).alias("km"),
            F.lit(9.0).alias("minutes"), F.lit(trip).alias("travel"), F.lit(300).alias("time_cost"), (p + more + trip + 300).alias("total"),
        )

    both = F.array(deal("Shop A", 0, 500, stock), deal("Shop B", 5000, 900, F.lit(True)))
    deals = F.slice(both, F.lit(1), F.when(k % 9 == 8, 0).otherwise(2))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", answers.grounded(said, deals).alias("grounded"))


_V4 = "(n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256)"


@registered(
    f"""WITH a AS (SELECT o_orderkey AS k, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 7 = 0 THEN {_V4} WHEN k % 7 = 1 THEN printf('2001:db8::%x', n % 65536) WHEN k % 7 = 2 THEN printf('%x:%x:3:4:5:6:7:8', n // 65536, n % 65536)
  WHEN k // 7 % 2 = 0 THEN {_V4} ELSE 'anonymous' END AS client FROM a"""
)
def client_keys(spark, sf_dir):
    """Two headers for each order: addresses of both kinds first in a list, or none there and perhaps one in the second."""
    k = F.col("o_orderkey")
    n = (k * F.lit(2654435761)) % F.lit(4294967296)
    parts = [F.shiftright(n, s) % 256 for s in (24, 16, 8, 0)]
    v4 = F.concat_ws(".", *(p.cast("string") for p in parts))
    named = [
        F.concat(v4, F.lit(", 10.0.0.1")), F.format_string(" 2001:db8::%x ", n % 65536), F.format_string("%x:%x:3:4:5:6:7:8,x", F.floor(n / 65536), n % 65536),
        F.format_string("%d.%d.%d.%d", parts[0] + 256, *parts[1:]), F.format_string("host%d", k), F.format_string("1:2:3:%x:5:6:7::8", n % 65536), F.lit(None).cast("string"),
    ]
    second = F.when(F.floor(k / 7) % 2 == 0, F.concat(v4, F.lit(" "))).otherwise("not an address")
    return B.table(spark, sf_dir, "orders").select("o_orderkey", guards.client_key(F.get(F.array(*named), (k % 7).cast("int")), second).alias("client"))


_KINDS, _DECLARED = ["application/json; charset=utf-8", "text/plain", "application/ld+json", None, "application/jsonp"], [None, "12", "5000", "-1", "x", ""]
_READ = ["{}", "{oops", None]


@registered(
    f"""WITH r AS (SELECT o_orderkey, {pick_sql("o_orderkey", _KINDS)} AS kind, {pick_sql("(o_orderkey // 5)", _DECLARED)} AS declared,
  {pick_sql("(o_orderkey // 30)", _READ)} AS body, (o_orderkey // 90 % 2) * 5001 AS took FROM orders)
SELECT o_orderkey, CASE WHEN kind IS NULL OR kind IN ('text/plain', 'application/jsonp') THEN 415 WHEN declared IN ('-1', 'x') THEN 400 WHEN declared = '5000' THEN 413
  WHEN body IS NULL THEN 400 WHEN took > 5000 THEN 408 WHEN body = '{{oops' THEN 400 END::INT AS status FROM r"""
)
def request_status(spark, sf_dir):
    k = F.col("o_orderkey")
    read = [pick(F.floor(k / step), c) for step, c in ((1, _KINDS), (5, _DECLARED), (30, _READ))]
    return B.table(spark, sf_dir, "orders").select("o_orderkey", guards.request_status(*read, F.floor(k / 90) % 2 * 5001).alias("status"))


_LABELS = " ".join(f"WHEN {text.quoted(why)} THEN {text.quoted(shown)}" for why, shown in guards.FAILURE_LABEL.items())


@registered(f"SELECT failure, CASE failure {_LABELS} END AS label, count(*) AS fetches FROM ({ORACLES['fetch_classify']}) GROUP BY failure")
def failure_labels(spark, sf_dir):
    """How the failures of all fetches are shown, and how many there are of each."""
    failed = QUERIES["fetch_classify"](spark, sf_dir).groupBy("failure").agg(F.count("*").alias("fetches"))
    return failed.select("failure", guards.failure_label(F.col("failure")).alias("label"), "fetches")
