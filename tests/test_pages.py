"""Extraction on odd and hostile pages, event state against plain Python, and its streaming twins."""

import random
import time

from pyspark.sql import functions as F

from pricecompass.functions import markup, web
from pricecompass.operators import events, extraction, stores
from pricecompass.plans import pages as queries
from pricecompass.streaming import windows

PAGE = "page_id long, url string, domain string, html string"


def pages(spark, *html):
    return spark.createDataFrame([(k, "https://shop.example/search", "shop.example", h) for k, h in enumerate(html)], PAGE)


def test_odd_pages_give_no_listings(spark):
    odd = pages(spark, None, "", "<script type='application/ld+json'>{oops</script>", "<a href='/p/1'>title only</a>", "999 ₸", "<script")
    assert extraction.extract_listings(odd).count() == 0
    assert extraction.extract_listings(odd.limit(0)).count() == 0


def test_currency_and_offers_of_jsonld(spark):
    block = """<script type="application/ld+json">[{"@type": "Product", "name": "A &amp; B", "offers": {"price": "512990,50", "priceCurrency": "USD"}},
      {"@type": "Product", "name": "Second one", "url": "https://other.example/x", "offers": [{"price": 7, "availability": "OutOfStock"}, {"lowPrice": "443990.00"}]}]</script>"""
    rows = extraction.from_jsonld(pages(spark, block)).collect()
    assert [(r.title, r.price, r.url, r.in_stock) for r in rows] == [("Second one", 443990, None, None)]


def test_hostile_pages_take_linear_time(spark):
    pieces, times = ["<a href='/p/x'>", "<script>", '<a title="', "1 000 ₸ ", "itemtype='x/Product'"], []
    for size in (100_000, 800_000):
        page = pages(spark, *(piece * (size // len(piece)) for piece in pieces))
        began = time.time()
        assert extraction.extract_listings(page).count() == 0
        times.append(time.time() - began)
    assert times[1] < 4 * times[0] + 5


def test_a_page_of_four_megabytes(spark):
    card = '<div><a href="/product/{0}">Red widget {0} x</a><s>15 000 ₸</s><span>12 300 ₸</span></div>' + '<i class="x">y</i>' * 20
    html = "".join(card.format(k) for k in range(4_000_000 // len(card)))
    began = time.time()
    rows = extraction.from_proximity(pages(spark, html)).collect()
    assert time.time() - began < 40  # of which some 10 are planning
    assert {(r.title, r.price, r.old_price) for r in rows} == {(f"Red widget {k} x", 12_300, 15_000) for k in range(500)}  # 1,000 prices of a page count


NEAR_LINKS = [
    ('<a href="/product/1">Red widget blue</a><div class="facet-wrapper slider"><span>5 000 ₸</span></div>', []),
    ('<div class="filter"><i>до 50 000 ₸</i></div>' + " " * 230 + '<a href="/p/1">Red widget blue</a><b>443 990 ₸</b>', [("Red widget blue", 443_990)]),
    ('<a href="/product/1">Red widget blue</a><span>5&#x202f;000&#8239;₸</span>', [("Red widget blue", 5_000)]),
    ('<a href="/p/1" title="a > b">Red widget blue</a><span>443 <strong>990</strong> ₸</span>', [("Red widget blue", 443_990)]),
    ('<a href="/p/1">Red widget blue</a><i>Рассрочка от 36 999 ₸ в месяц</i><i>39 999 ₸ — по рассрочке</i><b>443 990 ₸</b>', [("Red widget blue", 443_990)]),
    ('<a href="/p/1">Red widget blue</a><i>36 999 ₸ (ежемесячно)</i><i>36 999 ₸ / мес</i>', []),
    ('<a href="https://else.example/p/1">Red widget blue</a><b>443 990 ₸</b><a href="/blog/1">Red widget review</a>', []),
    ('<a href="/product/ps5">Sony PS5 Console</a>' + "<" * 300_000, []),
]


def test_prices_next_to_links(spark):
    found = {k: [] for k in range(len(NEAR_LINKS))}
    for r in extraction.from_proximity(pages(spark, *(h for h, _ in NEAR_LINKS))).collect():
        found[r.page_id].append((r.title, r.price))
    assert [found[k] for k in found] == [want for _, want in NEAR_LINKS]


def test_markup_is_read_with_its_quotes(spark):
    html = """<a title="x > y" href='/p'>T <b class="q>">bold</b></a><nav x='>'>n</nav><nav>zz</navigation> rest <a href="/open>never"""
    row = spark.createDataFrame([(html,)], "h string").select(
        markup.masked(F.col("h")).alias("m"), markup.without_tags(F.col("h")).alias("t"), markup.elements(F.col("h"), "a").alias("e"), markup.without_elements(F.col("h"), "nav").alias("n")
    ).first()
    assert len(row.m) == len(html) and row.m.split() == ["T", "bold", "n", "zz", "rest"]
    assert [html[k] for k, c in enumerate(row.m) if c != " "] == [c for c in row.m if c != " "]
    assert row.t.split() == ["T", "bold", "n", "zz", "rest"]
    assert (row.e[0].attributes, row.e[0].content) == (""" title="x > y" href='/p'""", 'T <b class="q>">bold</b>')
    assert "<nav>zz</navigation>" in row.n and "n</nav>" not in row.n
    big = spark.createDataFrame([("<a title=" + '"' * 1_000_001,)], "h string").cache()
    big.count()
    began = time.time()
    assert big.select(F.length(markup.masked(F.col("h")))).first()[0] == 1_000_010
    assert time.time() - began < 1.5


# RFC 3986, 5.4: references on the page http://a/b/c/d;p?q; other schemes have no address here.
REFERENCES = {
    "g:h": None, "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "?y": "/b/c/d;p?y", "g?y": "/b/c/g?y", "#s": "/b/c/d;p?q#s", "g#s": "/b/c/g#s",
    "g?y#s": "/b/c/g?y#s", ";x": "/b/c/;x", "g;x": "/b/c/g;x", "g;x?y#s": "/b/c/g;x?y#s", "": "/b/c/d;p?q", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/",
    "../g": "/b/g", "../..": "/", "../../": "/", "../../g": "/g", "../../../g": "/g", "../../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", ".g": "/b/c/.g",
    "g..": "/b/c/g..", "..g": "/b/c/..g", "./../g": "/b/g", "./g/.": "/b/c/g/", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h", "g;x=1/./y": "/b/c/g;x=1/y",
    "g;x=1/../y": "/b/c/y", "g?y/./x": "/b/c/g?y/./x", "g?y/../x": "/b/c/g?y/../x", "g#s/./x": "/b/c/g#s/./x", "g#s/../x": "/b/c/g#s/../x", "http:g": "/b/c/g",
}


def test_addresses_of_links(spark):
    rows = spark.createDataFrame([(h,) for h in REFERENCES], "h string").select("h", markup.resolved(F.col("h"), F.lit("http://a/b/c/d;p?q")).alias("u")).collect()
    assert {r.h: r.u for r in rows} == {h: w and "http://a" + w for h, w in REFERENCES.items()}
    odd = [("//g", "http://g/"), ("HTTP://A.B:80/x", "http://a.b/x"), ("https://u:p@a/x", None), (" /x y ", "http://a/x%20y"), ("x" * 9000, None), (None, None)]
    rows = spark.createDataFrame(odd, "h string, w string").select("w", markup.resolved(F.col("h"), F.lit("http://a/")).alias("u")).collect()
    assert all(r.u == r.w for r in rows)


def test_products_without_an_offer_hide_what_they_hold(spark):
    inner = '{"@type": "Product", "name": "inner one", "offers": {"price": 5000}}'
    block = '<script data-x=">" type="application/ld+json">[{"@type": "Product", "name": "outer one", "offers": [{"price": "x"}], "a": {"b": [%s]}}, %s]</script>'
    rows = extraction.from_jsonld(pages(spark, block % (inner, inner.replace("inner", "second")))).collect()
    assert [r.title for r in rows] == ["second one"]
    many = ",".join(f'{{"@type": "Product", "name": "Model {k}", "offers": {{"price": {100_000 + k}}}}}' for k in range(1_050))
    assert extraction.extract_listings(pages(spark, f'<script type="application/ld+json">[{many}]</script>')).count() == 1_000
    links = "".join(f'<a href="/product/model-{k}">Phone model {k}</a>' for k in range(7_000))
    assert extraction.from_proximity(pages(spark, links + "<b>443 990 ₸</b>")).count() == 0  # the first 5,000 links lie too far from it


def test_rate_limit_against_a_plain_fold_and_its_stream(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, r.randint(0, 4), (k + 1) * 1_000_000 * r.randint(1, 30)) for k in range(300)]  # a watermark starts at 1970: nothing lies there
    table = spark.createDataFrame(rows, "id long, key long, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    state, want = {}, {}
    for i, key, us in sorted(rows, key=lambda x: (x[2], x[0])):
        start, n = state.get(key, (None, 0))
        if start is None or start + 60_000_000 <= us:
            start, n = us, 0
        want[i] = n < 3
        state[key] = (start, n + want[i])
    got = {x.id: x.allowed for x in events.rate_limited(table, "key", "ts", "id", 3, 60_000_000).collect()}
    assert got == want
    for part in range(3):  # later files hold later events
        lo, hi = part * 3_000, (part + 1) * 3_000
        table.where((F.unix_micros("ts") >= lo * 1_000_000) & (F.unix_micros("ts") < hi * 1_000_000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = windows.rate_limited(source, "key", "ts", 3, 60_000_000).writeStream.format("memory").queryName("limited").outputMode("append")
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    streamed = spark.table("limited").groupBy("key").agg(F.count_if("allowed").alias("n")).collect()
    plain = {}
    for i, key, us in rows:
        if us < 9_000_000_000:
            plain[key] = plain.get(key, 0) + want[i]
    assert {x.key: x.n for x in streamed} == plain


def test_rate_limit_forgets_keys_whose_window_is_over(spark, tmp_path):
    day = 86_400
    for part in range(4):  # other keys each day
        rows = [(part * 10 + k % 5, part * day + k) for k in range(40)]
        table = spark.createDataFrame(rows, "key long, s long").select("key", F.timestamp_seconds("s").alias("ts"))
        table.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = windows.rate_limited(source, "key", "ts", 3, 60_000_000).writeStream.format("memory").queryName("forgotten").outputMode("append")
    query = query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 10 and held[-1] <= 5  # of twenty keys
    assert spark.table("forgotten").where("allowed").count() == 4 * 5 * 3


def test_latest_event_of_a_stream(spark, tmp_path):
    rows = [(k % 3, (k * 7) % 50, f"v{k}") for k in range(50)]
    table = spark.createDataFrame(rows, "key long, at long, v string")
    table.repartition(4).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = windows.latest(source, "key", "at", ["v"]).writeStream.format("memory").queryName("latest_of").outputMode("complete")
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    want = {key: max((at, v) for k, at, v in rows if k == key)[1] for key in range(3)}
    assert {r.key: r.v for r in spark.table("latest_of").collect()} == want


def test_stores_without_a_name_end_the_dedupe(spark):
    rows = [(1, "a", 43.0, 76.0, 10), (2, None, 43.0, 76.0, 5), (3, "A", 43.0001, 76.0, 12), (4, "a", None, 76.0, 3)]
    table = spark.createDataFrame(rows, "pos long, name string, lat double, lon double, distance_m long")
    assert [x.pos for x in stores.dedupe_pins(table).collect()] == [1]


def test_sse_records(spark):
    stream = spark.createDataFrame([("data: 1\n\ndata: 2\r\n\r\n: ping\n\ndata:a\ndata:b\n\n",)], "s string")
    data = stream.select(F.transform(web.sse_records(F.col("s")), web.sse_data)).first()[0]
    assert data == ["1", "2", None, "a\nb"]


def test_pages_are_never_broadcast_and_meet_in_as_many_tasks_as_shuffles_have(spark):
    """Files of pages are small beside their rows, so their size says nothing of what a driver can hold."""
    cards = queries.card_pages(spark, "/root/testdata/sf0.001")
    assert cards.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = extraction.from_proximity(cards)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
