"""Odd rows of map responses, snapshots, answers and search pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricecompass.functions import answers, guards
from pricecompass.operators import discovery, ingestion

CENTRE = (43.238, 76.8829)


def test_responses_that_hold_no_stores(spark):
    bodies = [
        None, "", "{oops", '{"elements": 5}', '{"elements": []}', '{"remark": "Out of memory", "elements": [{"type": "node", "id": 1, "lat": 1, "lon": 1, "tags": {"name": "a"}}]}',
        '{"elements": [{"type": "area", "id": 1, "lat": 1, "lon": 1, "tags": {"name": "a"}}, {"type": "node", "id": 0, "lat": 1, "lon": 1, "tags": {"name": "a"}},'
        ' {"type": "node", "id": 2, "tags": {"name": "a"}}, {"type": "node", "id": 3, "lat": 1, "lon": 1}]}',
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "response_id long, body string")
    assert ingestion.stores_of(ingestion.elements_of(rows), CENTRE).count() == 0


def test_first_elements_of_a_response_count(spark):
    one = '{"type": "way", "id": %d, "center": {"lat": 43, "lon": 76}, "tags": {"operator": " x ", "website": "shop.example"}}'
    body = '{"elements": [%s]}' % ",".join(one % (k + 1) for k in range(ingestion.MOST_ELEMENTS + 5))
    rows = spark.createDataFrame([(1, body)], "response_id long, body string")
    found = ingestion.stores_of(ingestion.elements_of(rows), CENTRE)
    assert found.count() == ingestion.MOST_ELEMENTS
    assert {(r.name, r.domain, r.website) for r in found.select("name", "domain", "website").distinct().collect()} == {("x", "shop.example", "https://shop.example")}


def test_freshest_snapshot(spark):
    rows = spark.createDataFrame(
        [("a", 10, "x"), ("a", 10, "w"), ("a", 5, "y"), ("b", 100, "late"), ("b", None, "z"), ("b", -1, "q"), ("c", 20, None), ("d", 200_000, "far")],
        "k string, at long, v string",
    )
    found = ingestion.freshest(rows, "k", "at", "v", 110, 50).orderBy("k").collect()
    assert [tuple(r) for r in found] == [("a", 10, "w", 100), ("b", 100, "late", None)]
    assert ingestion.freshest(rows.limit(0), "k", "at", "v", 110, 50).count() == 0


def test_verdicts_without_trips_or_text(spark):
    deal = "array(named_struct('name', 'Shop', 'title', 'tv 55', 'price', 1000L, 'in_stock', true, 'km', {0}, 'minutes', {0}, 'travel', {0}, 'time_cost', {0}, 'total', {0}))"
    null = deal.format("cast(null as double)")
    said = spark.createDataFrame([("Shop: tv 55 for 1 000 ₸",), ("Shop: tv 55 for 1 000 ₸, 0 more",), ("",), (None,)], "a string")
    found = said.select(answers.grounded(F.col("a"), F.expr(null)).alias("g"))
    assert [r.g for r in found.collect()] == [True, False, False, False]


def test_pages_of_long_blanks_are_read(spark):
    rows = spark.range(1).select(F.concat(F.lit("12 000"), F.repeat(F.lit(" "), F.lit(300_000)), F.lit("₸ <a href='"), F.repeat(F.lit("<form "), F.lit(20_000))).alias("h"))
    url = F.lit("https://shop.example/")
    row = rows.select(
        discovery.count_prices(F.col("h")).alias("n"), discovery.templates(F.col("h"), url).alias("t"), discovery.relevant_titles(F.col("h"), ("tv",), url).alias("r")
    ).first()
    assert (row.n, row.t, row.r) == (1, [], 0)


def test_guards_of_nothing(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        guards.client_key(none).alias("k"), guards.request_status(none, none, none, F.lit(0)).alias("s"), guards.failure_label(none).alias("f")
    ).first()
    assert tuple(row) == ("anonymous", 415, None)
