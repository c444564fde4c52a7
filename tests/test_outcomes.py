from pyspark.sql import functions as F

from pricecompass.functions import notices, query, web
from pricecompass.operators import budgets

FILES = "directory string, path string, age_ms long, size long"


def _kept(spark, rows):
    return sorted(r.path for r in budgets.pruned(spark.createDataFrame(rows, FILES)).collect() if r.kept)


def test_pruned_takes_smaller_files_after_one_that_does_not_fit(spark):
    mb = 1 << 20
    rows = [("d", "a", 1, 20 * mb), ("d", "b", 2, 13 * mb), ("d", "c", 3, 12 * mb), ("d", "e", 4, 1), (None, "f", 5, 32 * mb), (None, "g", 6, 1)]
    assert _kept(spark, rows) == ["a", "c", "f"]


def test_pruned_on_nulls_ties_and_nothing(spark):
    assert _kept(spark, [("d", "a", None, 1), ("d", "b", 1, None), ("d", "c", 91 * budgets.DAY_MS, 1), ("d", "e", 1, 1), ("d", "e", 1, 1)]) == ["e", "e"]
    assert _kept(spark, []) == []
    many = [("d", f"{k:04}", 7, 1) for k in range(budgets.MOST_FILES + 5)]
    assert _kept(spark, many) == [p for _, p, _, _ in many[: budgets.MOST_FILES]]


def test_pruned_counts_go_on_over_batches(spark):
    rows = spark.range(25_000).select(F.lit("d").alias("directory"), F.col("id").alias("path"), F.col("id").alias("age_ms"), F.lit(1).alias("size"))
    assert budgets.pruned(rows).where("kept").agg(F.max("path"), F.count("*")).first() == (299, 300)


def test_partial_results_without_times(spark):
    schema = "search_id long, domain string, known boolean, queued_ms long, took_ms long, found long, failure string"
    rows = [(1, "a", None, 0, None, 3, None), (1, "b", True, 30_000, 25_000, 3, None), (2, "c", True, 40_000, 20_000, 1, None), (None, "d", True, None, 1, 2, None)]
    got = {r.domain: (r.in_time, r.search_failed, r.found, r.failure, r.took_ms) for r in budgets.partial_results(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"] == (True, False, 0, "timeout", 16_000)
    assert got["b"] == (False, False, 0, "timeout", 52_000)
    assert got["c"] == (False, True, 0, "timeout", 52_000)
    assert got["d"][:2] == (False, True)
    assert budgets.partial_results(spark.createDataFrame([], schema)).count() == 0


def test_addresses_and_texts_that_are_missing(spark):
    row = spark.createDataFrame([(None, None)], "t string, n double").select(
        web.reserved_ip(F.col("t")).alias("ip"), query.parsed(F.col("t")).alias("asked"), notices.discount_badge(F.col("n"), F.col("n")).alias("off"),
        notices.low_confidence_hint(F.col("n")).alias("hint"), notices.empty_text(F.col("t"), F.lit(1), F.lit(1), F.col("t")).alias("empty"),
    ).first()
    assert row.ip and row.asked.tokens == [] and row.off is None and row.hint is None
    assert row.empty == 'Checked 1 retailer site near you and read 1 listing, but none matched "".'
