"""Hashed word n-grams as column expressions, and their log-ratio weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words

#: Buckets of the hashed multinomials; a weight table has this many entries whatever the corpus.
BUCKETS = 65536
#: Weights are integers of this many parts, so that sums don't depend on their order.
PARTS = 1_000_000
STEP = 8191


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_ids(w: Column) -> Column:
    """24-bit ids of words: the head of their MD5, which any SQL engine has."""
    return F.transform(w, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 6), 16, 10).cast("long"))


def pairs(ids: Column) -> Column:
    """Buckets of neighbouring words; the last entry is NULL."""
    return F.transform(ids, lambda x, i: (x * STEP + F.get(ids, i + 1)) % BUCKETS)


def grams(text: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours of a text."""
    return let(
        word_ids(words(text)),
        lambda ids: F.concat(
            F.transform(ids, lambda x: x % BUCKETS), F.filter(pairs(ids), lambda x: x.isNotNull())
        ),
    )


def n_grams(n: Column) -> Column:
    """Words and pairs of neighbours among n words."""
    return F.greatest(2 * n - 1, F.lit(0)).cast("long")


def counts(docs: DataFrame, **flags: Column) -> DataFrame:
    """(bucket, raw, *flags): n-grams of all documents, and of those where a flag holds.

    Each task sums its own documents into at most BUCKETS rows before anything is shuffled.
    """
    rows = docs.select(F.explode(grams(F.col("text"))).alias("bucket"), *(c.cast("int").alias(n) for n, c in flags.items()))
    return rows.groupBy("bucket").agg(F.count("*").alias("raw"), *(F.sum(n).cast("long").alias(n) for n in flags))


def log_ratio(count: DataFrame, of: str, to: str, toward: int = 0) -> Column:
    """Literal array over all buckets of the log ratio of two smoothed multinomials, in PARTS.

    `of` is smoothed by one n-gram a bucket, or by so many that are dealt as `to` has them (toward):
    then the weights tend to 0 where `of` has few n-grams.

    The table of BUCKETS rows passes through the driver: its size is fixed, not the corpus's. (A
    subquery isn't allowed in a higher-order function, and a joined array would be copied into
    each row.)
    """
    count = staged(count, "n-grams")
    full = count.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(count, "bucket", "left").na.fill(0)
    total = count.agg(F.coalesce(F.sum(of), F.lit(0)).alias("of_all"), F.coalesce(F.sum(to), F.lit(0)).alias("to_all"))
    share = (F.col(to) + 1.0) / (F.col("to_all") + float(BUCKETS))
    added, added_all = (share * float(toward), float(toward)) if toward else (F.lit(1.0), float(BUCKETS))
    ratio = F.log((F.col(of) + added) / (F.col("of_all") + added_all)) - F.log(share)
    weighed = full.join(F.broadcast(total)).select("bucket", F.round(ratio * PARTS).cast("long").alias("weight"))
    table = weighed.agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("t"))
    return array_literal(
        table.select(F.array_join(F.transform("t", lambda x: x["weight"].cast("string")), ",")).first()[0]
    )


def array_literal(numbers: str) -> Column:
    """Comma-separated whole numbers as a constant array; the optimizer folds it."""
    return F.split(F.lit(numbers), ",").cast("array<bigint>")


def score(w: Column, weights: Column) -> Column:
    """Sum of the weights of the n-grams of words w."""
    zero = F.lit(0).cast("long")
    return let(
        word_ids(w),
        lambda ids: F.aggregate(ids, zero, lambda a, x: a + F.get(weights, (x % BUCKETS).cast("int")))
        + F.aggregate(pairs(ids), zero, lambda a, x: a + F.coalesce(F.get(weights, x.cast("int")), zero)),
    )
