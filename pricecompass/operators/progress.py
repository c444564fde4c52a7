"""A search's events folded into what a shopper sees: progress of each retailer, and how the search ended.

Events have search_id, seq (their order), kind (status, stores, domain, results, error), and by kind
domain, state (start, done), found, failure, took_ms, message. streaming/progress.py has the twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Events that end a search, and what an error's message says where time ran out.
TERMINAL = ("results", "error")
OUT_OF_TIME = r"(?i)time limit|timed out"
PROGRESS = ("state", "found", "failure", "took_ms")


def closing_failure(message: Column) -> Column:
    """Failure of the retailers that an error leaves without an answer."""
    return F.when(F.coalesce(message.rlike(OUT_OF_TIME), F.lit(False)), "timeout").otherwise("unreachable")


def reduced(events: DataFrame) -> DataFrame:
    """(search_id, domain, place, state, found, failure, took_ms, ended): each retailer of a search as its last
    event before the search's end says, in the order of their first events (place, from 1); ended is the
    event that ended it, NULL while it runs.

    A search ends with its first terminal event; what comes later doesn't count. An error closes what has
    only started: nothing found, with the failure its message tells. Partial aggregates throughout: a search with a third
    of all events is no task's burden. Retailers of a search are few, so they are placed in a window.
    NULL ids are an id; events without a seq or, of a retailer, without a domain don't count; equal
    rows count once; no rows give none.
    """
    told = events.where(F.col("seq").isNotNull())
    # terminal events are few: the first of each search
    end = F.min(F.struct("seq", "kind", "message"))
    ends = told.where(F.col("kind").isin(*TERMINAL)).groupBy("search_id").agg(end.alias("end")).withColumnRenamed("search_id", "_ended")
    rows = told.where((F.col("kind") == "domain") & F.col("domain").isNotNull())
    before = rows.join(ends, F.col("search_id").eqNullSafe(F.col("_ended")), "left").where(F.col("end").isNull() | (F.col("seq") < F.col("end.seq")))
    done = F.col("state") != "start"
    said = F.struct("seq", "state", *(F.when(done, F.col(c)).alias(c) for c in PROGRESS[1:]))
    each = before.groupBy("search_id", "domain").agg(F.max(said).alias("last"), F.min("seq").alias("first"), F.any_value("end").alias("end"))
    error = (F.col("end.kind") == "error") & (F.col("last.state") == "start")
    own = lambda name, closed: F.when(error, closed).otherwise(F.col(f"last.{name}"))
    place = F.row_number().over(Window.partitionBy("search_id").orderBy("first", "domain")).cast("long")
    return each.select(
        "search_id", "domain", place.alias("place"), own("state", F.lit("done")).alias("state"),
        own("found", F.lit(0).cast("long")).alias("found"), own("failure", closing_failure(F.col("end.message"))).alias("failure"),
        own("took_ms", F.lit(None).cast("long")).alias("took_ms"), F.col("end.kind").alias("ended"),
    )



def counts(progress: DataFrame) -> DataFrame:
    """(search_id, done, total): how many retailers of each search have answered or been closed."""
    return progress.groupBy("search_id").agg(F.count_if(F.col("state") == "done").alias("done"), F.count("*").alias("total"))
