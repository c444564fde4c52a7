"""Keyed state over events: rate limits, lifetimes and progress, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import anchored_windows


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, limit: int, width_us: int) -> DataFrame:
    """events with allowed, remaining and retry_s.

    A key may have `limit` events in a window that begins with its first event and ends width_us
    later, exclusive; denied events don't count. Events without a time take no part.
    """
    placed = anchored_windows(events, key, ts, tie, width_us)
    allowed = F.col("nth") < limit
    left = F.ceil((F.col("start") + width_us - F.col("us")) / 1_000_000)
    return placed.withColumns(
        {
            "allowed": allowed,
            "remaining": F.greatest(F.lit(limit) - F.col("nth") - 1, F.lit(0)).cast("long"),
            "retry_s": F.when(allowed, 0).otherwise(F.greatest(left, F.lit(1))).cast("long"),
        }
    )


def cached(reads: DataFrame, key: str, ts: str, tie: str, ttl_us: int) -> DataFrame:
    """reads with hit: whether an earlier read's value still lives; a hit doesn't lengthen its life."""
    return anchored_windows(reads, key, ts, tie, ttl_us).withColumn("hit", F.col("nth") > 0)


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last event of each key by order, and the place of its first: a fold that overwrites."""
    at = F.struct(*order)
    row = events.groupBy(key).agg(F.max_by(F.struct(*values), at).alias("_v"), F.min(at).alias("first"))
    return row.select(key, "_v.*", "first")
