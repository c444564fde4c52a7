"""Structured Streaming twins of the keyed state: rate limits and the latest event of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunks import micros


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, width_us: int, late: str = "1 hour") -> DataFrame:
    """(key, us, allowed, remaining) of a stream of events.

    State of a key is the start of its window and how many events it has let in. Within a micro-batch
    events are taken by time; one earlier than its window's start, from a later batch, counts to that
    window: it is what had been seen that decides. Events later than `late` behind the latest one are
    dropped, and a key whose window the watermark has passed keeps no state, so state is bounded by the
    keys at hand. A NULL time takes no part; one at the start of 1970 or before is late always. Write with
    output mode append.
    """
    kind = dict(events.dtypes)[key]

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        us = np.sort(np.concatenate([b.us.to_numpy() for b in batches]))
        allowed, remaining = np.zeros(len(us), bool), np.zeros(len(us), np.int64)
        i = 0
        while i < len(us):  # a turn a window
            if start is None or us[i] >= start + width_us:
                start, count = int(us[i]), 0
            j = int(np.searchsorted(us, start + width_us))
            nth = count + np.arange(j - i)
            allowed[i:j], remaining[i:j] = nth < limit, np.maximum(limit - nth - 1, 0)
            count, i = min(count + j - i, limit), j
        state.update((start, count))
        end = -(-(start + width_us) // 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]] * len(us), "us": us, "allowed": allowed, "remaining": remaining})

    at = F.col(ts).cast("timestamp")
    timed = events.where(F.col(ts).isNotNull()).select(key, micros(events, ts).alias("us"), at.alias("at")).withWatermark("at", late)
    return timed.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, us long, allowed boolean, remaining long", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest(events: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The last event of each key so far; write with output mode complete or update."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(order, *values)).alias("v")).select(key, "v.*")
