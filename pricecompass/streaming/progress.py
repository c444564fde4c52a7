"""Streaming twins of a search's progress and of its deadline, and the sink that writes its records.

State is a map by retailer for each search, dropped when the search ends: with its terminal event, or by an
event-time timer. The state store must be RocksDB (`with_state` sets it for the session while a stream
starts). Streams have a watermark, so what is never ended is closed by time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.web import sse_data, sse_frame
from ..operators.budgets import KNOWN_MS, SEARCH_MS, UNKNOWN_MS
from ..operators.progress import OUT_OF_TIME, TERMINAL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TIMED_OUT = re.compile(OUT_OF_TIME)


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _whole(x: Any) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def _text(x: Any) -> str | None:
    return None if x is None or x is pd.NA or (isinstance(x, float) and pd.isna(x)) else str(x)


#: What a reducer reads of an event.
_READ = ("seq", "ms", "kind", "domain", "state", "found", "failure", "took_ms", "message")
_CLOSED = Row("search_id", "domain", "place", "state", "found", "failure", "took_ms", "ended")


class _Reducer(StatefulProcessor):
    """Progress of one search; what it ends with is sent on once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.domains = handle.getMapState("domains", "domain string", "first long, seq long, state string, found long, failure string, took_ms long")
        self.ended = handle.getValueState("ended", "kind string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        told = sorted(([r[c] for c in _READ] for r in rows), key=lambda r: r[0])
        if self.ended.exists():
            return
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(min(r[1] for r in told) + 2 * SEARCH_MS)
        # each call to the state is a message: what is kept is read at once, and written only where the search goes on
        kept = self._kept()
        changed = set()
        for seq, _, kind, domain, state, found, failure, took, message in told:
            if kind in TERMINAL:
                yield from self._close(key[0], kind, message, kept)
                return
            if kind == "domain" and domain is not None:
                old = kept.get(domain, (seq, -1, None, None, None, None))
                said = (found, failure, took) if state != "start" else (None, None, None)
                new = (seq, state, *said) if seq > old[1] else old[1:]
                kept[domain] = (min(old[0], seq), *new)
                changed.add(domain)
        for domain in changed:
            self.domains.updateValue((domain,), kept[domain])

    def _kept(self) -> dict[str, tuple]:
        return {k[0]: tuple(v) for k, v in self.domains.iterator()}

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        if self.ended.exists():
            self.ended.clear()  # so long after its end nothing of a search can come
        else:
            yield from self._close(key[0], None, None, self._kept())
            self.ended.clear()

    def _close(self, search: Any, kind: str | None, message: str | None, kept: dict[str, tuple]) -> list[Row]:
        failure = "timeout" if _TIMED_OUT.search(message or "") else "unreachable"
        out = []
        for place, (domain, (_, _, state, found, why, took)) in enumerate(sorted(kept.items(), key=lambda d: (d[1][0], d[0])), 1):
            closed = kind != "results" and state == "start"
            out.append(_CLOSED(search, domain, place, *(("done", 0, failure, None) if closed else (state, found, why, took)), kind))
        self.domains.clear()
        self.ended.update((kind or "none",))
        return out

    def close(self) -> None:
        pass


def reduced(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Twin of operators.progress.reduced over a stream of events with ts: the rows of a search when it ends,
    or, where nothing ends it within twice a search's time, closed as unreachable with ended NULL.

    Events of a search must come in order of seq from batch to batch; within a batch any order does. State of
    an ended search is one word, and goes with its timer. Write with output mode append.
    """
    kind = dict(events.dtypes)["search_id"]
    schema = f"search_id {kind}, domain string, place long, state string, found long, failure string, took_ms long, ended string"
    rows = events.where("seq is not null").withColumn("ms", F.unix_millis("ts")).select("search_id", "seq", "ts", "ms", "kind", "domain", "state", "found", "failure", "took_ms", "message")
    return rows.withWatermark("ts", late).groupBy("search_id").transformWithState(_Reducer(), schema, "append", "EventTime")


class _Deadline(StatefulProcessor):
    """Retailers asked by one search, and what they answered, until the search's time is up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getMapState("asked", "domain string", "known boolean, queued_ms long, took_ms long, found long, failure string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for r in frame.to_dict("records"):
                at = (r["domain"],)
                old = tuple(self.asked.getValue(at)) if self.asked.containsKey(at) else (None,) * 5
                if r["asked"]:
                    new = (bool(r["known"]), _whole(r["queued_ms"]), *old[2:])
                    self.handle.registerTimer(int(r["begun"].timestamp() * 1000) + SEARCH_MS)
                else:
                    new = (*old[:2], _whole(r["took_ms"]), _whole(r["found"]), _text(r["failure"]))
                self.asked.updateValue(at, new)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for (domain,), (known, queued, took, found, failure) in ((k, tuple(v)) for k, v in self.asked.iterator()):
            if queued is None:
                continue  # an answer that nobody asked for
            own = KNOWN_MS if known else UNKNOWN_MS
            late = took is None or took > own
            in_time = queued + (own if late else took) <= SEARCH_MS
            lost = late or not in_time
            told = SEARCH_MS if not in_time else own if late else took
            out.append([key[0], domain, in_time, False, 0 if lost else found, "timeout" if lost else failure, told])
        self.asked.clear()
        failed = not any(r[2] for r in out)
        names = ["search_id", "domain", "in_time", "search_failed", "found", "failure", "took_ms"]
        yield pd.DataFrame([[*r[:3], failed, *r[4:]] for r in out], columns=names)

    def close(self) -> None:
        pass


def deadline(attempts: DataFrame, late: str = "1 second") -> DataFrame:
    """Twin of operators.budgets.partial_results: a stream of (search_id, domain, ts, begun, asked, known, queued_ms,
    took_ms, found, failure), of which `asked` rows say that a retailer is asked by a search that began at `begun` and
    the others what it answered at ts. When the watermark passes a search's time, each retailer it asked comes
    out, those without an answer as timeouts. Write with output mode append.
    """
    kind = dict(attempts.dtypes)["search_id"]
    schema = f"search_id {kind}, domain string, in_time boolean, search_failed boolean, found long, failure string, took_ms long"
    rows = attempts.where("domain is not null").select("search_id", "domain", "ts", "begun", "asked", "known", "queued_ms", "took_ms", "found", "failure")
    return rows.withWatermark("ts", late).groupBy("search_id").transformWithStateInPandas(_Deadline(), schema, "append", "EventTime")


def record_writer(path: str, event: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes events as server-sent records under path: columns `event` of each row, those of
    a search together and by seq. A batch has a folder of its own, named by its number and written over if
    the batch is run again, so a restarted stream writes each record once."""

    def write(batch: DataFrame, number: int) -> None:
        frame = sse_frame(F.struct(*event))
        ordered = batch.repartition("search_id").sortWithinPartitions("search_id", "seq")
        lines = ordered.select(F.regexp_replace(frame, "\n\n$", "").alias("value"))
        lines.write.mode("overwrite").option("lineSep", "\n\n").text(f"{path}/batch={number:012d}")

    return write


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of the records that record_writer wrote, with the number of their batch."""
    lines = spark.read.option("lineSep", "\n\n").text(path)
    return lines.select("batch", F.from_json(sse_data(F.col("value")), schema).alias("e")).select("batch", "e.*")


def run_once(stream: DataFrame, state: str, name: str | None = None, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, wait_s: int | None = None) -> None:
    """Run a stream over all that is there and stop: into a memory table, a sink, or Parquet under path.
    It takes as long as it takes, unless wait_s says how many seconds at most."""
    with with_state(stream.sparkSession):
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True)
        if sink is not None:
            query = writer.foreachBatch(sink).start()
        elif path is not None:
            query = writer.format("parquet").option("path", path).start()
        else:
            query = writer.format("memory").queryName(name).start()
        if wait_s is None:
            query.awaitTermination()
        elif not query.awaitTermination(wait_s):
            query.stop()
            raise TimeoutError(f"the stream took more than {wait_s} s")
