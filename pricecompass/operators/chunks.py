"""Order-dependent folds over a key, run in parallel.

Rows are range-partitioned by (key, order): a hot key spans many tasks. Each task says what its piece
of a key would make of any state that comes in; a row or a few a piece then go through the pieces
in order, which gives the state that comes into each.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Confidences that the fold in pieces tries, at most.
MOST_LEVELS = 1_000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and driver and
    executors are one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="staging-"))
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows in range partitions by (key, order), with the number of their partition as piece."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.col(key).asc_nulls_last(), *order)
    return staged(ranged.withColumn("piece", F.spark_partition_id()), "pieces")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with pos, their place from 1 in the order of a column: range partitions are numbered each,
    and start where those before them end."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(rows.repartitionByRange(n, order).withColumn("piece", F.spark_partition_id()), "numbered")
    sizes = cut.groupBy("piece").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("piece", before.alias("before")))  # a row a partition
    own = F.row_number().over(Window.partitionBy("piece").orderBy(order))
    return cut.withColumn("own", own).join(starts, "piece").withColumn("pos", F.col("before") + F.col("own")).drop("piece", "own", "before")


def by_piece(frame: DataFrame, key: str, order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each piece of each key, its rows in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(order, kind="stable"))

    return frame.groupBy(key, "piece").applyInPandas(run, schema)


def best_of(confidence: np.ndarray, price: np.ndarray, start: int, tolerance: float) -> int:
    """Where the fold ends that begins with row `start` as the best: a row replaces it that is surer
    by more than the tolerance, or cheaper within it."""
    at = start
    while True:
        c, p = confidence[at + 1 :], price[at + 1 :]
        gap = c - confidence[at]
        beats = (gap > tolerance) | ((np.abs(gap) <= tolerance) & (p < price[at]))
        if not beats.any():
            return at
        at += 1 + int(beats.argmax())


def _streamed(rows: DataFrame, fields: list[str], tolerance: float) -> DataFrame:
    """The fold's best row of each domain, each domain read in order by one task that holds a batch at a time."""
    plain = rows.select("domain", "confidence", "price", *(F.col(f"at.{f}").alias(f"_{f}") for f in fields))
    names = [f"_{f}" for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for batch in batches:
            for _, group in batch.groupby("domain", dropna=False, sort=False):
                if best is not None:
                    if _same(best.domain.iloc[0], group.domain.iloc[0]):
                        group = pd.concat([best, group])
                    else:
                        yield best[["domain", *names]]
                at = best_of(group.confidence.to_numpy(), group.price.to_numpy(), 0, tolerance)
                best = group.iloc[[at]]
        if best is not None:
            yield best[["domain", *names]]

    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    sorted_ = plain.repartition("domain").sortWithinPartitions("domain", *names)
    ends = sorted_.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("domain", *names)))
    at = F.struct(*(F.col(n).alias(f) for n, f in zip(names, fields, strict=True)))
    ends = ends.select(F.col("domain").alias("_d"), at.alias("_at"))
    picked = rows.join(ends, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("at") == F.col("_at")))
    return picked.drop("_d", "_at").dropDuplicates(["domain"])


def _same(a: str | None, b: str | None) -> bool:
    return (pd.isna(a) and pd.isna(b)) or a == b


def best_listings(rows: DataFrame, tolerance: float) -> DataFrame:
    """The fold's best row of each domain: rows have domain, at (struct of their order), confidence,
    price and others.

    A piece meets an incoming best of each confidence that occurs at all (a small set: it comes of
    few tokens): either a much surer row replaces it, whatever it costs, or one of the ever cheaper
    rows within the tolerance, the first that is cheaper than the incoming one. Where more than
    MOST_LEVELS confidences occur, each domain is one sorted stream instead. Ties in price keep the
    earlier row; a NULL domain is a domain; at holds no NULL; no rows give none.
    """
    fields = [f.name for f in rows.schema["at"].dataType.fields]
    keyed = pieces(rows, "domain", [f"at.{f}" for f in fields])
    levels = [float(r[0]) for r in keyed.select("confidence").distinct().limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        return _streamed(keyed.drop("piece"), fields, tolerance)
    flat = keyed.select("domain", "piece", "confidence", "price", *(F.col(f"at.{f}").alias(f"_{f}") for f in fields))
    names = [f"_{f}" for f in fields]
    kinds = ", ".join(f"_{f.name} {f.dataType.simpleString()}" for f in rows.schema["at"].dataType.fields)
    columns = ["domain", "piece", "level", "step", "below", "confidence", "price", *names]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        c, p = pdf.confidence.to_numpy(), pdf.price.to_numpy()
        ends: dict[int, int] = {}
        out = []

        def add(level: float, step: int, below: float, row: int) -> None:
            if row not in ends:
                ends[row] = best_of(c, p, row, tolerance)
            end = ends[row]
            key = (pdf.domain.iloc[0], int(pdf.piece.iloc[0]), level, step, below)
            out.append((*key, float(c[end]), int(p[end]), *(pdf[n].iloc[end] for n in names)))

        add(-1.0, 0, -np.inf, 0)  # no best so far
        for level in levels:
            gap = c - level
            surer = np.flatnonzero(gap > tolerance)
            stop = int(surer[0]) if len(surer) else len(c)
            near = np.flatnonzero(np.abs(gap[:stop]) <= tolerance)
            low = np.minimum.accumulate(p[near])
            record = near[np.concatenate([[True], low[1:] < low[:-1]])] if len(near) else near
            for k, row in enumerate(record):
                add(level, k, float(p[row]), int(row))
            if stop < len(c):
                add(level, len(record), -np.inf, stop)
        return pd.DataFrame(out, columns=columns)

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        best, level, price = 0, -1.0, 0.0
        for _, piece in pdf.sort_values(["piece", "step"]).groupby("piece"):
            hit = piece[(piece.level == level) & (piece.below < price)]
            if len(hit):
                best = hit.index[0]
                level, price = pdf.confidence[best], float(pdf.price[best])
        return pdf.loc[[best], ["domain", *names]]

    schema = f"domain string, piece int, level double, step int, below double, confidence double, price long, {kinds}"
    steps = by_piece(flat, "domain", names, summary, schema)
    ends = steps.groupBy("domain").applyInPandas(through, f"domain string, {kinds}")
    ends = ends.select(F.col("domain").alias("_d"), F.struct(*(F.col(n).alias(f) for n, f in zip(names, fields, strict=True))).alias("_at"))
    picked = keyed.join(ends, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("at") == F.col("_at")))
    return picked.drop("piece", "_d", "_at").dropDuplicates(["domain"])


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a time column; of one without zone, as if in UTC."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def anchored_windows(events: DataFrame, key: str, ts: str, tie: str, width_us: int) -> DataFrame:
    """events with start (microseconds) of the window each is in, and nth, its place in it from 0.

    A window of a key begins with the first event outside the one before, and ends width_us later,
    exclusive: it isn't aligned to the clock. A piece gives, for each event at which a window may
    begin in it, the last window that follows; pieces then hand on their last window in order.
    Events of a key at the same time are in the order of tie; a NULL time takes no part.
    """
    rows = events.where(F.col(ts).isNotNull()).withColumn("us", micros(events, ts))
    cut = pieces(rows, key, ["us"])

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        us = pdf.us.to_numpy()
        nxt = np.searchsorted(us, us + width_us)
        last = np.where(nxt < len(us), nxt, np.arange(len(us)))
        while (further := last[last] != last).any():  # twice as many windows ahead each time
            last = np.where(further, last[last], last)
        first = int(np.searchsorted(us, us[0] + width_us))  # a window from before ends by then
        may = np.flatnonzero(np.concatenate([[True], us[1:] != us[:-1]]))
        may = may[may <= first]
        change = np.flatnonzero(np.concatenate([[True], last[may[1:]] != last[may[:-1]]]))
        upto = us[may[np.concatenate([change[1:] - 1, [len(may) - 1]])]]
        to = last[may[change]]
        return pd.DataFrame({"k": pdf.k.iloc[0], "piece": pdf.piece.iloc[0], "upto": upto, "last": us[to], "n": len(us) - to, "end": us[-1], "total": len(us)})

    flat = cut.select(F.col(key).alias("k"), "piece", "us")
    kind = dict(flat.dtypes)["k"]
    steps = by_piece(flat, "k", ["us"], entries, f"k {kind}, piece int, upto long, last long, n long, end long, total long")

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        start, count, out = None, 0, []
        for piece, rows in pdf.sort_values(["piece", "upto"]).groupby("piece"):
            out.append((pdf.k.iloc[0], int(piece), start, count))
            total, end = int(rows.total.iloc[0]), int(rows.end.iloc[0])
            if start is not None and end < start + width_us:
                count += total  # the whole piece is in the window that is open
                continue
            reset = -(2**62) if start is None else start + width_us
            hit = rows[rows.upto >= reset].iloc[0]
            start, count = int(hit["last"]), int(hit["n"])
        return pd.DataFrame(out, columns=["k", "piece", "start", "count"]).astype({"start": "Int64"})

    states = steps.groupBy("k").applyInPandas(through, f"k {kind}, piece int, start long, count long")
    states = states.select(F.col("k").alias("_k"), F.col("piece").alias("_p"), F.col("start").alias("_start"), F.col("count").alias("_count"))
    names = [f.name for f in cut.schema]
    joined = cut.join(states, F.col(key).eqNullSafe(F.col("_k")) & (F.col("piece") == F.col("_p"))).drop("_k", "_p")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        us = pdf.us.to_numpy()
        came, count = pdf._start.iloc[0], int(pdf._count.iloc[0])
        start, nth = np.zeros(len(us), np.int64), np.zeros(len(us), np.int64)
        i = 0
        if not pd.isna(came):
            i = int(np.searchsorted(us, int(came) + width_us))
            start[:i], nth[:i] = int(came), count + np.arange(i)
        while i < len(us):
            j = int(np.searchsorted(us, us[i] + width_us))
            start[i:j], nth[i:j] = us[i], np.arange(j - i)
            i = j
        return pdf[names].assign(start=start, nth=nth)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema), "start long, nth long"])
    return by_piece(joined, key, ["us", tie], place, schema).drop("piece")
