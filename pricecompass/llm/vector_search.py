"""Exact top-k search by inner product with a pivot-distance index.

Whole-number vectors are lifted by one coordinate to a common length, after which the largest inner
product is the smallest distance: |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its
nearest pivot and its distance to it, and a pivot's vectors are cut into annuli by that distance. A
query sorts all annuli by the least distance that the triangle inequality leaves their vectors, and
expands them in that order, more in each round. Its k-th score so far is a radius: once the next
annulus lies beyond it, the query is done.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounds, shuffle_parts, staged

SCALE = 64
K = 20
#: Pivots grow with the square root of the table up to so many; so do the vectors they are drawn from.
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Steps of the distance to a pivot that annuli are made of.
STEPS = 512
#: Vectors of an annulus, about; at most ANNULI of them, so what is broadcast has a bound.
BLOCK, ANNULI = 256, 1 << 16
#: Vectors of an annulus that are searched at a time.
PIECE = 4096
#: Annuli that a query expands in its first round; each next round takes GROWTH times as many.
FIRST, GROWTH = 4, 4
#: Queries scored at a time.
TOGETHER = 256


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(SCALE * x) of each component; vectors that are NULL, have a NULL id or a
    component that is NULL or not finite take no part."""
    ok = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return vectors.where(ok & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long")).alias("v"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """v with the coordinate that makes every vector `longest` long (squared)."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0))[:, None]])


def products(q: np.ndarray, v: np.ndarray, longest: float) -> np.ndarray:
    """Inner products of whole numbers, exact: in floating point while no sum of them leaves its 53
    bits, else in 64-bit integers, else in Python's. What a long can't hold is cut to its ends."""
    if longest < 2**52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if longest < 2**62:
        return q @ v.T
    most = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ v.astype(object).T, most.min, most.max).astype(np.int64)


class Annuli(NamedTuple):
    """Annuli of all pivots: pivot, number within it, distances, pieces; small and sent with the tasks."""

    pivot: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pieces: np.ndarray


class Index:
    """Pivots, drawn from a bounded sample, and how a distance becomes a step."""

    def __init__(self, vectors: DataFrame) -> None:
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.n, longest = vectors.agg(F.count("*"), F.max(size)).first()
        self.longest = float(longest or 0) * (1 + 1e-9)
        rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).select("v").collect()
        self.pivots, self.step = np.zeros((0, 0)), 1.0
        if rows:
            sample = _lifted(np.array([r.v for r in rows], np.int64), self.longest)
            most = min(PIVOTS, len(sample), max(8, int(self.n**0.5 / 2)))
            chosen = [0]  # far from each other: each next pivot is the farthest from those before
            gap = np.linalg.norm(sample - sample[0], axis=1)
            while len(chosen) < most and gap.max() > 0:
                chosen.append(int(gap.argmax()))
                gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
            self.pivots = sample[chosen]
            self.step = max(float(self.gaps(sample).min(1).max()), 1e-6) / STEPS

    def gaps(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def place(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, distance to it, its step (those beyond the sample's farthest share the last)."""
        gap = self.gaps(lifted)
        pivot = gap.argmin(1)
        gap = gap[np.arange(len(gap)), pivot]
        return pivot.astype(np.int32), gap, np.minimum(gap / self.step, STEPS).astype(np.int32)

    def visits(self, q: np.ndarray, kth: np.ndarray, have: np.ndarray, annuli: Annuli) -> tuple[np.ndarray, np.ndarray]:
        """For each query the annuli in order of the least distance left to their vectors, and how many
        of them lie within the radius of its k-th score (all, where it has none)."""
        d = self.gaps(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]))
        scale = (q.astype(np.float64) ** 2).sum(1) + self.longest
        least = np.maximum(d[:, annuli.pivot] - annuli.high[None], annuli.low[None] - d[:, annuli.pivot])
        least = np.maximum(least, (d[:, annuli.pivot] - d.min(1)[:, None]) / 2)  # nearest pivots part the space
        order = np.argsort(least, axis=1, kind="stable")
        # distances are floating-point: the radius is widened, scores stay whole numbers
        radius = np.sqrt(np.maximum(scale - 2 * kth.astype(np.float64), 0)) + 1e-7 * np.sqrt(scale) + 1e-6
        within = (least <= np.where(have, radius, np.inf)[:, None]).sum(1)
        return order, within


def _annuli(steps: DataFrame, n: int) -> DataFrame:
    """(pivot, step, ring): neighbouring steps of a pivot gathered to annuli. steps has a row for each
    pivot and step at most."""
    size = max(BLOCK, -(-n // ANNULI))
    before = Window.partitionBy("pivot").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.select("pivot", "step", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size).cast("int").alias("ring"))


def top_k(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each row where `queries`
    holds, that row itself left out.

    Vectors and ids that are NULL, and components that are NULL or not finite, take no part. Ties go
    to the smaller id. Rows of one id are rows of their own: a repeated row is found as often as it
    comes, and finds its own copies; as a query it answers once. Vectors of unequal length are filled
    up with zeros. Components that 64 bits can't hold, and scores, are cut to the ends of a long.
    Fewer than k candidates are all returned; no rows give none; other columns are ignored.
    """
    return _search(vectors, queries, k)[0]


def _search(vectors: DataFrame, queries: Column, k: int) -> tuple[DataFrame, dict[str, int]]:
    """top_k's rows, and how many annuli there are, queries, and annuli that queries expanded."""
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors)
    long = numbers.agg(F.max(F.size("v"))).first()[0] or 0
    filled = numbers.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(long) - F.size("v"))))
    plain = filled.groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("row", F.monotonically_increasing_id())
    plain = staged(plain, "vectors")
    index = Index(plain)
    if not index.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), {"annuli": 0, "queries": 0, "visited": 0}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                found = index.place(_lifted(_matrix(b.column("v")), index.longest))
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found)], [*b.schema.names, "pivot", "gap", "step"])

    shape = "vec_id long, v array<long>, n long, row long"
    placed = staged(plain.mapInArrow(place, f"{shape}, pivot int, gap double, step int"), "placed")
    rings = _annuli(placed.groupBy("pivot", "step").agg(F.count("*").alias("n")), index.n)
    ringed = placed.join(F.broadcast(rings), ["pivot", "step"]).drop("step")
    extent = ringed.groupBy("pivot", "ring").agg(
        F.min("gap").alias("low"), F.max("gap").alias("high"), F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")
    )
    of = extent.toArrow().sort_by([("pivot", "ascending"), ("ring", "ascending")])  # ANNULI + PIVOTS rows at most
    annuli = Annuli(*(of.column(c).to_numpy() for c in ("pivot", "ring", "low", "high", "pieces")))
    piece = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")  # a crowded annulus is searched in pieces
    blocks = ringed.join(F.broadcast(extent.select("pivot", "ring", "pieces")), ["pivot", "ring"])
    tile = ["pivot", "ring", "piece"]
    blocks = staged(blocks.withColumn("piece", piece).select(*tile, "row", "vec_id", "v", "n").repartition(shuffle_parts(spark), *tile), "index")
    asked = staged(plain.where(queries).select("vec_id", "v", "row").repartition(shuffle_parts(spark), "row"), "queries")

    def visit(first: int, last: int):
        """Tiles that the next annuli of each query make: places first to last in its order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, len(b), 64):
                    part = b.slice(at, 64)
                    order, within = index.visits(
                        _matrix(part.column("v")), part.column("kth").fill_null(0).to_numpy(), part.column("kth").is_valid().to_numpy(False), annuli
                    )
                    each = [order[i, first : min(last, w)] for i, w in enumerate(within)]
                    q = np.repeat(np.arange(len(each)), [len(x) for x in each])
                    cell = np.concatenate(each) if each else np.zeros(0, np.int64)
                    pieces = annuli.pieces[cell]
                    q, cell = np.repeat(q, pieces), np.repeat(cell, pieces)
                    nth = np.arange(len(q)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    cols = [annuli.pivot[cell], annuli.ring[cell], nth.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, cols), *(part.column(c).take(pa.array(q)) for c in ("row", "vec_id", "v", "kth"))],
                        [*tile, "row", "vec_id", "v", "kth"],
                    )

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best of each query in a tile; of a tile the vectors come first, PIECE or so, then the queries."""
        now, v, ids, n, row = None, None, None, None, None
        for b in batches:
            if not len(b):
                continue
            at = {c: b.column(c).to_numpy() for c in (*tile, "asks")}
            cut = np.unique(np.concatenate([bounds(at[c]) for c in at]))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                part = b.slice(lo, hi - lo)
                name = tuple(int(at[c][lo]) for c in tile)
                if not at["asks"][lo]:
                    cols = [_matrix(part.column("v")), *(part.column(c).to_numpy() for c in ("vec_id", "n", "row"))]
                    if name == now:
                        cols = [np.concatenate(x) for x in zip((v, ids, n, row), cols, strict=True)]
                    now, (v, ids, n, row) = name, cols
                    continue
                if name != now:
                    continue
                by = np.argsort(ids, kind="stable")
                for k0 in range(0, len(part), TOGETHER):
                    some = part.slice(k0, TOGETHER)
                    yield best(some, v[by], ids[by], n[by], row[by])

    def best(some: pa.RecordBatch, v: np.ndarray, ids: np.ndarray, n: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        s = products(_matrix(some.column("v")), v, index.longest)
        left = np.broadcast_to(n, s.shape) - (some.column("row").to_numpy()[:, None] == row[None])  # copies but the query itself
        keep = (left > 0) & (s >= some.column("kth").fill_null(-(2**63)).to_numpy()[:, None])
        # ties to the smaller id: the sort is stable over ids
        order = np.argsort(~np.where(keep, s, np.iinfo(np.int64).min), axis=1, kind="stable")[:, :k]
        hit = np.take_along_axis(keep, order, 1)
        q, c = np.nonzero(hit)
        at = order[q, c]
        cols = [some.column("row").to_numpy()[q], some.column("vec_id").to_numpy()[q], ids[at], s[q, at], np.minimum(left[q, at], k)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["row", "query_id", "vec_id", "score", "copies"])

    nth = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    top, first, many, visited = None, 0, FIRST, 0
    while True:
        if top is None:
            waiting = asked.withColumn("kth", F.lit(None).cast("long"))
        else:
            kth = top.where(F.col("rank") == k).select("row", F.col("score").alias("kth"))
            waiting = asked.join(kth, "row", "left")
        found = staged(waiting.mapInArrow(visit(first, first + many), f"{', '.join(f'{c} int' for c in tile)}, row long, vec_id long, v array<long>, kth long"), "visits")
        more = found.count()
        if not more:
            break
        visited += more
        no = F.lit(None).cast("long")
        met = F.broadcast(found.select("pivot", "ring").distinct())  # ANNULI + PIVOTS rows at most
        both = blocks.join(met, ["pivot", "ring"], "left_semi").select(*tile, F.lit(0).alias("asks"), "row", "vec_id", "v", "n", no.alias("kth")).unionByName(
            found.select(*tile, F.lit(1).alias("asks"), "row", "vec_id", "v", no.alias("n"), "kth")
        )
        ordered = both.repartition(shuffle_parts(spark), *tile).sortWithinPartitions(*tile, "asks")
        scored = ordered.mapInArrow(score, "row long, query_id long, vec_id long, score long, copies long")
        each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
        if top is not None:
            each = each.unionByName(top.drop("rank"))
        top = staged(each.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k), "top")
        first, many = first + many, many * GROWTH
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), {"annuli": 0, "queries": 0, "visited": 0}
    return top.select("query_id", "rank", "vec_id", "score"), {"annuli": len(annuli.pivot), "queries": asked.count(), "visited": visited}


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT min(r) AS r, vec_id, v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, v) q, v c WHERE c.r <> q.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
