"""Product codes of vectors: Lloyd's rounds in whole numbers, with Hamerly's bounds.

A vector becomes floor(SCALE * x) and is cut into PARTS equal parts; each part position has a codebook
of ENTRIES. A round assigns every part to its nearest entry (squared distance, ties to the lower
index) and moves each entry to the floor of its parts' mean. Per part one upper bound on the distance
to its own entry and one lower bound on that to the second nearest are kept in a table from round to
round: entries that move by m change them by m at most. Where the upper bound lies strictly below the
lower one (or below half the way to the entry's nearest other), the entry is the only nearest one and
the part isn't looked at; else its distance is taken anew, and if that isn't enough, all entries are
scanned in whole numbers.

Vectors stay where they are: a round reads the table and writes its successor, and only sums of a
fixed size (an entry's components, a task each) are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, spread_join, staged

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bounds are held in floating point; each is moved outward by so much of itself, far above rounding.
SLACK = 1e-9
_MOST = np.iinfo(np.int64)

#: Sums of a part's entry, as the text of whole numbers of any size.
_SUMS = "part int, entry int, position int, total decimal(38,0), n long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): floor(SCALE * x) of each component, what a long can't hold cut to its ends;
    vectors that are NULL or hold NULL or non-finite components are dropped."""
    ok = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    whole = lambda x: F.floor(F.least(F.greatest(SCALE * x.cast("double"), F.lit(-(2.0**62))), F.lit(2.0**62)))
    return vectors.where(ok).select("vec_id", "label", F.transform("embedding", lambda x: whole(x).cast("long")).alias("v"))


class Codebooks:
    """Entries of each part position (parts, entries, width), whole numbers; fixed in size, sent with tasks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.largest = int(np.abs(entries).max(initial=0))

    def squares(self, v: np.ndarray, part: int, at: np.ndarray | None = None) -> np.ndarray:
        """Squared distances of rows to all entries of a part, or to one each; exact, in Python's whole
        numbers where 64 bits might not do."""
        c = self.entries[part] if at is None else self.entries[part][at]
        reach = self.largest + int(np.abs(v).max(initial=0))
        if reach * reach * max(v.shape[1], 1) >= 2**62:
            v, c = v.astype(object), c.astype(object)
        d = v[:, None, :] - c[None] if at is None else v - c
        return (d * d).sum(-1)

    def spacing(self) -> np.ndarray:
        """(parts, entries): half the distance to the nearest other entry, rounded down; 0 for one that
        stands alone, so that it is looked at."""
        half = np.zeros(self.entries.shape[:2])
        for p, own in enumerate(self.entries):
            if len(own) > 1:
                d = np.sqrt(self.squares(own, p).astype(np.float64))
                np.fill_diagonal(d, np.inf)
                half[p] = d.min(1) / 2 * (1 - SLACK)
        return half

    def moved(self, to: Codebooks) -> np.ndarray:
        """(parts, entries): how far each entry moves, rounded up."""
        d = to.entries.astype(np.float64) - self.entries.astype(np.float64)
        return np.sqrt((d * d).sum(-1)) * (1 + SLACK)

    def next(self, sums: DataFrame) -> Codebooks:
        """Each entry moved to the floor of its parts' mean; entries without parts stay."""
        entries = self.entries.copy()
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            entries[r.part, r.entry, r.position] = int(r.total) // r.n
        return Codebooks(entries)


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _parts(v: np.ndarray, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width), the last part filled up with zeros."""
    return np.pad(v, ((0, 0), (0, parts * width - v.shape[1]))).reshape(len(v), parts, width)


def assign(v: np.ndarray, books: Codebooks, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> int:
    """Nearest entries of all parts into `at`, with their bounds; v is (rows, parts, width). Gives the
    number of parts that were scanned in full."""
    scanned = 0
    for p in range(v.shape[1]):
        least = np.maximum(lower[:, p], half[p][at[:, p]])
        open_ = np.flatnonzero(~(upper[:, p] < least))
        if len(open_):
            own = np.sqrt(books.squares(v[open_, p], p, at[open_, p]).astype(np.float64))
            upper[open_, p] = own * (1 + SLACK)
            open_ = open_[~(upper[open_, p] < least[open_])]
        if len(open_):
            scanned += len(open_)
            d = books.squares(v[open_, p], p)
            at[open_, p] = first = d.argmin(1)  # the lowest index of equal ones
            rows = np.arange(len(open_))
            upper[open_, p] = np.sqrt(d[rows, first].astype(np.float64)) * (1 + SLACK)
            d[rows, first] = d.max(1) + 1
            second = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)
            lower[open_, p] = second if d.shape[1] > 1 else np.inf
    return scanned


def loosen(at: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> None:
    """Bounds after the entries moved by drift: the upper one rises by its own entry's move, the lower
    one falls by the largest move of another."""
    for p in range(drift.shape[0]):
        moves, own = drift[p], at[:, p]
        upper[:, p] = (upper[:, p] + moves[own]) * (1 + SLACK)
        order = np.argsort(moves)
        others = np.where(own == order[-1], moves[order[-2]] if len(moves) > 1 else 0.0, moves[order[-1]])
        lower[:, p] = np.maximum(lower[:, p] - others, 0) * (1 - SLACK)


def _add(sums: np.ndarray, counts: np.ndarray, v: np.ndarray, at: np.ndarray) -> None:
    """Parts added to their entries' sums (parts, entries, width), Python's whole numbers."""
    small = int(np.abs(v).max(initial=0)) * len(v) < 2**62
    for p in range(v.shape[1]):
        order = np.argsort(at[:, p], kind="stable")
        entry, starts, n = np.unique(at[order, p], return_index=True, return_counts=True)
        counts[p, entry] += n
        sums[p, entry] += np.add.reduceat(v[order, p] if small else v[order, p].astype(object), starts).astype(object)


_STATE = [("_at", pa.list_(pa.int32())), ("_upper", pa.list_(pa.float64())), ("_lower", pa.list_(pa.float64()))]
_STATE_DDL = "_at array<int>, _upper array<double>, _lower array<double>"


def _listed(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(a.ravel(), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), flat)


def _round(books: Codebooks, drift: np.ndarray | None, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the bounds of the round before (drift: how far entries moved since; None: there are
    none yet) to batches with this round's."""
    half = books.spacing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _parts(_matrix(b.column("v"), np.int64), len(half), width)
            if drift is None:
                at = np.zeros(v.shape[:2], np.int64)
                upper, lower = np.full(at.shape, np.inf), np.zeros(at.shape)
            else:
                at = _matrix(b.column("_at"), np.int64).copy()
                upper, lower = _matrix(b.column("_upper"), np.float64).copy(), _matrix(b.column("_lower"), np.float64).copy()
                loosen(at, upper, lower, drift)
            assign(v, books, at, upper, lower, half)
            kept = [n for n in b.schema.names if not n.startswith("_")]
            state = [_listed(a, kind) for a, (_, kind) in zip((at, upper, lower), _STATE, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *state], [*kept, *(n for n, _ in _STATE)])

    return run


def _sums(parts: int, entries: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's parts summed by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.full((parts, entries, width), 0, object), np.zeros((parts, entries), np.int64)
        for b in batches:
            if b.num_rows:
                _add(sums, counts, _parts(_matrix(b.column("v"), np.int64), parts, width), _matrix(b.column("_at"), np.int64))
        p, e = np.nonzero(counts)
        where = np.arange(width)
        columns = [
            pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()), pa.array(np.tile(where, len(p)), pa.int32()),
            pa.array([Decimal(int(x)) for x in sums[p, e].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(counts[p, e], width)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "total", "n"])

    return run


def _coded(books: Codebooks, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = _matrix(b.column("_at"), np.int64)
            v = _parts(_matrix(b.column("v"), np.int64), at.shape[1], width)
            error = sum(books.squares(v[:, p], p, at[:, p]).astype(object) for p in range(at.shape[1]))
            codes = ["".join(f"{x:02x}" for x in row) for row in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(codes), pa.array([min(int(x), _MOST.max) for x in error], pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    return run


def codebooks_text(books: Codebooks, dims: int) -> str:
    """All entries' components by part, entry and position within the part, joined by commas; those that
    only fill up the last part are left out."""
    parts, entries, width = books.entries.shape
    return ",".join(str(x) for p in range(parts) for e in range(entries) for x in books.entries[p, e, : max(min(width, dims - p * width), 0)].tolist())


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks, str]:
    """(vec_id, label, code, error) of each kept row of (vec_id, embedding, label), the codebooks, and
    their text.

    Rows whose vector is NULL or holds NULL or non-finite components are dropped. The first codebook is
    the parts of the `entries` smallest vec_ids; of equal ids the smaller vector comes first, NULL ids
    come last; with fewer rows there are fewer entries. A length that `parts` doesn't divide is filled
    up with zeros; rows whose vector has another length than the first's can't be coded and come back
    with a NULL code and error. A very long vector is a row like any other; an error beyond a long is
    cut to its end; repeated rows come back each; no rows give none; extra columns are left out.
    """
    whole = staged(whole_vectors(vectors), "vectors")
    seeds = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not seeds or not len(seeds[0].v):
        none = whole.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, Codebooks(np.zeros((parts, 0, 0), np.int64)), ""
    dims = len(seeds[0].v)
    width = -(-dims // parts)
    first = np.array([r.v for r in seeds if len(r.v) == dims], np.int64)
    books = Codebooks(_parts(first, parts, width).transpose(1, 0, 2).copy())
    here = F.size("v") == dims
    state, drift = whole.where(here), None
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    for k in range(rounds + 1):
        table = staged(state.mapInArrow(_round(books, drift, width), f"{kinds}, {_STATE_DDL}"), f"bounds{k}")
        if k:
            drop_staged(state)
        state = table
        if k < rounds:
            moved = books.next(state.select("v", "_at").mapInArrow(_sums(parts, len(first), width), _SUMS))
            books, drift = moved, books.moved(moved)
    coded = state.select("vec_id", "label", "v", "_at").mapInArrow(_coded(books, width), f"vec_id {dict(whole.dtypes)['vec_id']}, label {dict(whole.dtypes)['label']}, code string, error long")
    odd = whole.where(~here).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(odd), books, codebooks_text(books, dims)


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: error summed over rows of an equal label, those without one together; what
    a long can't hold is cut to its end. A label with a third of all rows is dealt over salts."""
    key = F.when(F.col("label").isNull(), "none").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    table = staged(coded.withColumn("_label", key), "coded")
    total: Column = F.sum(F.col("error").cast("decimal(20,0)"))
    sums = table.groupBy("_label").agg(F.least(total, F.lit(_MOST.max).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return spread_join(table, sums, "_label").drop("_label")


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """SQL of the same rounds without bounds, for vectors of one length that `parts` divides."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, c.e, list_sum(list_transform(list_zip(x.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x JOIN c{k} c ON x.p = c.p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (
  SELECT p, e, i, sum(y)::HUGEINT AS s, count(*) AS n
  FROM (SELECT x.p, a.e, generate_subscripts(x.w, 1) AS i, unnest(x.w) AS y FROM x JOIN a{k} a ON a.r = x.r AND a.p = x.p) GROUP BY p, e, i),
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.w, c.w) AS w FROM c{k} c LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM s{k} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS w FROM v, range({parts}) t(p)),
c0 AS (SELECT p, r - 1 AS e, w FROM x WHERE r <= {entries}),{",".join(steps)},
o AS (SELECT r, lower(string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p)) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT v.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN o ON o.r = v.r
"""


ORACLE = _oracle()
