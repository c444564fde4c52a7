"""Runs: maximal periodic stretches of a text's words, by Main and Lorentz's divide and conquer.

Words are interned as whole numbers. A segment is halved, and the repetitions that cross its middle
are read off two Z-functions: of the right half followed by the segment, and of both reversed. With
f(q) words that agree after the middle and after a point q words from it, and b(q) before them, a
stretch of q + b + f words has period q; it is a repetition where b + f >= q. One that a neighbouring
word extends past its segment crosses the middle of a segment above and is found there whole, so
each run comes up where it first fits, and an interval keeps its smallest period.

A run of L >= max(12, 2q) words holds equal windows of GRAM words q apart at L - q >= GRAM words or
more, and such windows cover it. So only stretches that repeated windows cover are searched; no run
is lost, and most texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Words of a run at least.
LEAST = 12
#: Words of the windows that every run holds twice or more, and covers itself with.
GRAM = LEAST // 2
#: Bytes of texts sent back at a time, about.
BATCH_BYTES = 8 << 20

RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def z_values(s: list[int], at: list[int]) -> dict[int, int]:
    """Lengths of the common prefix of s and s[i:], for i in at: ascending, all with s[i] == s[0]."""
    n, left, right = len(s), 0, 0
    z: dict[int, int] = {}
    for i in at:
        k = 0
        if i < right:
            k = min(right - i, z.get(i - left, 0))
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _agreeing(half: np.ndarray, whole: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
    """For q > 0: words in which half agrees with itself from q on, and with whole from q before the
    place where half begins in it (it ends whole). Zeros are left out."""
    joined = np.concatenate([half, [-1], whole])
    n, end = len(half), len(half) + 1 + len(whole) - len(half)
    z = z_values(joined.tolist(), (np.flatnonzero(joined[1:end] == half[0]) + 1).tolist())
    within = {i: k for i, k in z.items() if i < n}
    return within, {end - i: k for i, k in z.items() if i > n}


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers (not negative), by start and period."""
    found: dict[tuple[int, int], int] = {}
    for lo, hi in _stretches(words):
        _search(words, lo, hi, found)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _stretches(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Longest stretches covered by windows of GRAM words that come twice or more."""
    n = len(words) - GRAM + 1
    if n <= LEAST - GRAM:
        return
    codes, key = mix(words + 1), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[GRAM : GRAM + n] -= again
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    starts, ends = np.flatnonzero(~covered[:-1] & covered[1:]), np.flatnonzero(covered[:-1] & ~covered[1:])
    wide = ends - starts >= LEAST
    yield from zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)


def _search(words: np.ndarray, lo: int, hi: int, found: dict[tuple[int, int], int]) -> None:
    """Runs within words[lo:hi]: into found, (start, end) to smallest period."""
    n, todo = len(words), [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        part = words[lo:hi]
        right, left = part[mid - lo :], part[: mid - lo][::-1]
        after_right, after_left = _agreeing(right, part)
        before_left, before_right = _agreeing(left, part[::-1])
        for after, before, of in ((after_left, before_left, -1), (after_right, before_right, 0)):
            for q in after.keys() | before.keys():
                f, b = after.get(q, 0), before.get(q, 0)
                if f + b < q or q + b + f < LEAST:
                    continue
                start = mid + of * q - b
                end = start + q + b + f
                if start and words[start - 1] == words[start - 1 + q] or end < n and words[end] == words[end - q]:
                    continue
                if q < found.get((start, end), n):
                    found[start, end] = q


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words, joined by blanks, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def repeated_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of docs with runs (start, length and period, by start and period) and collapsed:
    the words joined by blanks, without those that a run holds after its first period.

    Words are stretches without ASCII white space. A row is a task's own work, so nothing is shuffled
    and no group is gathered. A NULL, empty or blank text has no runs and an empty `collapsed`; a very
    long text costs n log n and memory in proportion to itself; where periods share an interval (ties),
    the smallest stays; repeated rows come back each; no rows give none; columns of docs that are not in
    `keep` are left out, and those in it named `runs` or `collapsed` are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts, size, begun = [], [], 0, 0

            def cut(end: int) -> pa.RecordBatch:
                part = batch.slice(begun, end - begun)  # noqa: B023
                new = [pa.array(found, RUN), pa.array(texts, pa.binary())]  # noqa: B023
                return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], [*kept, "runs", "collapsed"])

            for k, value in enumerate(batch.column("_text")):
                words = (value.as_py() or b"").split()
                number: dict[bytes, int] = {}
                runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(collapsed(words, runs))
                size += len(texts[-1])
                if size > BATCH_BYTES:
                    yield cut(k + 1)
                    found, texts, size, begun = [], [], 0, k + 1
            if begun < batch.num_rows:
                yield cut(batch.num_rows)

    kept = [c for c in keep if c not in ("runs", "collapsed")]
    plain = docs.select(F.col(f"`{text}`").cast("binary").alias("_text"), *(F.col(f"`{c}`") for c in kept))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "_text"]
    schema = ", ".join([*fields, "runs array<struct<start:long,length:long,period:long>>", "collapsed binary"])
    return plain.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
