"""Line dedup by pairwise alignment.

Documents overlap where they share a key: a line of at least ANCHOR_WORDS words, or two lines that
follow each other, so that lists, verse and code count too. A later text is paired with the first
text that holds a rare key of its own, then, for the common keys whose lines are still there, with
their first text, and while lines of shared keys remain with further holders, more in each round. So
a line in thousands of texts makes thousands of pairs and not their square, and no shared key is
given up before all its earlier holders were tried. A pair is aligned with patience diff; the
aligned common blocks that hold a key go from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, drop_staged, mix, shuffle_parts, spread_join, staged, text_key

ANCHOR_WORDS = 5
#: A key is rare if so many texts hold it at most; rare keys find pairs first.
RARE = 64


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, ascending in both.

    Between lines unique on both sides the search goes on; a stretch without one is aligned by the
    occurrences of its lines, the n-th on one side with the n-th on the other.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        at: dict[int, tuple[list[int], list[int]]] = {}
        for side, (lines, lo, hi) in enumerate(((a, alo, ahi), (b, blo, bhi))):
            for k in range(lo, hi):
                at.setdefault(lines[k], ([], []))[side].append(k)
        both = [v for v in at.values() if v[0] and v[1]]
        unique = [(x[0], y[0]) for x, y in both if len(x) == len(y) == 1]
        chain = _longest_rising(sorted(unique or [p for x, y in both for p in zip(x, y, strict=False)]))
        if not chain:
            continue
        out += chain
        for (i, j), (k, m) in zip([(alo - 1, blo - 1), *chain], [*chain, (ahi, bhi)], strict=True):
            if i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def _longest_rising(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of points, sorted by their first part, that rises in both."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(points):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(points[k])
        k = back[k]
    return chain[::-1]


def common_lines(earlier: list[int], later: list[int], words: list[int]) -> list[int]:
    """Lines of the later text in aligned blocks of two lines or with one of ANCHOR_WORDS words.
    Neither text has blank lines here."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if len(block) > 1 or any(words[k] >= ANCHOR_WORDS for k in block):
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def _nth(x: np.ndarray) -> np.ndarray:
    """How many equal values come before each value."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    start = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    row = np.arange(len(s))
    out = np.empty(len(s), np.int64)
    out[order] = row - np.maximum.accumulate(np.where(start, row, 0)) if len(s) else row
    return out


def keys_of(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, p, q): keys of a text without blank lines, and the first and last line each covers. The
    n-th occurrence of a line or pair of lines is a key of its own."""
    h = h.view(np.uint64)
    one = np.flatnonzero(n >= ANCHOR_WORDS)
    with np.errstate(over="ignore"):
        single = mix(h[one] + np.uint64(0x9E3779B97F4A7C15) * (_nth(h[one]).astype(np.uint64) + np.uint64(1)))
        two = mix(mix(h[:-1]) + h[1:])
        two = mix(two + np.uint64(0xBF58476D1CE4E5B9) * (_nth(two).astype(np.uint64) + np.uint64(1)))
    at = np.arange(len(two))
    return np.concatenate([single, two]).view(np.int64), np.concatenate([one, at]), np.concatenate([one, at + 1])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts, rows = [], []
        for k, (h, n) in enumerate(zip(b.column("h"), b.column("n"), strict=True)):
            found = keys_of(h.values.to_numpy(), n.values.to_numpy())
            parts.append(found)
            rows.append(np.full(len(found[0]), k))
        if parts:
            row = pa.array(np.concatenate(rows))
            key, p, q = (np.concatenate([x[k] for x in parts]) for k in range(3))
            of = [b.column(c).take(row) for c in ("t", "absent", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), *of, pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32))], ["key", "t", "absent", "doc_id", "p", "q"]
            )


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t, at = [], []
        for of, x, y, n in zip(b.column("t").to_pylist(), b.column("h1"), b.column("h2"), b.column("n2"), strict=True):
            gone = common_lines(x.values.to_pylist(), y.values.to_pylist(), n.values.to_pylist())
            t.append(np.full(len(gone), of, np.int64))
            at.append(np.array(gone, np.int32))
        if t:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)), pa.array(np.concatenate(at))], ["t", "pos"])


def aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(t, pos): the lines, counted without blank ones, that each text loses to the texts o it is paired with.
    Texts that many pairs share, on either side, are dealt over salts."""
    later = texts.select("t", F.col("h").alias("h2"), F.col("n").alias("n2"))
    earlier = texts.select(F.col("t").alias("o"), F.col("h").alias("h1"))
    met = spread_join(spread_join(pairs, earlier, "o"), later, "t", like=pairs)
    return met.select("t", "h1", "h2", "n2").mapInArrow(_align, "t long, pos int").distinct()


def _ranked(holders: DataFrame) -> DataFrame:
    """holders with rank, their place under their key from 1: range partitions split a hot key, and
    each partition adds what those before it hold of the key."""
    order = ["key", "absent", "doc_id", "t"]
    cut = holders.repartitionByRange(shuffle_parts(holders.sparkSession), *order).withColumn("part", F.spark_partition_id())
    cut = staged(cut, "holders")
    sums = cut.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("absent", "doc_id", "t"))
    joined = cut.withColumn("own", own).join(sums.select("key", "part", before.alias("before")), ["key", "part"])
    return joined.withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def _removed(texts: DataFrame) -> DataFrame:
    """(t, pos) of all lines that texts lose, blank lines not counted."""
    held = staged(
        texts.where(F.size("h") > 0).select("t", F.col("at.absent").alias("absent"), F.col("at.doc_id").alias("doc_id"), "h", "n").mapInArrow(
            _emit_keys, f"key long, t long, absent boolean, doc_id {dict(texts.select('at.doc_id').dtypes)['doc_id']}, p int, q int"
        ),
        "line-keys",
    )
    place = F.struct("absent", "doc_id", "t")
    firsts = held.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("df")).where("df > 1")
    firsts = firsts.select("key", F.col("first.t").alias("o"), "df")
    shared = staged(spread_join(held, firsts, "key").where("o <> t"), "shared-lines")

    def there(lines: DataFrame, gone: DataFrame) -> DataFrame:
        """Lines of shared keys that aren't gone; lines gone before aren't among them."""
        return staged(lines.join(gone, ["t", "pos"], "left_anti"), "left-lines")

    tried = staged(shared.where(F.col("df") <= RARE).select("t", "o").distinct(), "line-pairs")
    gone = [staged(aligned(tried, texts), "gone-lines")]
    each = shared.select("key", "t", "o", F.explode(F.array_distinct(F.array("p", "q"))).alias("pos"))
    lines = there(each, gone[0])
    drop_staged(shared)
    pairs = staged(lines.select("t", "o").distinct().join(tried, ["t", "o"], "left_anti"), "line-pairs")
    holders, upto = None, 1
    while True:
        if not pairs.isEmpty():
            gone.append(staged(aligned(pairs, texts), "gone-lines"))
            tried, before = tried.unionByName(pairs), lines
            lines = there(before, gone[-1])
            drop_staged(before)
        if holders is None:
            if lines.isEmpty():
                break
            holders = staged(_ranked(held.join(lines.select("key").distinct(), "key", "left_semi").drop("p", "q")), "ranked-lines")
            drop_staged(held)
        own = lines.select("key", "t").distinct().join(holders.select("key", "t", "rank"), ["key", "t"])
        # the holder just before, then ever more from the front
        most = F.least(F.lit(max(2 * upto - 1, 1)), F.col("rank") - 2)
        reach = own.where(F.col("rank") > 2).select("key", "t", F.explode(F.array(F.col("rank") - 1)).alias("rank")) if upto == 1 else (
            own.where(F.col("rank") - 2 >= upto).select("key", "t", F.explode(F.sequence(F.lit(upto), most)).alias("rank"))
        )
        reach = staged(reach, "line-reach")
        if upto > 1 and reach.isEmpty():
            break
        of = holders.select("key", "rank", F.col("t").alias("o"))
        pairs = reach.join(of, ["key", "rank"]).select("t", "o").distinct().join(tried, ["t", "o"], "left_anti")
        pairs = staged(pairs, "line-pairs")
        drop_staged(reach)
        upto *= 2
    drop_staged(lines)
    return reduce(DataFrame.unionByName, gone).distinct()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a text that stay; a blank line goes with the lines around it."""
    for b in batches:
        out = []
        for blank, gone in zip(b.column("blank"), b.column("gone"), strict=True):
            blank = blank.values.to_numpy(zero_copy_only=False)
            solid = np.flatnonzero(~blank)
            goes = np.zeros(len(solid), bool)
            goes[gone.values.to_numpy()] = True
            before = np.cumsum(~blank)  # solid lines up to each line
            edge = np.concatenate([[True], goes, [True]])
            drop = np.where(blank, edge[before] & edge[before + 1] & bool(len(solid)), edge[before])
            out.append(np.flatnonzero(~drop).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(out, pa.list_(pa.int32()))], ["t", "kept"])


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with text without the blocks that an earlier document has, n_lines and n_removed.

    Documents are ordered by (doc_id, text), NULL ids last. Lines are compared without surrounding
    white space, so line ends of either kind agree; blank lines aren't aligned and go with the lines
    around them. A line goes if it is in an aligned block with any earlier text that holds one of the
    block's keys. A text equal to an earlier one loses all its lines, if it has a key at all: two
    lines, or one of ANCHOR_WORDS words. Rows equal in doc_id and text share their fate. A NULL text
    stays NULL with no lines; an empty one has one line, which stays; no rows give none; columns of
    docs named n_lines or n_removed are replaced. A text whose 64-bit key collides with another's is
    left as it is.
    """
    docs = docs.drop(*({"n_lines", "n_removed", "_t", "_m"} & set(docs.columns)))
    keyed = docs.withColumns({"_t": text_key(F.col("text")), "_m": F.hash("text")})
    lines = F.split("text", "\n")
    solid = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))), lambda x: x != "")
    rows = keyed.where("text is not null").select(
        "doc_id", F.col("_t").alias("t"), F.col("_m").alias("m"), solid.alias("l"),
        F.transform(lines, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
    )
    hashes = F.transform("l", lambda x: F.xxhash64(x))
    words = F.transform("l", lambda x: F.size(F.split(x, SPACE)))
    rows = staged(rows.select("doc_id", "t", "m", hashes.alias("h"), words.alias("n"), "blank"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "t")
    one = rows.groupBy("t").agg(F.min(place).alias("at"), F.count("*").alias("n_rows"), *(F.first(c).alias(c) for c in ("m", "h", "n", "blank")))
    texts = staged(one, "line-texts")
    gone = _removed(texts).groupBy("t").agg(F.collect_list("pos").alias("gone"))
    kept = texts.select("t", "blank").join(gone, "t").mapInArrow(_kept, "t long, kept array<int>")
    has_key = (F.size("h") > 1) | F.exists("n", lambda x: x >= ANCHOR_WORDS)
    fate = texts.join(kept, "t", "left").where((F.col("n_rows") > 1) | F.col("kept").isNotNull())
    fate = staged(
        fate.select(F.col("t").alias("_t"), F.col("m").alias("_m1"), F.col("at.doc_id").alias("_first"), has_key.alias("_has_key"), "kept"), "fate"
    )
    joined = spread_join(keyed, fate, "_t", "left", rows.select(F.col("t").alias("_t"))).withColumn("_lines", lines)
    same = F.coalesce(F.col("_m") == F.col("_m1"), F.lit(False))
    copy = same & F.col("_has_key") & ~F.col("doc_id").eqNullSafe(F.col("_first"))
    left = (
        F.when(copy, F.slice("_lines", 1, 0))
        .when(~same | F.col("kept").isNull(), F.col("_lines"))
        .otherwise(F.transform("kept", lambda i: F.get("_lines", i)))
    )
    done = joined.withColumn("_left", left)
    return done.withColumns(
        {
            "text": F.array_join("_left", "\n"),
            "n_lines": F.greatest(F.size("_lines"), F.lit(0)).cast("long"),
            "n_removed": F.greatest(F.size("_lines") - F.size("_left"), F.lit(0)).cast("long"),
        }
    ).select(*docs.columns, "n_lines", "n_removed")
