"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code is perfect:
each 23-bit word is within three flips of exactly one codeword, and flipping one bit of a word
reaches at most five further codewords. So words that differ in one bit share a codeword index
between the one's own index and the other's one-flip indices. Of three errors over three segments,
either every segment has at most one, or one segment has none and another at most one. Those are
the cases that the keys below cover: two Golay segments with an exact half of the third, or an exact
segment with a Golay segment. Pairs that meet under a key are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, bounds, mix, shuffle_parts, sorted_stream, spread_join, staged, text_key, whole_groups
from .graph import components

#: Generator polynomial of the binary Golay code of 23 bits, 12 of them data.
GENERATOR = 0b110001110101
WIDTHS = (23, 23, 18)
MAX_BITS = 3
SHINGLE = 3


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += part.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(b)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"), pa.array(fp)], ["doc_id", "text_key", "fp"]
        )


_decoder: list[np.ndarray] = []


def golay_index() -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    if not _decoder:
        syndrome = np.zeros(1, np.uint16)
        for bit in range(23):
            rest = 1 << bit
            for k in range(bit, 10, -1):
                if rest >> k & 1:
                    rest ^= GENERATOR << (k - 11)
            syndrome = np.concatenate([syndrome, syndrome ^ np.uint16(rest)])
        error = np.zeros(2048, np.uint32)
        for n in (1, 2, 3):
            for bits in combinations(range(23), n):
                e = sum(1 << x for x in bits)
                error[syndrome[e]] = e
        _decoder.append(((np.arange(1 << 23, dtype=np.uint32) ^ error[syndrome]) >> 11).astype(np.uint16))
    return _decoder[0]


def golay_keys(seg: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own codeword index, and up to six indices within one flip as (n, 6) with a mask."""
    index = golay_index()
    own = index[seg]
    near = np.sort(np.stack([own, *(index[seg ^ (1 << b)] for b in range(width))], 1), 1)
    first = np.concatenate([np.ones((len(seg), 1), bool), near[:, 1:] != near[:, :-1]], 1)
    out, used = np.zeros((len(seg), 6), np.uint64), np.zeros((len(seg), 6), bool)
    row, col = np.nonzero(first)
    at = np.cumsum(first, 1)[row, col] - 1
    out[row, at], used[row, at] = near[row, col], True
    return own.astype(np.uint64), out, used


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own): the keys under which each fingerprint looks for others, and whether it is
    also found under them."""
    fp = fp.view(np.uint64)
    seg, shift = [], 0
    for w in WIDTHS:
        seg.append(((fp >> np.uint64(shift)) & np.uint64((1 << w) - 1)).astype(np.int64))
        shift += w
    golay = [golay_keys(s, w) for s, w in zip(seg, WIDTHS, strict=True)]
    rows, keys, owns = [], [], []

    def add(family: int, exact: np.ndarray, probe: np.ndarray, used: np.ndarray, own: np.ndarray) -> None:
        r, c = np.nonzero(used)
        p = probe[r, c]
        rows.append(r)
        owns.append(p == own[r])
        salt = np.uint64(family * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        keys.append(mix(mix((exact[r].astype(np.uint64) << np.uint64(24)) | p) ^ salt))

    (d1, k1, u1), (d2, k2, u2), _ = golay
    pair = ((k1[:, :, None] << np.uint64(12)) | k2[:, None, :]).reshape(-1, 36)
    both = (u1[:, :, None] & u2[:, None, :]).reshape(-1, 36)
    for half in (0, 1):
        add(1 + half, (seg[2] >> 9 * half) & 511, pair, both, (d1 << np.uint64(12)) | d2)
    for i in range(3):
        for j in range(3):
            if i != j:
                add(3 + 3 * i + j, seg[i], golay[j][1], golay[j][2], golay[j][0])
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(owns)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy()
        for at in range(0, len(fps), 4096):
            fp = fps[at : at + 4096]
            row, key, own = keys_of(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(own)], ["key", "fp", "own"])


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of each bucket, as a forest: a link between fingerprints that this task has
    already connected adds nothing to the components."""
    forest = Forest()
    for g in whole_groups(batches, "key"):
        at = bounds(g["key"])
        fp, own = g["fp"].view(np.uint64), g["own"]
        a, b = [], []
        for k in np.flatnonzero(np.diff(at) > 1):
            lo, hi = at[k], at[k + 1]
            have = own[lo:hi]
            if have.any():
                for x, y in _bucket_links(fp[lo:hi], have):
                    if forest.join(x, y):
                        a.append(x)
                        b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))],
                ["a", "b"],
            )


def _bucket_links(fp: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a bucket that connect what its verified pairs connect. A member that is reached is
    compared with those not yet reached alone, so a dense bucket costs about a row each."""
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= MAX_BITS
            if not own[x]:
                near &= own[left]
            if near.any():
                for y in left[near]:
                    yield int(fp[x]), int(fp[y])
                    queue.append(y)
                left = left[~near]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) of each row of docs; other columns are left out."""
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        _fingerprints, "doc_id long, text_key long, fp long"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, component_id, root) for each row of docs; root names the component.

    Fingerprints that differ in at most MAX_BITS bits are linked; component_id is the smallest
    doc_id that links reach. Equal fingerprints collapse to one before keys are made, so copies cost
    no pairs. A NULL text and a text without words have fingerprint 0 and link like any other. A
    NULL doc_id takes part but is nobody's component_id unless all of its component are NULL.
    Repeated rows come back as often as they came; no rows give none; further columns are ignored.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # in as many tasks as there are: a fingerprint becomes some eighty keys
    spread = own.select("fp").repartition(shuffle_parts(docs.sparkSession), "fp")
    keys = spread.mapInArrow(_emit_keys, "key long, fp long, own boolean")
    links = sorted_stream(keys, "key", [], _link_buckets, "a long, b long")
    roots = components(links)
    member = own.join(roots, own.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    top = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = spread_join(staged(member, "members"), top, "root").select("fp", "component_id", "root")
    return spread_join(prints, named, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: the smallest (doc_id, text) stays, once."""
    kept = near_duplicates(docs).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("root").alias("_root")
    )
    first = kept.groupBy("_root").agg(
        F.min(F.struct(F.col("_id").isNull().alias("absent"), "_id", "_key")).alias("m")
    )
    first = first.select(F.col("m._id").alias("_id"), F.col("m._key").alias("_key"))
    keyed = docs.withColumn("_text_key", text_key(F.col("text")))
    rest = keyed.join(first, keyed.doc_id.eqNullSafe(first._id) & (keyed._text_key == first._key), "left_semi")
    return rest.dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
