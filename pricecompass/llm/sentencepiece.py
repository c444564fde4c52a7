"""SentencePiece encoding and decoding with N-best segmentation.

The vocabulary of a .model file is read as a unigram lattice. Its scores are merge ranks, so a
piece's log probability is set by Zipf's law over its rank. No piece holds a space mark after
another character, so a text falls into chunks (spaces, then other characters) that no piece
crosses, and its N-best segmentations are made of those of its chunks. Within a chunk the forward
Viterbi scores are the exact cost to the start: an A* search from the end back, with them as its
heuristic, pops complete segmentations best first. Scores are multiples of 2^-20, so their sums are
exact and equal scores are ties; of those the path nearest the start goes on, so each further
segmentation costs about a step a character. The different chunks of some thousand texts take their
Viterbi steps together, a byte at a time; texts gather the ids of theirs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
#: Log probability of a byte of a character outside the vocabulary.
BYTE_SCORE = -14.0
N_BEST = 3
#: Parts of which scores are whole multiples.
GRAIN = 1 << 20
#: Chunks of which a worker remembers the n best segmentations, of so many bytes at most.
MEMO, MEMO_BYTES = 100_000, 40
#: Bytes of the texts whose chunks are segmented together, and of the longest such chunk; longer ones
#: go one by one.
TEXTS, TOGETHER = 4 << 20, 64
#: Bytes of a character by its first.
_WIDE = np.repeat([1, 2, 3, 4, 1], [0xC0, 0x20, 0x10, 0x08, 0x08])


class Pieces:
    """Vocabulary of a SentencePiece model."""

    def __init__(self, model_file: str | None = None, model: bytes | None = None) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file, model_proto=model)
        self.text: list[str] = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.byte_id = {int(t[3:5], 16): i for i, t in enumerate(self.text) if p.is_byte(i)}
        self.raw: list[bytes] = [b""] * len(self.text)
        self.ids: dict[str, tuple[int, float]] = {}
        for i, t in enumerate(self.text):
            if p.is_byte(i):
                self.raw[i] = bytes([int(t[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                if MARK in t.lstrip(MARK):
                    raise ValueError(f"piece {i} holds a space within")
                self.raw[i] = t.replace(MARK, " ").encode()
                self.ids[t.replace(MARK, " ")] = (i, -round(math.log(max(-p.get_score(i), 0.0) % 1e8 + 3.0) * GRAIN) / GRAIN)
        self.longest = max(map(len, self.ids))
        # pieces, and None for what only begins one: where neither is found, no longer piece begins
        self.begun: dict[str, tuple[tuple[int], float] | None] = {t[:k]: None for t in self.ids for k in range(1, len(t))}
        self.begun.update((t, ((i,), s)) for t, (i, s) in self.ids.items())
        self.memo: dict[tuple[bytes, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.pieces = pa.array(self.raw, pa.large_binary())
        self.size = np.array([len(r) for r in self.raw])
        self.score = np.zeros(len(self.raw))
        self.byte = np.full(256, -1, np.int32)
        self.byte[list(self.byte_id)] = list(self.byte_id.values())
        # the same prefixes as a table of bytes: row 1 is the empty one, 0 is none; those without a longer one come last, without a row
        begun = {self.raw[i][:k]: 0 for i, _ in self.ids.values() for k in range(1, len(self.raw[i]) + 1)}
        inner = {b"", *(t[:-1] for t in begun)}
        begun = {t: k for k, t in enumerate([*sorted(inner), *(t for t in begun if t not in inner)], 1)}
        self.next = np.zeros((len(inner) + 1, 256), np.int32)
        for t, k in begun.items():
            if t:
                self.next[begun[t[:-1]], t[-1]] = k
        self.piece = np.full(len(begun) + 1, -1, np.int32)
        for i, x in self.ids.values():
            self.piece[begun[self.raw[i]]], self.score[i] = i, x

    def edges(self, chunk: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each position the pieces that end there: (start, ids, score)."""
        ids, n, longest = self.ids, len(chunk), self.longest
        out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                if (hit := ids.get(chunk[i:j])) is not None:
                    out[j].append((i, (hit[0],), hit[1]))
            if chunk[i] not in ids:
                raw = chunk[i].encode("utf-8", "surrogatepass")
                out[i + 1].append((i, tuple(self.byte_id[x] for x in raw), BYTE_SCORE * len(raw)))
        return out

    def forward(self, edges: list[list[tuple[int, tuple[int, ...], float]]]) -> tuple[list[float], list[int]]:
        """Viterbi: best score to each position, and which of its edges gives it."""
        best, via = [0.0], [-1]
        for j in range(1, len(edges)):
            top, at = -math.inf, -1
            for k, (i, _, s) in enumerate(edges[j]):
                if best[i] + s > top:
                    top, at = best[i] + s, k
            best.append(top)
            via.append(at)
        return best, via

    def best(self, chunk: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best segmentation, and how much the second best falls short."""
        get, n, low = self.begun.get, len(chunk), -math.inf
        one, two = [0.0, *[low] * n], [low] * (n + 1)  # the two best scores to each position
        start, via = [0] * (n + 1), [()] * (n + 1)
        for i in range(n):
            top, next_ = one[i], two[i]
            for j in range(i + 1, n + 1):
                hit = edge = get(chunk[i:j], ())
                if not hit:
                    if j == i + 1:
                        raw = chunk[i].encode("utf-8", "surrogatepass")
                        edge = tuple(self.byte_id[c] for c in raw), BYTE_SCORE * len(raw)
                    elif hit is None:
                        continue
                    else:
                        break
                t = top + edge[1]
                if t > one[j]:
                    second = next_ + edge[1]
                    two[j] = second if second > one[j] else one[j]
                    one[j], start[j], via[j] = t, i, edge[0]
                elif t > two[j]:
                    two[j] = t
                if hit == ():
                    break
        parts, j = [], n
        while j:
            parts.append(via[j])
            j = start[j]
        return tuple(c for x in reversed(parts) for c in x), one[n], one[n] - two[n]

    def best_of_many(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """best() of chunks, the bytes of data from each of `at` to the next: ids, one chunk's after another's,
        how many each has, scores, and how much the second best falls short.

        Chunks of TOGETHER bytes at most take a step together; the longest stand first, so those that
        reach a place are the first of them. A row of a table is a place within chunks.
        """
        size, begin = np.diff(at), at[:-1]
        score, short, ids = np.zeros(len(size)), np.zeros(len(size)), np.full(len(data), -1, np.int32)
        order = np.argsort(-size, kind="stable")
        far = int(np.count_nonzero(size > TOGETHER))
        for c in order[:far].tolist():
            found, score[c], short[c] = self.best(data[at[c] : at[c + 1]].tobytes().decode("utf-8", "surrogatepass"))
            ids[at[c] : at[c] + len(found)] = found  # no more than bytes
        order = order[far:]
        begin, size = begin[order], size[order]
        reach = np.searchsorted(-size, -np.arange(int(size[0]) + 2 if len(size) else 1), "right").tolist()  # how many hold place i or end there
        one = [np.full(m, -np.inf) for m in reach]
        two = [x.copy() for x in one]
        via = [np.zeros(m, np.int32) for m in reach]  # a piece, or less the bytes of a character that is none
        code = [data[begin[:m] + i] for i, m in enumerate(reach[1:])]
        one[0][:] = 0.0
        for i in range(len(code)):
            top, under = one[i], two[i]
            known = top[: len(code[i])] == -np.inf  # within a character, or one that is a piece
            rows, wide = np.flatnonzero(~known), np.minimum(_WIDE[code[i]], size[: len(code[i])] - i)
            state = np.ones(len(rows), np.int32)
            for j in range(i, len(code)):
                if j > i:
                    go = np.searchsorted(rows, len(code[j]))
                    rows, state = rows[:go], state[:go]
                    live = state < len(self.next)
                    rows, state = rows[live], state[live]
                state = self.next[state, code[j][rows]]
                live = state > 0
                rows, state = rows[live], state[live]
                if not len(rows):
                    break
                piece = self.piece[state]
                whole = piece >= 0
                r, piece = rows[whole], piece[whole]
                if j < i + 4:
                    known[r[wide[r] == j + 1 - i]] = True
                self._step(r, piece, self.score[piece], top, under, one[j + 1], two[j + 1], via[j + 1])
            if not known.all():
                for k in range(1, 5):
                    if len(r := np.flatnonzero(~known & (wide == k))):
                        self._step(r, np.full(len(r), -k, np.int32), BYTE_SCORE * k, top, under, one[i + k], two[i + k], via[i + k])
        for i in range(1, len(reach)):
            done = slice(reach[i + 1] if i + 1 < len(reach) else 0, reach[i])
            score[order[done]], short[order[done]] = one[i][done], one[i][done] - two[i][done]
        flat, base, place, rows = np.concatenate(via), np.cumsum([0, *reach]), size.copy(), np.arange(len(size))
        while len(rows):
            piece = flat[base[place] + rows]
            place = place - np.where(piece >= 0, self.size[piece], -piece)
            where, byte = begin[rows] + place, piece < 0
            ids[where[~byte]] = piece[~byte]
            for k in range(int(-piece.min(initial=0))):
                w = where[piece < -k] + k
                ids[w] = self.byte[data[w]]
                if (ids[w] < 0).any():
                    raise KeyError("a byte without a piece")
            live = place > 0
            rows, place = rows[live], place[live]
        whole = ids >= 0
        return ids[whole], np.diff(np.concatenate([[0], np.cumsum(whole)])[at]), score, short

    @staticmethod
    def _step(r, piece, score, top, under, one, two, via) -> None:
        """Pieces of chunks r from a place with the two best scores top and under to that of one, two and via."""
        t, was = top[r] + score, one[r]
        better = t > was
        two[r] = np.where(better, np.maximum(under[r] + score, was), np.maximum(two[r], t))
        one[r] = np.where(better, t, was)
        via[r[better]] = piece[better]

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a chunk by A* from its end, as (score, ids); of equal scores the
        one that reaches the start first."""
        edges = self.edges(chunk)
        f, _ = self.forward(edges)
        count = 0
        heap: list[tuple[float, int, int, float, tuple]] = [(-f[-1], len(chunk), 0, 0.0, ())]
        out: list[tuple[float, tuple[int, ...]]] = []
        while heap and len(out) < n:
            _, j, _, behind, path = heapq.heappop(heap)
            if j == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            for i, x, s in edges[j]:
                count += 1
                heapq.heappush(heap, (-(f[i] + behind + s), i, count, behind + s, (x, path)))
        return out

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """(score, ids) of the n best segmentations of a whole text, best first; fewer if there are no more."""
        return self.encode_all(pa.array([text.encode("utf-8", "surrogatepass")], pa.large_binary()), n)[0][0]

    def encode_all(self, texts: pa.Array, n: int = N_BEST) -> tuple[list[list[tuple[float, np.ndarray]]], list[bool]]:
        """encode() of texts (large_binary, none NULL), and whether the best ids of each decode to it."""
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        head = data == 32
        head[1:] &= ~head[:-1]
        head[ends[:-1][np.diff(ends) > 0]] = True
        at = np.append(np.flatnonzero(head), len(data))
        first = np.searchsorted(at[:-1], ends)  # each text's first chunk
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
        chunks = chunks.dictionary_encode()
        code, every = chunks.indices.to_numpy(), chunks.dictionary
        offsets = np.frombuffer(every.buffers()[1], np.int64)[: len(every) + 1]
        ids, many, score, short = self.best_of_many(np.frombuffer(every.buffers()[2] or b"", np.uint8)[: offsets[-1]], offsets)
        upto = np.concatenate([[0], np.cumsum(many[code])])
        ids = ids[np.arange(upto[-1]) + np.repeat((np.cumsum(many) - many)[code] - upto[:-1], many[code])]
        scores = np.diff(np.concatenate([[0.0], np.cumsum(score[code])])[first]).tolist()
        decoded = np.frombuffer(self.pieces.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
        of = np.concatenate([[0], np.cumsum(self.size[ids])])[upto[first]].tolist()
        out, exact = [], []
        for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            exact.append(np.array_equal(decoded[of[k] : of[k + 1]], data[ends[k] : ends[k + 1]]))
            out.append(self._n_best_of(ids, upto, every, code, short, scores[k], lo, hi, n))
        return out, exact

    def _n_best_of(self, ids, upto, every, code, short, score: float, lo: int, hi: int, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of the text of chunks lo to hi, by the best ids of all."""
        if n <= 1 or lo == hi:
            return [(score, ids[upto[lo] : upto[hi]])]
        # All but the best differ from it in some chunk; the n - 1 cheapest changes are in the n - 1
        # chunks that lose least.
        lost = short[code[lo:hi]]
        sums: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        other: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        for k in np.argsort(lost, kind="stable")[: n - 1].tolist():
            if lost[k] == np.inf:
                continue
            chunk = every[int(code[lo + k])].as_py()
            found = self.memo.get((chunk, n))
            if found is None:
                found = self.n_best(chunk.decode("utf-8", "surrogatepass"), n)
                if len(chunk) <= MEMO_BYTES:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[chunk, n] = found
            other[k] = found
            top = found[0][0]
            sums = heapq.nsmallest(n, [(less + top - s, (*change, (k, m))) for less, change in sums for m, (s, _) in enumerate(found)])
        out = []
        for less, change in sums:
            parts, start = [], upto[lo]
            for k, m in sorted(change):
                parts += [ids[start : upto[lo + k]], np.array(other[k][m][1], np.int32)]
                start = upto[lo + k + 1]
            out.append((score - less, np.concatenate([*parts, ids[start : upto[hi]]])))
        return out

    def text_of(self, ids: np.ndarray) -> str:
        """Text of ids that are all pieces."""
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def decode(self, ids: list[int | None]) -> str:
        raw, n = self.raw, len(self.raw)
        return b"".join([raw[i] if i is not None and 0 <= i < n else _UNKNOWN for i in ids]).decode("utf-8", "replace")


#: What an id outside the vocabulary decodes to.
_UNKNOWN = "\ufffd".encode()
_loaded: dict[str, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    key = str(hash(model))
    if key not in _loaded:
        _loaded[key] = Pieces(model=model)
    return _loaded[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, n: int = N_BEST, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (of them `keep`, if given) with ids (of the best segmentation), n_tokens, n_best
    (the ids of the n best, best first), scores (theirs) and exact (whether ids decode to the text).

    A NULL text has NULL ids, n_best, scores and exact and no tokens; an empty one has empty ids, once,
    and the score 0; a text with fewer segmentations than n has those. Each row is encoded for
    itself, whatever its doc_id; no rows give none; columns of these names are replaced. The model (a
    file of half a megabyte) travels with the tasks.
    """
    added = {"ids": "array<int>", "n_tokens": "long", "n_best": "array<array<int>>", "scores": "array<double>", "exact": "boolean"}
    docs = docs.drop(*(set(added) & set(docs.columns)))
    kept = [c for c in docs.columns if keep is None or c in keep]
    one = pa.list_(pa.int32())
    kinds = one, pa.int64(), pa.list_(one), pa.list_(pa.float64()), pa.bool_()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            upto = np.cumsum(pc.binary_length(pc.fill_null(batch.column("text"), "")).to_numpy(), dtype=np.int64)
            cuts = np.unique([0, *np.searchsorted(upto, np.arange(TEXTS, upto[-1] if len(upto) else 0, TEXTS)), batch.num_rows]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                text = batch.column("text").slice(lo, hi - lo)
                found, exact = p.encode_all(pc.fill_null(text, "").cast(pa.large_binary()), n)
                null = text.is_null().to_pylist()
                for at in range(0, hi - lo, 128):
                    rows = [
                        (None, 0, None, None, None) if none else (f[0][1], len(f[0][1]), [x for _, x in f], [s for s, _ in f], e)
                        for f, e, none in zip(found[at : at + 128], exact[at : at + 128], null[at : at + 128], strict=True)
                    ]
                    new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                    part = batch.slice(lo + at, len(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], [*kept, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    return docs.mapInArrow(run, ", ".join([*fields, *map(" ".join, added.items())]))


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded with decoded: the text of ids, NULL for NULL. An element that is NULL or no id of the
    vocabulary, and bytes that are no UTF-8, become U+FFFD; control pieces are nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = [None if x.as_py() is None else p.decode(x.as_py()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    encoded = encoded.drop("decoded") if "decoded" in encoded.columns else encoded
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"])
    return encoded.mapInArrow(run, schema)
