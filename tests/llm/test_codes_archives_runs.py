"""Vector codes, archives and periodic runs: against brute force and round trips, with awkward rows."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from pricecompass.llm import periodic_runs, queries, vector_codes, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows):
    """Lloyd's rounds without bounds, in Python's whole numbers."""
    kept = sorted(((i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    part = lambda v, p: v[p * width : p * width + width]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(6):
        at = [[nearest(v, p)[1] for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), a in zip(kept, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, [nearest(v, p) for p in range(8)]) for i, v, _ in kept]
    text = ",".join(str(x) for p in range(8) for c in books[p] for x in c)
    return sorted((i is None, i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n)) for i, n in last), text


def clustered(n, seed, dims=16):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(9, dims))
    return [(k, [float(x) for x in np.float32(middles[k % 9] + r.normal(size=dims) * (0.02 + 0.2 * (k % 5)))], k % 4 or None) for k in range(n)]


def test_vector_codes_equal_plain_rounds(spark):
    rows = clustered(400, 1) + [(5, [0.0] * 16, None), (5, [0.0] * 16, None), (None, [0.25] * 16, 3), (2, [0.5] * 16, 3)]
    bad = [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [float("inf")] + [0.0] * 15, 1), (903, [None] + [0.0] * 15, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad], f"{VECTORS}, _at string").repartition(5)
    coded, books, text = vector_codes.compress(frame)
    want, want_text = plain_codes(rows)
    got = vector_codes.with_label_error(coded).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.code, r.error) for r in got) == want
    assert text == want_text
    assert books.entries.shape == (8, 16, 2)
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got)


def test_vector_codes_ties_few_rows_and_large_components(spark):
    same = [(k, [1.0, 2.0] * 8, 1) for k in range(40)]  # equal entries: the lowest index stays
    got, _, text = vector_codes.compress(spark.createDataFrame(same, VECTORS))
    assert {r.code for r in got.collect()} == {"00" * 8}
    assert text == plain_codes(same)[1]
    few = clustered(5, 2)
    got, books, text = vector_codes.compress(spark.createDataFrame(few, VECTORS))
    assert books.entries.shape[1] == 5 and text == plain_codes(few)[1]
    large = [(k, [float(np.float32(x * 1e11)) for x in v], None) for k, v, _ in clustered(60, 3)]
    got, _, text = vector_codes.compress(spark.createDataFrame(large, VECTORS))
    want, want_text = plain_codes(large)
    assert text == want_text
    assert sorted((r.vec_id is None, r.vec_id, r.code, r.error) for r in got.collect()) == [(*w[:3], min(w[3], 2**63 - 1)) for w in want]


def test_vector_codes_without_rows_and_with_other_lengths(spark):
    none = spark.createDataFrame([], VECTORS)
    got, _, text = vector_codes.compress(none)
    assert vector_codes.with_label_error(got).count() == 0 and text == ""
    mixed = [(0, [1.0] * 10, 1), (1, [2.0] * 10, 1), (2, [1.0] * 3, 1), (3, [], 2)]
    rows = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame(mixed, VECTORS))[0].collect()}
    assert rows[0].code[:2] == "00" and rows[0].error == 0 and rows[1].error == 0
    assert rows[2].code is None and rows[3].error is None


def test_bounds_spare_scans():
    r = np.random.default_rng(5)
    v = (r.integers(0, 12, size=(4000, 1, 1)) * 1000 + r.integers(-40, 40, size=(4000, 1, 2))).astype(np.int64)
    books = vector_codes.Codebooks(np.array([[[k * 1000, k * 1000] for k in range(12)]], np.int64))
    at, upper, lower = np.zeros((4000, 1), np.int64), np.full((4000, 1), np.inf), np.zeros((4000, 1))
    assert vector_codes.assign(v, books, at, upper, lower, books.spacing()) == 4000 - (at[:, 0] == 0).sum()
    moved = vector_codes.Codebooks(books.entries + 3)
    vector_codes.loosen(at, upper, lower, books.moved(moved))
    assert vector_codes.assign(v, moved, at, upper, lower, moved.spacing()) == 0
    assert (at[:, 0] == moved.squares(v[:, 0], 0).argmin(1)).all()


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(4)
    html = ["", None, "a", "ü\r\n\r\nx", "<p>same</p>" * 9, "".join(chr(r.randrange(32, 9000)) for _ in range(900_000))]
    rows = [(k, f"http://a.example/{k}", html[k % 6], "z") for k in range(60)]
    rows += [(4, "http://a.example/4", html[4], "z")] * 3 + [(None, None, "a", "z"), (None, "http://a b\n", "only", "z"), (None, "u", "only", "z"), (-7, None, "neg", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(6)
    archives = warc.write(frame, archive_bytes=2_000)
    assert archives.count() > 6
    got = warc.page_records(warc.read(archives)).collect()
    assert len(got) == len(rows) and all(x.problem is None for x in got)
    first = {}
    for k, _, h, _ in rows:
        p = (h or "").encode()
        if k is not None:
            first[p] = min(first.get(p, k), k)
    want = []
    for k, _, h, _ in rows:
        p = (h or "").encode()
        want.append((k is None, k, len(p), sha(p), p))
    assert sorted((x.page_id is None, x.page_id, x.payload_bytes, x.payload_digest) for x in got) == sorted(w[:4] for w in want)
    for p in {w[4] for w in want}:
        of = [x for x in got if x.payload_digest == sha(p)]
        heads = [x for x in of if x.record_type == "response"]
        assert len(heads) == 1 and bytes(heads[0].payload) == p and heads[0].page_id == first.get(p)
        assert all(x.refers_to == first.get(p) and not x.payload for x in of if x.record_type == "revisit")
    assert {x.url for x in got if x.page_id is None} == {None, "http://a%20b%0A", "u"}
    assert warc.read(warc.write(frame.limit(0))).count() == 0
    some = archives.collect()[:2]
    assert warc.read_paths(spark, [a.path for a in some]).count() == sum(a.records for a in some)


def test_archives_that_are_broken():
    pages = [(f"p{k}".encode() * (300 * k + 1)) for k in range(5)]
    made = [warc.record("response", f"http://h/{k}", f"urn:page:{k}", p, sha(p)) for k, p in enumerate(pages)]
    assert [x.payload for x in warc.read_records(io.BytesIO(b"".join(made)))] == pages
    offsets = [x.offset for x in warc.read_records(io.BytesIO(b"".join(made)))]
    assert offsets == [sum(map(len, made[:k])) for k in range(5)]

    def seen(data):
        return [(x.headers.get("warc-record-id"), x.problem) for x in warc.read_records(io.BytesIO(data))]

    assert seen(b"".join(made)[:-9])[-1][1] == "torn" and len(seen(b"".join(made)[:-9])) == 5
    assert seen(b"") == []
    after = seen(made[0] + b"no member at all" + made[1])
    assert after[0] == ("<urn:page:0>", None) and after[1][1] == "torn" and after[-1] == ("<urn:page:1>", None)
    hurt = bytearray(made[3])
    hurt[len(hurt) // 2] ^= 0xFF
    ids = seen(made[2] + bytes(hurt) + made[4])
    assert ids[0] == ("<urn:page:2>", None) and ids[-1] == ("<urn:page:4>", None) and any(p for _, p in ids[1:-1])
    swap = lambda m, a, b: (lambda z: z.compress(zlib.decompress(m, 31).replace(a, b)) + z.flush())(zlib.compressobj(wbits=31))
    assert seen(swap(made[1], b"p1p1", b"p1p2"))[0][1] == "block digest"
    assert seen(swap(made[1], b"Content-Length: ", b"Content-Length: 1"))[0][1] == "torn"
    assert seen(swap(made[0], b"WARC/1.1", b"what/1.1"))[0][1] == "header"
    short = zlib.decompress(made[2], 31)
    n = int(short.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
    assert seen(swap(made[2], b"\r\nContent-Length: %d\r\n\r\nHTTP" % n, b"\r\nContent-Length: %d\r\n\r\nHTTP" % (n - 1)))[0][1] in ("length", "block digest")


def plain_runs(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        n, k = r.randint(0, 120), r.choice([1, 2, 2, 3, 4, 30])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n > 15 else 0):
            a, p = r.randrange(n - 3), r.randint(1, 12)
            for i in range(a, min(n, a + r.randint(5, 60))):
                w[i] = w[a + (i - a) % p]
        assert periodic_runs.runs_of(np.array(w, np.int64)) == plain_runs(w)


def test_runs_of_texts(spark):
    loop = "one two three " * 6
    texts = [None, "", " \t\n", loop, f"a {loop} b {loop}", "x " * 40, "no run in this text", "ab c " * 12, "é ü " * 50_000]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(3, loop, "x"), (None, loop, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs.repeated_runs(docs, ["doc_id", "runs"]).collect()
    assert len(got) == len(rows)
    for x, (k, t, _) in zip(sorted(got, key=lambda x: (x.doc_id is None, x.doc_id or 0)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        w = (t or "").encode().split()
        number = {}
        want = plain_runs([number.setdefault(x, len(number)) for x in w]) if len(w) < 1000 else [(0, len(w), 2)]
        assert [(z.start, z.length, z.period) for z in x.runs] == want, k
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert x.collapsed == b" ".join(y for i, y in enumerate(w) if i not in gone).decode()
    assert periodic_runs.repeated_runs(docs.limit(0), ["doc_id"]).count() == 0


def test_op13_query_plants_its_cycles(spark, tmp_path):
    r = random.Random(8)
    rows = [(k, " ".join(str(r.randrange(500)) for _ in range(r.randint(0, 90)))) for k in range(400)] + [(None, "a b " * 9), (401, None), (402, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for k, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(k).encode())
        g, n = h // 10, len(w)
        if k is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        number = {}
        runs = plain_runs([number.setdefault(x, len(number)) for x in w])
        x = got[k]
        best = max(runs, key=lambda z: (z[1], -z[0], -z[2]), default=(None, None, None))
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
        assert x.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(y for i, y in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 20


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_warc", "op13_periodic_runs"])
def test_queries_give_their_contracts(spark, name):
    columns = {
        "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op12_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op13_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    }
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.columns == columns[name]
    assert not got.toPandas().empty
