"""Corpus operators against brute force, round trips and planted cases, with awkward rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pricecompass.llm import (
    language_id,
    line_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    queries,
    secret_scan,
    sentencepiece,
    simhash,
    substring_dedup,
    vector_search,
)
from pricecompass.llm.common import hot_keys, spread_join, staged

R = random.Random(1)
VOCAB = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def frame(spark, texts, extra=()):
    rows = [(k, t, "en", "ab"[k % 2], None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


AWKWARD = [(None, "some words without an id", None, None, None), (7, None, "en", None, None), (7, None, "en", None, None), (8, "", "en", "a", 0)]


def plain_metrics(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1}
    covered = {k + j for k, x in enumerate(windows) if x in twice for j in range(8)}
    return len(w), sum(map(len, w)), len(covered)


def test_quality_rules(spark):
    loop = " ".join(VOCAB[:9])
    texts = [prose(60, 1), f"{loop} {prose(30, 2)} {loop}", " ".join(["again"] * 50), "a few words", "x#$\ny z w\ny z w", prose(3000, 4)]
    docs = frame(spark, texts, AWKWARD)
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_repeat_words) == plain_metrics(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id: r.n_dup_lines for r in rows}[4] == 1
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_pipeline_keeps_held_out_good_documents(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = sorted({r.doc_id for r in labels.where("quality = 1").join(docs, "doc_id").select("doc_id").collect()})
    bad = {r.doc_id for r in labels.where("quality = 0").select("doc_id").collect()}
    for n in (0, 40, 150):
        few = labels.limit(0) if not n else labels.where(F.col("doc_id").isin(good[:n]))
        few.write.parquet(f"{tmp_path}/{n}/labels.parquet")
        kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, f"{tmp_path}/{n}").collect()}
        held = [r.doc_id for r in docs.where(F.col("doc_id").isin(good[n:]) & (F.size(F.split("text", r"\s+")) > 25)).collect()]
        assert sum(k in kept for k in held) >= 0.7 * len(held), n
        if n == 150:
            assert len(bad & kept) < 0.2 * len(bad)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = prose(400, 5).split()
    near = []
    for k in range(12):
        w = list(base)
        w[k * 30] = "changed"
        near.append(" ".join(w))
    texts = [" ".join(base), *near, prose(300, 6), prose(300, 6), "one", "ONE", *(prose(50, 100 + k) for k in range(60))]
    docs = frame(spark, texts, AWKWARD).withColumn("fp", F.lit("clash"))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    prints = {r.doc_id: plain_fingerprint(t) for r, t in ((r, texts[r.doc_id]) for r in rows if r.doc_id is not None and r.doc_id < len(texts) and r.doc_id not in (7, 8))}
    assert all(r.fp % (1 << 64) == prints[r.doc_id] for r in rows if r.doc_id in prints)
    all_prints = [(r.doc_id, r.fp % (1 << 64)) for r in rows]
    up = list(range(len(all_prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(all_prints):
        for j, (_, b) in enumerate(all_prints[:i]):
            if (a ^ b).bit_count() <= 3:
                up[root(i)] = root(j)
    want = {}
    for i, (k, _) in enumerate(all_prints):
        want.setdefault(root(i), []).append(k)
    for i, r in enumerate(rows):
        ids = [k for k in want[root(i)] if k is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.deduplicate(docs).count() == len(want)


def test_golay_keys_reach_three_bits():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 64, 2000, dtype=np.uint64)
    b = a.copy()
    for k in range(len(a)):
        for bit in r.choice(64, r.integers(0, 4), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    rows, keys, own = simhash.keys_of(np.concatenate([a, b]).view(np.int64))
    by = [dict() for _ in range(2 * len(a))]
    for row, key, o in zip(rows, keys, own, strict=True):
        by[row][key] = by[row].get(key, False) or o
    for k in range(len(a)):
        assert any(by[k][key] or by[k + len(a)][key] for key in by[k].keys() & by[k + len(a)].keys())


def test_line_dedup(spark):
    shared = [prose(9, 50 + k) for k in range(6)]
    one = [prose(8, 1), *shared, prose(8, 2)]
    two = [prose(8, 3), *shared[:3], prose(8, 4), *shared[3:]]
    three = [prose(8, 5), "short", prose(8, 6)]
    docs = frame(spark, ["\n".join(x) for x in (one, two, three)], [*AWKWARD, (20, "\n".join(one), "en", "a", 1), (21, "\r\n".join(shared), "en", "a", 1)])
    rows = line_dedup.line_dedup(docs.withColumn("n_lines", F.lit(0))).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id in (0, 1, 2, 20, 21)}
    assert by[0].n_removed == 0 and by[2].n_removed == 0
    assert by[1].text == "\n".join([two[0], two[4]])
    assert by[20].text == "" and by[20].n_removed == len(one)
    assert by[21].text == ""
    assert line_dedup.patience([1, 2, 3, 4], [2, 9, 3, 4]) == [(1, 0), (2, 2), (3, 3)]
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def all_pairs_lines(texts):
    """Lines left of each text, every earlier one aligned with it."""
    rows = [[x.strip() for x in t.split("\n")] for t in texts]
    left = []
    for k, later in enumerate(rows):
        gone = set()
        for earlier in rows[:k]:
            names = {}
            a, b = ([names.setdefault(x, len(names)) for x in t] for t in (earlier, later))
            gone.update(line_dedup.common_lines(a, b, [len(x.split()) for x in later]))
        left.append("" if later in rows[:k] else "\n".join(x for i, x in enumerate(later) if i not in gone))
    return left


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_loses_no_link(spark, seed):
    r = random.Random(seed)
    pool = [f"{prose(7, 900 + k)}" for k in range(14)] + [f"short {k}" for k in range(8)]
    texts = []
    for k in range(60):
        lines = r.sample(pool, r.randint(2, 9))
        lines[r.randint(0, len(lines) - 1)] = f"own line number {k} of this very text"
        texts.append("\n".join(lines))
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == all_pairs_lines(texts)


def test_line_dedup_tries_further_holders(spark):
    one, two = "first long line of five words", "second long line of five words"
    texts = [f"{two}\n{one}", f"{one}\nshort\n{two}", f"x\n{one}\nshort\n{two}"]
    rows = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, texts)).collect()}
    assert rows[2] == "x"
    verse = "\n".join(f"verse {k} ends" for k in range(20))  # no line of five words
    rows = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, [f"head\n{verse}", f"{verse}\ntail", verse])).collect()}
    assert rows == {0: f"head\n{verse}", 1: "tail", 2: ""}
    many = "\n".join(f"line {k} of a very long text" for k in range(30_000))
    rows = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(frame(spark, [many, f"own words that nobody else has\n{many}"])).collect()}
    assert rows == {0: 0, 1: 30_000}


def test_substring_dedup(spark):
    passage = prose(60, 70)
    near = passage.split()
    near[30] = "changed"
    long_near = prose(200, 71).split()
    other = list(long_near)
    other[100] = "changed"
    texts = [
        f"{prose(40, 1)} {passage} {prose(50, 2)}", f"{prose(10, 3)} {passage}", f"{passage} {prose(90, 4)}",
        f"{prose(30, 5)} {' '.join(long_near)}", f"{' '.join(other)} {prose(30, 6)}", prose(200, 7), prose(300, 8), prose(40, 9),
        prose(80, 10), prose(80, 10),
    ]
    docs = frame(spark, texts, [(None, None, None, None, None), (50, "", "en", "a", 0)])
    rows = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 8, 9}
    assert {k: r.class_id for k, r in rows.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 8: 8, 9: 8}
    for k, start in ((0, 40), (1, 10), (2, 0)):
        inside = [s for s in rows[k].spans if s.start <= start + 8 and s.end >= start + 52]
        assert inside
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_substring_dedup_of_passages_held_twice(spark):
    texts = []
    for k in range(24):
        notice = prose(100, 1000 + k)
        once, twice = f"{prose(60, 2000 + k)} {notice}", f"{notice} {prose(150, 3000 + k)} {notice}"
        texts += [once if k % 2 else f"{notice} {prose(80, 4000 + k)} {notice}", twice]
    rows = {r.doc_id: r for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    both = [k for k in range(24) if 2 * k in rows and 2 * k + 1 in rows and rows[2 * k].class_id == rows[2 * k + 1].class_id]
    assert both == list(range(24))
    # links of two copies in turn: each copy's meet all the same
    links = np.array([(0, 0, 10, 10, 99, 99), (0, 200, 10, 210, 99, 299), (0, 0, 40, 40, 99, 99), (0, 200, 40, 240, 99, 299)])
    assert set(substring_dedup.tight_passages(links)) == {(0, 99, 0, 99), (0, 99, 200, 299)}
    assert substring_dedup.partners(links).tolist() == [[0, 99, 0, 99], [0, 99, 200, 299]] * 2


def test_interval_join_meets_all_links():
    r = np.random.default_rng(2)
    least = substring_dedup.LEAST
    for n in (2, 2, 2, 2, 5, 20, 60):
        c = np.sort(r.integers(100, 500, n))
        w = np.stack([c - r.integers(0, 90, n), c + 7 - r.integers(0, 90, n), c, c + 7, c + r.integers(0, 90, n), c + 7 + r.integers(0, 90, n)], 1)
        want = np.full(n, least - 2)
        for i in range(n):
            for j in range(n):
                l1, l2, r1, r2 = max(w[i, 0], w[j, 0]), max(w[i, 1], w[j, 1]), min(w[i, 4], w[j, 4]), min(w[i, 5], w[j, 5])
                inside = all(l1 <= w[k, 2] <= r1 and l2 <= w[k, 3] <= r2 for k in (i, j))
                if i != j and inside and min(r1 - l1, r2 - l2) + 1 >= least:
                    want[i] = max(want[i], min(r1 - l1, r2 - l2))
        box = substring_dedup.partners(w)
        got = np.where(box[:, 0] < 0, least - 2, np.minimum(box[:, 1] - box[:, 0], box[:, 3] - box[:, 2]))
        assert (got == want).all()


def test_substring_dedup_recall_of_planted_pairs(spark):
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randint(0, 60_000)}" for _ in range(n)]
    texts, changed = [], []
    for size, n_changes in ((55, 0), (70, 0), (60, 1), (120, 2)):
        for _ in range(30):
            passage = fresh(size)
            other = list(passage)
            for i in r.sample(range(size), n_changes):
                other[i] = "changed"
            texts += [" ".join(fresh(r.randint(0, 120)) + p + fresh(r.randint(0, 120))) for p in (passage, other)]
            changed.append(n_changes)
    alone = len(texts)
    texts += [" ".join(fresh(200)) for _ in range(40)] + [" ".join(fresh(30_000))]
    rows = {x.doc_id: x.class_id for x in substring_dedup.repeated_passages(frame(spark, texts, AWKWARD)).collect()}
    found = [2 * k in rows and rows.get(2 * k) == rows.get(2 * k + 1) for k in range(len(changed))]
    assert all(ok for ok, n in zip(found, changed, strict=True) if not n)
    assert sum(found) >= 0.95 * len(found)
    assert not [k for k in rows if k is not None and k >= alone]


def test_substring_dedup_of_variants_around_one(spark):
    r = random.Random(9)
    passage = [f"w{r.randint(0, 60_000)}" for _ in range(100)]
    texts = [" ".join(passage)]
    for k in range(40):  # each like the first, none like another
        other = list(passage)
        for i in r.sample(range(100), 2):
            other[i] = f"v{k}x{i}"
        texts.append(" ".join(other))
    rows = {x.doc_id: x.class_id for x in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert sum(c == 0 for c in rows.values()) >= 0.95 * len(texts)


def test_mixing(spark):
    docs = frame(spark, [prose(R.randint(0, 90), k) for k in range(200)], AWKWARD)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken, target, longest = {}, {}, max(r.size for r in rows)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= longest for s in target)
    order = mixing.training_order(docs)
    assert order.columns == [*docs.columns, "position"]
    placed = [r.position for r in order.collect()]
    assert placed == sorted(placed) and len(placed) == sum(r.passes for r in rows)
    assert all(0 <= p <= 1 for r in rows for p in r.positions) and all(len(r.positions) == r.passes for r in rows)
    early = {t: np.mean([p for r in rows if r.turn == t for p in r.positions]) for t in (0, 1)}
    assert early[0] < early[1]  # the heavier source leads
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.withColumn("size", F.lit("x"))).count() == len(rows)
    u = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    due = [r[0] for r in u.select(mixing.due(F.col("u"), F.lit(0))).collect()]
    assert due[0] == 0 and abs(due[-1] - 1) < 1e-9 and due == sorted(due)


def best_rows(rows, queries, k):
    """Brute force: rows are (id, whole numbers); repeated rows are rows of their own."""
    width = max((len(v) for _, v in rows), default=0)
    full = [(i, [*v, *[0] * (width - len(v))]) for i, v in rows]
    out = set()
    for n, (q, v) in enumerate(full):
        if queries(q):
            score = lambda w: min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
            found = sorted((-score(w), i) for m, (i, w) in enumerate(full) if m != n)
            out.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(found[:k]))
    return out


def searched(spark, rows, k=20, step=20):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "row": F.lit(1), "n": F.lit(2)})
    got = [tuple(r) for r in vector_search.top_k(table, F.col("vec_id") % step == 0, k).collect()]
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    assert set(got) == best_rows(whole, lambda q: q % step == 0, k)


def test_top_k(spark):
    r = np.random.default_rng(4)
    vectors = [(int(k), [float(x) for x in r.integers(-3, 4, 8) / 4]) for k in range(300)]
    odd = [(None, [0.0] * 8), (900, None), (901, [float("nan")] * 8), (902, [None] * 8)]
    searched(spark, [*vectors, *odd, vectors[5], vectors[20], (40, [9.0] * 8)])  # repeated rows, an id with two vectors
    searched(spark, vectors[:7], k=20)  # fewer than k
    searched(spark, [(k, [1.0, 2.0]) for k in range(5000)], k=3, step=2500)  # one crowded annulus, all ties
    assert vector_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    assert vector_search.top_k(spark.createDataFrame(odd, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_ragged_and_huge_vectors(spark):
    r = np.random.default_rng(5)
    searched(spark, [(k, [float(x) for x in r.integers(-9, 9, r.integers(1, 6))]) for k in range(120)])
    for size in (5e5, 5e7, 3e8):  # products beyond 53 bits stay exact
        searched(spark, [(k, [float(x) for x in r.normal(0, size, 4)]) for k in range(120)])
    table = spark.createDataFrame([(k, [1e300, float(k)]) for k in range(30)], "vec_id long, embedding array<double>")
    assert vector_search.top_k(table, F.col("vec_id") % 20 == 0).count() == 40  # cut to the ends of a long


def test_top_k_prunes_where_vectors_cluster(spark):
    r = np.random.default_rng(6)
    centres = r.normal(0, 1, (40, 16))
    rows = [(k, (centres[k % 40] + r.normal(0, 0.02, 16)).tolist()) for k in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top, work = vector_search._search(table, F.col("vec_id") % 200 == 0, 20)
    assert top.count() == 30 * 20
    assert work["visited"] < 0.5 * work["annuli"] * work["queries"]


def test_secret_scan_held_out(spark):
    words = frozenset(w.encode() for w in "the service reads values from this place and writes them again when users".split())
    docs = frame(spark, [prose(200, k) for k in range(60)], AWKWARD)
    pairs = secret_scan.transitions(docs)
    around = secret_scan.surroundings(docs)
    model = secret_scan.train(secret_scan.labelled_findings(spark, 1600, 1, around[:30]), pairs, words)
    held = secret_scan.labelled_findings(spark, 400, 2, around[30:])  # in other documents
    truth = held.select("doc_id", F.col("label").alias("y"), F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))
    found = secret_scan.scan(held.withColumn("probability", F.lit(0)), model, pairs, words, "path").join(truth, "doc_id")
    found = found.where("start < e and start + length > s").collect()
    hit = {r.doc_id for r in found if r.is_secret}
    true = {r.doc_id for r in found if r.y}
    assert true == set(range(0, 400, 2))  # every secret is a candidate
    assert len(hit & true) >= 0.95 * len(true) and len(hit & true) >= 0.95 * len(hit)
    assert secret_scan.scan(frame(spark, [], AWKWARD), model, pairs, words, "source").count() == 0
    assert secret_scan.scan(docs.limit(0), model, pairs, words).count() == 0
    long = "x" * 300_000 + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + "word " * 50_000
    rows = secret_scan.scan(frame(spark, [long, long]), model, pairs, words).collect()
    assert {(r.doc_id, r.start) for r in rows if r.is_secret} >= {(0, 300_010), (1, 300_010)}


@pytest.mark.parametrize(
    "text", ["password: hunter2xyz", "API_KEY=QWERTYuiopASDFghjkZXCV", "Authorization: Bearer abCDefGHijKLmn", "x qGzPwLmRtYkVbNcXdFsJ y", "auth_token := 'a1b2c3d4'"]
)
def test_secret_candidates(text):
    assert [v for _, v in secret_scan.candidates(text.encode())]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("my_extremely_long_configuration_setting_name_password = hunter2abc", "hunter2abc"),
        ("password: s3cr3t!", "s3cr3t!"),
        ("pwd=abc123", "abc123"),
        ("token = '" + "a1B2" * 75 + "'", "a1B2" * 75),
        ("postgres://u:Pa55word!@host/db", "Pa55word!"),
        ("AUTH_URL=postgres://u:Pa55word!@host/db", "Pa55word!"),
        ('{"password": "hunter2"}', "hunter2"),
        ("n" * 5000 + "_token=" + "v7" * 5000, "v7" * 5000),
    ],
)
def test_secret_candidates_of_any_length(text, want):
    assert [(text[at : at + len(want)], v.decode()) for at, v in secret_scan.candidates(text.encode())] == [(want, want)]


def test_secret_candidates_are_found_in_linear_time():
    import time

    for piece in ("a=", "key=", "key", "://a:", "'a'=\"", "a_token=://b:", "Bearer ", "a.b-c", "key:=\t"):
        began = time.time()
        assert sum(1 for _ in secret_scan.candidates((piece * (2_000_000 // len(piece))).encode())) >= 0
        assert time.time() - began < 5, piece


def test_quality_classifier(spark):
    texts = [prose(40, k) if k % 3 else " ".join(w + "###" for w in prose(40, k).split()) for k in range(240)]
    docs = frame(spark, texts, AWKWARD)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id is not None and 150 <= r.doc_id < 240]
    assert sum(r.kept == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    none = quality_classifier.classify(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert {r.evidence for r in none} == {0.0}


def test_shrinkage_keeps_sparse_sites_near_the_prior(spark):
    rows = [("big", "big/x", 1.0)] * 80 + [("big", "big/y", 0.0)] * 20 + [("small", "small/x", 0.0)] + [("bad", "bad/x", 0.0)] * 60
    priors, worth = quality_classifier.site_priors(spark.createDataFrame(rows, "host string, path string, p double"))
    by = {r.path: r.parent for r in priors.collect()}
    assert worth >= quality_classifier.LEAST_SHRINK
    assert by["bad/x"] < by["small/x"] < by["big/x"]


def test_language_id(spark):
    de, en = "der die und nicht eine zu schön ist über".split(), "the and of that with from this these which".split()
    text = lambda words, k: " ".join(random.Random(k).choices(words, k=30))
    rows = [(k, text(de if k % 2 else en, k), None, ("de" if k % 2 else "en") if k < 40 else None, f"http://{'d' if k % 2 else 'e'}.example.org/{k}", None) for k in range(80)]
    rows += [(100, None, f'<html lang="de"><body><p>{text(de, 1)}</p><script>the of</script></body></html>', None, "http://d.example.org/x", None)]
    rows += [(101, "", None, None, "http://d.example.org/", None), (102, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "id long, text string, html string, declared string, url string, host string")
    labelled = spark.createDataFrame([(text(de if k % 2 else en, 500 + k), "de" if k % 2 else "en") for k in range(30)], "text string, lang string")
    found = {r.id: r for r in language_id.identify(table, labelled).collect()}
    assert len(found) == len(rows)
    assert all(found[k].lang == ("de" if k % 2 else "en") for k in range(80))
    assert found[100].lang == "de" and found[100].declared == "de"
    assert found[101].lang == "de"  # its host decides
    assert {r.lang for r in language_id.identify(table, labelled.limit(0)).collect()} == {language_id.UNKNOWN}


def test_language_id_keeps_rare_languages(spark):
    of = {x: [f"{x}{w}" for w in VOCAB[:60]] for x in ("en", "hr", "sl")}
    text = lambda x, k: " ".join(random.Random(k).choices(of[x], k=30))
    labelled = [(text("en", k), "en") for k in range(400)] + [(text("hr", 1), "hr"), (text("sl", 2), "sl"), (None, "xx"), ("y", None)]
    rows = [(k, text(x, 900 + k), None, None, None, None) for k, x in enumerate(("en", "hr", "sl", "hr"))]
    table = spark.createDataFrame([*rows, *rows], "id long, text string, html string, declared string, url string, host string").withColumn("lang", F.lit("?"))
    found = language_id.identify(table, spark.createDataFrame(labelled, "text string, lang string")).collect()
    assert sorted((r.id, r.lang) for r in found) == sorted(2 * [(0, "en"), (1, "hr"), (2, "sl"), (3, "hr")])
    assert language_id.identify(table.limit(0), spark.createDataFrame(labelled, "text string, lang string")).count() == 0


def test_language_weights_do_not_depend_on_how_many_there_are(spark):
    r = random.Random(12)
    rows = [(" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(30)), f"l{k % 400:03d}", k % 2) for k in range(900)]
    table = spark.createDataFrame(rows, "text string, lang string, half int")
    (all_,) = language_id.learned(table)
    assert len(all_.names) == 400
    dense = np.zeros((400, language_id.BUCKETS))
    for text, lang, _ in rows:
        np.add.at(dense[all_.names.index(lang)], language_id.grams(text), 1)
    pooled = (dense.sum(0) + 1) / (dense.sum() + language_id.BUCKETS)
    log = np.log((dense + language_id.SMOOTH * pooled) / (dense.sum(1, keepdims=True) + language_id.SMOOTH))
    for text in (rows[0][0], rows[7][0], "", "zz äöü 你好", rows[3][0] * 50):
        s = log[:, language_id.grams(text)].sum(1) / language_id.OVERLAP
        p = np.exp(s - s.max())
        np.testing.assert_allclose(all_.posterior(text), p / p.sum(), rtol=1e-6, atol=1e-12)


def test_language_id_by_halves(spark):
    rows = [(k, "the cat sat on the mat and then it ran" if k % 4 < 2 else "le chat dort sur la table et puis il mange", "en" if k % 4 < 2 else "fr", k % 2) for k in range(80)]
    rows += [(100, "zq xq zq xq " * 40, "only", 0), (101, None, None, None), (102, "", "en", 1), (103, "the cat sat on the mat and then it ran " * 60_000, None, 1)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, half int")
    asked = docs.select("id", "text", "half", F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("declared"),
                        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("host"), F.lit(7).alias("_site"))
    found = {r.id: r for r in language_id.identify(asked, docs.select("text", "lang", "half"), "half").collect()}
    assert len(found) == len(rows)
    assert all(found[k].text_lang == lang for k, _, lang, _ in rows[:80]) and found[103].lang == "en"
    first, second = language_id.learned(docs, "half")
    assert first.names == second.names == ["en", "fr", "only"]
    alone = second.posterior("zq xq zq xq")  # learned from half 0, where that language is
    assert alone.argmax() == 2 and first.posterior("zq xq zq xq")[2] == 0


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 100")
    held = docs.where("doc_id % 5 = 0")
    no = F.lit(None).cast("string")
    rows = held.select("doc_id", "text", no.alias("html"), no.alias("declared"), no.alias("url"), no.alias("host"))
    found = language_id.identify(rows, docs.where("doc_id % 5 > 0").select("text", "lang")).withColumnRenamed("lang", "found")
    right = [r.found == r.lang for r in found.join(held.select("doc_id", "lang"), "doc_id").collect()]
    assert sum(right) >= 0.98 * len(right)


@pytest.mark.parametrize("piece", ["<!--", "<script>", "<nav ", "<", "</script", "<html lang", "&#", "<style></styl"])
def test_visible_text_of_hostile_pages_in_linear_time(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.time()
    language_id.visible(page)
    language_id._HTML_LANG.search(page)
    assert time.time() - began < 1.5


def test_visible_text():
    page = "<html><nav>menu</nav>a<b>c</b><SCRIPT>x<script>y</script >d<!-- e -->f&amp;<style>g"
    assert language_id.visible(page).split() == ["a", "c", "d", "f", "g"]


def test_sentencepiece_n_best_and_round_trip(spark):
    model = sentencepiece.model_bytes(MODEL)
    p = sentencepiece.Pieces(model=model)
    for chunk in (" thation", "   x", " ñandú", "aaaa", "▁", "\n\t€𝄞"):
        edges = p.edges(chunk)

        def paths(j):
            if j == 0:
                yield 0.0, ()
            for i, ids, s in edges[j]:  # noqa: B023
                for total, before in paths(i):
                    yield total + s, before + ids

        every = sorted((round(-s, 9) for s, _ in paths(len(chunk))))
        got = p.n_best(chunk, 5)
        assert [-s for s, _ in got] == pytest.approx(every[:5])
        assert len({ids for _, ids in got}) == len(got) and all(p.decode(ids) == chunk for _, ids in got)
        assert p.best(chunk)[1] == pytest.approx(-every[0])
    texts = ["Hello world, hello", "", "  two  spaces ", "▁ mark", "é\u0000\n\r\t\U0001f525", prose(5000, 3)]
    docs = frame(spark, texts, AWKWARD).withColumn("ids", F.lit(1))
    rows = sentencepiece.decode(sentencepiece.encode(docs, model), model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded == r.text and r.exact in (None, True)
        if r.text is not None:
            assert r.scores == sorted(r.scores, reverse=True) and r.n_best[0] == r.ids and len(r.n_best) == len(r.scores)
            assert all(p.decode(ids) == r.text for ids in r.n_best) and len(set(map(tuple, r.n_best))) == len(r.n_best)
    assert sentencepiece.encode(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([([None, 5, 10**9, -1],), ([p.byte_id[0xE2]],), (None,), ([],)], "ids array<int>")
    assert {r.decoded for r in sentencepiece.decode(odd, model).collect()} >= {None, "", "\ufffd"}


def test_sentencepiece_n_best_of_whole_texts():
    p = sentencepiece.Pieces(MODEL)
    score = {t: s for t, (_, s) in p.ids.items()}
    name = {i: t for t, (i, _) in p.ids.items()}

    def every(text):
        """Scores of all segmentations of a text whose characters are all pieces."""
        if not text:
            return [0.0]
        return [score[text[:j]] + s for j in range(1, min(len(text), p.longest) + 1) if text[:j] in score for s in every(text[j:])]

    for text in ("to be or", " an ox", "go on up", "aa aa aa"):
        got = p.encode(text, 6)
        assert [s for s, _ in got] == sorted(every(text), reverse=True)[:6]
        for s, ids in got:
            assert "".join(name[i] for i in ids) == text and sum(score[name[i]] for i in ids) == s


@pytest.mark.parametrize("text", ["haha1" * 20_000, "".join(random.Random(1).choices("abcdefgh", k=64_000)), "a" * 50_000, " " * 50_000])
def test_sentencepiece_of_long_chunks_in_linear_time(text):
    import time

    p = sentencepiece.Pieces(MODEL)
    began = time.time()
    found = p.encode(text)
    assert time.time() - began < 10
    assert len(found) == 3 and all(p.text_of(ids) == text for _, ids in found)


def test_sentencepiece_segments_chunks_together(monkeypatch):
    p, rnd = sentencepiece.Pieces(MODEL), random.Random(3)
    texts = ["", "  ", "a", *("".join(rnd.choices("aceinorst  \u00e9\u4e2d\n\u20ac\u2581\U0001d11e", k=rnd.randrange(1, 90))) for _ in range(400)), "x" * 70 + " y", prose(3000, 9)]
    want = []
    for text in texts:
        chunks = re.findall(" *[^ ]+| +", text)
        want.append((sum(p.best(c)[1] for c in chunks), [x for c in chunks for x in p.best(c)[0]], [p.best(c)[2] for c in chunks]))
    calls, best = [], sentencepiece.Pieces.best
    monkeypatch.setattr(sentencepiece.Pieces, "best", lambda p, chunk: calls.append(chunk) or best(p, chunk))
    got = [p.encode(text) for text in texts]
    assert all(len(c.encode()) > sentencepiece.TOGETHER for c in calls)  # no other is segmented by itself
    for found, (score, ids, short) in zip(got, want, strict=True):
        assert found[0][0] == score and found[0][1].tolist() == ids
        assert len(found) == 1 or found[1][0] == score - min(short)
    data = pa.array([t.encode() for t in texts], pa.large_binary())
    for cut in (data, data.slice(3, 300), data.slice(0, 0)):
        every, exact = p.encode_all(cut)
        assert all(exact) and len(every) == len(cut)
    every, _ = p.encode_all(data)
    assert [[(s, x.tolist()) for s, x in f] for f in every] == [[(s, x.tolist()) for s, x in f] for f in got]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, kept, "/root/testdata/sf0.001"), "stage")
        assert kept.columns == docs.columns, name
        if name == "simhash near-dedup":
            order = [r.doc_id for r in mixing.training_order(kept).orderBy("position", "doc_id").collect()]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").orderBy("position").collect()
    assert out and all(r.exact for r in out)
    assert [r.doc_id for r in out] == order
    assert len({r.position for r in out}) == len(out)


def test_pipeline_stages_take_awkward_rows(spark):
    import corpus_pipeline

    text = prose(40, 3)
    docs = frame(spark, [text, text, prose(30, 4), "word " * 200_000], [*AWKWARD, (0, text, "en", "a", 9), (None, None, None, None, None)])
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
        assert name != "sentencepiece" or len(found) == docs.count()
        assert name != "quality rules" or all(r.text for r in found)


def test_salted_joins_equal_plain_ones(spark):
    many = staged(spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 900).alias("k"), "id"), "many")
    one = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert hot_keys(many, "k") is not None
    for how in ("inner", "left"):
        got, want = (sorted(map(str, x.select("k", "id", "v").collect())) for x in (spread_join(many, one, "k", how), many.join(one, "k", how)))
        assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_corpus_query_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    plain = lambda row: tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row)
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(plain, found.select(columns).collect())) == sorted(map(plain, want))


def test_pipeline_positions_where_a_task_writes_several_files(spark, tmp_path):
    import corpus_pipeline

    spark.range(1000).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = docs.select("id", corpus_pipeline._written_order(docs).alias("position")).collect()
    assert len({r.position for r in found}) == 1000
    assert [r.id for r in sorted(found, key=lambda r: r.position)] == list(range(1000))


def _worth(groups):
    spread = noise = scale = 0.0
    for n, s, parent in groups:
        p = min(max(parent, 1e-6), 1 - 1e-6)
        spread, noise, scale = spread + n * (s / n - p) ** 2, noise + p * (1 - p), scale + n * p * (1 - p)
    if spread <= noise or scale <= noise:
        return quality_classifier.MOST_SHRINK
    return min(max((scale - noise) / (spread - noise) - 1, quality_classifier.LEAST_SHRINK), quality_classifier.MOST_SHRINK)


def test_quality_classifier_against_plain_sums(spark):
    import math

    r = random.Random(21)
    bad = lambda k: " ".join(r.choice(["buy!!", "### now", "|| click", "$$$"]) for _ in range(40))
    rows, good = [], {}
    for k in range(300):
        host = r.choice(["big", "big", "big", "mid", "small", None, ""])
        good[k] = r.random() < {"big": 0.8, "mid": 0.3}.get(host, 0.5)
        rows.append((k, prose(60, k) if good[k] else bad(k), host, r.choice(["en", "de", None])))
    rows += [(900, None, "big", "en"), (901, "", None, None), (902, prose(200_000, 5), "small", "en"), (None, prose(30, 6), "mid", "de"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, l string")
    docs = docs.selectExpr("*", "1 AS evidence", "2 AS p", "'x' AS host", "'y' AS _site", "3 AS label", "4 AS terms")
    labels = spark.createDataFrame([(k, int(good[k]), 0) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    found = quality_classifier.classify(docs, labels, F.col("h"), F.col("l")).collect()
    assert len(found) == len(rows)
    known = [good[k] for k in range(0, 300, 2)] + [good[0]]  # the repeated row is labelled twice
    base = math.log(sum(known) / len(known)) - math.log1p(-sum(known) / len(known))
    p = [1 / (1 + math.exp(-(x.evidence + base))) for x in found]
    paths, hosts = {}, {}
    for x, y in zip(found, p, strict=True):
        for of, key in ((paths, (x.host, x.path)), (hosts, x.host)):
            n, s = of.get(key, (0, 0.0))
            of[key] = (n + 1, s + y)
    whole = sum(p) / len(p)
    w = _worth([(n, s, whole) for n, s in hosts.values()])
    share = {h: (s + w * whole) / (n + w) for h, (n, s) in hosts.items()}
    w = _worth([(n, s, share[h]) for (h, _), (n, s) in paths.items()])
    for x, y in zip(found, p, strict=True):
        n, s = paths[x.host, x.path]
        prior = min(max((s - y + w * share[x.host]) / (n - 1 + w), 1e-6), 1 - 1e-6)
        want = 1 / (1 + math.exp(-(x.evidence + math.log(prior) - math.log1p(-prior))))
        assert abs(x.prior - prior) < 1e-9 and abs(x.probability - want) < 1e-9 and x.kept == (x.probability >= 0.5)
    judged = [x for x in found if x.doc_id is not None and x.doc_id < 300 and x.doc_id % 2]
    assert sum(x.kept == good[x.doc_id] for x in judged) >= 0.95 * len(judged)
    assert quality_classifier.classify(docs.limit(0), labels, F.col("h"), F.col("l")).count() == 0


def test_substring_dedup_of_pairs_with_one_link(spark):
    """Passages of 60 words with one changed, similar enough, whose texts share the least token of one
    stretch under one hash function alone; and links that meet no other of their pair."""
    r, pairs = random.Random(10), []
    for _ in range(2000):
        passage = [f"w{r.randint(0, 60_000)}" for _ in range(60)]
        other = list(passage)
        other[r.randrange(12, 48)] = "changed"
        pairs.append((" ".join(passage), " ".join(other)))
    token, ends = substring_dedup.tokens(pa.array([t for pair in pairs for t in pair]))
    least = [set() for _ in range(2 * len(pairs))]
    for f in range(substring_dedup.HASHES):
        text, _, c, _ = substring_dedup.compact_windows(token, ends, f)
        for i, v in zip(text.tolist(), token[c].tolist(), strict=True):
            least[i].add((f, v))
    lone = [p for k, p in enumerate(pairs) if len(least[2 * k] & least[2 * k + 1]) == 1]
    assert len(lone) >= 3
    rows = {x.doc_id: x.class_id for x in substring_dedup.repeated_passages(frame(spark, [t for p in lone for t in p])).collect()}
    assert rows == {i: i - i % 2 for i in range(2 * len(lone))}
    # three links, of which the last meets no other: it is kept, with its own windows
    w = [(0, 0, 10, 10, 99, 99), (0, 0, 40, 40, 99, 99), (300, 500, 310, 510, 360, 560)]
    a, c, b = ([x[k] << 32 | x[k + 1] for x in w] for k in (0, 2, 4))
    batch = pa.RecordBatch.from_pydict({"pair": [5] * 3, "t1": [1] * 3, "t2": [2] * 3, "a": a, "c": c, "b": b})
    (found,) = substring_dedup._join_intervals(iter([batch]))
    assert [x[:6] for x in np.reshape(found.column("links")[0].as_py(), (-1, 10)).tolist()] == [list(x) for x in w]


def test_stretches_around_a_link_equal_brute_force():
    r = random.Random(11)
    least = substring_dedup.LEAST
    similar = lambda x, y: len(set(x) & set(y)) >= substring_dedup.SIMILARITY * len(set(x) | set(y))
    n_found = 0
    for _ in range(60):
        x = list(range(1000, 1000 + r.choice([46, 60, 75])))
        y = list(x)
        for i in r.sample(range(len(y)), r.choice([0, 2, 4, 6, 12])):
            y[i] = r.randint(5000, 9000)
        p = r.choice([i for i, v in enumerate(x) if y[i] == v])
        x, y = [*range(r.randint(0, 6)), *x, 7, 8], [*range(20, 20 + r.randint(0, 6)), *y]
        p = q = x.index(1000 + p)
        q = y.index(x[p])
        spans = lambda z, at: [(lo, hi) for lo in range(at + 1) for hi in range(max(at, lo + least - 1), len(z))]
        want = any(similar(x[a : b + 1], y[c : d + 1]) for a, b in spans(x, p) for c, d in spans(y, q))
        got = substring_dedup.around(x, y, p, q)
        assert (got is not None) == want
        if got:
            l1, r1, l2, r2 = got
            n_found += 1
            assert l1 <= p <= r1 and l2 <= q <= r2 and min(r1 - l1, r2 - l2) + 1 >= least and similar(x[l1 : r1 + 1], y[l2 : r2 + 1])
    assert 20 <= n_found < 60


def test_links_are_rejected_by_what_their_pair_has_in_common(monkeypatch):
    r, calls, gains = random.Random(4), [], substring_dedup._gains
    wide = substring_dedup.LEAST
    # 90 common tokens far apart: no link leads to a passage, and each text's gains are taken once for all links
    x, y = np.arange(1000, 1900), np.arange(5000, 5900)
    y[::10] = x[::10]
    w = [(max(0, c - 200), max(0, c - 200), c, c, min(899, c + 200), min(899, c + 200)) for c in range(100, 800, 10)]
    links = np.array([(*k, k[0], k[4], k[1], k[5]) for k in w], np.int32)
    monkeypatch.setattr(substring_dedup, "_gains", lambda *a: calls.append(1) or gains(*a))
    assert substring_dedup.passages(links, x, y, 0, 0) == [] and len(calls) == 2
    # a link by itself comes to what the stretches around it do, repeats and windows within the cut texts included
    found = 0
    for _ in range(300):
        x = [r.randint(0, 400) for _ in range(r.randint(wide + 8, 150))]
        y = list(x)
        for k in r.sample(range(len(y)), r.choice([0, 3, 6, 10, 40])):
            y[k] = r.choice([r.randint(500, 900), 7, y[k - 1]])
        x, y = [*x[5:9] * r.randint(0, 2), *x], [*y, *y[:9] * r.randint(0, 2)]
        a1, a2, b1, b2 = r.randint(0, 4), r.randint(0, 4), len(x) - 1 - r.randint(0, 4), len(y) - 1 - r.randint(0, 4)
        c1, c2 = r.randint(a1, b1), r.randint(a2, b2)
        want = substring_dedup.around(x[a1 : b1 + 1], y[a2 : b2 + 1], c1 - a1, c2 - a2)
        link = np.array([(a1, a2, c1, c2, b1, b2, a1, b1, a2, b2)], np.int32) + 30
        got = substring_dedup.passages(link, np.array(x), np.array(y), 30, 30)
        assert got == ([(want[0] + a1 + 30, want[1] + a1 + 30, want[2] + a2 + 30, want[3] + a2 + 30)] if want else [])
        found += len(got)
    assert 50 <= found < 250


def test_compact_windows_equal_cartesian_trees():
    texts = [prose(300, 1), prose(40, 2), None, "", "The " * 90 + prose(80, 3), prose(50, 4), "  " + prose(49, 5) + "\n"]
    token, ends = substring_dedup.tokens(pa.array(texts))
    assert np.diff(ends).tolist() == [max(len((t or "").split()) - 4, 0) for t in texts]
    for k, text in enumerate(texts):
        own, _ = substring_dedup.tokens(pa.array(["other words", text]).slice(1, 1))
        assert (own == token[ends[k] : ends[k + 1]]).all()
        for f in range(substring_dedup.HASHES):
            v, want, todo = substring_dedup.mix(own ^ substring_dedup._SEEDS[f]), [], [(0, len(own))]
            while todo:
                lo, hi = todo.pop()
                if hi - lo >= substring_dedup.LEAST:
                    c = lo + int(v[lo:hi].argmin())
                    want.append((lo, c, hi - 1))
                    todo += [(lo, c), (c + 1, hi)]
            want = [w for w in want if not w[1] or own[w[1]] != own[w[1] - 1]]  # of equal ones in a row the first
            of, a, c, b = substring_dedup.compact_windows(token, ends, f)
            mine = of == k
            got = np.stack([a, c, b], 1)[mine] - ends[k]
            assert got.tolist() == [list(w) for w in sorted(want, key=lambda w: w[1])]


def test_mixing_query_reads_the_training_order(spark, tmp_path):
    """op5 writes the copies in training order, range-sorted, and takes its figures from there."""
    docs = frame(spark, [prose(R.randint(0, 90), k) for k in range(60)], AWKWARD)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    written, stage = [], mixing.staged
    try:
        mixing.staged = lambda df, name: written.append((name, stage(df, name))) or written[-1][1]
        rows = queries.op5_mixing(spark, str(tmp_path)).collect()
    finally:
        mixing.staged = stage
    order = dict(written)["order"].select("position", F.input_file_name().alias("file")).collect()
    placed = [r.position for r in sorted(order, key=lambda r: r.file.rsplit("/", 1)[1])]
    assert placed == sorted(placed)
    known = mixing.mix(docs).collect()
    assert len(placed) == sum(r.passes for r in known) and len(rows) == len(known) == docs.count()
    ends = lambda p: (round(min(p), 6), round(max(p), 6)) if p else (None, None)
    want = [(r.doc_id, r.size, r.taken, *ends(r.positions)) for r in known]
    got = [(r.doc_id, r.size, r.taken, r.first_position, r.last_position) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
