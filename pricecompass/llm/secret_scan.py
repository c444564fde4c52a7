"""Secret scan: candidates found by their shape, false positives removed by a random forest.

A candidate is a long run of key characters with a letter, a quoted value of eight characters or more
assigned to a name, any value assigned to a name that speaks of secrets, or the password in an address. Its features are its length, how its characters follow each other (class changes, entropy, bigrams
against those of the corpus), how much of it dictionary words cover, the path it was found under and
the words around it. The forest is trained on labelled findings.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings that a forest is fitted on, at most.
TRAINING_ROWS = 20_000
#: Findings written by labelled_findings().
WRITTEN_ROWS = 4_000
TREES, DEPTH, SEED = 24, 7, 11
THRESHOLD = 0.5
#: Bytes of context looked at on either side.
AROUND = 64

# A candidate is written in one of four ways. Names and values may be of any length; repeats that give nothing
# back, from a name's first character on, keep the search linear.
_NAME = rb"[A-Za-z0-9_.-]++[\"']?+"
_SET = rb"[ \t]{0,3}+(?::=|=>|[:=])[ \t]{0,3}+"
_SPEAKS = rb"(?=[A-Za-z0-9_.-]*?(?i:token|secret|passw|pwd|key|auth|credential|bearer))"
_QUOTED = _NAME + _SET + rb"[\"']([^\"'\s]{8,}+)[\"']"
_NAMED = _SPEAKS + _NAME + rb"(?:" + _SET + rb"(?:(?i:bearer|basic)[ \t]++)?+|(?<=[Bb]earer)[ \t]++)(?:[\"']([^\"'\s]++)[\"']|([^\s\"'<>(){}\[\],;]++))"
_ADDRESS = rb"://[^\s/@:\"'<>]*+:([^\s/@\"'<>]++)@"
_RUN = rb"[A-Za-z0-9+/_=.~-]{16,}+"
_CANDIDATE = re.compile(rb"(?<![A-Za-z0-9_.-])(?:" + _NAMED + rb"|" + _QUOTED + rb")|" + _ADDRESS + rb"|(" + _RUN + rb")")
_IN_ADDRESS = re.compile(_ADDRESS)
_WORD = re.compile(rb"[a-z]+")
_SEPARATED = re.compile(rb"[A-Za-z0-9]+")

# Words that stand by secrets, by digests, and in placeholders and trial paths.
SECRET_WORDS = frozenset(b"token secret password passwd pwd key apikey api auth credential credentials bearer private access".split())
DIGEST_WORDS = frozenset(b"sha sha1 sha256 sha512 md5 commit hash checksum digest integrity uuid guid etag revision id version".split())
PLACEHOLDERS = (b"example", b"changeme", b"placeholder", b"dummy", b"xxxx", b"your", b"sample", b"redacted", b"1234567")
TRIAL_PATHS = (b"test", b"example", b"fixture", b"sample", b"doc", b"mock")

FEATURES = (
    "length", "entropy", "distinct", "digits", "uppers", "symbols", "changes", "hex", "bigram", "coverage", "quoted",
    "assigned", "secret_word", "digest_word", "placeholder", "trial_path", "path_depth", "words_near", "in_address",
)
_CLASS = np.full(256, 3, np.int8)  # 0 lower, 1 upper, 2 digit, 3 else
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_SYMBOL = np.full(256, 37, np.int64)  # letters without case, digits, other
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(26)
_SYMBOL[48:58] = 26 + np.arange(10)
SYMBOLS = 38


def dictionary(vocabulary_file: str) -> frozenset[bytes]:
    """Words of four letters or more of a vocabulary with word ends (a file of fixed size)."""
    with open(vocabulary_file, encoding="utf-8") as f:
        words = (w.removesuffix("</w>") for w in json.load(f)["model"]["vocab"] if w.endswith("</w>"))
        return frozenset(w.encode() for w in words if len(w) >= 4 and w.isascii() and w.isalpha())


def transitions(docs: DataFrame) -> np.ndarray:
    """Log probability of each symbol after another in all texts; each task sums its own bigrams,
    so that SYMBOLS squared rows a task are shuffled and as many come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for b in batches:
            for text in b.text.dropna():
                s = _SYMBOL[np.frombuffer(text.encode(), np.uint8)]
                if len(s) > 1:
                    total += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=len(total))
        yield pd.DataFrame({"pair": np.arange(len(total)), "n": total})

    rows = docs.select("text").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.ones((SYMBOLS, SYMBOLS))
    for r in rows:
        table[r.pair // SYMBOLS, r.pair % SYMBOLS] += r.n
    return np.log(table / table.sum(1, keepdims=True))


def _covered(value: bytes, words: frozenset[bytes]) -> float:
    """Share of a value's characters that dictionary words cover, longest first from the left."""
    done = 0
    for run in _WORD.findall(value.lower()):
        i = 0
        while i < len(run) - 3:
            for j in range(min(len(run), i + 20), i + 3, -1):
                if run[i:j] in words:
                    done += j - i
                    i = j
                    break
            else:
                i += 1
    return done / len(value)


def features(value: bytes, before: bytes, after: bytes, path: bytes, table: np.ndarray, words: frozenset[bytes]) -> list[float]:
    """FEATURES of a candidate."""
    raw = np.frombuffer(value, np.uint8)
    kind, symbol, n = _CLASS[raw], _SYMBOL[raw], len(value)
    p = np.array(list(Counter(value).values())) / n
    near = [w.lower() for w in _SEPARATED.findall(before)[-4:]]
    follow = _SEPARATED.findall(after)[:2]
    tail = before.rstrip(b" \t\"'")
    low = value.lower()
    return [
        float(n),
        float(-(p * np.log2(p)).sum()),
        len(p) / n,
        float((kind == 2).mean()),
        float((kind == 1).mean()),
        float((kind == 3).mean()),
        float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0,
        float(all(c in b"0123456789abcdef" for c in low)),
        float(table[symbol[:-1], symbol[1:]].mean()) if n > 1 else 0.0,
        _covered(value, words),
        float(before[-1:] in (b'"', b"'") and after[:1] == before[-1:]),
        float(tail[-1:] in (b"=", b":", b">")),
        float(any(part in SECRET_WORDS for w in near for part in (w, *w.split(b"_")))),
        float(any(w in DIGEST_WORDS for w in near)),
        float(any(x in low for x in PLACEHOLDERS) or len(p) <= 3),
        float(any(x in path.lower() for x in TRIAL_PATHS)),
        float(path.count(b"/")),
        float(sum(w.lower() in words for w in near + follow)),
        float(after[:1] == b"@" and b"://" in before[-40:]),
    ]


def candidates(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(byte offset, value) of each candidate of a text. Of a named value that is an address with a
    password in it, the password is the candidate."""
    for m in _CANDIDATE.finditer(text):
        k = m.lastindex
        if k == 5 and not any(65 <= c <= 90 or 97 <= c <= 122 for c in m[5]):
            continue
        inner = list(_IN_ADDRESS.finditer(m[k])) if k < 4 and b"://" in m[k] else []
        if inner:
            for x in inner:
                yield m.start(k) + x.start(1), x[1]
        else:
            yield m.start(k), m[k]


def find(docs: DataFrame, table: np.ndarray, words: frozenset[bytes], path: str | None) -> DataFrame:
    """(doc_id, start, length, value_md5, x): candidates of whole texts with their features.

    start counts bytes of UTF-8; the value itself isn't returned. A very long value is one candidate like others.
    """
    from hashlib import md5

    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((table, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, words = known.value
        for b in batches:
            out = []
            for id_, text, where in zip(b.doc_id, b.text, b.path, strict=True):
                if text is None:
                    continue
                raw = text.encode()
                for at, value in candidates(raw):
                    end = at + len(value)
                    x = features(value, raw[max(0, at - AROUND) : at], raw[end : end + AROUND], (where or "").encode(), table, words)
                    out.append((None if pd.isna(id_) else int(id_), at, len(value), md5(value).hexdigest(), x))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "length", "value_md5", "x"]
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    return docs.select("doc_id", "text", where.alias("path")).mapInPandas(
        run, "doc_id long, start long, length long, value_md5 string, x array<double>"
    )


def surroundings(docs: DataFrame, n: int = 400) -> list[str]:
    """Stretches of 300 characters of n documents at most, those with the smallest MD5 of the id: what
    findings are written into."""
    some = docs.where("text is not null and doc_id is not null").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return [r[0] for r in some.select(F.substring("text", 1, 300)).limit(n).collect()]


def labelled_findings(spark: SparkSession, n: int = WRITTEN_ROWS, seed: int = SEED, around: list[str] | None = None) -> DataFrame:
    """(doc_id, text, path, start, length, label): n written texts of one finding each, half of them
    secrets, for corpora that bring no labelled findings of their own. doc_id counts from 0; start and
    length say where in the text (bytes) the finding is; `around` are texts to write it into."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa, lower = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    alnum = lower.upper() + lower + "0123456789"
    plain = "the service reads values from this place and writes them again when users change their settings later".split()
    word = lambda: r.choice(plain)

    def prose() -> str:
        if not around:
            return " ".join(word() for _ in range(r.randint(2, 8)))
        text = r.choice(around)
        at = r.randint(0, max(len(text) - 60, 0))
        return text[at : at + r.randint(20, 60)]

    def value() -> str:
        return r.choice(
            [
                lambda: pick(hexa, r.choice([32, 40, 64])),
                lambda: pick(alnum, r.randint(20, 64)),
                lambda: pick(alnum + "+/", r.randint(24, 60)) + "==",
                lambda: pick(lower.upper() + lower, r.randint(20, 48)),
                lambda: pick(lower + "0123456789", r.randint(9, 16)),
                lambda: f"{pick(lower, 4)}_{pick(alnum, r.randint(24, 40))}",
                lambda: f"{word()}{r.randint(10, 9999)}{pick('!#%*', 1)}{pick(alnum, 4)}",
                lambda: f"{pick(lower, 3)}{r.randint(1, 999)}{pick(lower, 2)}{pick('!#%*', r.randint(0, 1))}",
                lambda: pick(alnum, r.randint(257, 600)),
            ]
        )()

    def secret() -> tuple[str, str, str]:
        v = value()
        name = r.choice("token secret api_key password auth_token access_key client_secret db.password PRIVATE_KEY pwd".split())
        name, v = (name.upper(), v.upper()) if r.random() < 0.2 else (name, v)
        if r.random() < 0.15:
            name = "_".join([word() for _ in range(r.randint(3, 9))] + [name])
        if r.random() < 0.1:
            v = v.replace("/", "-")
            return f"{r.choice(['postgres', 'mysql', 'https', 'amqp'])}://{word()}:", v, f"@{word()}.example.com/{word()}"
        q = r.choice(['"', "'", "", ""])
        if r.random() < 0.15:
            return "Authorization: Bearer ", v, ""
        if r.random() < 0.1 and len(v) >= 20:
            return "", v, ""
        return f"{name}{r.choice([' = ', '=', ': ', ' := '])}{q}", v, q

    def other() -> tuple[str, str]:
        return r.choice(
            [
                lambda: (f"{r.choice(['sha256', 'commit', 'md5', 'checksum', 'etag'])}{r.choice([' ', ': ', ' = '])}", pick(hexa, r.choice([32, 40, 64]))),
                lambda: ("id ", f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}"),
                lambda: ("", f"{word()}{word()}{word()}{r.randint(1, 99)}{word()}"),
                lambda: ("", f"{word()}{word().title()}{word().title()}{word().title()}"),
                lambda: ("", r.choice([str.upper, str.lower, str.title])("".join(re.findall("[A-Za-z]+", prose())))[: r.randint(16, 30)] or word()),
                lambda: ("", f"/{word()}/{word()}/{word()}/{r.randint(100, 99999)}.html"),
                lambda: (f"{r.choice(['token', 'password', 'api_key'])} = ", r.choice(["changeme", "your_token_here_1", "example-secret-1", "xxxxxxxxxxxxxxxx1"])),
                lambda: (f"{r.choice(['password', 'token', 'secret_name'])}: ", f"{word()}_{word()}" if r.random() < 0.5 else word() + word()),
                lambda: (f"{r.choice(['password', 'token', 'secret', 'api_key', 'auth'])}{r.choice([': ', ' = ', '='])}", r.choice([word(), "none", "true", "required", "null"])),
                lambda: (f"{r.choice(['postgres', 'mysql', 'https'])}://{word()}:", f"{r.choice(['password', 'changeme', 'xxxxxxxx', 'your_password'])}@{word()}.example.com/"),
                lambda: (f"{r.choice(['key', 'keyboard', 'author'])} = ", f"{word()}.{word()}.{word()}"),
                lambda: (f'{r.choice(["title", "name", "label"])} = "', f'{word()}_{word()}_{word()}"'),
                lambda: ("", f"{word()}.{r.randint(1, 99)}.{word()}@mail{r.randint(1, 9)}.example.com"),
                lambda: ("", f"www.{word()}-{word()}{r.randint(1, 9)}.example.com/{word()}"),
            ]
        )()

    rows = []
    for k in range(n):
        good = k % 2 == 0
        trial = r.random() < (0.1 if good else 0.3)
        path = f"{r.choice(['src', 'app', 'conf'])}/{'tests/' if trial else ''}{word()}.txt" if r.random() < 0.5 else None
        before, (name, v, tail), after = prose(), secret() if good else (*other(), ""), prose()
        head = f"{before} {name}"
        rows.append((k, f"{head}{v}{tail} {after}", path, len(head.encode()), len(v.encode()), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, path string, start long, length long, label int")


def train(labelled: DataFrame, table: np.ndarray, words: frozenset[bytes], path: str | None = "path") -> RandomForestClassificationModel:
    """Forest over labelled findings (doc_id, text, path, label, and start and length in bytes, where
    known): the candidates that meet a finding have its label, all of a text where start is NULL or no
    column. Beyond TRAINING_ROWS, those with the smallest MD5 of the id are taken."""
    some = labelled.where("label is not null and text is not null").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(TRAINING_ROWS)
    no = F.lit(None).cast("long")
    of = [F.col(c) if c in labelled.columns else no for c in ("start", "length")]
    truth = some.select("doc_id", F.col("label").cast("double").alias("label"), of[0].alias("from"), (of[0] + of[1]).alias("to"))
    found = find(some, table, words, path).join(truth, "doc_id")
    found = found.where(F.col("from").isNull() | ((F.col("start") < F.col("to")) & (F.col("start") + F.col("length") > F.col("from"))))
    rows = found.orderBy("doc_id", "start").coalesce(1).select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=3).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, table: np.ndarray, words: frozenset[bytes], path: str | None = None) -> DataFrame:
    """(doc_id, start, length, value_md5, probability, is_secret) of every candidate of docs.

    A candidate that runs over another isn't given twice. Names and values may be of any length, and so may
    texts: the search is linear in them. A NULL or empty text has no candidates; a NULL doc_id or path is allowed; a repeated row gives
    its findings again; no rows give none; other columns are ignored.
    """
    scored = model.transform(find(docs, table, words, path).withColumn("features", array_to_vector("x")))
    p = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "length", "value_md5", F.round(p, 6).alias("probability"), (p >= THRESHOLD).alias("is_secret"))
