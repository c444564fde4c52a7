"""Language ID by Bayesian evidence fusion.

Four sources of evidence meet in a posterior: the likelihood of the text's hashed letter n-grams under
each language, the language that the markup declares, the suffix of the address, and the languages
of the host, shrunk towards its domain's and those towards all. How far declarations, suffixes
and hosts are to be believed is estimated from the texts' own posteriors by grouped aggregation,
the document that is judged left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged
from .ngrams import let

#: Buckets of letter n-grams of every language, however many there are.
BITS = 14
BUCKETS = 1 << BITS
ORDER = 3
#: n-grams that all languages together lend to each: a rare one isn't flattened by its few texts.
SMOOTH = 1000.0
#: n-grams of a text overlap and repeat: so many count as one.
OVERLAP = 6.0
#: Documents that the prior of a declaration, a suffix, a domain and a host is worth.
WORTH = 10.0
UNKNOWN = "und"

_HTML_LANG = re.compile(r"<html\b[^<>]{0,2000}?\blang\s{0,20}=\s{0,20}[\"']?([A-Za-z]{2,8})", re.I)
_OPEN = re.compile(r"<(script|style|noscript|nav|footer)\b|<!--", re.I)
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "nav", "footer")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^<>]*>")
_ENTITY = re.compile(r"&#?\w{1,31};")
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32  # letters without case
_FOLD[:65] = 32  # digits and signs separate words
_FOLD[91:97] = _FOLD[123:128] = 32


def visible(html: str) -> str:
    """Text of a page without scripts, styles, navigation, comments, tags and entities.

    What opens and is never closed hides nothing. Each kind of end that isn't found once isn't sought
    again, so the time is linear in the page.
    """
    parts, at, missing = [], 0, set()
    for m in _OPEN.finditer(html):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in missing:
            continue
        end = _CLOSE[kind].search(html, m.end())
        if end is None:
            missing.add(kind)
            continue
        parts.append(html[at : m.start()])
        at = end.end()
    parts.append(html[at:])
    return _ENTITY.sub(" ", _TAG.sub(" ", " ".join(parts)))


def grams(text: str) -> np.ndarray:
    """Buckets of the letter n-grams (1 to ORDER bytes) of a text."""
    b = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    out, h = [], np.zeros(len(b), np.uint64)
    for k in range(ORDER):
        h = h[: len(b) - k] * np.uint64(257) + b[k:]
        keep = h != np.uint64(32) if k == 0 else np.ones(len(h), bool)
        mixed = (h[keep] + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


class Languages:
    """Names of languages and how much likelier each makes a bucket than what all languages lend it.

    Only buckets that a language's texts hold are kept, bucket by bucket: a language adds what its own
    texts have, and no other language's weights depend on how many there are.
    """

    def __init__(self, names: list[str], k: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> None:
        """Counts n of a bucket in the texts of language k, each pair once."""
        self.names = names
        pooled = (np.bincount(bucket, n, BUCKETS) + 1) / (n.sum() + BUCKETS)
        order = np.lexsort((k, bucket))
        self.lang, at, n = k[order], bucket[order], n[order]
        self.start = np.searchsorted(at, np.arange(BUCKETS + 1))
        self.gain = np.log1p(n / (SMOOTH * pooled[at]))
        size = np.bincount(self.lang, n, len(names))
        self.size = np.log(size + SMOOTH)
        self.unseen = (size == 0) & size.any()  # nothing was learned of them, so no text is theirs

    def posterior(self, text: str) -> np.ndarray:
        """Probability of each language by the text alone, all of them alike before."""
        c = np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(c)
        first, many = self.start[at], self.start[at + 1] - self.start[at]
        cell = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        gain = np.bincount(self.lang[cell], np.repeat(c[at], many) * self.gain[cell], len(self.names))
        s = np.where(self.unseen, -np.inf, (gain - c.sum() * self.size) / OVERLAP)
        p = np.exp(s - s.max())
        return p / p.sum()


def learned(labelled: DataFrame, half: str | None = None) -> list[Languages]:
    """Languages of (text, lang). With half, a column of 0 and 1, two of them over the same names: the
    first has learned from the texts of half 1 and judges those of half 0, the second the other way.

    Each task sums its own n-grams; of the sums, BUCKETS rows a language and half at most come to the
    driver. A language that only one half has is found in the other alone.
    """
    known = labelled.where("lang is not null and text is not null")
    names = sorted(r.lang for r in known.select("lang").distinct().collect())
    index = {n: k for k, n in enumerate(names)}
    of = known.select("text", "lang", (F.lit(0) if half is None else 1 - F.coalesce(half, F.lit(0))).cast("int").alias("model"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for text, lang, model in zip(b.column("text"), b.column("lang"), b.column("model").to_pylist(), strict=True):
                key = (model, index[lang.as_py()])
                if key not in sums:
                    sums[key] = np.zeros(BUCKETS, np.int64)
                sums[key] += np.bincount(grams(text.as_py()), minlength=BUCKETS)
        for (model, k), n in sums.items():
            at = np.flatnonzero(n)
            columns = [np.full(len(at), model), np.full(len(at), k), at, n[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["model", "k", "bucket", "n"])

    counted = of.mapInArrow(count, "model long, k long, bucket long, n long").groupBy("model", "k", "bucket").agg(F.sum("n").alias("n"))
    model, k, bucket, n = (c.to_numpy() for c in counted.toArrow().columns)
    return [Languages(names, *(x[model == m] for x in (k, bucket, n))) for m in range(1 if half is None else 2)]


def read_texts(rows: DataFrame, languages: list[Languages], half: str | None = None) -> DataFrame:
    """(id columns..., declared, host, domain, suffix, p): rows have text or html, url or host, declared.

    p is the text's posterior over the languages, as the model of the row's half has it (NULL: 0).
    """
    shared = rows.sparkSession.sparkContext.broadcast(languages)
    rows = rows.withColumn("_model", (F.lit(0) if half is None else F.coalesce(half, F.lit(0))).cast("int"))
    ids = [c for c in rows.columns if c not in ("text", "html", "declared", "url", "host", "_model")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            p, declared = [], []
            for text, html, said, model in zip(b.text, b.html, b.declared, b._model, strict=True):
                if html is not None:
                    text = visible(html)
                    m = _HTML_LANG.search(html)
                    said = m[1] if m else said
                p.append(known[model].posterior(text or ""))
                declared.append(None if said is None else said.lower())
            yield b[[*ids, "host"]].assign(declared=declared, p=p)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    host = F.coalesce(F.col("host"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ids), "host string", "declared string", "p array<double>"])
    read = rows.withColumn("host", host).select(*ids, "text", "html", "declared", "host", "_model").mapInPandas(run, schema)
    labels = F.split("host", r"\.")
    dotted = F.size(labels) > 1
    return read.withColumns(
        {
            "suffix": F.when(dotted, F.element_at(labels, -1)).otherwise(F.lit("")),
            "domain": F.when(dotted, F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))).otherwise(F.col("host")),
        }
    )


def _grouped(read: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Sums of the texts' posteriors by keys, one array of n; partial sums leave each task."""
    sums = [F.sum(F.col("p")[k]) for k in range(n)]
    return read.groupBy(*keys).agg(F.array(*sums).alias("seen"))


def _shrunk(seen: Column, own: Column, toward: Column) -> Column:
    """Shares of an array of sums without a document's own, shrunk towards other shares worth WORTH
    documents. A document's own shares sum to one."""
    total = F.greatest(F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) - 1, F.lit(0.0)) + F.lit(WORTH)
    return F.transform(seen, lambda x, i: (F.greatest(x - F.get(own, i), F.lit(0.0)) + F.lit(WORTH) * F.get(toward, i)) / total)


def fuse(read: DataFrame, names: list[str]) -> DataFrame:
    """read with lang and probability: the best language of the fused posterior.

    A document's own posterior is taken out of what its host, domain, suffix and declaration have seen.
    Rows meet what their site has seen in a join that deals hot sites over salts.
    """
    n = len(names)
    keys = ["host", "domain", "suffix", "declared"]
    site = F.to_json(F.struct(*keys))  # names what is there, so NULL and empty differ
    read = staged(read.withColumn("_site", site), "languages")
    cells = staged(_grouped(read, keys, n), "sites")

    def level(of: list[str], name: str) -> DataFrame:
        summed = cells.groupBy(*of).agg(F.array(*(F.sum(F.col("seen")[k]) for k in range(n))).alias(name))
        return summed.select(*(F.col(k).alias(f"_{k}") for k in of), name)

    all_ = cells.agg(*(F.sum(F.col("seen")[k]) for k in range(n))).first()
    total = sum(x or 0.0 for x in all_) or 1.0
    overall = F.array(*(F.lit(((x or 0.0) + 1.0 / n) / (total + 1.0)) for x in all_))
    sites = cells.select(*keys)
    for of, name in ((["domain"], "in_domain"), (["domain", "host"], "in_host"), (["declared"], "so_declared"), (["suffix"], "in_suffix")):
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in of]
        sites = sites.join(level(of, name), on[0] if len(on) == 1 else on[0] & on[1], "left").drop(*(f"_{k}" for k in of))
    sites = staged(sites.select(site.alias("_site"), "in_domain", "in_host", "so_declared", "in_suffix"), "weights")
    own = F.col("p")
    said, dotted = F.col("declared").isNotNull(), F.col("suffix") != ""
    prior = let(_shrunk(F.col("in_domain"), own, overall), lambda d: _shrunk(F.col("in_host"), own, d))

    def odds(seen: str, known: Column) -> Column:
        """P(key | language) over P(key): how much more often the language has it than all have."""
        share = _shrunk(F.col(seen), own, overall)
        return F.when(known, F.transform(share, lambda x, i: F.log(x / F.get(overall, i)))).otherwise(F.array_repeat(F.lit(0.0), n))

    parts = F.struct(prior.alias("prior"), odds("so_declared", said).alias("declared"), odds("in_suffix", dotted).alias("suffix"))
    score = let(
        parts,
        lambda s: F.transform(
            "p", lambda x, i: F.log(x + F.lit(1e-300)) + F.log(F.get(s["prior"], i)) + F.get(s["declared"], i) + F.get(s["suffix"], i)
        ),
    )
    fused = spread_join(read, sites, "_site").withColumn("score", score)
    known = F.array(*map(F.lit, names))
    top = F.array_max("score")
    rest = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return fused.withColumns({"lang": F.get(known, F.array_position("score", top).cast("int") - 1), "probability": 1 / rest}).drop(
        "_site", "in_domain", "in_host", "so_declared", "in_suffix", "score"
    )


def identify(rows: DataFrame, labelled: DataFrame, half: str | None = None) -> DataFrame:
    """rows' other columns, declared, host, lang, text_lang (by the text alone) and probability.

    rows have text, html (used instead of the text where not NULL), declared, url and host (NULL:
    taken from the url). labelled (text, lang) trains the likelihoods. With half, a column of 0 and 1 in
    both (NULL: 0), a row is judged by what was learned from the other half alone. A NULL or empty text leaves
    the decision to the other evidence; NULL declarations and missing hosts are evidence of nothing;
    repeated rows are judged alike; without labelled documents every language is UNKNOWN; every
    labelled language can be found, however rare; no rows give none; a column of rows named like a
    result (lang, text_lang, probability) is replaced.
    """
    languages = learned(labelled, half)
    names = languages[0].names
    rows = rows.drop(*({"lang", "text_lang", "probability", "p", "domain", "suffix", "score", "_site", "_model"} & set(rows.columns)))
    keep = [c for c in rows.columns if c not in ("text", "html", "declared", "url", "host")]
    if not names:
        none = F.lit(UNKNOWN)
        host = F.coalesce("host", F.lit(""))
        return rows.select(*keep, "declared", host.alias("host"), none.alias("lang"), none.alias("text_lang"), F.lit(0.0).alias("probability"))
    fused = fuse(read_texts(rows, languages, half), names)
    alone = F.get(F.array(*map(F.lit, names)), F.array_position("p", F.array_max("p")).cast("int") - 1)
    return fused.select(*keep, "declared", "host", "lang", alone.alias("text_lang"), "probability")
