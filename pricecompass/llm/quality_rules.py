"""Quality rules: base rules of a text, and the log-likelihood ratio of its hashed n-grams between
a trusted target and the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words
from .ngrams import BUCKETS, PARTS, counts, let, log_ratio, n_grams, score

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document is kept when its log-likelihood ratio per n-gram is no less than this.
THRESHOLD = -0.1
#: The target multinomial is fitted on at most this many trusted documents (8 bytes each are
#: broadcast); the raw one on all.
TRUSTED_ROWS = 100_000
#: n-grams that the raw corpus adds to the target where it is smoothed toward it.
TOWARD_RAW = 4 * BUCKETS


def repeat_words(w: Column) -> Column:
    """Words in windows of WINDOW words found twice or more in w, the first ones included.

    Window hashes are built by doubling (2, 4, 8 words). Only texts whose windows are not all
    distinct are sorted to find which ones repeat.
    """

    def twice(h: Column, step: int) -> Column:
        return let(h, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))

    def covered(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = F.transform(
            s,
            lambda x, i: F.when(
                (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])), x["i"]
            ),
        )
        return let(F.array_sort(F.filter(same, lambda x: x.isNotNull())), covered)

    def of(h: Column) -> Column:
        s = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(s, repeated))

    hashes = let(w, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))))
    for step in (2, 4):
        hashes = twice(hashes, step)
    return let(F.slice(hashes, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), of)


def base_metrics(docs: DataFrame) -> DataFrame:
    """docs with w (the words), n_words and the four measures of the base rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumns(
        {"w": words(text), "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")}
    ).withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col("w")),
        }
    )


def trusted_sample(labels: DataFrame) -> DataFrame:
    """doc_ids labelled as good, at most TRUSTED_ROWS: those with the smallest MD5 of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    return good.orderBy(key, "doc_id").limit(TRUSTED_ROWS)


def quality_rules(docs: DataFrame, labels: DataFrame, toward: int = 0) -> DataFrame:
    """docs' columns, the measures, score (sum of n-gram log ratios), base_failed and kept.

    A NULL text counts as empty and an empty text fails the base rules. A repeated row is judged
    like the first; a NULL doc_id is judged but never trusted. toward 0 weighs as ORACLE does: the
    target is smoothed evenly, so with few trusted documents frequent n-grams weigh negative and
    clean texts are dropped. With toward (TOWARD_RAW) it is smoothed toward the raw corpus: without
    trusted documents all weights are 0 and the base rules decide. Columns of docs named like a
    measure are replaced. Everything runs as built-in expressions; the corpus is read twice and only
    n-gram counts (at most BUCKETS rows a task) are shuffled.
    """
    names = {"w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"}
    docs = docs.drop(*(names & set(docs.columns)))
    trusted = F.broadcast(trusted_sample(labels).select(F.col("doc_id").alias("_trusted")))
    marked = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_trusted"), "left")
    count = counts(marked, target=F.col("_trusted").isNotNull())
    measured = base_metrics(docs).withColumn("score", score(F.col("w"), log_ratio(count, "target", "raw", toward)))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    floor = n_grams(F.col("n_words")) * F.lit(int(THRESHOLD * PARTS)).cast("long")
    return (
        measured.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= floor))
        .drop("w")
    )


#: What SQL makes of the same rules.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (SELECT *, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 6))::BIGINT) AS ids FROM d),
g AS (
  SELECT r, doc_id, unnest(list_concat(
    list_transform(ids, lambda x: x % 65536),
    list_transform(range(1, len(ids)), lambda k: (ids[k] * 8191 + ids[k + 1]) % 65536))) AS bucket FROM i),
good AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)
  ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100000),
c AS (
  SELECT bucket, count(*) AS raw, count(good.doc_id) AS target
  FROM g LEFT JOIN good ON g.doc_id = good.doc_id GROUP BY bucket),
n AS (SELECT sum(raw)::DOUBLE AS raw_all, sum(target)::DOUBLE AS target_all FROM c),
weights AS (
  SELECT bucket, round((ln((target + 1.0::DOUBLE) / (target_all + 65536.0::DOUBLE))
                      - ln((raw + 1.0::DOUBLE) / (raw_all + 65536.0::DOUBLE))) * 1000000)::BIGINT AS weight
  FROM c, n),
s AS (SELECT r, sum(weight)::BIGINT AS score FROM g JOIN weights USING (bucket) GROUP BY r),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS p, w FROM i WHERE len(w) >= 8),
key AS (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS k FROM win),
dup AS (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS n FROM key),
hit AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM dup WHERE n > 1),
rep AS (SELECT r, sum(least(8, coalesce(q - p, 8)))::BIGINT AS n_repeat_words FROM hit GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT
      AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(score, 0)::BIGINT AS score
  FROM i LEFT JOIN rep USING (r) LEFT JOIN s USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND score >= greatest(2 * n_words - 1, 0) * -100000 AS kept FROM f
"""
