"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    language_id,
    line_dedup,
    mixing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece,
    simhash,
    substring_dedup,
    vector_codes,
    vector_search,
    warc,
)
from .common import table, words

#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words, pairs = secret_scan.dictionary(vocabulary), secret_scan.transitions(docs)
    model = secret_scan.train(secret_scan.labelled_findings(spark, around=secret_scan.surroundings(docs)), pairs, words)
    return secret_scan.scan(docs, model, pairs, words, "source")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text", "lang", "source", "n_chars")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentencepiece.encode(docs, sentencepiece.model_bytes(model), keep=["doc_id"])
    digest = lambda ids: F.md5(F.array_join(ids.cast("array<string>"), " ").cast("binary"))
    return found.withColumn("md5", F.transform("n_best", digest)).select(
        "doc_id", "n_tokens", F.get("md5", F.lit(0)).alias("ids_md5"), F.array_join("md5", " ").alias("n_best_md5"), "scores", "exact",
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken, and the positions of the first and the last copy, as the training order has them."""
    return mixing.mixed_in_order(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.round("first_position", 6).alias("first_position"), F.round("last_position", 6).alias("last_position"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.concat_ws("/", "source", "lang")
    found = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), site)
    return found.drop("text_key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their language tag is the declaration, their source the host) and pages. No document is
    judged by likelihoods learned from itself: those of even ids by the odd ones, and the other way."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    no, half = F.lit(None), F.pmod("doc_id", F.lit(2))
    rows = docs.select(
        "doc_id", no.cast("long").alias("page_id"), "text", no.cast("string").alias("html"), F.col("lang").alias("declared"),
        no.cast("string").alias("url"), F.coalesce("source", F.lit("")).alias("host"), half.alias("half"),
    ).unionByName(
        pages.select(
            no.cast("long").alias("doc_id"), "page_id", no.cast("string").alias("text"), "html", no.cast("string").alias("declared"),
            "url", no.cast("string").alias("host"), F.pmod("page_id", F.lit(2)).alias("half"),
        )
    )
    return language_id.identify(rows, docs.select("text", "lang", half.alias("half")), "half").drop("half")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", "n_lines", "n_removed", n_chars.alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _, text = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.lit(text).cast("binary"), 256)
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the archives that pages were written to, as read back and found in order."""
    records = warc.page_records(warc.read(warc.write(table(spark, sf_dir, "pages"))))
    sound = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat_ws(" ", "path", "offset", "problem")))
    return records.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the words of documents, of which one in ten repeats a stretch of its own (`_with_cycles`)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_cycles(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.repeated_runs(docs, ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), "longest.length",
        (-F.col("longest.period")).alias("period"), F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _with_cycles(doc_id: Column, text: Column) -> Column:
    """The text itself, but for ids whose CRC-32 h is a multiple of ten: with g = h / 10 and n words, the
    words from a = g % n on repeat the first p = 1 + (n - a) / (3 + g % 8) of them. A NULL id has none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, w = F.floor(h / 10), words(text)
    n = F.size(w)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    cycles = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), cycles), F.lit(1), n), " ")).otherwise(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_topk": op9_topk,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_warc": op12_warc,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op9_topk": vector_search.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_warc": warc.ORACLE,
}
