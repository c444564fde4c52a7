"""Training-data pipeline over documents: quality rules, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricecompass.llm import line_dedup, mixing, quality_rules, sentencepiece, simhash
from pricecompass.llm.common import staged, table
from pricecompass.llm.queries import TOKENIZERS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, the trusted target smoothed toward the raw corpus.

    A NULL or empty text goes, for it has too few words; a NULL doc_id is judged like another; repeated
    rows stay or go together; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, labels, quality_rules.TOWARD_RAW).where("kept").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has.

    A document that loses all its lines stays, with an empty text; a NULL text stays NULL, with NULL
    n_chars; rows equal in doc_id and text lose the same; an empty table stays empty.
    """
    left = line_dedup.line_dedup(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest (doc_id, text), NULL ids last.

    NULL texts, empty ones and those without words are one group; of repeated rows one stays; an empty
    table stays empty.
    """
    return simhash.deduplicate(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them: range-sorted, so the order is that
    of the files written and of the rows in them.

    A NULL text counts no words and is taken as its place says; a NULL source is a source; repeated
    rows are dealt one by one; an empty table stays empty.
    """
    return mixing.training_order(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with the scores of their best segmentations and their position in
    training: ascending over the rows in the order they were written in.

    A NULL text has NULL ids and no tokens; an empty one has empty ids; repeated rows are encoded each;
    an empty table gives no rows.
    """
    placed = docs.withColumn("position", _written_order(docs))
    encoded = sentencepiece.encode(placed, sentencepiece.model_bytes(f"{TOKENIZERS}/piece_bpe_32k.model"), keep=[*docs.columns, "position"])
    return encoded.drop("text", "n_best")


def _written_order(docs: DataFrame) -> Column:
    """Whole number that ascends with the place of a row in the files of a table, by the numbers of the
    task and of its file in a file's name and the row's place in it; of rows that come from no file, as
    they come."""
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return F.monotonically_increasing_id()
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(number(r"^part-(\d+)"), 43) + F.shiftleft(number(r"-c(\d+)\."), 32) + F.col("_metadata.row_index")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SentencePiece segmentation is beyond SQL.
ORACLE_SQL: str | None = None
