"""Values kept in files, one a key, each in an envelope that says when it was saved."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingestion import usable_snapshot

# Bytes of a file at most, and how its name is made of the key's SHA-1.
MOST_BYTES = 8 * 1024 * 1024
NAME_DIGITS = 20
NAME = rf"/[a-f0-9]{{{NAME_DIGITS}}}\.json$"


def file_name(key: Column) -> Column:
    return F.concat(F.substring(F.sha1(key.cast("binary")), 1, NAME_DIGITS), F.lit(".json"))


def write(values: DataFrame, folder: str) -> DataFrame:
    """Files of values (key, saved_ms, value: JSON) in a folder that executors share: (name, bytes) of each,
    when the frame is run.

    A file is written under another name and moved, so a reader never sees half of one, and a task that is
    run again writes the same. Of equal keys the last to be saved stays; ties go to the larger value.
    """
    newest = values.where("key is not null").groupBy("key").agg(F.max(F.struct("saved_ms", "value")).alias("v"))
    text = F.concat(F.lit('{"savedAt": '), F.col("v.saved_ms").cast("string"), F.lit(', "value": '), F.col("v.value"), F.lit("}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            for name, body in zip(b.column("name").to_pylist(), b.column("body").to_pylist(), strict=True):
                part = f"{base}/{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(body)
                system.move(part, f"{base}/{name}")
            sizes = pa.array([len(x) for x in b.column("body").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("name"), sizes], ["name", "bytes"])

    rows = newest.where("v.value is not null").select(file_name(F.col("key")).alias("name"), text.cast("binary").alias("body"))
    return rows.mapInArrow(run, "name string, bytes long")


def read(spark: SparkSession, folder: str, now_ms: int) -> DataFrame:
    """(name, bytes, saved_ms, age_ms, value, problem) of the files in a folder whose names are made of keys.

    problem is `too-large` (such a file isn't opened), `not-json` or `no-time` (a time that is missing, no
    number, negative or ahead of the clock); value is JSON. Files of other names, as those still being written, are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).where(F.col("path").rlike(NAME))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    large = files.where(F.col("length") > MOST_BYTES).select(name.alias("name"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("text"))
    small = files.where(F.col("length") <= MOST_BYTES).select(name.alias("name"), F.col("length").alias("bytes"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    parsed = large.unionByName(small).withColumn("v", F.try_parse_json("text"))
    saved = F.try_variant_get("v", "$.savedAt", "double")
    is_number = F.schema_of_variant(F.try_variant_get("v", "$.savedAt", "variant")).rlike("^(?:BIGINT|DOUBLE|DECIMAL)")
    whole = F.when(is_number & usable_snapshot(saved, now_ms), saved.cast("long"))
    problem = (
        F.when(F.col("bytes") > MOST_BYTES, "too-large")
        .when(F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "not-json")
        .when(whole.isNull(), "no-time")
    )
    told = parsed.withColumns({"saved_ms": whole, "problem": problem})
    fine = F.col("problem").isNull()
    return told.select(
        "name", "bytes", "saved_ms", F.when(fine, F.greatest(F.lit(now_ms) - F.col("saved_ms"), F.lit(0))).alias("age_ms"),
        F.when(fine, F.to_json(F.try_variant_get("v", "$.value", "variant"))).alias("value"), "problem",
    )
