"""Limits on time and space: what of a search is ranked in time, how long an answer is remembered, which
files of a cache stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Time for a retailer whose search is known, for another, and for a whole search.
KNOWN_MS, UNKNOWN_MS, SEARCH_MS = 28_000, 16_000, 52_000
DAY_MS = 86_400_000
# Lifetimes of a search template that was found, and of none found.
FOUND_MS, NONE_MS = 30 * DAY_MS, 3 * DAY_MS
# The same in memory, where what is blocked or rendered by the client counts as none found.
FOUND_IN_MEMORY_MS, NONE_IN_MEMORY_MS = 6 * 3_600_000, 30 * 60_000
# Age, number and bytes of the files that a directory keeps.
FILE_AGE_MS, MOST_FILES, MOST_BYTES = 90 * DAY_MS, 300, 32 * 1024 * 1024


def budget_ms(known: Column) -> Column:
    return F.when(known, KNOWN_MS).otherwise(UNKNOWN_MS)


def template_fresh(template: Column, age_ms: Column) -> Column:
    """Whether a remembered template, or the memory that there is none (NULL), still counts."""
    return F.coalesce(age_ms <= F.when(template.isNull(), NONE_MS).otherwise(FOUND_MS), F.lit(False))


def template_in_memory(template: Column, blocked: Column, age_ms: Column) -> Column:
    """What is done with a template in memory: `use` it, `skip` the retailer (none was found, or it was blocked, and
    that isn't long ago), or `ask` again."""
    none = template.isNull() | F.coalesce(blocked, F.lit(False))
    young = F.coalesce(age_ms <= F.when(none, NONE_IN_MEMORY_MS).otherwise(FOUND_IN_MEMORY_MS), F.lit(False))
    return F.when(~young, "ask").when(none, "skip").otherwise("use")


def partial_results(attempts: DataFrame) -> DataFrame:
    """attempts (search_id, domain, known, queued_ms, took_ms, found, failure) as they end: found,
    failure and took_ms as told, in_time, and search_failed where a search ran out of time with nothing.

    An attempt over its own budget ends there with failure timeout; one that hasn't ended when the
    search's time is up is told as a timeout with nothing found. NULL took_ms never ends. A search asks a
    few retailers only, so its rows may meet in a window.
    """
    own = budget_ms(F.coalesce("known", F.lit(False)))
    late = F.coalesce(F.col("took_ms") > own, F.lit(True))
    ended = F.col("queued_ms") + F.when(late, own).otherwise(F.col("took_ms"))
    in_time = F.coalesce(ended <= SEARCH_MS, F.lit(False))
    told = attempts.withColumns({"_late": late, "_own": own, "in_time": in_time})
    any_in_time = F.bool_or("in_time").over(Window.partitionBy("search_id"))
    lost = F.col("_late") | ~F.col("in_time")
    return told.withColumns(
        {
            "search_failed": ~any_in_time,
            "found": F.when(lost, 0).otherwise(F.col("found")),
            "failure": F.when(lost, "timeout").otherwise(F.col("failure")),
            "took_ms": F.when(~F.col("in_time"), SEARCH_MS).when(F.col("_late"), F.col("_own")).otherwise(F.col("took_ms")),
        }
    ).drop("_late", "_own")


def _fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    directory, kept, held = object(), 0, 0
    for b in batches:
        out = np.zeros(len(b), bool)
        for k, (at, size, old) in enumerate(zip(*(b.column(c).to_pylist() for c in ("directory", "size", "old")), strict=True)):
            if at != directory:
                directory, kept, held = at, 0, 0
            if not old and kept < MOST_FILES and held + size <= MOST_BYTES:
                out[k] = True
                kept, held = kept + 1, held + size
        yield pa.RecordBatch.from_arrays([b.column("directory"), b.column("path"), pa.array(out)], ["directory", "path", "kept"])


def pruned(files: DataFrame) -> DataFrame:
    """(directory, path, kept) of files (directory, path, age_ms, size): newest first, ties by path, a file
    stays if it is young enough, fewer than MOST_FILES stayed and it still fits; one that doesn't fit
    leaves room for smaller, older ones.

    A directory is one sorted stream, so what a task holds doesn't grow with it. Old files can't stay and
    are dealt apart from it. NULL ages or sizes don't stay; a NULL directory is one directory; repeated
    rows count each; no rows give none.
    """
    old = ~F.coalesce((F.col("age_ms") <= FILE_AGE_MS) & (F.col("size") <= MOST_BYTES), F.lit(False))
    rows = files.select("directory", "path", "age_ms", "size", old.alias("old"))
    young = rows.where(~F.col("old")).repartition("directory").sortWithinPartitions("directory", "age_ms", "path")
    gone = rows.where("old").select("directory", "path", F.lit(False).alias("kept"))
    kinds = dict(files.dtypes)
    return young.mapInArrow(_fits, f"directory {kinds['directory']}, path {kinds['path']}, kept boolean").unionByName(gone)
