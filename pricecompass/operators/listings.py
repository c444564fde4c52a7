"""Listings before they are matched: sanity, and one of each that is listed more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a title that is one.
TITLE = (3, 300)


def sane(rows: DataFrame) -> DataFrame:
    """Rows with a price above 0 and a title of TITLE characters that has a letter or a digit. NULL
    titles and prices go."""
    return rows.where((F.col("price") > 0) & F.length("title").between(*TITLE) & F.col("title").rlike(r"[\p{L}\p{N}]"))


def deduped(rows: DataFrame, order: str) -> DataFrame:
    """The first row, by order, of each address (or title without case, where there is none) and price.

    The first place of a key is a partial aggregate, so a key in a third of all rows is no task's
    burden; order holds no ties.
    """
    key = F.coalesce(F.col("url"), F.lower("title"))
    first = rows.groupBy(key.alias("_key"), F.col("price").alias("_price")).agg(F.min(order).alias(order))
    return rows.join(first.select(order), order, "left_semi")
