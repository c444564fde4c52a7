"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, spread_join, staged


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root): root is the smallest node that can be reached.

    Each round hangs a node's larger neighbours on its smallest neighbour (large star), then its
    smaller ones (small star), until nothing moves; the rounds needed grow with the logarithm of
    the longest path. A hub is never gathered: its minimum is a partial aggregate, and its edges meet
    that minimum in a join that deals them over salts. Null ends and loops are ignored; no edges
    give no rows.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = staged(large.distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        drop_staged(now)
        drop_staged(large)
        now = after
        n, total, centres = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.countDistinct("v")).first()
        if (n, total, centres) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (n, total, centres)
