"""From matched listings to ranked deals, their reasons, summary and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import values as V
from ..functions.matching import accepted
from .chunks import best_listings, staged


def purchasable(rows: DataFrame) -> DataFrame:
    """Accepted rows; where a domain has one that isn't known to be out of stock, those alone."""
    stocked = rows.groupBy("domain").agg(F.bool_or(F.coalesce("in_stock", F.lit(True))).alias("_some"))
    stocked = stocked.withColumnRenamed("domain", "_d")
    joined = rows.join(stocked, F.col("domain").eqNullSafe(F.col("_d")))
    return joined.where(~F.col("_some") | F.coalesce("in_stock", F.lit(True))).drop("_d", "_some")


def best_by_domain(matched: DataFrame) -> DataFrame:
    """The best credible listing of each domain; what is accepted is staged, to be matched once."""
    return best_listings(purchasable(staged(accepted(matched), "accepted")), V.TOLERANCE)


def deals(best: DataFrame, branches: DataFrame) -> DataFrame:
    """Best listings joined to their nearest branch, with cost, score and rank from 0.

    Rows here are one a retailer. What is out of stock ranks last unless everything is.
    """
    near = branches.groupBy("domain").agg(
        F.min_by(F.struct("name", "distance_m"), F.struct("distance_m", "pos")).alias("b"), F.count("*").alias("branches")
    )
    joined = best.join(near, "domain").select(
        "domain", "title", "price", "old_price", "in_stock", "confidence", F.col("b.name").alias("store"),
        F.col("b.distance_m").alias("distance_m"), "branches",
    )
    priced = joined.withColumns(geo.cost_columns(F.col("price"), F.col("distance_m")))
    scored = priced.withColumn("score", geo.score(F.col("total"), F.col("confidence"), F.col("in_stock")))
    every = Window.partitionBy()
    out = F.col("in_stock").eqNullSafe(F.lit(False))
    last = F.when(F.bool_or(~out).over(every) & out, 1).otherwise(0)
    ranked = scored.withColumn("_last", last)
    order = Window.orderBy("_last", "score", "domain")
    return ranked.withColumn("rank", F.row_number().over(order) - 1).drop("_last")


def with_reasons(deals: DataFrame) -> DataFrame:
    """deals with reasons, an array of sentences in fixed order."""
    every = Window.partitionBy()
    sticker, total = F.min("price").over(every), F.min("total").over(every)
    off = F.round((1 - F.col("price") / F.col("old_price")) * 100).cast("long")
    reasons = [
        F.when(F.col("price") == F.col("_sticker"), F.lit("Lowest sticker price found")),
        F.when(
            (F.col("total") == F.col("_total")) & (F.col("price") != F.col("_sticker")),
            F.concat(
                F.lit("Cheaper overall once travel is counted (+"),
                geo.format_kzt(F.col("travel") + F.col("time_cost")),
                F.lit(" to get there and back)"),
            ),
        ),
        F.when(
            (F.col("old_price") > F.col("price")) & (off >= 3),
            F.concat(F.lit("Discounted "), off.cast("string"), F.lit("% from "), geo.format_kzt(F.col("old_price"))),
        ),
        F.when(F.col("distance_km") <= 2, F.lit("Walking distance")),
        F.when(F.col("branches") > 1, F.format_string("Same price at %d %s branches; nearest shown", "branches", "store")),
        F.when(F.col("confidence") < 0.7, F.lit("Listing title is an approximate match — verify before travelling")),
        F.when(~F.col("in_stock"), F.lit("Marked out of stock online")),
    ]
    marked = deals.withColumns({"_sticker": sticker, "_total": total})
    return marked.withColumn("reasons", F.array_compact(F.array(*reasons))).drop("_sticker", "_total")


def verdict(deals: DataFrame) -> DataFrame:
    """One row: a sentence on the best deal, NULL without deals; deals are one a retailer."""
    row = F.struct("rank", "store", "price", "total", "distance_km", "confidence", "in_stock")
    one = deals.agg(
        F.count("*").alias("n"),
        F.min_by(row, "rank").alias("best"),
        F.min_by(row, F.when(F.col("rank") > 0, F.col("rank"))).alias("second"),
        F.min_by(row, F.struct("price", "rank")).alias("sticker"),
        F.min_by(row, F.struct("total", "rank")).alias("cheap"),
        F.bool_and(F.col("in_stock").eqNullSafe(F.lit(False))).alias("none"),
    )
    kzt = lambda c: geo.format_kzt(F.col(c))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    best, cheap, sticker = F.col("best.rank"), F.col("cheap.rank"), F.col("sticker.rank")
    km = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    unknown = F.when(F.col("best.in_stock").isNull(), " Branch stock is unverified.").otherwise("")
    name = F.col("best.store")
    caveat = (
        F.when(F.col("cheap.in_stock").eqNullSafe(F.lit(False)), "is marked out of stock")
        .when(F.col("cheap.confidence") < F.col("best.confidence"), "is a lower-confidence match")
        .otherwise("has a weaker availability or match signal")
    )
    gone = F.when(F.col("best.in_stock").eqNullSafe(F.lit(False)), " It is marked out of stock online.").otherwise("")
    text = (
        F.when(F.col("n") == 0, F.lit(None).cast("string"))
        .when(F.col("n") == 1, say("Only one nearby shop had a readable listing: ", name, " at ", kzt("best.price"), ".", gone, unknown))
        .when(
            F.col("none"),
            say("Every readable matching listing is marked out of stock; ", name, " has the lowest ranked unavailable option at ", kzt("best.price"), "."),
        )
        .when(
            (best == cheap) & (best != sticker),
            say(
                name, " wins on total cost: ", kzt("best.price"), " at ", km("best.distance_km"), " km beats the ", kzt("sticker.price"),
                " at ", F.col("sticker.store"), " once its ", km("sticker.distance_km"), " km distance is priced in (",
                geo.format_kzt(F.col("sticker.total") - F.col("best.total")), " better).", unknown,
            ),
        )
        .when(
            best == cheap,
            say(
                name, " is the best-value option at ", kzt("best.price"), " (", kzt("best.total"), " including travel), ",
                geo.format_kzt(F.col("second.total") - F.col("best.total")), " below the next ranked option.", unknown,
            ),
        )
        .otherwise(
            say(
                name, " ranks first as the stronger available match at ", kzt("best.price"), "; ", F.col("cheap.store"),
                " has the lower estimated total at ", kzt("cheap.total"), ", but ", caveat, ".", unknown,
            )
        )
    )
    return one.select(text.alias("verdict"))


def badge(in_stock: Column) -> Column:
    # What a deal's badge says, and above the sentences of the verdict.
    return (
        F.when(in_stock.isNull(), "Best listed option").when(in_stock, "Best overall").otherwise("Best unavailable listing")
    )
