"""What a search leaves out: retailers that failed and why, those that were skipped, and listings that were
rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V

# Characters of a title, and listings of each kind, that a report on a retailer shows.
TITLE_CHARS, MOST_KEPT, MOST_SAMPLES = 78, 15, 6


def states(domains: DataFrame, adapters: DataFrame, fetched: DataFrame) -> DataFrame:
    """domains with label, note and failure: what is known of a retailer (adapters: domain, label, blocked,
    client_rendered, note; a few rows) comes before the failure of its fetch (fetched: domain, failure, a
    row a domain). A domain that was never fetched is unreachable; one without a label is called by its name."""
    known = domains.join(F.broadcast(adapters.select("domain", "label", "blocked", "client_rendered", "note")), "domain", "left")
    met = known.join(fetched.select("domain", F.lit(True).alias("_met"), F.col("failure").alias("_failure")), "domain", "left")
    failure = (
        F.when(F.col("blocked"), "blocked").when(F.col("client_rendered"), "js-rendered").when(F.col("_met").isNull(), "unreachable").otherwise(F.col("_failure"))
    )
    told = met.withColumns({"label": F.coalesce("label", "domain"), "failure": failure})
    return told.drop("blocked", "client_rendered", "_met", "_failure")


def gaps(attempted: DataFrame, skipped: DataFrame) -> DataFrame:
    """(label, reason) of what a search doesn't cover: attempted retailers (label, note, failure) whose failure
    is a gap, by the note on them or the failure's reason, and the first MAX_GAPS skipped ones (label, place)
    with a row that counts the others. A retailer that has no fitting listing is no gap."""
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in V.GAP_REASONS.items() for x in kv)), F.col("failure"))
    failed = attempted.where(F.col("failure").isNotNull()).withColumn("reason", reason).where("reason is not null")
    failed = failed.select("label", F.coalesce("note", "reason").alias("reason"))
    shown = skipped.orderBy("place").limit(V.MAX_GAPS).select("label", F.lit(V.SKIPPED_REASON).alias("reason"))
    more = skipped.agg((F.count("*") - V.MAX_GAPS).alias("more")).where("more > 0")
    more = more.select(F.concat(F.col("more").cast("string"), F.lit(" more mapped retailers")).alias("label"), F.lit(V.MORE_REASON).alias("reason"))
    return failed.unionByName(shown).unionByName(more)


def match_report(judged: DataFrame) -> DataFrame:
    """(domain, kind, place, title, price, confidence, reason, n) of judged listings (domain, at, title, price,
    rejected, reject_reason, confidence), so that too strict a match is seen: `kept`, the first MOST_KEPT;
    `rejected`, how many by reason, most first, ties by reason; `sample`, the first MOST_SAMPLES rejected.

    Reasons are counted map-side, and a window keeps its first rows before the shuffle, so a retailer with
    a third of all listings sends a few rows a task. NULL reasons are `unknown`.
    """
    rows = judged.select(
        "domain", "at", F.substring("title", 1, TITLE_CHARS).alias("title"), "price", "confidence", F.coalesce("rejected", F.lit(False)).alias("rejected"),
        F.when(F.col("rejected"), F.coalesce("reject_reason", F.lit("unknown"))).alias("reason"),
    )
    first = Window.partitionBy("domain", "rejected").orderBy("at")
    most = F.when(F.col("rejected"), MOST_SAMPLES).otherwise(MOST_KEPT)
    shown = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= max(MOST_KEPT, MOST_SAMPLES)).where(F.col("place") <= most)
    shown = shown.select(
        "domain", F.when(F.col("rejected"), "sample").otherwise("kept").alias("kind"), "place", "title", "price", "confidence", "reason", F.lit(1).cast("long").alias("n")
    )
    counts = rows.where("rejected").groupBy("domain", "reason").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("n").desc(), "reason"))
    no = F.lit(None)
    counts = counts.select(
        "domain", F.lit("rejected").alias("kind"), place.alias("place"), no.cast("string").alias("title"), no.cast("long").alias("price"),
        no.cast("double").alias("confidence"), "reason", "n",
    )
    return shown.unionByName(counts)
