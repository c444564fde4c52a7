"""Chains of redirects, followed for a whole table of addresses at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, web
from ..functions.text import let
from .chunks import staged

# Statuses that send on, and redirects that are followed at most.
REDIRECTS, MOST_HOPS = (301, 302, 303, 307, 308), 5


def tidy(url: Column) -> Column:
    return markup.resolved(url, url)


def follow(addresses: DataFrame, responses: DataFrame) -> DataFrame:
    """(url, final_url, hops, failure) of each distinct url of addresses, by responses (url, status, location,
    content_type, size, body), of which an address has one at most.

    Each address in a chain must be public; a location is read on the page that sends it. failure is
    `unsafe-url` for the first that isn't, `unreachable` for an address without a response, a redirect
    without a location, a sixth one and so each circle, else what the last response says (NULL: a fine page).
    final_url is the last address that was asked, NULL where the first may not be. Addresses are joined once a
    hop and only while they are open, each hop a table of its own; NULL urls have no chain; no rows give none.
    """
    outcome = web.fetch_outcome(F.col("status"), F.col("content_type"), F.col("size"), F.col("body"))
    told = responses.select(tidy(F.col("url")).alias("open"), "status", "location", outcome.alias("_outcome"))
    told = staged(told.where("open is not null").dropDuplicates(["open"]), "responses")
    first = addresses.select("url").where("url is not null").distinct().withColumn("_to", tidy(F.col("url")))
    rows = _judged(first, F.lit(None).cast("string"), F.lit(0), F.lit(None).cast("string"), F.lit(True))
    ended = rows.where("open is null").select(*_CHAIN)
    for hop in range(MOST_HOPS + 1):
        rows = rows.where("open is not null").select("url", "open", "hops")
        if rows.isEmpty():
            break
        sent = F.coalesce(F.col("status").isin(*REDIRECTS), F.lit(False))
        over = F.col("location").isNull() | F.lit(hop == MOST_HOPS)
        why = F.when(F.col("status").isNull() | (sent & over), "unreachable").when(~sent, F.col("_outcome"))
        met = rows.join(told, "open", "left").withColumn("_to", F.when(sent & ~over, markup.resolved(F.col("location"), F.col("open"))))
        rows = _judged(met, F.col("open"), F.col("hops"), why, sent & ~over)
        ended = ended.unionByName(rows.where("open is null").select(*_CHAIN))
    return ended


_CHAIN = ["url", "final_url", "hops", "failure"]


def _judged(met: DataFrame, at: Column, hops: Column, why: Column, goes_on: Column) -> DataFrame:
    """met (url, _to) after a hop, as a table of its own: open is where the chain goes on, NULL where it ended."""
    told = met.select("url", "_to", at.alias("at"), hops.alias("n"), why.alias("why"), goes_on.alias("sent"), let(F.col("_to"), web.public_url).alias("fine"))
    told = staged(told, "hops")
    on = F.col("sent") & F.col("fine")
    return told.select(
        "url", F.when(on, F.col("_to")).alias("open"), F.when(~on, F.col("at")).alias("final_url"), (F.col("n") + (on & F.col("at").isNotNull()).cast("int")).alias("hops"),
        F.when(F.col("sent") & ~F.col("fine"), "unsafe-url").otherwise(F.col("why")).alias("failure"),
    )
