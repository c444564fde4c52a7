"""Queries on a search's events, in batch and as streams, on redirects and on kept files; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import progress, redirects
from ..operators.chunks import shared_folder
from ..sources import bindings as B
from ..sources import envelopes
from ..streaming import progress as streams
from .search import ORACLES, QUERIES, registered  # noqa: F401

#: Events of a search: forty at most, a second apart.
EACH = 40
_TOLD = f"""e AS (SELECT event_id // {EACH} AS search_id, event_id AS seq, CASE WHEN event_type = 'error' AND value > 110 THEN 'error'
    WHEN event_type = 'purchase' AND value > 110 THEN 'results' WHEN event_type = 'view' THEN 'status' ELSE 'domain' END AS kind, 'shop' || (user_id % 6) || '.example' AS domain,
  CASE WHEN event_type = 'click' THEN 'start' ELSE 'done' END AS state, floor(value)::BIGINT AS found, CASE WHEN event_id % 7 = 0 THEN 'blocked' END AS failure,
  (event_id % 5000)::BIGINT AS took_ms, CASE WHEN user_id % 2 = 0 THEN 'The search timed out' ELSE 'No route' END AS message FROM events)"""
_EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def told(events: DataFrame) -> DataFrame:
    """The events table as a search's events."""
    kind = F.col("event_type")
    high = F.col("value") > 110
    return events.select(
        F.floor(F.col("event_id") / EACH).alias("search_id"), F.col("event_id").alias("seq"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("event_id")).alias("ts"),
        F.when((kind == "error") & high, "error").when((kind == "purchase") & high, "results").when(kind == "view", "status").otherwise("domain").alias("kind"),
        F.concat(F.lit("shop"), (F.col("user_id") % 6).cast("string"), F.lit(".example")).alias("domain"), F.when(kind == "click", "start").otherwise("done").alias("state"),
        F.floor("value").alias("found"), F.when(F.col("event_id") % 7 == 0, "blocked").alias("failure"), (F.col("event_id") % 5000).alias("took_ms"),
        F.when(F.col("user_id") % 2 == 0, "The search timed out").otherwise("No route").alias("message"),
    )


_REDUCED = f"""WITH {_TOLD},
t AS (SELECT search_id, min(seq) AS at, arg_min(kind, seq) AS ended, arg_min(message, seq) AS said FROM e WHERE kind IN ('results', 'error') GROUP BY search_id),
d AS (SELECT e.search_id, e.domain, min(e.seq) AS first, arg_max(e.state, e.seq) AS state, arg_max(CASE WHEN e.state = 'done' THEN {{'n': e.found, 'why': e.failure, 'ms': e.took_ms}} ELSE {{'n': NULL, 'why': NULL, 'ms': NULL}} END, e.seq) AS x,
  any_value(t.ended) AS ended, any_value(t.said) AS said FROM e LEFT JOIN t USING (search_id) WHERE e.kind = 'domain' AND (t.at IS NULL OR e.seq < t.at) GROUP BY ALL),
c AS (SELECT *, ended IS NOT DISTINCT FROM 'error' AND state = 'start' AS closed FROM d)
SELECT search_id, domain, row_number() OVER (PARTITION BY search_id ORDER BY first) AS place, CASE WHEN closed THEN 'done' ELSE state END AS state, CASE WHEN closed THEN 0 ELSE x.n END AS found,
  CASE WHEN closed THEN CASE WHEN said = 'The search timed out' THEN 'timeout' ELSE 'unreachable' END ELSE x.why END AS failure, CASE WHEN NOT closed THEN x.ms END AS took_ms, ended FROM c"""


@registered(_REDUCED)
def search_progress(spark, sf_dir):
    return progress.reduced(told(B.table(spark, sf_dir, "events")))


@registered(f"SELECT search_id, count(*) FILTER (WHERE state = 'done') AS done, count(*) AS total FROM ({_REDUCED}) GROUP BY search_id")
def progress_counts(spark, sf_dir):
    return progress.counts(progress.reduced(told(B.table(spark, sf_dir, "events"))))


def _as_stream(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(_EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@registered(f"SELECT * FROM ({_REDUCED}) WHERE ended IS NOT NULL")
def search_progress_stream(spark, sf_dir):
    """The same from a stream over the events table: state by retailer, sent on when a search ends."""
    base = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    streams.run_once(streams.reduced(told(_as_stream(spark, sf_dir))), f"{base}/state", path=f"{base}/out")
    return spark.read.parquet(f"{base}/out").where("ended is not null")


@registered(f"WITH {_TOLD} SELECT search_id, seq, kind, CASE WHEN kind = 'domain' THEN domain END AS domain, CASE WHEN kind = 'error' THEN message END AS message FROM e")
def event_records(spark, sf_dir):
    """Events written by the stream's sink as server-sent records, and read back."""
    base = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    events = told(_as_stream(spark, sf_dir))
    events = events.withColumns({"domain": F.when(F.col("kind") == "domain", F.col("domain")), "message": F.when(F.col("kind") == "error", F.col("message"))})
    columns = ["search_id", "seq", "kind", "domain", "message"]
    streams.run_once(events, f"{base}/state", sink=streams.record_writer(f"{base}/out", columns))
    return streams.read_records(spark, f"{base}/out", "search_id long, seq long, kind string, domain string, message string").select(*columns)


_BARE = "regexp_replace(url, '[?#].*$', '')"
_NEXT = "(page_id * 7 + 3) % (SELECT max(page_id) + 1 FROM pages)"


@registered(
    f"""WITH RECURSIVE p AS (SELECT page_id, {_NEXT} AS next, page_id % 8 AS k FROM pages),
c AS (SELECT page_id AS start, page_id AS here, 0 AS hops FROM p
  UNION ALL SELECT c.start, p.next, c.hops + 1 FROM c JOIN p ON p.page_id = c.here WHERE p.k IN (0, 3, 4, 5, 7) AND c.hops < 5),
l AS (SELECT start, arg_max(here, hops) AS here, max(hops) AS hops FROM c GROUP BY start)
SELECT start AS page_id, CASE WHEN p.k = 1 AND l.hops < 5 THEN l.hops + 1 ELSE l.hops END AS hops, CASE WHEN p.k IN (0, 1, 3, 4, 5, 7) THEN 'unreachable'
  WHEN p.k = 2 THEN CASE WHEN l.hops < 5 THEN 'unsafe-url' ELSE 'unreachable' END WHEN p.page_id % 24 = 6 THEN 'blocked' END AS failure FROM l JOIN p ON p.page_id = l.here"""
)
def redirect_chains(spark, sf_dir):
    """Pages that send on to each other, to a place that isn't there (k = 1) and to a private one (k = 2)."""
    k, n = F.col("page_id") % 8, F.col("n")
    pages = B.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("bare"))
    pages = pages.crossJoin(F.broadcast(pages.agg((F.max("page_id") + 1).alias("n"))))  # one row
    url = F.concat("bare", F.lit("?id="), F.col("page_id").cast("string"))
    named = pages.select("page_id", "n", url.alias("url"), (F.col("page_id") * 7 + 3).alias("m")).withColumn("next", F.col("m") % n)
    target = named.select(F.col("page_id").alias("next"), F.col("url").alias("to"))
    rows = named.join(target, "next")
    location = F.when(k == 1, "./gone").when(k == 2, "http://10.0.0.1/x").when(k != 6, F.col("to"))
    status = F.when(k == 6, F.when(F.col("page_id") % 24 == 6, 403).otherwise(200)).otherwise(F.when(k < 4, 301).otherwise(308))
    responses = rows.select("url", status.alias("status"), location.alias("location"), F.lit("text/html").alias("content_type"), F.lit(10).alias("size"), F.lit("<p>").alias("body"))
    found = redirects.follow(named, responses).join(named.select("page_id", "url"), "url")
    return found.select("page_id", "hops", "failure")


_NOW = 1_700_000_000_000


@registered(
    f"""WITH s AS (SELECT *, s_suppkey % 10 AS k, {_NOW} - s_suppkey * 60000 + CASE WHEN s_suppkey % 10 = 4 THEN 864000000 ELSE 0 END AS saved FROM supplier)
SELECT substr(sha1('stores:' || s_suppkey), 1, {envelopes.NAME_DIGITS}) || '.json' AS name, CASE WHEN k NOT IN (3, 4) OR (k = 4 AND saved <= {_NOW} + 60000) THEN saved END AS saved_ms,
  CASE WHEN k NOT IN (3, 4) OR (k = 4 AND saved <= {_NOW} + 60000) THEN greatest({_NOW} - saved, 0) END AS age_ms, CASE WHEN k NOT IN (3, 4) OR (k = 4 AND saved <= {_NOW} + 60000) THEN '{{"name":"' || s_name || '"}}' END AS value,
  CASE WHEN k = 3 THEN 'not-json' WHEN k = 4 AND saved > {_NOW} + 60000 THEN 'no-time' END AS problem FROM s"""
)
def envelope_files(spark, sf_dir):
    """A file a supplier, of which two in ten are broken or ahead of the clock, read back."""
    k = F.col("s_suppkey")
    value = F.concat(F.lit('{"name": "'), "s_name", F.lit('"'), F.when(k % 10 == 3, "").otherwise("}"))
    saved = F.lit(_NOW) - k * 60000 + F.when(k % 10 == 4, 864_000_000).otherwise(0)
    values = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("stores:"), k.cast("string")).alias("key"), saved.alias("saved_ms"), value.alias("value"))
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    envelopes.write(values, folder).write.format("noop").mode("overwrite").save()
    return envelopes.read(spark, folder, _NOW).drop("bytes")
