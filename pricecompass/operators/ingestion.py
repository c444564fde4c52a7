"""Stores from a map service's responses, and from snapshots kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..functions.answers import stripped
from .stores import with_distance

# What a response may hold, failures it may remark on, and how long the parts of a store may be.
BODY_BYTES, MOST_ELEMENTS, MOST_STORES = 8 * 1024 * 1024, 5_000, 2_000
FAILURE = "(?i)error|timed? ?out|memory"
CHARS = {"id": 200, "name": 160, "domain": 253, "website": 2_048, "shop_type": 60, "address": 240, "phone": 80, "opening_hours": 200}
NAMES = ("name", "name:ru", "name:kk", "brand", "operator")
WEBSITES = ("website", "contact:website", "url", "brand:website")
#: A snapshot may be so much ahead of the clock.
AHEAD_MS = 60_000

POINT = "lat: double, lon: double"
RESPONSE = f"remark string, elements array<struct<type: string, id: bigint, {POINT}, center: struct<{POINT}>, tags: map<string, string>>>"


def elements_of(responses: DataFrame) -> DataFrame:
    """response_id, pos and el of the first 5,000 elements of each response.

    Responses over 8 MiB, those that remark on a failure, and what has no list of elements give none.
    """
    parsed = responses.where(F.octet_length("body") <= BODY_BYTES).withColumn("_r", F.from_json("body", RESPONSE))
    fine = parsed.where(~F.coalesce(F.col("_r.remark").rlike(FAILURE), F.lit(False)))
    # cut before the elements are looked at, so a bad one takes a place
    return fine.select("response_id", F.posexplode(F.slice("_r.elements", 1, MOST_ELEMENTS)).alias("pos", "el"))


def _origin(url: Column) -> Column:
    """Scheme and host of a website, with a port that isn't the scheme's own."""
    text = F.trim(url)
    full = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    scheme, host = (F.lower(F.try_parse_url(full, F.lit(part))) for part in ("PROTOCOL", "HOST"))
    port = F.regexp_extract(F.try_parse_url(full, F.lit("AUTHORITY")), r":(\d+)$", 1)
    own = F.when(scheme == "http", "80").otherwise("443")
    return F.concat(scheme, F.lit("://"), host, F.when((port != "") & (port != own), F.concat(F.lit(":"), port)).otherwise(""))


def stores_of(elements: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """Stores: id, name, domain, website, shop_type, lat, lon, distance_m, address, phone, opening_hours.

    An element without a place on earth or a name is none. The first key of a kind that is there
    counts, even if it is blank: a store whose name is blank goes.
    """
    tags = F.col("el.tags")
    first = lambda *keys: F.coalesce(*(tags[k] for k in keys))

    def kept(value: Column, most: int) -> Column:
        value = stripped(value)
        return F.when(value != "", F.substring(value, 1, most))

    street, house, city = kept(tags["addr:street"], 120), kept(tags["addr:housenumber"], 30), kept(tags["addr:city"], 100)
    line = F.concat_ws(" ", street, house)
    address = F.concat_ws(", ", F.when(line != "", line), city)
    site = first(*WEBSITES)
    domain = web.normalised_domain(site)
    stores = elements.where(F.col("el.type").isin("node", "way", "relation") & (F.col("el.id") > 0)).select(
        "response_id",
        "pos",
        F.concat_ws("/", "el.type", F.col("el.id").cast("string")).alias("id"),
        kept(first(*NAMES), CHARS["name"]).alias("name"),
        domain.alias("domain"),
        F.when(domain.isNotNull(), _origin(site)).alias("website"),
        F.coalesce(kept(tags["shop"], CHARS["shop_type"]), F.lit("unknown")).alias("shop_type"),
        F.coalesce("el.lat", "el.center.lat").alias("lat"),
        F.coalesce("el.lon", "el.center.lon").alias("lon"),
        F.when(address != "", F.substring(address, 1, CHARS["address"])).alias("address"),
        kept(first("phone", "contact:phone"), CHARS["phone"]).alias("phone"),
        kept(tags["opening_hours"], CHARS["opening_hours"]).alias("opening_hours"),
    )
    placed = stores.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("name").isNotNull())
    return with_distance(placed, centre)


def sound(store: dict[str, Column]) -> Column:
    """Whether a store from a snapshot may be used: parts there and within their lengths, a place on
    earth, a distance that isn't negative."""
    ok = (F.length(store["id"]) > 0) & (F.length(store["name"]) > 0) & store["shop_type"].isNotNull()
    for name, most in CHARS.items():
        ok = ok & (F.coalesce(F.length(store[name]), F.lit(0)) <= most)
    finite = lambda c: c.isNotNull() & ~F.isnan(c)
    ok = ok & finite(store["lat"]) & store["lat"].between(-90, 90) & finite(store["lon"]) & store["lon"].between(-180, 180)
    far = store["distance_m"].cast("double")
    ok = ok & finite(far) & (far >= 0) & (far < float("inf"))
    return F.coalesce(ok, F.lit(False))


def usable_snapshot(saved_ms: Column, now_ms: int) -> Column:
    return F.coalesce((saved_ms >= 0) & (saved_ms <= now_ms + AHEAD_MS), F.lit(False))


def freshest(snapshots: DataFrame, key: str, saved_ms: str, value: str, now_ms: int, ttl_ms: int) -> DataFrame:
    """The newest usable snapshot of each key, and its age if it is stale: older than ttl_ms.

    Snapshots from the future, without a time or without a value don't count; of equal times the
    smaller value is taken.
    """
    usable = snapshots.where(usable_snapshot(F.col(saved_ms), now_ms) & F.col(value).isNotNull())
    # the order turns round, so that the smaller of equal ones wins
    newest = usable.groupBy(key).agg(F.min(F.struct((-F.col(saved_ms)).alias("a"), F.col(value).alias("v"))).alias("s"))
    age = F.greatest(F.lit(now_ms) + F.col("s.a"), F.lit(0))
    return newest.select(key, (-F.col("s.a")).alias(saved_ms), F.col("s.v").alias(value), F.when(age > ttl_ms, age).alias("stale_age_ms"))
