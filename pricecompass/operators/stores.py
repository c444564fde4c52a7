"""Stores: distance, grid cells, greedy dedupe of pins, chains and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import values as V
from .chunks import staged


def with_distance(stores: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """stores with distance_m, whole metres from the centre."""
    metres = geo.haversine(F.lit(centre[0]), F.lit(centre[1]), F.col("lat"), F.col("lon"))
    return stores.withColumn("distance_m", F.round(metres).cast("long"))


def in_radius(stores: DataFrame, centre: tuple[float, float], radius_m: int) -> DataFrame:
    """Stores within the radius; a bounding box on latitude reaches the scan first."""
    reach = radius_m / 111_000 * 1.01
    boxed = stores.where(F.col("lat").between(centre[0] - reach, centre[0] + reach))
    return with_distance(boxed, centre).where(F.col("distance_m") <= radius_m)


#: Metres of a degree of latitude, a little less than there are, and the reach of a cell as a power of two.
DEGREE_M = 110_000.0
LEVELS = range(8, 16)


def _band(lat: Column, level: Column) -> Column:
    return F.floor((lat + 90) / (F.pow(F.lit(2.0), level) / DEGREE_M))


def _columns(band: Column, level: Column) -> Column:
    """Cells that a band of latitude is cut into: each at least as wide as the level's reach, all round the earth."""
    size = F.pow(F.lit(2.0), level) / DEGREE_M
    furthest = F.least(F.greatest(F.abs(band * size - 90), F.abs((band + 1) * size - 90)), F.lit(90.0))
    return F.greatest(F.floor(360 * F.cos(F.radians(furthest)) / size), F.lit(1))


def within_reach(shoppers: DataFrame, stores: DataFrame) -> DataFrame:
    """Pairs of shoppers (shopper, lat, lon, radius_m) and the stores (lat, lon, ...) within their radius, with
    distance_m: columns of stores, shopper and distance_m.

    An equi-join on grid cells. A shopper looks into the cells of its radius's level alone, a few in the
    bands of latitude around it; a store stands in one cell of each level. The cells of a band are as wide as its latitude
    needs and go round the earth, so pairs across 180 degrees and near the poles are found. Rows without
    a place on earth and radii that are NULL or not within 0 to 2^15 m reach nothing; repeated rows meet each.
    """
    on_earth = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    radius = F.col("radius_m")
    asking = shoppers.where(on_earth & radius.between(0, 1 << LEVELS[-1])).select("shopper", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), radius.alias("_radius"))
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("_radius"), F.lit(1)).cast("double"))), F.lit(LEVELS[0])).cast("int")
    asking = asking.withColumn("_level", level)
    band = _band(F.col("_lat"), F.col("_level"))
    asking = asking.withColumn("_y", F.explode(F.sequence(band - 1, band + 1)))
    # the widest a circle gets in longitude; all round where it holds a pole
    angle = F.radians(F.pow(F.lit(2.0), "_level") / DEGREE_M)
    wide = F.degrees(F.asin(F.least(F.sin(angle) / F.cos(F.radians("_lat")), F.lit(1.0))))
    pole = F.abs("_lat") + F.degrees(angle) >= 90
    n = _columns(F.col("_y"), F.col("_level"))
    cell = lambda lon: F.floor((lon + 180) * n / 360)
    span = F.when(pole, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(
        F.array_distinct(F.transform(F.sequence(cell(F.col("_lon") - wide), F.least(cell(F.col("_lon") + wide), cell(F.col("_lon") - wide) + n)), lambda x: F.pmod(x, n)))
    )
    asking = asking.withColumn("_x", F.explode(span))
    standing = stores.where(on_earth).withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("_y", _band(F.col("lat"), F.col("_level")))
    m = _columns(F.col("_y"), F.col("_level"))
    standing = standing.withColumn("_x", F.pmod(F.floor((F.col("lon") + 180) * m / 360), m))
    metres = F.round(geo.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).cast("long")
    met = asking.join(standing, ["_level", "_y", "_x"]).withColumn("distance_m", metres).where(F.col("distance_m") <= F.col("_radius"))
    return met.select("shopper", *(f"`{c}`" for c in stores.columns), "distance_m")


# Metres that a cell's answer reaches further than it was asked for, and parts of a degree a cell has.
BUFFER_M, CELL_PARTS = 100, 1000


def within_cells(shoppers: DataFrame, stores: DataFrame) -> DataFrame:
    """The same rows as within_reach, of answers that shoppers in one cell share: stores are sought once for each
    cell (place to three decimals) and radius, BUFFER_M further, and what a shopper gets of them is cut to the
    shopper's own radius. Nothing is lost: a place lies less than BUFFER_M from its cell's."""
    near = lambda c: F.round(F.col(c) * CELL_PARTS) / CELL_PARTS
    asking = shoppers.where(F.col("radius_m").between(0, (1 << LEVELS[-1]) - BUFFER_M)).select(
        F.struct(near("lat").alias("y"), near("lon").alias("x"), F.col("radius_m").cast("long").alias("r")).alias("_cell"), F.col("shopper").alias("_shopper"),
        F.col("lat").alias("_from_lat"), F.col("lon").alias("_from_lon"),
    )
    cells = asking.select("_cell").distinct().select(
        F.col("_cell").alias("shopper"), F.col("_cell.y").alias("lat"), F.col("_cell.x").alias("lon"), (F.col("_cell.r") + BUFFER_M).alias("radius_m")
    )
    answers = staged(within_reach(cells, stores).drop("distance_m"), "cells")
    metres = F.round(geo.haversine(F.col("_from_lat"), F.col("_from_lon"), F.col("lat"), F.col("lon"))).cast("long")
    met = asking.join(answers, F.col("_cell") == F.col("shopper")).withColumn("distance_m", metres).where(F.col("distance_m") <= F.col("_cell.r"))
    return met.select(F.col("_shopper").alias("shopper"), *(f"`{c}`" for c in stores.columns), "distance_m")


def dedupe_pins(stores: DataFrame, most: int | None = None) -> DataFrame:
    """Stores (with distance_m, pos) without pins of a store already kept: of the same name, less than
    SAME_PIN_M away and within two grid cells, in order of distance.

    The greedy choice is made in rounds: a pin goes that a kept one covers, and one is kept that no
    earlier undecided pin covers. In a fine cell every pin covers every later one, so only its first
    undecided pin can be kept next: a crowd of pins in one place costs a row each, not their square.
    Stores without a name or a place aren't pins and go; each round keeps at least the first of those
    left. Names are compared without case.
    """
    stores = stores.where(F.col("name").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("distance_m").isNotNull())
    fine = V.CELL_DEG / 3  # 19 m at most: the diagonal is well below SAME_PIN_M
    spots = stores.withColumns(
        {
            "_n": F.lower("name"),
            "_at": F.struct("distance_m", "pos"),
            "_y": geo.cell(F.col("lat")),
            "_x": geo.cell(F.col("lon")),
            "_v": F.floor(F.col("lat") / fine),
            "_u": F.floor(F.col("lon") / fine),
        }
    )
    cols = ["_n", "_at", "_y", "_x", "_v", "_u", "lat", "lon"]
    left = staged(spots.select(*cols), "pins")
    kept = None
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3))))

    def near(one: DataFrame, other: DataFrame) -> DataFrame:
        """Pairs of pins of `one` (as _1...) that a pin of `other` covers."""
        a = one.select(*(F.col(c).alias(f"{c}1") for c in cols)).withColumn("_c", cells)
        b = other.select(*(F.col(c).alias(f"{c}2") for c in cols))
        on = (F.col("_n1") == F.col("_n2")) & (F.col("_y1") + F.col("_c.a") == F.col("_y2")) & (F.col("_x1") + F.col("_c.b") == F.col("_x2"))
        metres = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
        return a.join(b, on).where((metres < V.SAME_PIN_M) & (F.col("_at2") < F.col("_at1")))

    while True:
        heads = left.groupBy("_n", "_v", "_u").agg(F.min_by(F.struct(*cols), "_at").alias("h")).select("h.*")
        blocked = near(heads, heads).select(F.col("_n1").alias("_n"), F.col("_at1").alias("_at")).distinct()
        now = staged(heads.join(blocked, ["_n", "_at"], "left_anti"), "kept-pins")
        kept = now if kept is None else kept.unionByName(now)
        covered = near(left, now).select(F.col("_n1").alias("_n"), F.col("_at1").alias("_at"))
        gone = covered.unionByName(now.select("_n", "_at")).distinct()
        left = staged(left.join(gone, ["_n", "_at"], "left_anti"), "pins")
        if left.isEmpty():
            break
    found = spots.join(kept.select("_n", "_at").distinct(), ["_n", "_at"], "left_semi").select(*stores.columns)
    return found if most is None else found.orderBy("distance_m", "pos").limit(most)


def nearest_branches(stores: DataFrame, most: int = V.MAX_BRANCHES) -> DataFrame:
    """Branches of each domain with their place from 1, the nearest `most` of them."""
    order = Window.partitionBy("domain").orderBy("distance_m", "pos")
    return stores.where(F.col("domain").isNotNull()).withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= most)


def chains(stores: DataFrame) -> DataFrame:
    """(domain, branches, nearest_m): a row for each chain, with all branches counted up to the cap."""
    grouped = stores.where(F.col("domain").isNotNull()).groupBy("domain")
    return grouped.agg(F.least(F.count("*"), F.lit(V.MAX_BRANCHES)).alias("branches"), F.min("distance_m").alias("nearest_m"))


def ordered(chains: DataFrame, known: Column) -> DataFrame:
    """chains with known and place: known ones first, then by branches and nearness.

    A row a chain: their number is that of retailers, not of stores.
    """
    order = Window.orderBy(F.col("known").desc(), F.col("branches").desc(), "nearest_m", "domain")
    return chains.withColumn("known", known).withColumn("place", F.row_number().over(order))


def selected(ordered: DataFrame, unknown: int = V.MAX_UNKNOWN, most: int = V.MAX_DOMAINS) -> DataFrame:
    """The chains to ask: known ones, the first `unknown` others, `most` in all."""
    of_kind = Window.partitionBy("known").orderBy("place")
    fair = ordered.withColumn("_k", F.row_number().over(of_kind)).where(F.col("known") | (F.col("_k") <= unknown))
    return fair.drop("_k").orderBy("place").limit(most)
