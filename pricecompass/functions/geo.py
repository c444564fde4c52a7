"""Distance, travel and cost expressions, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * F.lit(V.EARTH_M) * F.asin(F.sqrt(half))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"(2 * {V.EARTH_M}::DOUBLE * asin(sqrt({half})))"


def cell(degrees: Column) -> Column:
    return F.floor(degrees / V.CELL_DEG)


def driving_km(metres: Column) -> Column:
    return metres * V.DETOUR / 1000


def driving_minutes(metres: Column) -> Column:
    return driving_km(metres) / V.SPEED_KMH * 60 + V.PARKING_MIN


def cost_columns(price: Column, metres: Column) -> dict[str, Column]:
    """travel, time_cost, total (whole tenge), distance_km (one digit), minutes (whole)."""
    travel = F.round(driving_km(metres) * 2 * V.KZT_PER_KM).cast("long")
    time = F.round(driving_minutes(metres) * 2 / 60 * V.KZT_PER_HOUR).cast("long")
    return {
        "travel": travel,
        "time_cost": time,
        "total": price + travel + time,
        "distance_km": F.round(driving_km(metres) * 10) / 10,
        "minutes": F.round(driving_minutes(metres)).cast("long"),
    }


def cost_sql(price: str, metres: str) -> str:
    km = f"({metres} * {V.DETOUR}::DOUBLE / 1000)"
    minutes = f"({km} / {V.SPEED_KMH}::DOUBLE * 60 + {V.PARKING_MIN}::DOUBLE)"
    travel = f"round({km} * 2 * {V.KZT_PER_KM}::DOUBLE)::BIGINT"
    time = f"round({minutes} * 2 / 60 * {V.KZT_PER_HOUR}::DOUBLE)::BIGINT"
    return (
        f"{travel} AS travel, {time} AS time_cost, {price} + {travel} + {time} AS total, "
        f"round({km} * 10) / 10 AS distance_km, round({minutes})::BIGINT AS minutes"
    )


def score(total: Column, confidence: Column, in_stock: Column) -> Column:
    """Total cost with penalties for doubt and for what is out of stock."""
    none = F.when(in_stock.eqNullSafe(F.lit(False)), V.NO_STOCK).otherwise(0.0)
    return total * (1 + (1 - confidence) * V.DOUBT + none)


SCORE_SQL = (
    f"total * (1 + (1 - confidence) * {V.DOUBT}::DOUBLE + CASE WHEN in_stock IS NOT DISTINCT FROM false "
    f"THEN {V.NO_STOCK}::DOUBLE ELSE 0.0::DOUBLE END)"
)


def format_kzt(n: Column) -> Column:
    """Whole tenge with a no-break space between thousands."""
    return F.concat(F.translate(F.format_number(F.round(n.cast("double")), 0), ",", " "), F.lit(" ₸"))


def kzt_sql(n: str) -> str:
    return f"(replace(format('{{:,}}', round({n})::BIGINT), ',', chr(160)) || ' ₸')"


def format_distance(metres: Column) -> Column:
    near = F.format_string("%d m", (F.round(metres / 10) * 10).cast("long"))
    return F.when(metres < 950, near).otherwise(F.format_string("%.1f km", F.round(metres / 100) / 10))


def format_age(ms: Column) -> Column:
    minutes = F.round(ms / 60_000).cast("long")
    hours = F.round(minutes / 60).cast("long")
    days = F.round(hours / 24).cast("long")
    return (
        F.when(minutes < 60, F.format_string("%d min", minutes))
        .when(hours < 48, F.format_string("%d h", hours))
        .otherwise(F.format_string("%d days", days))
    )


def map_url(lat: Column, lon: Column) -> Column:
    """Address of a map with a mark at a place; its form is a fixed value."""
    lat, lon = lat.cast("string"), lon.cast("string")
    return F.concat(F.lit("https://www.openstreetmap.org/?mlat="), lat, F.lit("&mlon="), lon, F.lit("#map=18/"), lat, F.lit("/"), lon)
