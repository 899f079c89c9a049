"""Plane coordinates, distances, bearings and compass names as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugegrid.settings import COMPASS, COMPASS_WORDS, KM_PER_DEGREE_LAT, KM_PER_DEGREE_LON, LAT_CENTRE, LON_CENTRE


def with_xy(stations: DataFrame, lon: str = "location_longitude", lat: str = "location_latitude") -> DataFrame:
    """Add ``x_km`` (east) and ``y_km`` (north) of the network centre."""
    east = KM_PER_DEGREE_LON * math.cos(math.radians(LAT_CENTRE))
    return stations.select(
        "*",
        ((F.col(lon) - LON_CENTRE) * east).alias("x_km"),
        ((F.col(lat) - LAT_CENTRE) * KM_PER_DEGREE_LAT).alias("y_km"),
    )


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 <= b < 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def compass(degrees: Column) -> Column:
    step = F.pmod(F.floor((degrees + 11.25) / 22.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*[F.lit(name) for name in COMPASS]), step + 1)


def compass_words(degrees: Column) -> Column:
    """The compass point spelled out letter by letter, e.g. ``north-north-east``."""
    words = F.create_map(*[F.lit(v) for pair in COMPASS_WORDS.items() for v in pair])
    letters = F.filter(F.split(compass(degrees), ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c: words[c]), "-")
