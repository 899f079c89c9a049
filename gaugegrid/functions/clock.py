"""Wall-clock time, slots and calendar terms.

Times are handled as TIMESTAMP_NTZ (local wall clock), so hours, months and slots do not depend on the
session time zone. A TIMESTAMP column is first read in the session zone, which must have a fixed offset.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugegrid.settings import SEASON_MONTHS, SEASON_NAMES, Grid


def wall(ts: Column | str) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds of a wall-clock time since 1970-01-01 00:00 (date arithmetic only, no time zone)."""
    t = wall(ts)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def slot_of(ts: Column | str, grid: Grid) -> Column:
    """Slot whose interval contains ``ts``."""
    since = epoch_seconds(ts) - epoch_seconds(F.lit(grid.origin))
    return F.floor(since / grid.width).cast("int")


def time_of(slot: Column | str, grid: Grid) -> Column:
    """Start of a slot."""
    s = F.col(slot) if isinstance(slot, str) else slot
    return F.timestamp_add("SECOND", s.cast("long") * grid.width, F.lit(grid.origin).cast("timestamp_ntz"))


def off_grid(ts: Column | str, grid: Grid) -> Column:
    return F.pmod(epoch_seconds(ts) - epoch_seconds(F.lit(grid.origin)), F.lit(grid.width)) != 0


def year_month(ts: Column | str) -> Column:
    """``yyyy-MM`` of a wall-clock time."""
    return F.substring(wall(ts).cast("string"), 1, 7)


def season_code(month: Column) -> Column:
    code = F.lit(1)
    for value, months in SEASON_MONTHS.items():
        code = F.when(month.isin(*months), F.lit(value)).otherwise(code)
    return code


def season_name(month: Column) -> Column:
    code = season_code(month)
    name = F.lit(SEASON_NAMES[1])
    for value in SEASON_MONTHS:
        name = F.when(code == value, F.lit(SEASON_NAMES[value])).otherwise(name)
    return name


def with_calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Daily and yearly sine/cosine pairs and the season code (``t0_hod_*``, ``t0_doy_*``, ``t0_season``)."""
    t = wall(ts)
    day_share = (F.hour(t) * 60 + F.minute(t)) / 1440.0
    this_year = F.trunc(F.to_date(t), "year")
    year_days = F.datediff(F.add_months(this_year, 12), this_year)
    year_share = (F.datediff(F.to_date(t), this_year) + day_share) / year_days
    terms = []
    for stem, share, orders in (("hod", day_share, (1, 2, 3)), ("doy", year_share, (1, 2))):
        for k in orders:
            turn = share * (2 * math.pi * k)
            terms += [F.sin(turn).alias(f"t0_{stem}_s{k}"), F.cos(turn).alias(f"t0_{stem}_c{k}")]
    return df.select("*", *terms, season_code(F.month(t)).cast("double").alias("t0_season"))


def clock_text(hour: Column) -> Column:
    """Fractional hour as ``HH:mm``."""
    whole = F.floor(hour).cast("int")
    minutes = F.pmod(F.round((hour - F.floor(hour)) * 60).cast("int"), F.lit(60))
    return F.concat_ws(":", F.lpad(whole.cast("string"), 2, "0"), F.lpad(minutes.cast("string"), 2, "0"))
