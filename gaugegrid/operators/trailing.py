"""What a station measured itself up to and including the current slot (tier 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugegrid.functions.amounts import from_tenths, recency_band, tenths
from gaugegrid.functions.clock import time_of
from gaugegrid.operators.labels import finish_labels, label_frames
from gaugegrid.operators.windows import add_chunks, chunk_window, own_rows, running_difference
from gaugegrid.settings import DAY_SLOTS, MINUTES_PER_SLOT, TRAILING_SLOTS, Grid


def trailing_frames(amount: Column, w: WindowSpec) -> dict[str, Column]:
    """The frames behind the trailing features of an amount in tenths. All share one partitioning and one sort."""
    wet = amount > 0
    return {
        **{f"_r{m}": running_difference(amount, w, slots) for m, slots in TRAILING_SLOTS.items() if slots > 1},
        "_max": F.max(amount).over(w.rangeBetween(1 - TRAILING_SLOTS[30], 0)),
        "_wet": running_difference(wet.cast("int"), w, TRAILING_SLOTS[60]),
        "_last": F.max(F.when(wet, F.col("slot"))).over(w.rangeBetween(Window.unboundedPreceding, 0)),
        "_seen": running_difference(F.lit(1), w, TRAILING_SLOTS[120]),
    }


def trailing_columns() -> list[Column]:
    """The eleven features, from the frames and the amount ``_t``."""
    since = F.least(F.coalesce(F.col("slot") - F.col("_last"), F.lit(DAY_SLOTS)), F.lit(DAY_SLOTS)) * MINUTES_PER_SLOT
    return [
        from_tenths(F.col("_t")).alias("t1_rain_5"),
        *[from_tenths(F.col(f"_r{m}")).alias(f"t1_rain_{m}") for m, slots in TRAILING_SLOTS.items() if slots > 1],
        from_tenths(F.col("_max")).alias("t1_max5_30"),
        F.col("_wet").alias("t1_wet_slots_60"),
        from_tenths(2 * F.col("_r15") - F.col("_r30")).alias("t1_trend_30"),
        since.cast("int").alias("t1_min_since_rain"),
        (TRAILING_SLOTS[120] - F.col("_seen")).alias("t1_missing_120"),
    ]


def trailing_features(readings: DataFrame, grid: Grid, size: int | None = None) -> DataFrame:
    """Totals, strongest reading, trend, wet count, time since wet and missing count of each reading.

    The time since the last wet reading is capped at a day, so a day's halo is enough for it as well.
    """
    rows = (
        readings.where(F.col("value").isNotNull())
        .select("station_id", "slot", tenths("value").alias("_t"))
        .transform(add_chunks, DAY_SLOTS, 0, size)
        .withColumns(trailing_frames(F.col("_t"), chunk_window()))
        .transform(own_rows, DAY_SLOTS, 0, size)
    )
    return rows.select("station_id", "slot", F.year(time_of("slot", grid)).alias("year"), *trailing_columns())


def observed_rows(readings: DataFrame, grid: Grid, ahead: int = 6, behind: int = 6, size: int | None = None) -> DataFrame:
    """Labels and trailing features of every reading in one pass: one shuffle and one sort for both, and no join.

    Rows that ``label_rows`` leaves out have a null ``label``; they are kept because neighbours need their totals.
    """
    rows = (
        readings.where(F.col("value").isNotNull())
        .select("station_id", "slot", tenths("value").alias("_t"))
        .transform(add_chunks, DAY_SLOTS, ahead, size)
        .withColumns({**trailing_frames(F.col("_t"), chunk_window()), **label_frames(F.col("_t"), chunk_window(), ahead, behind)})
        .transform(own_rows, DAY_SLOTS, ahead, size)
        .select("station_id", "slot", "next_n", "next_sum", "past_n", "past_sum", *trailing_columns())
    )
    return finish_labels(rows, grid, ahead, behind, *[c for c in rows.columns if c.startswith("t1_")])


def recency_table(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Rows and event share per band of the time since the last wet reading."""
    joined = labels.select("station_id", "slot", "label").join(
        features.select("station_id", "slot", "t1_min_since_rain"), ["station_id", "slot"]
    )
    return joined.groupBy(recency_band("t1_min_since_rain").alias("last_rain")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("label") > 0).cast("double")), 6).alias("p_wet")
    )
