"""The long grid (station, slot, value) and its wide, dense and block forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugegrid.functions.amounts import from_tenths, tenths
from gaugegrid.functions.clock import time_of, year_month
from gaugegrid.settings import STUCK_EXPECTED, Grid


def to_matrix(readings: DataFrame, stations: list[str], value: str = "value") -> DataFrame:
    """One row per slot and one column per station. The station list is given, so no extra job looks for it."""
    return readings.groupBy("slot").pivot("station_id", stations).agg(F.first(value, ignorenulls=True))


def measures_matrix(rows: DataFrame, stations: list[str], measures: dict[str, str]) -> DataFrame:
    """One row per slot and a column ``<station>_<measure>`` for each station and measure (name -> source column)."""
    return rows.groupBy("slot").pivot("station_id", stations).agg(
        *[F.first(column, ignorenulls=True).alias(name) for name, column in measures.items()]
    )


def to_long(matrix: DataFrame, stations: list[str]) -> DataFrame:
    """Back to one row per station and slot, with null where nothing was reported."""
    return matrix.unpivot("slot", stations, "station_id", "value")


def slot_spine(spark, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("slot"))


def dense_grid(readings: DataFrame, stations: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Every slot of every station, from the first to the last one that any station reports unless given; missing readings are null."""
    begin = F.lit(first) if first is not None else readings.select(F.min("slot")).scalar()
    end = F.lit(last) if last is not None else readings.select(F.max("slot")).scalar()
    cells = stations.select("station_id", F.explode(F.sequence(begin, end)).alias("slot"))
    return cells.join(readings, ["station_id", "slot"], "left")


def block_sum(readings: DataFrame, k: int) -> DataFrame:
    """Totals of consecutive blocks of ``k`` slots; blocks with a missing slot are left out."""
    block = F.floor(F.col("slot") / k).cast("int").alias("block")
    return (
        readings.where(F.col("value").isNotNull())
        .groupBy("station_id", block)
        .agg(F.count("*").alias("n"), from_tenths(F.sum(tenths("value"))).alias("total"))
        .where(F.col("n") == k)
        .drop("n")
    )


def window_slice(rows: DataFrame, station: str, first: int, last: int) -> DataFrame:
    """The rows of one station between two slots, in order; both conditions reach the scan."""
    return rows.where((F.col("station_id") == station) & F.col("slot").between(first, last)).orderBy("slot")


def network_share(readings: DataFrame) -> DataFrame:
    """Reporting stations and share of wet ones per slot."""
    return (
        readings.where(F.col("value").isNotNull())
        .groupBy("slot")
        .agg(F.count("*").alias("stations"), F.avg((F.col("value") > 0).cast("double")).alias("p_net"))
    )


def stuck_periods(readings: DataFrame, period: Column, least: float = STUCK_EXPECTED) -> DataFrame:
    """Wet readings observed and expected per station and period; ``stuck`` if none came where ``least`` were due."""
    wet = (F.col("value") > 0).cast("double")
    return (
        readings.where(F.col("value").isNotNull())
        .select("station_id", "slot", period.alias("ym"), wet.alias("wet"))
        .withColumn("p_net", F.avg("wet").over(Window.partitionBy("slot")))
        .groupBy("station_id", "ym")
        .agg(F.count("*").alias("n"), F.sum("wet").alias("observed"), F.sum("p_net").alias("expected"))
        .withColumn("stuck", (F.col("observed") == 0) & (F.col("expected") >= least))
    )


def mask_periods(readings: DataFrame, flagged: DataFrame, period: Column) -> DataFrame:
    """Null the readings of flagged (station, period) pairs."""
    marks = flagged.select("station_id", "ym", F.lit(True).alias("_flagged"))
    joined = readings.withColumn("ym", period).join(marks, ["station_id", "ym"], "left")
    return joined.select(
        *[c for c in readings.columns if c != "value"], F.when(F.col("_flagged").isNull(), F.col("value")).alias("value")
    )


def mask_intervals(readings: DataFrame, faults: DataFrame, grid: Grid) -> DataFrame:
    """Null the readings inside known fault intervals (``start_time`` included, ``end_time`` excluded).

    The intervals of a station travel as one array, so overlapping intervals cannot repeat a reading.
    """
    spans = faults.groupBy("station_id").agg(F.collect_list(F.struct("start_time", "end_time")).alias("_spans"))
    at = time_of("slot", grid)
    inside = F.exists("_spans", lambda s: (at >= s["start_time"]) & (at < s["end_time"]))
    kept = F.when(~F.coalesce(inside, F.lit(False)), F.col("value"))
    return readings.join(spans, "station_id", "left").select(
        *[c for c in readings.columns if c != "value"], kept.alias("value")
    )


def clean_readings(readings: DataFrame, faults: DataFrame, grid: Grid, least: float = STUCK_EXPECTED) -> DataFrame:
    """Readings with stuck station-months and fault intervals set to null."""
    month = year_month(time_of("slot", grid))
    flagged = stuck_periods(readings, month, least).where("stuck")
    return mask_intervals(mask_periods(readings, flagged, month), faults, grid)
