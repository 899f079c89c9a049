"""Alignment of raw times to the grid and removal of readings sent twice around the change of stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugegrid.settings import Grid


def on_mark(ts: str = "timestamp", step: int = 5) -> Column:
    return (F.second(ts) == 0) & (F.pmod(F.minute(ts), F.lit(step)) == 0)


def before_mark(ts: str = "timestamp", step: int = 5) -> Column:
    """The legacy form: the last second before a mark."""
    return (F.second(ts) == 59) & (F.pmod(F.minute(ts), F.lit(step)) == step - 1)


def stamp_forms(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows per stamp form; ``other`` must be empty before alignment."""
    form = F.when(on_mark(ts), "exact").when(before_mark(ts), "legacy").otherwise("other")
    return rows.groupBy(form.alias("form")).agg(F.count("*").alias("n"))


def shifted(ts: str = "timestamp") -> Column:
    late = F.timestamp_add("SECOND", F.lit(1), F.col(ts))
    return F.when(F.second(ts) == 59, late).otherwise(F.col(ts))


def align(rows: DataFrame, overlap: Column | None = None, ts: str = "timestamp", out: str = "time_5min") -> DataFrame:
    """Move legacy stamps to their mark; where an exact reading has the same station and mark, drop the legacy one.

    ``overlap`` limits the search for such pairs to the time in which both forms were sent: rows outside it never
    leave their partition. It is a condition on the mark (``out``), which both rows of a pair share, so that a legacy stamp just before
    the end and its exact partner are judged alike.
    """
    rows = rows.withColumn(out, shifted(ts))
    exact = F.col(ts) == F.col(out)
    key = Window.partitionBy("station_id", out)

    def deduplicated(part: DataFrame) -> DataFrame:
        has_exact = F.max(exact.cast("int")).over(key)
        return part.withColumn("_exact", has_exact).where(exact | (F.col("_exact") == 0)).drop("_exact")

    if overlap is None:
        return deduplicated(rows)
    inside = F.coalesce(overlap, F.lit(False))
    return rows.where(~inside).unionByName(deduplicated(rows.where(inside)))


def off_mark(rows: DataFrame, ts: str = "time_5min", grid: Grid = Grid()) -> DataFrame:
    """One row: how many rows are off the grid."""
    from gaugegrid.functions.clock import off_grid

    return rows.agg(F.count_if(off_grid(ts, grid)).alias("off_grid"))
