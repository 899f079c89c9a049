"""Time windows with bounded halos.

A gauge network has few stations and very long series, so a window partitioned by station alone has as many
tasks as stations, and a station with a third of all rows is one task. Here each series is cut into chunks of
slots; the rows that a chunk's windows can reach are copied into it, the window runs by (station, chunk), and the
copies are dropped. The frames stay exact because a frame never reaches further than its halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"


def chunk_length(before: int, after: int) -> int:
    """At least a week of five-minute slots, and eight halos, so that copies stay below an eighth of the rows."""
    return max(2016, 8 * (before + after))


def add_chunks(df: DataFrame, before: int, after: int, size: int | None = None, slot: str = "slot") -> DataFrame:
    """Copy each row to its own chunk and to those whose frames (``before``/``after`` slots) include it."""
    size = size or chunk_length(before, after)
    first = F.floor((F.col(slot) - after) / size)
    last = F.floor((F.col(slot) + before) / size)
    return df.select("*", F.explode(F.sequence(first, last)).alias(CHUNK))


def own_rows(df: DataFrame, before: int, after: int, size: int | None = None, slot: str = "slot") -> DataFrame:
    """Drop the halo copies again."""
    size = size or chunk_length(before, after)
    return df.where(F.col(CHUNK) == F.floor(F.col(slot) / size)).drop(CHUNK)


def chunk_window(key: str = "station_id", slot: str = "slot") -> WindowSpec:
    return Window.partitionBy(key, CHUNK).orderBy(slot)


def running_difference(total: Column, w: WindowSpec, slots: int) -> Column:
    """Sum over the last ``slots`` slots as a running total minus the running total at the frame's start.

    Both frames only grow, so a row costs the same for 3 as for 288 slots; a sliding frame would add up all its
    rows again for each row. ``total`` must be an integer column for the difference to be exact.
    """
    running = F.sum(total).over(w.rangeBetween(Window.unboundedPreceding, 0))
    before = F.sum(total).over(w.rangeBetween(Window.unboundedPreceding, -slots))
    return running - F.coalesce(before, F.lit(0))
