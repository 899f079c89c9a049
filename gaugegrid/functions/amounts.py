"""Amounts, classes and event flags.

Gauge amounts have a resolution of 0.1 mm. Totals are therefore summed as whole tenths: the result is exact,
does not depend on the order in which a shuffle delivers the rows, and a re-run task gives the same bytes.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugegrid.settings import CLASS_FLOORS, EDGES, HEAVY_CLASS, RECENCY_BANDS, RECENCY_DAY, RECENCY_REST


def tenths(amount: Column | str) -> Column:
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.round(c * 10).cast("long")


def from_tenths(total: Column) -> Column:
    return total / F.lit(10)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it does not, null where it is unknown."""
    return condition.cast("double")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, True))


def bucketize(amount: Column | str) -> Column:
    """Class 0..8 of an amount: class k holds floor_k <= amount < floor_(k+1)."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return reduce(add, [(c >= floor).cast("int") for floor in CLASS_FLOORS])


def past_class(amount: Column | str) -> Column:
    """Class of the past total judged on the raw edges; -1 when the total is unknown."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.coalesce(reduce(add, [(c > edge).cast("int") for edge in EDGES]), F.lit(-1))


def is_event(label: Column | str = "label") -> Column:
    return F.col(label) > 0 if isinstance(label, str) else label > 0


def is_heavy(label: Column | str = "label") -> Column:
    return F.col(label) >= HEAVY_CLASS if isinstance(label, str) else label >= HEAVY_CLASS


def recency_band(minutes: Column | str) -> Column:
    c = F.col(minutes) if isinstance(minutes, str) else minutes
    name = F.when(c < 1440, RECENCY_DAY).otherwise(RECENCY_REST)
    for limit, text in reversed(RECENCY_BANDS):
        name = F.when(c <= limit, text).otherwise(name)
    return name
