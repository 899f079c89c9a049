"""Counting forecasts: constant, climatology and persistence. A forecast is an array of nine class probabilities."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugegrid.functions.amounts import past_class
from gaugegrid.settings import CLIMATOLOGY_STRENGTHS, EDGES, N_CLASSES

CELL = ("station_id", "month", "hour")


def with_cell(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"month": F.month("ts"), "hour": F.hour("ts")})


def class_counts(rows: DataFrame, *keys: str | Column, weight: Column | None = None, name: str = "counts") -> DataFrame:
    """Weight of each class per key as an array; a class that never occurs counts 0."""
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys).agg(
        F.array(*[F.sum(F.when(F.col("label") == k, w).otherwise(0.0)) for k in range(N_CLASSES)]).alias(name)
    )


def add_counts(table: DataFrame, *keys: str, name: str = "counts") -> DataFrame:
    """Sum count arrays per key."""
    return table.groupBy(*keys).agg(F.array(*[F.sum(F.col(name)[k]) for k in range(N_CLASSES)]).alias(name))


def sum_of(counts: Column) -> Column:
    return reduce(add, [counts[k] for k in range(N_CLASSES)])


def shares(counts: Column) -> Column:
    return F.transform(counts, lambda c: c / sum_of(counts))


def fit_constant(train: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: the class shares of all rows."""
    return class_counts(train, weight=weight).select(shares(F.col("counts")).alias("probs"))


def predict_constant(model: DataFrame, rows: DataFrame, name: str = "probs") -> DataFrame:
    return rows.withColumn(name, model.select("probs").scalar())


def climatology_counts(train: DataFrame, weight: Column | None = None) -> DataFrame:
    """Counts per station, month and hour, with the network counts of the month and hour beside them.

    The rows are counted once; the network counts are sums of the station counts.
    """
    cells = class_counts(with_cell(train), *CELL, weight=weight)
    network = add_counts(cells, "month", "hour").withColumnRenamed("counts", "network")
    return cells.join(F.broadcast(network), ["month", "hour"])  # at most 12 x 24 rows


def shrunk(counts: Column, parent: Column, strength: Column | float) -> Column:
    """Shares of the cell, pulled towards the shares of its parent with the weight of ``strength`` rows."""
    m = F.lit(float(strength)) if isinstance(strength, (int, float)) else strength
    return F.zip_with(counts, parent, lambda c, q: (c + m * q / sum_of(parent)) / (sum_of(counts) + m))


def fit_climatology(train: DataFrame, strength: float, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The table per station cell, and the network table for cells never seen."""
    counts = climatology_counts(train, weight)
    table = counts.select(*CELL, shrunk(F.col("counts"), F.col("network"), strength).alias("cell_probs"))
    fallback = counts.groupBy("month", "hour").agg(F.any_value("network").alias("network")).select(
        "month", "hour", shares(F.col("network")).alias("network_probs")
    )
    return table, fallback


def predict_climatology(model: tuple[DataFrame, DataFrame], rows: DataFrame, name: str = "probs") -> DataFrame:
    table, fallback = model
    joined = with_cell(rows).join(table, list(CELL), "left").join(
        F.broadcast(fallback), ["month", "hour"], "left"  # at most 12 x 24 rows
    )
    return joined.select(*rows.columns, F.coalesce("cell_probs", "network_probs").alias(name))


def climatology_strengths(train: DataFrame, rows: DataFrame, strengths=CLIMATOLOGY_STRENGTHS) -> DataFrame:
    """Score of every shrinkage strength on ``rows``.

    A climatology forecast depends on the cell only, so the rows to score are first counted per (cell, label); the
    grid of strengths then runs over that small table and never multiplies the rows.
    """
    from gaugegrid.operators.scoring import exceedances, rps

    counts = climatology_counts(train)
    network = counts.groupBy("month", "hour").agg(F.any_value("network").alias("network"))
    seen = with_cell(rows).groupBy(*CELL, "label").agg(F.count("*").alias("n"))
    joined = (
        seen.join(counts.drop("network"), list(CELL), "left")
        .join(F.broadcast(network), ["month", "hour"], "left")  # at most 12 x 24 rows
        .withColumn("strength", F.explode(F.array(*[F.lit(m) for m in strengths])))
    )
    m = F.col("strength").cast("double")
    probs = F.when(F.col("counts").isNotNull(), shrunk(F.col("counts"), F.col("network"), m)).otherwise(shares(F.col("network")))
    scored = joined.withColumn("probs", probs).withColumn("exc", exceedances(F.col("probs")))
    return scored.groupBy("strength").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * rps("exc", "label")) / F.sum("n")).alias("rps")
    )


def best_strength(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min_by("strength", F.struct(F.round("rps", 12), F.col("strength"))).alias("strength"), F.min("rps").alias("rps"))


def fit_persistence(train: DataFrame, weight: Column | None = None) -> DataFrame:
    """Class shares of the next window per class of the past window (-1: unknown)."""
    counted = class_counts(train.withColumn("now", past_class("past30_mm")), "now", weight=weight)
    return counted.select("now", shares(F.col("counts")).alias("now_probs"))


def predict_persistence(table: DataFrame, rows: DataFrame, name: str = "probs") -> DataFrame:
    # at most ten rows: one per class and one for unknown
    joined = rows.withColumn("now", past_class("past30_mm")).join(F.broadcast(table), "now", "left")
    return joined.select(*rows.columns, F.col("now_probs").alias(name))


def constant_check(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Closed-form scores of the constant forecast: per edge its event rate, forecast, and Brier score."""
    from gaugegrid.operators.scoring import exceedances

    rates = class_counts(rows).select(shares(F.col("counts")).alias("observed"))
    p = exceedances(fit_constant(train).select("probs").scalar())
    o = exceedances(F.col("observed"))
    both = rates.select(F.explode(F.arrays_zip(F.array(*[F.lit(e) for e in EDGES]).alias("edge"), p.alias("p"), o.alias("o"))).alias("r"))
    return both.select(
        F.col("r.edge").alias("edge"), F.col("r.p").alias("forecast"), F.col("r.o").alias("event_rate"),
        (F.col("r.o") * F.pow(1 - F.col("r.p"), 2) + (1 - F.col("r.o")) * F.pow(F.col("r.p"), 2)).alias("brier"),
    )
