"""Station pairs, neighbour weights and neighbourhood features (tiers 2 and 3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugegrid.functions.clock import season_code, time_of
from gaugegrid.functions.geo import bearing, length, with_xy
from gaugegrid.operators.tiles import tiled_summaries
from gaugegrid.settings import (
    CHANGE_LAG_SLOTS,
    CHANGED_COLUMNS,
    IDW_FLOOR_KM,
    MINUTES_PER_SLOT,
    MOTION,
    NO_RAIN_KM,
    R_CLOSE,
    R_FAR,
    R_NEAR,
    T2_COLUMNS,
    UPSTREAM_CUT_KM,
    UPSTREAM_MINUTES,
    UPSTREAM_SIGMA_KM,
    Grid,
)


def station_pairs(stations: DataFrame, radius_km: float) -> DataFrame:
    """Ordered pairs (``s``, ``j``) of different stations at most ``radius_km`` apart.

    Stations meet through square cells of the radius: each ``j`` is copied to the nine cells around its own and
    joined on equality, so far stations are never compared.
    """
    xy = with_xy(stations).select(
        "station_id",
        "x_km",
        "y_km",
        F.floor(F.col("x_km") / radius_km).alias("cx"),
        F.floor(F.col("y_km") / radius_km).alias("cy"),
    )
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = xy.select(F.col("station_id").alias("s"), F.col("x_km").alias("sx"), F.col("y_km").alias("sy"), "cx", "cy")
    right = (
        xy.select(F.col("station_id").alias("j"), F.col("x_km").alias("jx"), F.col("y_km").alias("jy"), "cx", "cy")
        .withColumn("cx", F.explode(F.transform(around, lambda i: F.col("cx") + i)))
        .withColumn("cy", F.explode(F.transform(around, lambda i: F.col("cy") + i)))
    )
    dx, dy = F.col("jx") - F.col("sx"), F.col("jy") - F.col("sy")
    return (
        left.join(right, ["cx", "cy"])
        .where(F.col("s") != F.col("j"))
        .select("s", "j", "sx", "sy", "jx", "jy", dx.alias("dx"), dy.alias("dy"), length(dx, dy).alias("dist_km"))
        .where(F.col("dist_km") <= radius_km)
        .withColumn("bearing", bearing(F.col("dx"), F.col("dy")))
    )


def neighbour_counts(stations: DataFrame, radius_km: float = R_NEAR) -> DataFrame:
    """Stations with another position within the radius, per station (0 where none)."""
    counted = (
        station_pairs(stations, radius_km)
        .where("dist_km > 0")
        .groupBy(F.col("s").alias("station_id"))
        .agg(F.count("*").alias("n"))
    )
    return stations.select("station_id").join(counted, "station_id", "left").select(
        "station_id", F.coalesce("n", F.lit(0)).alias("neighbours")
    )


def upstream_reach(motion: dict = MOTION) -> float:
    """Farthest neighbour that an upstream kernel can give weight to."""
    return max(v for _, v in motion.values()) * max(UPSTREAM_MINUTES) / 60 + UPSTREAM_CUT_KM


def _kernel(motion: tuple[float, float], minutes: int) -> Column:
    """Gaussian weight of ``j`` around the point that rain moving over ``s`` left ``minutes`` ago."""
    heading, speed = motion
    step = speed * minutes / 60
    px = F.col("sx") - step * math.sin(math.radians(heading))
    py = F.col("sy") - step * math.cos(math.radians(heading))
    d = length(F.col("jx") - px, F.col("jy") - py)
    scaled = d / UPSTREAM_SIGMA_KM
    return F.when(d <= UPSTREAM_CUT_KM, F.exp(scaled * scaled * -0.5)).otherwise(0.0)


def neighbour_weights(stations: DataFrame, motion: dict = MOTION) -> DataFrame:
    """Every weight a neighbour ``j`` has for a station ``s``, plus one self row per station (``is_self``).

    ``w_idw``/``w_far``: inverse squared distance inside 10 km and from 10 to 25 km; ``in_5``/``in_10``: flags;
    ``quadrant``: 0..3 for north, east, south, west within 25 km, else -1; ``k<minutes>_<season>``: upstream kernels.
    A neighbour at the same position has no distance weights but may have kernel weights.
    """
    d, apart = F.col("dist_km"), F.col("dist_km") > 0
    idw = 1 / F.pow(F.greatest(d, F.lit(IDW_FLOOR_KM)), 2)
    kernels = {(m, c): f"k{m}_{c}" for m in UPSTREAM_MINUTES for c in motion}
    weights = station_pairs(stations, max(NO_RAIN_KM, upstream_reach(motion))).select(
        "s",
        "j",
        F.when(apart, d).otherwise(F.lit(NO_RAIN_KM)).alias("dist_km"),
        F.when(apart & (d <= R_NEAR), idw).otherwise(0.0).alias("w_idw"),
        F.when((d > R_NEAR) & (d <= R_FAR), idw).otherwise(0.0).alias("w_far"),
        (apart & (d <= R_CLOSE)).cast("int").alias("in_5"),
        (apart & (d <= R_NEAR)).cast("int").alias("in_10"),
        F.when(apart & (d <= R_FAR), F.floor(F.pmod(F.col("bearing") + 45, F.lit(360.0)) / 90).cast("int"))
        .otherwise(-1)
        .alias("quadrant"),
        *[_kernel(motion[c], m).alias(name) for (m, c), name in kernels.items()],
        F.lit(0).alias("is_self"),
    )
    useful = (F.col("dist_km") < NO_RAIN_KM) | (F.greatest(*[F.col(k) for k in kernels.values()]) > 0)
    alone = stations.select(
        F.col("station_id").alias("s"),
        F.col("station_id").alias("j"),
        F.lit(NO_RAIN_KM).alias("dist_km"),
        *[F.lit(0.0).alias(c) for c in ("w_idw", "w_far")],
        *[F.lit(0).alias(c) for c in ("in_5", "in_10")],
        F.lit(-1).alias("quadrant"),
        *[F.lit(0.0).alias(name) for name in kernels.values()],
        F.lit(1).alias("is_self"),
    )
    return weights.where(useful).unionByName(alone)


def _mean(weight: Column, z: Column, now: Column) -> Column:
    """Weighted mean of ``z`` over the rows of one role; 0 where no neighbour reported."""
    w = F.when(now, weight).otherwise(0.0)
    return F.coalesce(F.try_divide(F.sum(w * z), F.sum(w)), F.lit(0.0))


def _share(member: Column, z_tenths: Column, now: Column, scale: int = 1) -> Column:
    """Mean of an integer column over the members of one role, from two integer sums; 0 where none."""
    hit = now & member
    return F.coalesce(F.try_divide(F.sum(F.when(hit, z_tenths)), F.count(F.when(hit, True)) * scale), F.lit(0.0))


def _summaries(now: Column) -> dict[str, Column]:
    """The neighbourhood summaries of the rows of one role, keyed by column name without its tier prefix."""
    r15, r30 = F.col("r15") / 10, F.col("r30") / 10
    wet30 = (F.col("r30") > 0).cast("int")
    near = now & (F.col("in_10") == 1)
    out = {
        "idw_rain_15": _mean(F.col("w_idw"), r15, now),
        "idw_rain_30": _mean(F.col("w_idw"), r30, now),
        "far_rain_30": _mean(F.col("w_far"), r30, now),
        "max_rain_30": F.coalesce(F.max(F.when(near, F.col("r30"))) / 10, F.lit(0.0)),
        "wet_frac_5km": _share(F.col("in_5") == 1, wet30, now),
        "wet_frac_10km": _share(F.col("in_10") == 1, wet30, now),
        "dist_rain_km": F.coalesce(
            F.min(F.when(now & (F.col("r15") > 0), F.least(F.col("dist_km"), F.lit(NO_RAIN_KM)))), F.lit(NO_RAIN_KM)
        ),
        "nbrs_10km": F.count(F.when(near, True)).cast("double"),
    }
    for q, side in enumerate("nesw"):
        out[f"rain_30_{side}"] = _share(F.col("quadrant") == q, F.col("r30"), now, 10)
    return out


def _network(now: Column, w) -> dict[str, Column]:
    """Wet share and mean total over every station that reported in the slot."""
    n = F.count(F.when(now, True)).over(w)
    return {
        "island_wet_frac": F.coalesce(F.try_divide(F.count(F.when(now & (F.col("r30") > 0), True)).over(w), n), F.lit(0.0)),
        "island_rain_30": F.coalesce(
            F.try_divide(F.sum(F.when(now, F.col("r30"))).over(w), n * 10), F.lit(0.0)
        ),
    }


def neighbour_features(
    trailing: DataFrame, stations: DataFrame, grid: Grid, tiers: tuple[str, ...] = ("t2", "t3"), form: str = "tiled",
    motion: dict[int, tuple[float, float]] = MOTION,
) -> DataFrame:
    """Tier 2 and tier 3 of every (station, slot) that reported, in one pass.

    ``trailing`` needs ``t1_rain_15`` and ``t1_rain_30``; readings of stations that ``stations`` lacks are left out. Two layouts give the
    same numbers at every size: ``tiled`` works on spatial tiles and blocks of slots, ``joined`` on one row per reading and neighbour.
    ``motion`` gives each season code its heading (degrees) and speed (km/h), for example from ``pairs.motion_of``.
    """
    lagged = "t3" in tiers
    rows = trailing.select(
        F.col("station_id").alias("j"),
        "slot",
        F.round(F.col("t1_rain_15") * 10).cast("long").alias("r15"),
        F.round(F.col("t1_rain_30") * 10).cast("long").alias("r30"),
    )
    reach = max(NO_RAIN_KM, upstream_reach(motion) if lagged else 0.0)
    if form == "tiled":
        summaries = tiled_summaries(rows, stations, grid, lagged, reach, motion=motion)
    else:
        summaries = joined_summaries(rows, stations, grid, lagged, motion)
    return summaries.select("station_id", "slot", F.year(time_of("slot", grid)).alias("year"), *_feature_columns(tiers))


def joined_summaries(rows: DataFrame, stations: DataFrame, grid: Grid, lagged: bool, motion: dict = MOTION) -> DataFrame:
    """The summaries from a join with the neighbour table.

    Rows are hash-partitioned by slot once; where the optimizer can broadcast the neighbour table, the grouping by
    (slot, station) needs no further shuffle because a slot lives in one partition. A slot holds at most one row per
    station, so no partition grows hot. For the changes each reading is also sent to the slot ``CHANGE_LAG_SLOTS``
    later in the role of the earlier state; a neighbour or a whole network missing there counts as no rain.
    """
    rows = rows.join(stations.select(F.col("station_id").alias("j")), "j", "left_semi")
    if lagged:
        later = (F.col("slot") + CHANGE_LAG_SLOTS).alias("slot")
        roles = F.array(F.struct(F.col("slot"), F.lit(1).alias("now")), F.struct(later, F.lit(0).alias("now")))
        rows = rows.select("j", "r15", "r30", F.explode(roles).alias("role")).select("j", "r15", "r30", "role.slot", "role.now")
    else:
        rows = rows.withColumn("now", F.lit(1))
    now, then = F.col("now") == 1, F.col("now") == 0
    in_slot = Window.partitionBy("slot")
    network = {f"now_{k}": v for k, v in _network(now, in_slot).items()}
    values = {f"now_{k}": v for k, v in _summaries(now).items()}
    if lagged:
        network |= {f"then_{k}": v for k, v in _network(then, in_slot).items()}
        values |= {f"then_{k}": v for k, v in _summaries(then).items()}
        code = season_code(F.month(time_of("slot", grid)))
        for m in UPSTREAM_MINUTES:
            k = F.lit(0.0)
            for c in motion:
                k = F.when(code == c, F.col(f"k{m}_{c}")).otherwise(k)
            values[f"up{m}_rain"] = _mean(k, F.col("r15") / 10, now)
            values[f"up{m}_wet"] = _mean(k, (F.col("r15") > 0).cast("double"), now)
            values[f"up{m}_nbrs"] = F.count(F.when(now & (k > 0), True)).cast("double")
    carried = {k: F.max(k) for k in network}
    paired = rows.repartition("slot").withColumns(network).join(neighbour_weights(stations, motion), "j")
    return (
        paired.groupBy("slot", F.col("s").alias("station_id"))
        .agg(
            *[c.alias(k) for k, c in {**values, **carried}.items()],
            F.max(F.when(now, F.col("is_self")).otherwise(0)).alias("reports"),
        )
        .where("reports = 1")
    )


def _feature_columns(tiers: tuple[str, ...]) -> list[Column]:
    """Names and final rounding (4 decimals) of the requested tiers."""
    columns: list[Column] = []
    if "t2" in tiers:
        trend = 2 * F.col("now_idw_rain_15") - F.col("now_idw_rain_30")
        for name in T2_COLUMNS:
            value = trend if name == "t2_idw_trend" else F.col("now_" + name.removeprefix("t2_"))
            columns.append(F.round(value, 4).alias(name))
    if "t3" in tiers:
        gap = CHANGE_LAG_SLOTS * MINUTES_PER_SLOT
        for name in CHANGED_COLUMNS:
            columns.append(F.round(F.col(f"now_{name}") - F.col(f"then_{name}"), 4).alias(f"t3_d{gap}_{name}"))
        for m in UPSTREAM_MINUTES:
            columns += [F.round(f"up{m}_{k}", 4).alias(f"t3_up{m}_{k}") for k in ("rain", "wet")]
        far = max(UPSTREAM_MINUTES)
        columns.append(F.col(f"up{far}_nbrs").alias(f"t3_up{far}_nbrs"))
    return columns


def event_ratios(labels: DataFrame, shrink: float = 500) -> DataFrame:
    """Observed over expected events and heavy events per station, shrunk towards 1.

    The expectation of a row is the network's share in its slot, so a station's sum of expectations is the sum of
    window averages; slots are the shuffle key and hold one row per station.
    """
    in_slot = Window.partitionBy("slot")
    wet, heavy = (F.col("label") > 0).cast("double"), (F.col("label") >= 6).cast("double")
    return (
        labels.select("station_id", "slot", wet.alias("wet"), heavy.alias("heavy"))
        .withColumns({"p_wet": F.avg("wet").over(in_slot), "p_heavy": F.avg("heavy").over(in_slot)})
        .groupBy("station_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("wet").alias("o_wet"),
            F.sum("p_wet").alias("e_wet"),
            F.sum("heavy").alias("o_heavy"),
            F.sum("p_heavy").alias("e_heavy"),
        )
        .withColumns(
            {
                "t0_wet_ratio": (F.col("o_wet") + shrink) / (F.col("e_wet") + shrink),
                "t0_heavy_ratio": (F.col("o_heavy") + shrink) / (F.col("e_heavy") + shrink),
            }
        )
    )


def station_statics(labels: DataFrame, stations: DataFrame) -> DataFrame:
    """Position and event ratios of every station with labelled rows."""
    xy = with_xy(stations).select("station_id", F.col("x_km").alias("t0_x_km"), F.col("y_km").alias("t0_y_km"))
    ratios = event_ratios(labels).select("station_id", "t0_wet_ratio", "t0_heavy_ratio")
    return xy.join(ratios, "station_id")
