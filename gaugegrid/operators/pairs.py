"""Station pairs over time: lagged correlation, its decay with distance, and the motion it implies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugegrid.functions.amounts import tenths
from gaugegrid.functions.geo import bearing, length, with_xy
from gaugegrid.operators.neighbours import station_pairs
from gaugegrid.operators.tiles import BLOCK_SLOTS, tile_of
from gaugegrid.operators.windows import CHUNK, add_chunks
from gaugegrid.settings import DISTANCE_BANDS, MIN_PEAK_CORRELATION
from gaugegrid.sources.session import stored

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Stations in a group, on average, where pairs of any distance are wanted.
GROUP_STATIONS = 256


def _grouped(readings: DataFrame) -> DataFrame:
    """Readings in every ordered pair of station groups that theirs belongs to (``ga``, ``gb``; ``left``: may be ``i``, ``right``: ``j``)."""
    n = readings.select(F.count_distinct("station_id").alias("n")).select(F.floor(F.col("n") / GROUP_STATIONS) + 1).scalar()
    own = F.pmod(F.xxhash64("station_id"), n)
    rows = readings.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    here = F.struct(F.col("own").alias("ga"), F.col("other").alias("gb"), F.lit(True).alias("left"), (F.col("own") == F.col("other")).alias("right"))
    there = F.struct(F.col("other").alias("ga"), F.col("own").alias("gb"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    roles = F.when(F.col("own") == F.col("other"), F.array(here)).otherwise(F.array(here, there))
    return rows.select(*readings.columns, F.explode(roles).alias("role")).select(*readings.columns, "role.*")


def near_rows(stations: DataFrame, within_km: float) -> DataFrame:
    """(``i``, ``j``, ``d``, ``ga``, ``gb``): rows of two stations at most ``within_km`` apart, in both orders, and the tile that the row of ``i`` lies in."""
    side = tile_of(within_km)
    return station_pairs(stations, within_km).select(
        F.col("s").alias("i"), "j", F.col("dist_km").alias("d"), F.floor(F.col("sx") / side).alias("ga"), F.floor(F.col("sy") / side).alias("gb")
    )


def near_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of stations (``i``, ``j``) of ``near_rows`` and the tile (``ga``, ``gb``) they are worked on in.

    A station may have several rows; two stations are a pair once, in the first tile that has a row of ``i`` within reach of one of ``j``.
    """
    return rows.groupBy("i", "j").agg(F.min(F.struct("ga", "gb")).alias("tile")).select("i", "j", "tile.*")


def _in_tiles(readings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Readings in the tiles that need their station."""
    return readings.join(pairs.select(F.explode(F.array("i", "j")).alias("station_id"), "ga", "gb").distinct(), "station_id")


def lagged_sums(
    readings: DataFrame, max_lag: int, by: Column | None = None, stations: DataFrame | None = None, within_km: float | None = None,
    block: int = BLOCK_SLOTS, pairs: DataFrame | None = None,
) -> DataFrame:
    """Joint counts and sums of every ordered station pair (``i`` at t, ``j`` at t + lag) for lags 0..``max_lag``.

    Stations are dealt to tiles (``within_km``: only pairs that close, no others are computed; ``pairs``: those of ``near_pairs``) or to pairs of groups of bounded size, the
    series to blocks of slots with a halo of ``max_lag``; each is one task with dense matrices, and its sums are matrix products, so pairs
    are never joined slot by slot. Blocks add up by a grouped sum that Spark combines before its shuffle. Sums are in whole tenths and
    therefore exact. ``by`` (a function of the slot) splits the reference time t, e.g. by season or year.
    """
    size = max(8 * max_lag, block)

    def products(key, pdf, near):
        first, lag_range = int(key[2]) * size, range(max_lag + 1)
        parts = {"g": [np.array([], object)], "i": [np.array([], object)], "j": [np.array([], object)], "lag": [np.array([], np.int32)]}
        parts |= {c: [np.array([])] for c in SUMS}
        ids, at = np.unique(pdf["station_id"].to_numpy(dtype=object), return_inverse=True)
        if near is None:
            left, right = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            left[at], right[at] = pdf["left"], pdf["right"]
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            wanted = a[:, None] != b[None, :]
        else:
            i, j = (pd.Index(ids).get_indexer(near[c]) for c in ("i", "j"))
            here = (i >= 0) & (j >= 0)  # both report in this block
            (a, row_of), (b, column_of) = (np.unique(x[here], return_inverse=True) for x in (i, j))
            wanted = np.zeros((len(a), len(b)), bool)
            wanted[row_of, column_of] = True
        row = pdf["slot"].to_numpy() - first
        used = int(row.max()) + 1 if wanted.any() else 0
        value, there, group = np.zeros((used, len(ids))), np.zeros((used, len(ids))), np.full(used, "", dtype=object)
        if used:
            value[row, at], there[row, at], group[row] = pdf["t"], 1.0, pdf["g"]
        for g in set(group[:size]) - {""}:
            for lag in lag_range:
                own = np.flatnonzero(group[:min(size, used - lag)] == g)
                u, seen_u, v, seen_v = value[own][:, a], there[own][:, a], value[own + lag][:, b], there[own + lag][:, b]
                n = seen_u.T @ seen_v
                i, j = np.nonzero((n > 0) & wanted)
                sums = (n, u.T @ seen_v, seen_u.T @ v, (u * u).T @ seen_v, seen_u.T @ (v * v), u.T @ v)
                found = {"g": np.full(len(i), g, object), "i": ids[a[i]], "j": ids[b[j]], "lag": np.full(len(i), lag, np.int32)}
                for c, values in {**found, **{k: m[i, j] for k, m in zip(SUMS, sums)}}.items():
                    parts[c].append(values)
        return pd.DataFrame({c: np.concatenate(values) for c, values in parts.items()})

    rows = readings.where(F.col("value").isNotNull()).select(
        "station_id", "slot", tenths("value").cast("double").alias("t"), (F.lit("all") if by is None else by.cast("string")).alias("g")
    )
    schema = "g string, i string, j string, lag int, " + ", ".join(f"{c} double" for c in SUMS)
    keys = ("ga", "gb", CHUNK)
    if within_km is None and pairs is None:
        found = _grouped(rows).transform(add_chunks, 0, max_lag, size).groupBy(*keys).applyInPandas(lambda key, pdf: products(key, pdf, None), schema)  # a block looks ahead by the largest lag
    else:
        pairs = stored(near_pairs(near_rows(stations, within_km))) if pairs is None else pairs
        dealt = _in_tiles(stored(rows).transform(add_chunks, 0, max_lag, size), pairs)
        block_of = F.broadcast(dealt.select(F.col(CHUNK).alias("block")).distinct())  # a row per block of slots
        near = pairs.join(block_of).select("i", "j", F.col("ga").alias("a"), F.col("gb").alias("b"), F.col("block").alias("c"))
        found = dealt.groupBy(*keys).cogroup(near.groupBy("a", "b", "c")).applyInPandas(products, schema)
    return found.groupBy("g", "i", "j", "lag").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlation() -> Column:
    """Pearson correlation from the sums; null where a side is constant."""
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return F.try_divide(cov, F.when(var > 0, F.sqrt(var)))


def lagged_correlation(readings: DataFrame, max_lag: int = 0, by: Column | None = None, **reach) -> DataFrame:
    """corr(x_i(t), x_j(t + lag)) and shared slots for i < j and lags -``max_lag``..``max_lag``.

    A negative lag is the positive lag of the swapped pair. ``reach`` (``stations``, ``within_km``, or ``pairs``) limits the pairs.
    """
    return correlated(lagged_sums(readings, max_lag, by, **reach))


def rolled_up(sums: DataFrame, *levels: Column) -> DataFrame:
    """Joint sums of coarser groups from those of finer ones: each level, an expression of ``g``, is a group that the rows add up to.

    Levels need different names of groups; a level that is null for a row leaves it out.
    """
    spread = sums.select(F.explode(F.array_compact(F.array(*levels))).alias("_level"), "i", "j", "lag", *SUMS)
    return spread.groupBy(F.col("_level").alias("g"), "i", "j", "lag").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlated(sums: DataFrame) -> DataFrame:
    """Correlations for i < j and lags of both signs from joint sums."""
    forward = sums.where("i < j")
    backward = sums.where("i > j and lag > 0").select(
        "g", F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("lag")).alias("lag"), *SUMS
    )
    return forward.unionByName(backward).select("g", "i", "j", "lag", F.col("n").cast("long").alias("n"), correlation().alias("r"))


def with_distance(pairs: DataFrame, stations: DataFrame) -> DataFrame:
    """Add offset and distance of ``j`` from ``i``."""
    xy = with_xy(stations).select("station_id", "x_km", "y_km")
    a = xy.select(F.col("station_id").alias("i"), F.col("x_km").alias("ix"), F.col("y_km").alias("iy"))
    b = xy.select(F.col("station_id").alias("j"), F.col("x_km").alias("jx"), F.col("y_km").alias("jy"))
    dx, dy = F.col("jx") - F.col("ix"), F.col("jy") - F.col("iy")
    return pairs.join(a, "i").join(b, "j").select(*pairs.columns, dx.alias("dx"), dy.alias("dy"), length(dx, dy).alias("d"))


def band_of(d: Column, bands=DISTANCE_BANDS) -> Column:
    """Index of the band that holds ``d``; null outside all bands."""
    index = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(bands, bands[1:])):
        index = F.when((d >= low) & (d < high), F.lit(k)).otherwise(index)
    return index


def distance_bands(pairs: DataFrame, bands=DISTANCE_BANDS) -> DataFrame:
    """Median distance and correlation, and pairs, per distance band and group."""
    return (
        pairs.where(F.col("r").isNotNull())
        .withColumn("band", band_of(F.col("d"), bands))
        .where(F.col("band").isNotNull())
        .groupBy("g", "band")
        .agg(F.percentile("d", 0.5).alias("distance"), F.percentile("r", 0.5).alias("median_r"), F.count("*").alias("pairs"))
    )


def _decays(pairs: DataFrame, coarse: int) -> DataFrame:
    """Least-squares amplitude and residual sum of r = c0 * exp(-d / reach) per group and candidate reach, every ``coarse``-th from ``low`` to ``high``.

    For a given reach the best c0 is a ratio of two sums, so all candidates are one aggregate; a batch of pairs is added up for all of its
    candidates where it stands, and no pair is copied per candidate.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            at = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            r, d, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 5))
            known = ~batch.column(2).is_null().to_numpy(zero_copy_only=False)  # a pair without a distance counts, but has no part in c0
            for code in np.unique(at):
                rows = np.flatnonzero(at == code)
                steps = np.arange(low[rows[0]], high[rows[0]] + 1, coarse, dtype=np.int32)
                r_here, n = r[rows], len(steps)
                e = np.where(known[rows][:, None], np.exp(-d[rows][:, None] / np.round(1.02**steps, 6)[None, :]), 0.0)
                sums_of_e = (r_here @ e, np.einsum("ij,ij->j", e, e)) if known[rows].any() else (pa.nulls(n, pa.float64()),) * 2
                columns = [np.full(n, len(rows)), *sums_of_e, np.full(n, r_here @ r_here)]
                name = pa.array([None if code < 0 else groups.dictionary[int(code)].as_py()] * n, pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(steps), *map(pa.array, columns)], names=["g", "step", "pairs", "re", "ee", "rr"])

    parts = pairs.select(F.col("g").cast("string"), "r", "d", "low", "high").mapInArrow(sums, "g string, step int, pairs long, re double, ee double, rr double")
    fits = parts.groupBy("g", "step").agg(*[F.sum(c).alias(c) for c in ("pairs", "re", "ee", "rr")])
    c0, reach = F.col("re") / F.col("ee"), F.round(F.pow(F.lit(1.02), F.col("step")), 6).alias("reach_km")
    scored = fits.select("g", "step", reach, "pairs", c0.alias("c0"), (F.col("rr") - c0 * F.col("re")).alias("sse"))
    best = F.min_by(F.struct("step", "reach_km", "c0", "pairs"), F.struct(F.round("sse", 12), "reach_km")).alias("b")
    return scored.groupBy("g").agg(best).select("g", "b.*")


def decay_fit(pairs: DataFrame, steps: int = 600, coarse: int = 20) -> DataFrame:
    """Least-squares fit of r = c0 * exp(-d / reach) per group, the reach to 2 % between 1 km and 1.02 ** ``steps`` km (144,000).

    First every ``coarse``-th reach of the grid, then all between the neighbours of the best. A correlation that does not fall with
    distance has no such reach: ``reach_km`` and ``c0`` are null and ``bounded`` is false where the best lies at an end of the grid.
    """
    known = pairs.where(F.col("r").isNotNull()).select("g", F.col("r").cast("double"), F.col("d").cast("double"))
    rough = _decays(known.withColumns({"low": F.lit(0), "high": F.lit(steps)}), coarse)
    around = rough.select("g", F.greatest(F.col("step") - coarse, F.lit(0)).alias("low"), F.least(F.col("step") + coarse, F.lit(steps)).alias("high"))
    fine = _decays(known.join(stored(around), "g"), 1)
    inside = (F.col("step") > 0) & (F.col("step") < steps)
    return fine.select("g", F.when(inside, F.col("c0")).alias("c0"), F.when(inside, F.col("reach_km")).alias("reach_km"), "pairs", inside.alias("bounded"))


def best_lags(curves: DataFrame, slot_minutes: float, least_r: float = MIN_PEAK_CORRELATION) -> DataFrame:
    """The lag of the highest correlation of each pair, refined by a parabola through its neighbours.

    Only peaks inside the lag range and above ``least_r`` count. ``lag`` is in minutes; ties go to the lowest lag.
    """
    pair = Window.partitionBy("g", "i", "j").orderBy("lag")  # one row per lag
    r = F.coalesce(F.col("r"), F.lit(-9.0))
    placed = curves.withColumns({"_r": r, "_lo": F.lag(r).over(pair), "_hi": F.lead(r).over(pair)})
    top = placed.groupBy("g", "i", "j").agg(F.max_by(F.struct("lag", "_r", "_lo", "_hi"), F.struct(F.round("_r", 12), -F.col("lag"))).alias("p"))
    inner = top.select("g", "i", "j", "p.*").where(F.col("_lo").isNotNull() & F.col("_hi").isNotNull() & (F.col("_r") > least_r))
    bend = F.col("_lo") - 2 * F.col("_r") + F.col("_hi")
    shift = F.coalesce(F.try_divide(0.5 * (F.col("_lo") - F.col("_hi")), bend), F.lit(0.0))
    return inner.select("g", "i", "j", F.col("lag").alias("slot_lag"), F.col("_r").alias("peak_r"), ((F.col("lag") + shift) * slot_minutes).alias("lag"))


def motion_fit(lags: DataFrame, least_pairs: int = 2) -> DataFrame:
    """Speed, heading and R2 of the least-squares slowness (lag = dx*a + dy*b) per group, from five sums."""
    x, y, t = F.col("dx"), F.col("dy"), F.col("lag")
    s = lags.groupBy("g").agg(
        F.count("*").alias("pairs"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"),
        F.sum(x * t).alias("xt"), F.sum(y * t).alias("yt"), F.sum(t * t).alias("tt"), F.sum(t).alias("t"),
    ).where(F.col("pairs") >= least_pairs)
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = F.try_divide(F.col("yy") * F.col("xt") - F.col("xy") * F.col("yt"), det)
    b = F.try_divide(F.col("xx") * F.col("yt") - F.col("xy") * F.col("xt"), det)
    solved = s.withColumns({"a": a, "b": b})
    unexplained = F.col("tt") - F.col("a") * F.col("xt") - F.col("b") * F.col("yt")
    spread = F.col("tt") - F.col("t") * F.col("t") / F.col("pairs")
    return solved.select(
        "g", "pairs", "a", "b",
        F.try_divide(F.lit(60.0), length(F.col("a"), F.col("b"))).alias("speed"),
        bearing(F.col("a"), F.col("b")).alias("heading"),
        (1 - F.try_divide(unexplained, spread)).alias("r2"),
    )


def motion_by_level(sums: DataFrame, stations: DataFrame, ring: tuple[float, float], slot_minutes: float, least_shared: int, least_pairs: int) -> DataFrame:
    """Motion of every group of joint sums: peaks of pairs in the ring that share enough slots at a lag, where enough pairs have one."""
    lags = with_distance(best_lags(correlated(sums).where(F.col("n") >= least_shared), slot_minutes), stations)
    return motion_fit(lags.where(F.col("d").between(*ring)), least_pairs)


def motion_of(fits: DataFrame, default: dict) -> dict[int, tuple[float, float]]:
    """Heading and speed by season code from fits whose group is the code (a row each); ``default`` where a season has no fit."""
    found = {int(r["g"]): (r["heading"], r["speed"]) for r in fits.where("speed IS NOT NULL").select("g", "heading", "speed").collect()}
    return {code: found.get(code, known) for code, known in default.items()}


def along_track(lags: DataFrame, fit: DataFrame) -> DataFrame:
    """Distance of each pair along the fitted motion, beside its lag."""
    f = F.broadcast(fit.select("g", "a", "b"))  # one row per group
    unit = length(F.col("a"), F.col("b"))
    return lags.join(f, "g").select("g", "i", "j", "lag", ((F.col("dx") * F.col("a") + F.col("dy") * F.col("b")) / unit).alias("along_km"))
