"""Work on spatial tiles and blocks of slots, one task each, with halos in space and time.

A station belongs to the square tile it lies in and is copied to the tiles whose stations can reach it; a reading goes to the tiles of
its station and, with a halo, to the blocks of slots that need it. What a task holds is bounded by the tile and the block, whatever the
length of the series and the size of the network. Readings of stations that are not in the dimension are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugegrid.functions.clock import season_code, time_of
from gaugegrid.functions.geo import with_xy
from gaugegrid.operators.windows import CHUNK, add_chunks
from gaugegrid.settings import (
    CHANGE_LAG_SLOTS, CHANGED_COLUMNS, IDW_FLOOR_KM, MOTION, NO_RAIN_KM, R_CLOSE, R_FAR, R_NEAR, UPSTREAM_CUT_KM, UPSTREAM_MINUTES,
    UPSTREAM_SIGMA_KM, Grid,
)

#: Slots in a block: a week of five minutes.
BLOCK_SLOTS = 2016


def tile_of(reach_km: float) -> float:
    """Side of a tile: twice the reach, so that a station is copied to four tiles at most."""
    return 2 * reach_km


def placed(stations: DataFrame, reach_km: float) -> DataFrame:
    """(station_id, x_km, y_km, tx, ty, own): the tile of every station and the tiles that lie within its reach."""
    side = tile_of(reach_km)

    def touched(c: str):
        return F.sequence(F.floor((F.col(c) - reach_km) / side), F.floor((F.col(c) + reach_km) / side))

    xy = with_xy(stations).select("station_id", "x_km", "y_km")
    spread = xy.withColumn("tx", F.explode(touched("x_km"))).withColumn("ty", F.explode(touched("y_km")))
    own = (F.col("tx") == F.floor(F.col("x_km") / side)) & (F.col("ty") == F.floor(F.col("y_km") / side))
    return spread.withColumn("own", own)


NOW = (
    "idw_rain_15", "idw_rain_30", "far_rain_30", "nbrs_10km", "wet_frac_5km", "wet_frac_10km", "rain_30_n", "rain_30_e", "rain_30_s",
    "rain_30_w", "max_rain_30", "dist_rain_km",
)
UP = tuple(f"up{m}_{k}" for m in UPSTREAM_MINUTES for k in ("rain", "wet", "nbrs"))


def _weights(east: np.ndarray, north: np.ndarray) -> dict[str, np.ndarray]:
    """Weight of every station for a target at offset 0, by purpose; a station at the target's own place has none of them."""
    d = np.hypot(east, north)
    other = d > 0
    inverse = 1 / np.maximum(d, IDW_FLOOR_KM) ** 2
    quarter = np.floor((np.degrees(np.arctan2(east, north)) + 45) % 360 / 90)
    out = {
        "idw": np.where(other & (d <= R_NEAR), inverse, 0), "far": np.where((d > R_NEAR) & (d <= R_FAR), inverse, 0),
        "in5": other & (d <= R_CLOSE), "in10": other & (d <= R_NEAR),
    }
    return out | {side: other & (d <= R_FAR) & (quarter == q) for q, side in enumerate("nesw")}


def _upwind(east: np.ndarray, north: np.ndarray, me: int, minutes: int, motion: tuple[float, float]) -> np.ndarray:
    """Gaussian weight of every station around the place from which rain of that motion reaches the target in so many minutes."""
    heading, speed = motion
    way = speed * minutes / 60
    d = np.hypot(east + way * math.sin(math.radians(heading)), north + way * math.cos(math.radians(heading)))
    w = np.where(d <= UPSTREAM_CUT_KM, np.exp(-((d / UPSTREAM_SIGMA_KM) ** 2) / 2), 0)
    w[me] = 0
    return w


def _mean(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), 0)


def _around(w: dict[str, np.ndarray], d: np.ndarray, r15: np.ndarray, r30: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    """Summaries of one target over the slots (rows) from the stations (columns) of its tile; amounts in tenths."""
    names = list(w)
    table = np.column_stack([w[n] for n in names]).astype(float)
    has, wet, low, high = (dict(zip(names, (m @ table).T)) for m in (there, (r30 > 0).astype(float), r15, r30))
    out = {
        "idw_rain_15": _mean(low["idw"] / 10, has["idw"]), "idw_rain_30": _mean(high["idw"] / 10, has["idw"]),
        "far_rain_30": _mean(high["far"] / 10, has["far"]), "nbrs_10km": has["in10"],
        "wet_frac_5km": _mean(wet["in5"], has["in5"]), "wet_frac_10km": _mean(wet["in10"], has["in10"]),
    } | {f"rain_30_{side}": _mean(high[side], has[side] * 10) for side in "nesw"}
    near, reach = np.flatnonzero(w["in10"]), np.flatnonzero((d > 0) & (d < NO_RAIN_KM))
    out["max_rain_30"] = r30[:, near].max(axis=1, initial=0) / 10
    out["dist_rain_km"] = np.where(r15[:, reach] > 0, d[reach], NO_RAIN_KM).min(axis=1, initial=NO_RAIN_KM)
    return out


def tiled_summaries(
    rows: DataFrame, stations: DataFrame, grid: Grid, lagged: bool, reach_km: float, block: int = BLOCK_SLOTS, motion: dict | None = None,
) -> DataFrame:
    """Summaries now (``now_*``), at the earlier slot (``then_*``) and upstream (``up*``) of every reported row.

    ``rows``: ``j``, ``slot``, ``r15``, ``r30`` (tenths). The sums over the whole network are one row per slot, joined at the end.
    """
    lag, motion = (CHANGE_LAG_SLOTS if lagged else 0), motion or MOTION
    then = [c for c in CHANGED_COLUMNS if not c.startswith("island")] if lagged else []
    columns = [f"now_{c}" for c in NOW] + [f"then_{c}" for c in then] + list(UP if lagged else ())

    def summarise(key, pdf):
        first = int(key[2]) * block - lag
        ids, at = np.unique(pdf["station_id"].to_numpy(dtype=object), return_inverse=True)
        slot = pdf["slot"].to_numpy() - first
        used = int(slot.max()) + 1
        r15, r30, there = (np.zeros((used, len(ids))) for _ in range(3))
        r15[slot, at], r30[slot, at], there[slot, at] = pdf["r15"], pdf["r30"], 1
        season = np.zeros(used, np.int64)
        season[slot] = pdf["season"]
        x, y, own = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool)
        x[at], y[at], own[at] = pdf["x_km"], pdf["y_km"], pdf["own"]
        none = {"station_id": np.array([], object), "slot": np.array([], np.int32), **{c: np.array([]) for c in columns}}
        out = [none]  # a tile may hold no station of its own
        for s in np.flatnonzero(own):
            east, north = x - x[s], y - y[s]
            reports = np.flatnonzero(there[lag:, s]) + lag
            if not len(reports):
                continue
            w, d = _weights(east, north), np.hypot(east, north)
            found = _around(w, d, r15[reports], r30[reports], there[reports])
            values = {f"now_{c}": found[c] for c in NOW}
            if lagged:
                found = _around(w, d, r15[reports - lag], r30[reports - lag], there[reports - lag])
                values |= {f"then_{c}": found[c] for c in then}
                for m in UPSTREAM_MINUTES:
                    kernel = np.array([_upwind(east, north, s, m, motion[code]) for code in sorted(motion)])[season[reports]]
                    here = there[reports] * kernel
                    weight = here.sum(axis=1)
                    values[f"up{m}_rain"] = _mean((r15[reports] * here).sum(axis=1) / 10, weight)
                    values[f"up{m}_wet"] = _mean(((r15[reports] > 0) * here).sum(axis=1), weight)
                    values[f"up{m}_nbrs"] = (here > 0).sum(axis=1).astype(float)
            out.append({"station_id": np.full(len(reports), ids[s], object), "slot": (reports + first).astype(np.int32), **values})
        return pd.DataFrame({c: np.concatenate([part[c] for part in out]) for c in ("station_id", "slot", *columns)})

    known = rows.withColumnRenamed("j", "station_id").withColumn("season", season_code(F.month(time_of("slot", grid))))
    dealt = known.join(placed(stations, reach_km), "station_id").transform(add_chunks, lag, 0, block)
    schema = "station_id string, slot int, " + ", ".join(f"{c} double" for c in columns)
    return dealt.groupBy("tx", "ty", CHUNK).applyInPandas(summarise, schema).join(_network(rows, stations, lag), "slot")


def _network(rows: DataFrame, stations: DataFrame, lag: int) -> DataFrame:
    """Wet share and mean total of all stations per slot, and ``lag`` slots earlier (0 where nobody reported)."""
    known = rows.join(stations.select(F.col("station_id").alias("j")), "j", "left_semi")
    n, wet, total = F.count(F.lit(1)), F.count_if(F.col("r30") > 0), F.sum("r30")
    now = known.groupBy("slot").agg((wet / n).alias("now_island_wet_frac"), (total / (n * 10)).alias("now_island_rain_30"))
    if not lag:
        return now
    late = now.select((F.col("slot") + lag).alias("slot"), *[F.col(f"now_{c}").alias(f"then_{c}") for c in ("island_wet_frac", "island_rain_30")])
    return now.join(late, "slot", "left").na.fill(0.0, ["then_island_wet_frac", "then_island_rain_30"])
