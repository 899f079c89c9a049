"""Neighbour features: both forms, and the edge cases of the geometry."""

import pytest

from gaugegrid.operators.neighbours import neighbour_counts, neighbour_features, station_pairs
from gaugegrid.operators.trailing import trailing_features
from gaugegrid.settings import Grid

GRID = Grid("2024-01-01 00:00:00", 10800)


@pytest.fixture(scope="module")
def stations(spark):
    # S000 and S001 stand at the same place, S002 is 6 km away, S003 has nobody within 25 km
    rows = [("S000", 103.82, 1.35), ("S001", 103.82, 1.35), ("S002", 103.87, 1.36), ("S003", 104.40, 1.35)]
    return spark.createDataFrame(rows, "station_id string, location_longitude double, location_latitude double")


@pytest.fixture(scope="module")
def trailing(spark, small):
    rows = small + [("S003", t, 0.2) for t in range(0, 60, 2)]
    return trailing_features(spark.createDataFrame(rows, "station_id string, slot int, value double"), GRID)


def by_key(rows):
    return {(r.station_id, r.slot): r.asDict() for r in rows.collect()}


def test_both_forms_agree(trailing, stations):
    tiled = by_key(neighbour_features(trailing, stations, GRID, form="tiled"))
    joined = by_key(neighbour_features(trailing, stations, GRID, form="joined"))
    assert tiled.keys() == joined.keys() and len(tiled) == trailing.count()
    for key, row in tiled.items():
        for name, value in row.items():
            assert value == joined[key][name] or abs(value - joined[key][name]) <= 1.0001e-4, (key, name)


def test_blocks_do_not_change_the_result(trailing, stations):
    from pyspark.sql import functions as F

    from gaugegrid.operators.tiles import tiled_summaries

    rows = trailing.select(F.col("station_id").alias("j"), "slot", (F.col("t1_rain_15") * 10).cast("long").alias("r15"), (F.col("t1_rain_30") * 10).cast("long").alias("r30"))
    whole = by_key(tiled_summaries(rows, stations, GRID, True, 40.0))
    cut = by_key(tiled_summaries(rows, stations, GRID, True, 40.0, block=16))
    assert whole.keys() == cut.keys()
    assert all(whole[k][c] == pytest.approx(cut[k][c]) for k in whole for c in whole[k] if c not in ("station_id", "slot"))


def test_unknown_stations_are_left_out_of_both_layouts(spark, trailing, stations):
    from pyspark.sql import functions as F

    stranger = trailing.where("station_id = 'S002'").withColumn("station_id", F.lit("S999"))
    for form in ("tiled", "joined"):
        with_one = by_key(neighbour_features(trailing.unionByName(stranger), stations, GRID, form=form))
        assert with_one == by_key(neighbour_features(trailing, stations, GRID, form=form))


def test_a_large_network_on_many_tiles(spark):
    rows = [(f"S{k:04d}", 100.0 + 0.05 * (k % 60), 1.0 + 0.05 * (k // 60)) for k in range(3000)]
    stations = spark.createDataFrame(rows, "station_id string, location_longitude double, location_latitude double")
    readings = spark.createDataFrame([(r[0], 5, (k * 7 % 13) / 10) for k, r in enumerate(rows)], "station_id string, slot int, value double")
    trailing = trailing_features(readings, GRID)
    tiled, joined = (by_key(neighbour_features(trailing, stations, GRID, ("t2",), form=f)) for f in ("tiled", "joined"))
    assert tiled.keys() == joined.keys() and len(tiled) == 3000
    for key, row in tiled.items():
        assert all(v == joined[key][n] or abs(v - joined[key][n]) <= 1.0001e-4 for n, v in row.items()), key


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Only the driver has the package on its path; the workers start in another folder."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from gaugegrid.operators.neighbours import neighbour_features
from gaugegrid.operators.trailing import trailing_features
from gaugegrid.settings import Grid
grid = Grid("2024-01-01 00:00:00", 10800)
stations = spark.createDataFrame([("a", 103.8, 1.35), ("b", 103.82, 1.35)], "station_id string, location_longitude double, location_latitude double")
readings = spark.createDataFrame([("a", 1, 0.4), ("b", 1, 0.2)], "station_id string, slot int, value double")
print("rows", len(neighbour_features(trailing_features(readings, grid), stations, grid).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 2" in out.stdout, out.stderr[-2000:]


def test_lone_station(trailing, stations):
    lone = [r for r in neighbour_features(trailing, stations, GRID, ("t2",)).collect() if r.station_id == "S003"]
    assert lone and all(r.t2_dist_rain_km == 30 and r.t2_nbrs_10km == 0 and r.t2_idw_rain_30 == 0 and r.t2_max_rain_30 == 0 for r in lone)


def test_co_located_stations_are_not_neighbours(stations):
    counts = {r.station_id: r.neighbours for r in neighbour_counts(stations).collect()}
    assert counts == {"S000": 1, "S001": 1, "S002": 2, "S003": 0}


def test_pairs_by_cells_equal_all_pairs(spark):
    import math

    rows = [(f"S{k:03d}", 103.6 + 0.037 * (k % 9), 1.2 + 0.029 * (k // 9)) for k in range(40)]
    table = spark.createDataFrame(rows, "station_id string, location_longitude double, location_latitude double")
    xy = {s: ((lon - 103.82) * 111.32 * math.cos(math.radians(1.35)), (lat - 1.35) * 110.57) for s, lon, lat in rows}
    for radius in (3.0, 11.0):
        got = {(r.s, r.j) for r in station_pairs(table, radius).collect()}
        assert got == {(a, b) for a in xy for b in xy if a != b and math.dist(xy[a], xy[b]) <= radius}


def test_missing_earlier_slot(spark, stations):
    rows = spark.createDataFrame([("S000", 10, 1.0), ("S002", 10, 0.5)], "station_id string, slot int, value double")
    out = by_key(neighbour_features(trailing_features(rows, GRID), stations, GRID))
    assert out["S000", 10]["t3_d15_max_rain_30"] == 0.5
    assert out["S000", 10]["t3_d15_dist_rain_km"] == pytest.approx(out["S000", 10]["t2_dist_rain_km"] if "t2_dist_rain_km" in out["S000", 10] else 0, abs=30) and out["S000", 10]["t3_d15_dist_rain_km"] < 0


def test_motion_is_a_parameter_of_both_layouts(spark, trailing, stations):
    from gaugegrid.operators.pairs import motion_of
    from gaugegrid.settings import MOTION

    fits = spark.createDataFrame([("0", 262.0, 12.0), ("2", None, None)], "g string, heading double, speed double")
    motion = motion_of(fits, MOTION)
    assert motion == MOTION | {0: (262.0, 12.0)}
    tiled, joined, usual = (
        by_key(neighbour_features(trailing, stations, GRID, ("t3",), form=f, motion=m)) for f, m in (("tiled", motion), ("joined", motion), ("tiled", MOTION))
    )
    assert tiled != usual and all(abs(row["t3_up15_rain"] - joined[key]["t3_up15_rain"]) <= 1.0001e-4 for key, row in tiled.items())
