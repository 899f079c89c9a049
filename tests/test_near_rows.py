"""Pairs within reach where a station has several rows: every pair once, every two rows within reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugegrid.functions.geo import with_xy
from gaugegrid.operators import pairs as P

#: A and B lie near each other at two places far apart; C is near the second of them only, D near nobody.
PLACES = [("A", 103.0, 1.0), ("B", 103.1, 1.0), ("A", 110.0, 5.0), ("B", 110.0, 5.1), ("C", 110.1, 5.1), ("D", 120.0, -9.0)]


@pytest.fixture(scope="module")
def network(spark):
    rng = np.random.default_rng(3)
    readings = [(s, k, float(rng.integers(0, 40)) / 10) for s in "ABCD" for k in range(60) if rng.random() < 0.8]
    stations = spark.createDataFrame(PLACES, "station_id string, location_longitude double, location_latitude double")
    return readings, spark.createDataFrame(readings, "station_id string, slot int, value double"), stations


def test_rows_of_a_station_do_not_multiply_its_readings(network):
    readings, rows, stations = network
    values = {(s, k): v for s, k, v in readings}
    found = {(r.i, r.j): r for r in P.lagged_correlation(rows, stations=stations, within_km=50.0, block=16).collect()}
    assert set(found) == {("A", "B"), ("A", "C"), ("B", "C")}
    for (i, j), r in found.items():
        both = [(values[i, k], values[j, k]) for k in range(60) if (i, k) in values and (j, k) in values]
        assert r.n == len(both) and r.r == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])
    lagged = P.lagged_correlation(rows, 2, stations=stations, within_km=50.0, block=16)
    far = P.lagged_correlation(rows, 2, block=16).where("i != 'D' and j != 'D'")
    assert sorted(map(tuple, lagged.select("i", "j", "lag", "n", F.round("r", 9)).collect())) == sorted(map(tuple, far.select("i", "j", "lag", "n", F.round("r", 9)).collect()))


def test_every_two_rows_within_reach_have_their_distance(network):
    _, _, stations = network
    at = [(r.station_id, r.x_km, r.y_km) for r in with_xy(stations).collect()]
    wanted = sorted((i, j, round(float(np.hypot(x - u, y - v)), 6)) for i, x, y in at for j, u, v in at if i != j and np.hypot(x - u, y - v) <= 50)
    found = P.near_rows(stations, 50.0)
    assert sorted(map(tuple, found.select("i", "j", F.round("d", 6)).collect())) == wanted
    assert P.near_pairs(found).count() == 6  # three pairs in both orders
