"""Cases that the derived tables do not hold."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gaugegrid.operators import align, audit, grid, inference, mapper, neighbours, pairs, regions


def test_thresholds_of_classes_without_rows_stay(spark):
    fitted = spark.createDataFrame([(1, 0.1, 2.0), (5, 3.0, 1.0), (5, 4.0, 3.0)], "label int, y_mm double, w double")
    shares = {r.theta: r.q for r in mapper.threshold_shares(fitted, [0.0, 3.0, 15.0, 30.0]).collect()}
    assert shares == {0.0: 1.0, 3.0: 0.75, 15.0: None, 30.0: None}
    rows = spark.createDataFrame([([0.8] * 8,)], "f array<double>")
    long = {r.theta: r.f for r in mapper.with_thresholds(rows, fitted, [0.0, 3.0, 15.0, 30.0], "f").collect()}
    assert long == {0.0: pytest.approx(0.8), 3.0: pytest.approx(0.8), 15.0: None, 30.0: None}


def test_t_interval_of_any_size(spark):
    known = {2: 12.706205, 3: 4.302653, 4: 3.182446, 31: 2.042272, 40: 2.022691, 121: 1.979930, 2001: 1.961151}
    rows = spark.createDataFrame([(n, float(k)) for n in known for k in range(n)], "n int, v double")
    for r in inference.mean_interval(rows.withColumnRenamed("n", "g"), "v", "g").collect():
        assert r.half_width / r.sd * r.n**0.5 == pytest.approx(known[r.g], abs=1e-5)
    one = spark.createDataFrame([(1, 2.0)], "g int, v double")
    assert inference.mean_interval(one, "v", "g").first().half_width is None


def test_a_repeat_at_the_end_of_the_overlap_goes(spark):
    change = dt.datetime(2024, 1, 15)
    stamps = [change - dt.timedelta(seconds=1), change, change + dt.timedelta(minutes=5) - dt.timedelta(seconds=1)]
    rows = spark.createDataFrame([("a", t, float(k)) for k, t in enumerate(stamps)], "station_id string, timestamp timestamp_ntz, reading_value double")
    got = align.align(rows, overlap=F.col("time_5min") <= F.lit(change).cast("timestamp_ntz")).collect()
    assert sorted(r.reading_value for r in got) == [1.0, 2.0] and len(align.align(rows).collect()) == 2


def test_ties_at_the_latest_time_have_an_order(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 103.8, 1.3, "x", "d"), ("a", t, 103.9, 1.2, "w", "d"), ("a", t - dt.timedelta(1), 110.0, 9.0, "z", "d")]
    schema = "station_id string, timestamp timestamp_ntz, location_longitude double, location_latitude double, station_name string, station_device_id string"
    for order in (rows, rows[::-1]):
        obs = spark.createDataFrame(order, schema)
        last = audit.latest_attributes(obs).first()
        assert (last.location_longitude, last.location_latitude, last.station_name, last.observations) == (103.9, 1.2, "w", 3)
        assert audit.identity_versions(obs).first().canonical_station_name == "x"


def test_the_grid_reaches_to_the_last_slot(spark):
    readings = spark.createDataFrame([("a", 3, 1.0), ("b", 247, 2.0)], "station_id string, slot int, value double")
    dense = grid.dense_grid(readings, readings.select("station_id")).groupBy("station_id").agg(F.min("slot"), F.max("slot"), F.count("*")).collect()
    assert sorted(map(tuple, dense)) == [("a", 3, 247, 245), ("b", 3, 247, 245)]


def test_a_decay_copies_no_pair_per_reach(spark):
    """The plan of a fit makes no rows from pairs; pairs without a distance count without a part in the amplitude."""
    rows = [("a", 0.9 * math.exp(-d / 7), float(d)) for d in range(1, 40)] + [("a", 0.5, None), (None, 0.1, 1.0), ("b", 0.2, None)]
    fit = pairs.decay_fit(spark.createDataFrame(rows, "g string, r double, d double"))
    assert "Generate" not in fit._jdf.queryExecution().executedPlan().toString()
    found = {r.g: r for r in fit.collect()}
    assert found["a"].pairs == 40 and found["a"].bounded and abs(found["a"].reach_km / 7 - 1) < 0.02 and abs(found["a"].c0 - 0.9) < 0.05


def test_a_flat_decay_has_no_reach(spark):
    flat = [("flat", 0.5, float(d)) for d in range(1, 40)]
    steep = [("steep", 0.9 * 2.718281828459045 ** (-d / 300.0), float(d)) for d in range(1, 900, 7)]
    fits = {r.g: r for r in pairs.decay_fit(spark.createDataFrame(flat + steep, "g string, r double, d double")).collect()}
    assert not fits["flat"].bounded and fits["flat"].reach_km is None
    assert fits["steep"].bounded and fits["steep"].reach_km == pytest.approx(300, rel=0.011) and fits["steep"].c0 == pytest.approx(0.9, rel=0.01)


def test_stations_that_share_no_slot_are_short(spark):
    rows = [(s, t, t % 5 / 10) for s, slots in (("A", range(50)), ("B", range(50, 100)), ("C", range(100))) for t in slots]
    readings = spark.createDataFrame(rows, "station_id string, slot int, value double")
    left = regions.core_stations(pairs.lagged_correlation(readings), readings.select("station_id"), 20)
    assert sorted(r.station_id for r in left.collect()) == ["B", "C"]  # A and B are equally bad; the smaller id goes


def test_pairs_do_not_depend_on_the_layout(spark, monkeypatch):
    places = spark.createDataFrame([(f"S{k}", 103.5 + 0.09 * k, 1.3) for k in range(9)], "station_id string, location_longitude double, location_latitude double")
    rows = [(f"S{k}", t, (t * (k + 2) % 7) / 10) for k in range(9) for t in range(70) if (t + k) % 6]
    readings = spark.createDataFrame(rows, "station_id string, slot int, value double")

    def table(df):
        return {(r.i, r.j, r.lag): (r.n, r.r) for r in df.collect()}

    whole = table(pairs.lagged_correlation(readings, 2))
    monkeypatch.setattr(pairs, "GROUP_STATIONS", 2)
    assert table(pairs.lagged_correlation(readings, 2)) == whole and len(whole) == 36 * 5
    close = {(r.s, r.j) for r in neighbours.station_pairs(places, 25.0).collect()}
    near = table(pairs.lagged_correlation(readings, 2, stations=places, within_km=25.0))
    assert near == {k: v for k, v in whole.items() if k[:2] in close} and 0 < len(near) < len(whole)
