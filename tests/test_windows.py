"""Chunked windows, labels and trailing features against brute force in plain Python."""

import pytest
from pyspark.sql import functions as F

from gaugegrid.operators.labels import label_rows, label_violations
from gaugegrid.operators.trailing import observed_rows, trailing_features
from gaugegrid.settings import CLASS_FLOORS, Grid

GRID = Grid("2024-01-01 00:00:00", 10800)


def frame(spark, rows):
    return spark.createDataFrame(rows, "station_id string, slot int, value double")


def expected_labels(rows):
    at = {(s, t): v for s, t, v in rows}
    out = {}
    for s, t, _ in rows:
        nxt = [at.get((s, t + k)) for k in range(1, 7)]
        past = [at.get((s, t - k)) for k in range(6)]
        if None not in nxt:
            total = round(sum(nxt), 1)
            known = None if None in past else round(sum(past), 1)
            regime = "unknown" if known is None else "wet_now" if known > 0 else "dry_now"
            out[s, t] = (total, float(sum(total >= f for f in CLASS_FLOORS)), known, regime)
    return out


@pytest.mark.parametrize("size", [None, 7, 16])
def test_labels_for_any_chunk_length(spark, small, size):
    got = label_rows(frame(spark, small), GRID, size=size).collect()
    assert {(r.station_id, r.slot): (r.y_mm, r.label, r.past30_mm, r.regime) for r in got} == expected_labels(small)
    assert len(got) == len(expected_labels(small))


@pytest.mark.parametrize("size", [None, 10])
def test_trailing_for_any_chunk_length(spark, small, size):
    at = {(s, t): v for s, t, v in small}
    for r in trailing_features(frame(spark, small), GRID, size=size).collect():
        def last(n):
            return [at[r.station_id, u] for u in range(r.slot - n + 1, r.slot + 1) if (r.station_id, u) in at]

        for minutes, n in ((15, 3), (30, 6), (60, 12), (120, 24), (1440, 288)):
            assert r[f"t1_rain_{minutes}"] == pytest.approx(round(sum(last(n)), 1))
        assert r.t1_rain_5 == at[r.station_id, r.slot] and r.t1_max5_30 == max(last(6))
        assert r.t1_wet_slots_60 == sum(v > 0 for v in last(12)) and r.t1_missing_120 == 24 - len(last(24))
        wet = [u for u in range(r.slot + 1) if at.get((r.station_id, u), 0) > 0]
        assert r.t1_min_since_rain == (min(1440, (r.slot - wet[-1]) * 5) if wet else 1440)
        assert r.t1_trend_30 == pytest.approx(round(2 * sum(last(3)) - sum(last(6)), 1))


@pytest.mark.parametrize("size", [None, 9])
def test_one_pass_equals_labels_and_trailing(spark, small, size):
    rows = frame(spark, small)
    both = observed_rows(rows, GRID, size=size)
    labels = label_rows(rows, GRID)
    assert sorted(both.where("label is not null").select(labels.columns).collect()) == sorted(labels.collect())
    trailing = trailing_features(rows, GRID)
    assert sorted(both.select(trailing.columns).collect()) == sorted(trailing.collect())


def test_gaps_stop_a_label_but_not_a_total(spark):
    rows = [("A", t, 0.3) for t in range(21) if t not in (3, 4, 11)]
    labels = {r.slot for r in label_rows(frame(spark, rows), GRID).collect()}
    assert labels == {t for t in range(21) if t not in (3, 4, 11) and all(u not in (3, 4, 11) and u <= 20 for u in range(t + 1, t + 7))}
    trailing = {r.slot: r for r in trailing_features(frame(spark, rows), GRID).collect()}
    assert trailing[5].t1_rain_15 == 0.3 and trailing[5].t1_rain_30 == pytest.approx(1.2)


def test_boundary_amounts(spark):
    from gaugegrid.functions.amounts import bucketize, past_class

    amounts = [0.0, 0.1, 0.2, 0.3, 0.5, 0.6, 1.0, 1.1, 2.0, 2.1, 5.0, 5.1, 10.0, 10.1, 20.0, 20.1]
    rows = spark.createDataFrame([(a,) for a in amounts], "a double").select("a", bucketize("a").alias("b"), past_class("a").alias("p")).collect()
    assert all(r.b == r.p for r in rows)
    half = spark.createDataFrame([(0.05,), (0.25,), (0.55,)], "a double").select(bucketize("a").alias("b")).collect()
    assert [r.b for r in half] == [1, 2, 3]


def test_label_checks_are_zero(spark, small):
    assert set(label_violations(label_rows(frame(spark, small), GRID)).first().asDict().values()) == {0}


def test_year_end_is_left_out(spark):
    grid = Grid("2023-12-31 00:00:00", 10800)
    rows = [("A", t, 0.0) for t in range(20)]
    kept = sorted(r.slot for r in label_rows(frame(spark, rows), grid).collect())
    assert kept == [t for t in range(14) if (t < 8) == (t + 6 < 8)]


def test_empty_input_keeps_the_schema(spark):
    empty = frame(spark, [])
    assert label_rows(empty, GRID).count() == 0 and trailing_features(empty, GRID).count() == 0


def test_no_row_is_lost_to_chunks(spark, small):
    got = trailing_features(frame(spark, small), GRID, size=5)
    assert got.count() == len(small) and got.select("station_id", "slot").distinct().count() == len(small)
    assert got.agg(F.min("slot")).first()[0] >= 0
