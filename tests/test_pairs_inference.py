"""Pairs, regions, regressions and permutations against NumPy and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugegrid.operators import inference as I
from gaugegrid.operators import pairs as P
from gaugegrid.operators import regions as R
from gaugegrid.operators.models import shuffle_tier
from gaugegrid.operators.ranks import average_ranks


def test_lagged_correlation_across_blocks(spark, small):
    rows = spark.createDataFrame(small, "station_id string, slot int, value double")
    at = {(s, t): v for s, t, v in small}
    names = ["S000", "S001", "S002"]
    whole = {(r.i, r.j, r.lag): r for r in P.lagged_correlation(rows, 4).collect()}
    for (i, j, lag), r in whole.items():
        pairs = [(at[i, t], at[j, t + lag]) for t in range(60) if (i, t) in at and (j, t + lag) in at]
        assert r.n == len(pairs) and i < j
        x, y = np.array(pairs).T
        assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert len(whole) == 3 * 9
    sums = P.lagged_sums(rows, 4, block=1)  # eight lags is the smallest block
    assert sums.count() == 6 * 5 and set(sums.select("i").distinct().toPandas()["i"]) == set(names)


def test_motion_is_recovered(spark):
    speed, heading = 40.0, 120.0
    a, b = (60 / speed) * math.sin(math.radians(heading)), (60 / speed) * math.cos(math.radians(heading))
    rng = random.Random(1)
    rows = [("all", dx := rng.uniform(-20, 20), dy := rng.uniform(-20, 20), dx * a + dy * b) for _ in range(50)]
    fit = P.motion_fit(spark.createDataFrame(rows, "g string, dx double, dy double, lag double")).first()
    assert (fit.speed, fit.heading, fit.r2) == (pytest.approx(speed), pytest.approx(heading), pytest.approx(1.0))


def test_decay_is_recovered_within_a_grid_step(spark):
    rows = [("all", 0.8 * math.exp(-d / 12.0), d / 1.0) for d in range(1, 50)]
    fit = P.decay_fit(spark.createDataFrame(rows, "g string, r double, d double")).first()
    assert fit.reach_km == pytest.approx(12.0, rel=0.02) and fit.c0 == pytest.approx(0.8, rel=0.03)


def test_core_stations_drop_the_worst_first(spark):
    names = [f"S{k}" for k in range(7)]
    rng = random.Random(3)
    n = {(a, b): rng.choice([5, 50]) for i, a in enumerate(names) for b in names[i + 1 :]}
    keep = set(names)
    while True:
        short = {s: sum(v < 10 for p, v in n.items() if s in p and set(p) <= keep) for s in keep}
        worst = max(sorted(short), key=lambda s: short[s])
        if not short[worst]:
            break
        keep.remove(worst)
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in n.items()], "i string, j string, n int")
    assert {r.station_id for r in R.core_stations(pairs, spark.createDataFrame([(x,) for x in names], "station_id string"), 10).collect()} == keep


def test_rand_index_limits(spark):
    same = spark.createDataFrame([(i, i % 3, (i % 3) * 7) for i in range(30)], "id int, a int, b int")
    assert R.rand_index(same, "a", "b").first().ari == pytest.approx(1.0)
    one = spark.createDataFrame([(i, 0, 0) for i in range(5)], "id int, a int, b int")
    assert R.rand_index(one, "a", "b").first().ari == 1.0


def test_average_ranks_over_any_cells(spark):
    values = [3.0, 1.0, 3.0, 2.0, 9.0, 3.0, 1.0]
    rows = spark.createDataFrame([("k", v, values.count(v)) for v in set(values)], "key string, v double, n long")
    want = [sorted(values).index(v) + 1 + (values.count(v) - 1) / 2 for v in sorted(values)]
    for cells in ([0.0], [1.5, 2.5], [1.0, 2.0, 3.0, 4.0]):
        assert sorted(r["rank"] for r in average_ranks(rows, ["key"], "v", "n", cells).collect() for _ in range(r.n)) == want


@pytest.fixture(scope="module")
def monthly(spark):
    rng = random.Random(5)
    rows = [(y, m, 5 + math.cos(m / 2) + 0.3 * (y - 2017) + rng.gauss(0, 0.4)) for y in range(2017, 2021) for m in range(1, 13) if (y, m) != (2018, 7)]
    return spark.createDataFrame(rows, "year int, month int, value double")


def test_harmonics_equal_least_squares(monthly):
    pdf = monthly.toPandas()
    phase = (pdf.month.to_numpy() - 0.5) / 12
    for r in I.harmonic_fit(monthly, "value", (F.col("month") - 0.5) / 12).collect():
        x = np.column_stack([np.ones(len(pdf))] + [f(2 * np.pi * k * phase) for k in range(1, r.pairs + 1) for f in (np.cos, np.sin)])
        beta = np.linalg.lstsq(x, pdf.value, rcond=None)[0]
        assert r.rss == pytest.approx(np.sum((pdf.value - x @ beta) ** 2), rel=1e-8)
        assert r.amplitudes[0] == pytest.approx(np.hypot(beta[1], beta[2]), rel=1e-8)


def test_effects_equal_least_squares(monthly):
    levels = {"month": list(range(1, 13)), "year": list(range(2017, 2021))}
    pdf = monthly.toPandas()

    def coded(factor):
        return np.column_stack([np.where(pdf[factor] == v, 1.0, np.where(pdf[factor] == levels[factor][-1], -1.0, 0.0)) for v in levels[factor][:-1]])

    def fit(*parts):
        x = np.column_stack([np.ones(len(pdf)), *parts])
        beta = np.linalg.lstsq(x, pdf.value, rcond=None)[0]
        return beta, np.sum((pdf.value - x @ beta) ** 2)

    beta, full = fit(coded("month"), coded("year"))
    parts = {r.factor: r.sum_sq for r in I.two_way_effects(monthly, "value", "month", "year", levels).collect()}
    assert parts["month"] == pytest.approx(fit(coded("year"))[1] - full, rel=1e-6)
    assert parts["year"] == pytest.approx(fit(coded("month"))[1] - full, rel=1e-6)
    effects = {r.level: r for r in I.level_effects(monthly, "value", "year", "month", levels).collect()}
    assert [effects[y].effect for y in (2017, 2018, 2019)] == [pytest.approx(b) for b in beta[-3:]]
    assert effects[2020].effect == pytest.approx(-beta[-3:].sum())
    assert all(0 <= r.p <= r.p_holm <= 1 for r in effects.values())


def test_permutations_keep_years_and_values(monthly):
    shuffled = I.permuted_months(monthly, 3)
    assert shuffled.count() == 3 * monthly.count()
    a = sorted(map(tuple, shuffled.where("rep = 2").select("year", "value").collect()))
    assert a == sorted(map(tuple, monthly.select("year", "value").collect()))
    assert shuffled.groupBy("rep", "year", "month").count().where("count > 1").count() == 0
    p = I.permutation_test(monthly, 50).first().p
    assert 0 < p <= 1 and p == pytest.approx(1 / 51)


def test_bootstrap_of_equal_days_has_no_spread(spark):
    daily = spark.createDataFrame([(f"d{k}", 4, 2.0, 1.0) for k in range(6)], "day string, n int, a double, b double")
    rows = {r.series: r for r in I.block_bootstrap(daily, ["a", "b"], 30, [("b", "a")]).collect()}
    assert (rows["a"].low, rows["a"].high, rows["a"].estimate) == (0.5, 0.5, 0.5) and rows["b - a"].below_0 == 1.0


def test_shuffled_tier_is_a_permutation_of_whole_rows(spark):
    rows = spark.createDataFrame([(f"S{k % 5}", k, float(k), k * 2.0, -1.0 * k) for k in range(200)], "station_id string, slot int, t1_a double, t1_b double, t0_c double")
    mixed = shuffle_tier(rows, ["t1_a", "t1_b"], cells=7).collect()
    assert sorted(r.t1_a for r in mixed) == [float(k) for k in range(200)] and all(r.t1_b == 2 * r.t1_a and r.t0_c == -r.slot for r in mixed)
    assert sum(r.t1_a == r.slot for r in mixed) < 20
