"""Core stations, the region chain, tails and roll-ups against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugegrid.operators import inference as I
from gaugegrid.operators import pairs as P
from gaugegrid.operators import regions as R


def plain_core(names, n, least):
    keep = set(names)
    while True:
        short = {s: sum(n.get(tuple(sorted((s, o))), 0) < least for o in keep if o != s) for s in keep}
        worst = max(sorted(short), key=lambda s: short[s], default=None)
        if worst is None or not short[worst]:
            return keep
        keep.remove(worst)


def test_core_stations_of_random_networks(spark):
    """200 networks at once, some pairs without a shared slot, some stations without any pair."""
    rng, pairs, stations, want = random.Random(8), [], [], set()
    for g in range(200):
        names, dense = [f"S{k:02d}" for k in range(rng.randrange(0, 13))], rng.random()
        n = {(a, b): 50 if rng.random() < dense else 5 for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < 0.9}
        pairs += [(f"g{g}", a, b, v) for (a, b), v in n.items()]
        stations += [(f"g{g}", s) for s in names]
        want |= {(f"g{g}", s) for s in plain_core(names, n, 10)}
    found, rounds = R.core_rounds(
        spark.createDataFrame(pairs, "g string, i string, j string, n int"), spark.createDataFrame(stations + stations[:5], "g string, station_id string"), 10, by="g"
    )
    assert sorted((r.g, r.station_id) for r in found.collect()) == sorted(want) and rounds <= 12


def test_stations_far_apart_go_in_one_round(spark):
    """Ten independent short pairs and one hub that is short with everyone: the hub first, then all the others at once."""
    names = [f"S{k:02d}" for k in range(20)]
    good = [(a, b, 50) for i, a in enumerate(names) for k, b in enumerate(names) if i < k and (i // 2 != k // 2)]
    pairs = spark.createDataFrame(good, "i string, j string, n int")
    left, rounds = R.core_rounds(pairs, spark.createDataFrame([(s,) for s in [*names, "hub"]], "station_id string"), 10)
    assert rounds == 2 and sorted(r.station_id for r in left.collect()) == names[1::2]


def test_no_pairs_and_no_stations(spark):
    none = spark.createDataFrame([], "i string, j string, n int")
    assert [r.station_id for r in R.core_stations(none, spark.createDataFrame([("a",), ("b",)], "station_id string"), 1).collect()] == ["b"]
    assert R.core_stations(none, spark.createDataFrame([], "station_id string"), 1).count() == 0


@pytest.fixture(scope="module")
def two_regions(spark):
    """Ten stations in the west follow one signal, ten in the east another; W9 and E9 report in one slot of three."""
    rng = np.random.default_rng(2)
    signals, rows = {"W": rng.gamma(0.5, 4, 600), "E": rng.gamma(0.5, 4, 600)}, []
    for side in "WE":
        for k in range(10):
            for slot in range(600):
                if k < 9 or slot % 3 == 0:
                    rows.append((f"{side}{k}", slot, round(float(signals[side][slot] + rng.gamma(0.5, 0.5)), 1)))
    places = [(f"{side}{k}", x + 0.003 * k, 1.3) for side, x in (("W", 103.6), ("E", 103.9)) for k in range(10)]
    return (
        spark.createDataFrame(rows, "station_id string, slot int, value double"),
        spark.createDataFrame(places, "station_id string, location_longitude double, location_latitude double"),
    )


def test_region_chain_finds_two_regions(two_regions):
    readings, places = two_regions
    pairs = P.lagged_correlation(readings)
    chain = {r.station_id: (r.cluster, r.core) for r in R.region_chain(pairs, places, 201, k=2).collect()}
    assert len(chain) == 20 and not any(chain[s][1] for s in ("W9", "E9"))  # they share 200 slots
    assert {s: c for s, (c, _) in chain.items() if s[1] != "9"} == {f"{side}{k}": 1 + (side == "E") for side in "WE" for k in range(9)}
    assert chain["W9"][0] is None and chain["E9"][0] is None
    loose = R.assign_by_correlation(pairs, R.station_clusters(R.among(pairs, _core(pairs, places)), places.where("station_id not like '%9'"), 2).withColumnRenamed("position", "cluster"), 150)
    assert sorted((r.station_id, r.cluster) for r in loose.collect()) == [("E9", 2), ("W9", 1)]


def _core(pairs, places):
    return R.core_stations(pairs, places, 201)


def test_halves_agree_where_regions_are_real(two_regions):
    readings, places = two_regions
    halves = P.lagged_correlation(readings, 0, F.when(F.col("slot") % 2 == 1, "odd").otherwise("even"))
    both = R.half_clusters(halves, places, 150, k=2)
    assert sorted(r.station_id for r in both.collect()) == sorted(f"{side}{k}" for side in "WE" for k in range(9))
    assert R.rand_index(both, "odd", "even").first().ari == pytest.approx(1.0)


def test_normal_tail(spark):
    z = [-9.0, -3.0, -0.5, 0.0, 1e-6, 0.7, 1.959963984540054, 2.999, 3.0, 4.5, 8.0, 20.0]
    got = spark.createDataFrame([(v,) for v in [*z, None]], "z double").select("z", I.normal_tail(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p is None if r.z is None else r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-9)


def test_f_tail(spark):
    """Against the tail integrated numerically, with odd and even degrees of freedom."""
    cases = [(f, a, b) for f in (0.3, 1.0, 4.2) for a in (1, 2, 3, 4, 7, 11) for b in (1, 2, 5, 40, 71)]
    for r in spark.createDataFrame(cases, "f double, a int, b int").select("*", I.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        edge = math.atan(math.sqrt(r.a * r.f / r.b))  # F = (b / a) tan^2: the density in the angle is sin^(a-1) cos^(b-1)
        at = [np.linspace(lo, hi, 20001) for lo, hi in ((edge, math.pi / 2), (0, edge))]
        upper, lower = (np.trapezoid(np.sin(x) ** (r.a - 1) * np.clip(np.cos(x), 0, None) ** (r.b - 1), x) for x in at)
        assert r.p == pytest.approx(upper / (upper + lower), abs=1e-6), r


def test_month_means_against_two_pairs(spark):
    rng = random.Random(6)
    rows = [(y, m, math.sin(m) + (2.0 if m == 5 else 0) + rng.gauss(0, 0.5)) for y in range(7) for m in range(1, 13) if (y, m) != (3, 4)]
    monthly = spark.createDataFrame(rows + [(8, 1, None)], "year int, month int, value double")
    fits = I.harmonic_fit(monthly, "value", (F.col("month") - 0.5) / 12, (1, 2))
    y, m = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    phase = (m - 0.5) / 12
    rss = {}
    for k in (1, 2):
        x = np.column_stack([np.ones(len(y))] + [f(2 * np.pi * j * phase) for j in range(1, k + 1) for f in (np.cos, np.sin)])
        rss[k] = np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2)
    means = sum(np.sum((y[m == v] - y[m == v].mean()) ** 2) for v in range(1, 13))
    rest = I.level_f(fits, monthly, "value", "month", 2).first()
    assert (rest.df1, rest.df2) == (7, len(y) - 12) and rest.f == pytest.approx((rss[2] - means) / 7 / (means / (len(y) - 12)), rel=1e-6) and rest.p < 1e-3
    second = I.nested_f(fits, 1, 2).first()
    f = (rss[1] - rss[2]) / 2 / (rss[2] / (len(y) - 5))
    assert second.f == pytest.approx(f, rel=1e-6) and second.p == pytest.approx((1 + 2 * f / (len(y) - 5)) ** (-(len(y) - 5) / 2), rel=1e-5)


def test_rolled_up_sums_are_those_of_the_coarser_groups(spark, small):
    rows = spark.createDataFrame(small, "station_id string, slot int, value double")
    fine = P.lagged_sums(rows, 2, F.concat_ws("|", F.col("slot") % 2, (F.col("slot") / 20).cast("int")))
    both = P.rolled_up(fine, F.substring_index("g", "|", 1), F.col("g"))

    def table(df):
        return sorted(map(tuple, df.select("g", "i", "j", "lag", *P.SUMS).collect()))

    assert table(both.where("g not like '%|%'")) == table(P.lagged_sums(rows, 2, F.col("slot") % 2))
    assert table(both.where("g like '%|%'")) == table(fine)


def test_fronts_that_others_overtake(spark, monkeypatch):
    """Fronts of three stations, so that stations outside them come first in between."""
    monkeypatch.setattr(R, "FRONT", 3)
    rng, pairs, stations, want = random.Random(3), [], [], set()
    for g in range(6):
        names, dense = [f"S{k:02d}" for k in range(rng.randrange(6, 10))], rng.random()
        n = {(a, b): 50 if rng.random() < dense else 5 for i, a in enumerate(names) for b in names[i + 1:]}
        pairs += [(f"g{g}", a, b, v) for (a, b), v in n.items()]
        stations += [(f"g{g}", s) for s in names]
        want |= {(f"g{g}", s) for s in plain_core(names, n, 10)}
    found = R.core_stations(spark.createDataFrame(pairs, "g string, i string, j string, n int"), spark.createDataFrame(stations, "g string, station_id string"), 10, by="g")
    assert sorted((r.g, r.station_id) for r in found.collect()) == sorted(want)


def test_stations_that_wait_for_each_other_take_no_round_each(spark, monkeypatch):
    """Thirty stations that are all short with each other go one after the other, in one round."""
    written, kept = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df: written.append(1) or kept(df))
    none = spark.createDataFrame([("S00", "S01", 5)], "i string, j string, n int")
    left, chain = R.core_rounds(none, spark.createDataFrame([(f"S{k:02d}",) for k in range(30)], "station_id string"), 10)
    assert [r.station_id for r in left.collect()] == ["S29"] and chain == 29 and len(written) < 12


def test_rows_of_a_station_share_its_links(spark, monkeypatch):
    """Repeated stations: m + n - 1 links a pair instead of m * n, the same weight from a row to all rows of another station, the clusters of all links."""
    given, rng, assign = [], random.Random(4), R.PowerIterationClustering.assignClusters
    monkeypatch.setattr(R.PowerIterationClustering, "assignClusters", lambda self, links: given.append(links) or assign(self, links))
    names = [f"{side}{k}" for side in "EW" for k in range(5)]
    rows = {s: 1 + (3 * at) % 5 + 6 * (at == 7) for at, s in enumerate(names)}
    r = {(a, b): (0.9 if a[0] == b[0] else 0.05) * rng.uniform(0.8, 1) for at, a in enumerate(names) for b in names[at + 1:]}
    r["E0", "W4"] = -0.2
    places = [(s, (103.6 if s[0] == "W" else 103.9) + 0.001 * c, 1.3) for s in names for c in range(rows[s])] + [(None, 103.0, 1.3)]
    pairs = spark.createDataFrame([(a, b, 50, v) for (a, b), v in r.items()], "i string, j string, n int, r double")
    stations = spark.createDataFrame(places, "station_id string, location_longitude double, location_latitude double")
    found = sorted((x.station_id, x.position) for x in R.station_clusters(pairs, stations, 2).collect())

    of = dict(enumerate((s for s in names for _ in range(rows[s])), 2))  # the row without a station comes first
    links = [(x.src, x.dst, x.weight) for x in given[0].collect()]
    assert len(links) <= sum(rows[a] + rows[b] - 1 for (a, b), v in r.items() if v > 0) < sum(rows[a] * rows[b] for a, b in r) / 1.5
    sums = {}
    for src, dst, weight in links:
        for own, other in ((src, dst), (dst, src)):
            sums[own, of[other]] = sums.get((own, of[other]), 0) + weight
    want = {(own, b): r[min(of[own], b), max(of[own], b)] * rows[b] for own in of for b in names if of[own] != b and r[min(of[own], b), max(of[own], b)] > 0}
    assert sums == pytest.approx(want)
    every = [(x, y, r[of[x], of[y]]) for x in of for y in of if of[x] < of[y] and r[of[x], of[y]] > 0]
    pic = R.PowerIterationClustering(k=2, maxIter=20, initMode="degree", weightCol="weight")
    plain = {x.id: x.cluster for x in assign(pic, spark.createDataFrame(every, "src long, dst long, weight double").repartition(1)).collect()}
    assert found == sorted((of[x], 1 + (c != plain[max(of)])) for x, c in plain.items()) and {p for _, p in found} == {1, 2}
