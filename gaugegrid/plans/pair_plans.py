"""Named queries: station pairs, regions and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugegrid.functions.clock import season_code, time_of
from gaugegrid.operators import inference as I
from gaugegrid.operators import neighbours as N
from gaugegrid.operators import pairs as P
from gaugegrid.operators import regions as R
from gaugegrid.operators.grid import block_sum
from gaugegrid.plans import pattern_plans as PP
from gaugegrid.plans import score_plans as SP
from gaugegrid.plans import sqltext
from gaugegrid.plans.registry import query
from gaugegrid.operators import scoring as S
from gaugegrid.settings import CLUSTER_TEST_BANDS
from gaugegrid.sources.fixtures import GRID, Tables
from gaugegrid.sources.session import stored

C = sqltext.CTES
_R = """(count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(sqrt(greatest((count(*) * sum(x * x) - sum(x) ** 2) * (count(*) * sum(y * y) - sum(y) ** 2), 0)), 0)"""


def _corr_sql(source: str, lags: int, group: str = "'all'") -> str:
    return f"""SELECT g, i, j, lag, count(*) AS n, {_R} AS r FROM (
  SELECT {group} AS g, a.station_id AS i, b.station_id AS j, CAST(l.lag AS INTEGER) AS lag, round(a.value * 10) AS x, round(b.value * 10) AS y
  FROM {source} a CROSS JOIN (SELECT unnest(range({-lags}, {lags + 1})) AS lag) l JOIN {source} b ON b.slot = a.slot + l.lag AND b.station_id > a.station_id) GROUP BY g, i, j, lag"""


C["g_blocks2"] = "SELECT station_id, slot // 2 AS slot, round(sum(value), 1) AS value FROM g_readings GROUP BY 1, 2 HAVING count(*) = 2"
C["g_blocks4"] = "SELECT station_id, slot // 4 AS slot, round(sum(value), 1) AS value FROM g_readings GROUP BY 1, 2 HAVING count(*) = 4"
C["g_corr"] = _corr_sql("g_readings", 0)
C["g_lagged"] = _corr_sql("g_readings", 3)
C["g_half_corr"] = _corr_sql("g_readings", 3, "CASE WHEN CASE WHEN l.lag >= 0 THEN a.slot ELSE b.slot END % 16 < 8 THEN 'odd' ELSE 'even' END")
C["g_res"] = " UNION ALL ".join(
    f"SELECT '{g}' AS res, i, j, n, r FROM ({_corr_sql(s, 0)})" for g, s in (("1", "g_readings"), ("2", "g_blocks2"), ("4", "g_blocks4")))
C["g_res_d"] = "SELECT c.res AS g, c.i, c.j, c.n, c.r, p.dist_km AS d FROM g_res c JOIN g_pairs p ON p.s = c.i AND p.j = c.j WHERE n >= 20 AND r IS NOT NULL"
_BAND = "CASE " + " ".join(f"WHEN d >= {a} AND d < {b} THEN {k}" for k, (a, b) in enumerate(zip(P.DISTANCE_BANDS, P.DISTANCE_BANDS[1:]))) + " END"
C["g_season_corr"] = _corr_sql("g_readings", 3, "CASE WHEN month(TIMESTAMP '2024-01-01' + to_seconds(CAST(CASE WHEN l.lag >= 0 THEN a.slot ELSE b.slot END AS BIGINT) * 10800)) IN (12, 1, 2, 3) THEN '0' ELSE '1' END")
C["g_peaks"] = """
SELECT g, i, j, arg_max(lag, (round(rr, 12), -lag)) AS slot_lag, max(rr) AS peak_r, arg_max(lo, (round(rr, 12), -lag)) AS lo, arg_max(hi, (round(rr, 12), -lag)) AS hi
FROM (SELECT *, lag(rr) OVER w AS lo, lead(rr) OVER w AS hi FROM (SELECT g, i, j, lag, coalesce(r, -9) AS rr FROM g_half_corr) WINDOW w AS (PARTITION BY g, i, j ORDER BY lag)) GROUP BY g, i, j"""
C["g_best"] = """
SELECT k.g, k.i, k.j, slot_lag, peak_r, (slot_lag + coalesce(0.5 * (lo - hi) / nullif(lo - 2 * peak_r + hi, 0), 0)) * 180 AS lag, p.dx, p.dy, p.dist_km AS d
FROM g_peaks k JOIN g_pairs p ON p.s = k.i AND p.j = k.j
WHERE peak_r > 0.1 AND slot_lag > -3 AND slot_lag < 3 AND p.dist_km BETWEEN 5 AND 30"""

#: Slots that a pair must share at a lag, and pairs that a season needs, for its motion.
LEAST_SHARED, LEAST_PAIRS = 60, 5
C["g_season_peaks"] = C["g_peaks"].replace("g_half_corr", f"g_season_corr WHERE n >= {LEAST_SHARED}")
C["g_season_best"] = C["g_best"].replace("g_peaks", "g_season_peaks")


def _r(*names: str):
    return [F.round(c, 6).alias(c) for c in names]


@query("pair_corr", "C01 J12", "SELECT i, j, n, round(r, 6) AS r FROM g_corr")
def pair_corr(t: Tables):
    return P.lagged_correlation(t.readings()).select("i", "j", "n", *_r("r"))


@query("lagged_corr", "C01 J12", "SELECT i, j, lag, n, round(r, 6) AS r FROM g_lagged")
def lagged_corr(t: Tables):
    return P.lagged_correlation(t.readings(), 3).select("i", "j", "lag", "n", *_r("r"))


def _halves(t: Tables, **reach):
    """Correlations with the reference time split into odd and even days."""
    odd = F.pmod(F.col("slot"), F.lit(16)) < 8
    return P.lagged_correlation(t.readings(), 3, F.when(odd, "odd").otherwise("even"), **reach)


@query("lagged_corr_halves", "C01 P31 C12", "SELECT g, i, j, lag, n, round(r, 6) AS r FROM g_half_corr")
def lagged_corr_halves(t: Tables):
    return _halves(t).select("g", "i", "j", "lag", "n", *_r("r"))


def _resolutions(t: Tables, within_km: float | None = None):
    out, reach, stations = None, {}, stored(t.stations())
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))  # stations and pairs are few rows for Spark, but rows of stations may repeat and multiply them
    if within_km is not None:
        near = stored(P.near_rows(stations.repartition(parts), within_km))
        reach["pairs"] = stored(P.near_pairs(near))
    for k in (1, 2, 4):
        rows = t.readings() if k == 1 else block_sum(t.readings(), k).select("station_id", F.col("block").alias("slot"), F.col("total").alias("value"))
        corr = P.lagged_correlation(rows, **reach).where("n >= 20 and r is not null").withColumn("g", F.lit(str(k)))
        out = corr if out is None else out.unionByName(corr)
    rows = stored(out.repartition(parts))
    if within_km is None:
        return P.with_distance(rows, stations)
    return rows.join(near.where("i < j").select("i", "j", "d"), ["i", "j"])  # a row per two rows of the stations; far ones never meet


@query("multi_resolution_corr", "C02 R09", "SELECT g, i, j, n, round(r, 6) AS r, round(d, 6) AS d FROM g_res_d")
def multi_resolution_corr(t: Tables):
    return _resolutions(t).select("g", "i", "j", "n", *_r("r", "d"))


@query("distance_bands", "A40 C02", f"""
SELECT g, CAST(band AS INTEGER) AS band, round(quantile_cont(d, 0.5), 6) AS distance, round(quantile_cont(r, 0.5), 6) AS median_r, count(*) AS pairs
FROM (SELECT *, {_BAND} AS band FROM g_res_d) WHERE band IS NOT NULL GROUP BY g, band""")
def distance_bands(t: Tables):
    rows = _resolutions(t, float(P.DISTANCE_BANDS[-1]))
    return P.distance_bands(rows).select("g", "band", *_r("distance", "median_r"), "pairs")


@query("decay_fit", "C03", """
SELECT g, CASE WHEN bounded THEN round(c0, 6) END AS c0, CASE WHEN bounded THEN reach_km END AS reach_km, pairs, bounded FROM (
 SELECT g, arg_min(re / ee, round(rr - re * re / ee, 12)) AS c0, arg_min(reach_km, round(rr - re * re / ee, 12)) AS reach_km, any_value(pairs) AS pairs,
  arg_min(s, round(rr - re * re / ee, 12)) BETWEEN 1 AND 599 AS bounded FROM (
  SELECT g, s, reach_km, count(*) AS pairs, sum(r * exp(-d / reach_km)) AS re, sum(exp(-d / reach_km) ** 2) AS ee, sum(r * r) AS rr
  FROM g_res_d, (SELECT s, round(1.02::DOUBLE ** s, 6) AS reach_km FROM (SELECT unnest(range(601)) AS s)) GROUP BY g, s, reach_km) GROUP BY g)""")
def decay_fit(t: Tables):
    return P.decay_fit(_resolutions(t)).select("g", *_r("c0"), "reach_km", "pairs", "bounded")


def _lags(t: Tables):
    best = P.with_distance(P.best_lags(_halves(t, stations=t.stations(), within_km=P_RING[1]), 180.0), t.stations())
    return best.where(F.col("d").between(*P_RING))


P_RING = (5.0, 30.0)


@query("best_lag", "C10 W14 J13", "SELECT g, i, j, slot_lag, round(peak_r, 6) AS peak_r, round(lag, 6) AS lag FROM g_best")
def best_lag(t: Tables):
    return _lags(t).select("g", "i", "j", "slot_lag", *_r("peak_r", "lag"))


@query("motion_fit", "C11 C12", """
SELECT g, pairs, round(60 / sqrt(a * a + b * b), 4) AS speed, round(((degrees(atan2(a, b)) % 360) + 360) % 360, 4) AS heading,
       round(1 - (tt - a * xt - b * yt) / (tt - t * t / pairs), 6) AS r2 FROM (
 SELECT *, (yy * xt - xy * yt) / (xx * yy - xy * xy) AS a, (xx * yt - xy * xt) / (xx * yy - xy * xy) AS b FROM (
  SELECT g, count(*) AS pairs, sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy, sum(dx * lag) AS xt, sum(dy * lag) AS yt, sum(lag * lag) AS tt, sum(lag) AS t FROM g_best GROUP BY g))""")
def motion_fit(t: Tables):
    fit = P.motion_fit(_lags(t))
    return fit.select("g", "pairs", *[F.round(c, 4).alias(c) for c in ("speed", "heading")], *_r("r2"))


def season_motion_fits(t: Tables):
    """Motion per season from pairs in the ring that share enough slots at a lag, where enough pairs have a peak."""
    season = season_code(F.month(time_of("slot", GRID)))
    curves = P.lagged_correlation(t.readings(), 3, season, stations=t.stations(), within_km=P_RING[1]).where(F.col("n") >= LEAST_SHARED)
    lags = P.with_distance(P.best_lags(curves, 180.0), t.stations()).where(F.col("d").between(*P_RING))
    return P.motion_fit(lags, LEAST_PAIRS)


@query("season_motion", "C12", f"""
SELECT g, pairs, round(60 / sqrt(a * a + b * b), 4) AS speed, round(((degrees(atan2(a, b)) % 360) + 360) % 360, 4) AS heading,
       round(1 - (tt - a * xt - b * yt) / (tt - t * t / pairs), 6) AS r2 FROM (
 SELECT *, (yy * xt - xy * yt) / (xx * yy - xy * xy) AS a, (xx * yt - xy * xt) / (xx * yy - xy * xy) AS b FROM (
  SELECT g, count(*) AS pairs, sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy, sum(dx * lag) AS xt, sum(dy * lag) AS yt, sum(lag * lag) AS tt, sum(lag) AS t
  FROM g_season_best GROUP BY g HAVING count(*) >= {LEAST_PAIRS}))""")
def season_motion(t: Tables):
    return season_motion_fits(t).select("g", "pairs", *[F.round(c, 4).alias(c) for c in ("speed", "heading")], *_r("r2"))


def season_year_fits(t: Tables):
    """Motion per season (``year`` null) and per season and year. The series are read once, by season and year; their joint sums add up to those of
    the seasons, and each level asks its own pairs for enough shared slots and its own groups for enough pairs."""
    at = time_of("slot", GRID)
    fine = F.concat_ws("|", season_code(F.month(at)), F.year(at))
    sums = stored(P.lagged_sums(t.readings(), 3, fine, stations=t.stations(), within_km=P_RING[1]))
    return P.motion_by_level(P.rolled_up(sums, F.substring_index("g", "|", 1), F.col("g")), t.stations(), P_RING, 180.0, LEAST_SHARED, LEAST_PAIRS)


def _motions(source: str) -> str:
    return f"""SELECT g, pairs, round(60 / sqrt(a * a + b * b), 4) AS speed, round(((degrees(atan2(a, b)) % 360) + 360) % 360, 4) AS heading,
       round(1 - (tt - a * xt - b * yt) / (tt - t * t / pairs), 6) AS r2 FROM (
 SELECT *, (yy * xt - xy * yt) / (xx * yy - xy * xy) AS a, (xx * yt - xy * xt) / (xx * yy - xy * xy) AS b FROM (
  SELECT g, count(*) AS pairs, sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy, sum(dx * lag) AS xt, sum(dy * lag) AS yt, sum(lag * lag) AS tt, sum(lag) AS t
  FROM {source} GROUP BY g HAVING count(*) >= {LEAST_PAIRS}))"""


_REFERENCE = "TIMESTAMP '2024-01-01' + to_seconds(CAST(CASE WHEN l.lag >= 0 THEN a.slot ELSE b.slot END AS BIGINT) * 10800)"
C["g_season_year_corr"] = _corr_sql("g_readings", 3, f"CASE WHEN month({_REFERENCE}) IN (12, 1, 2, 3) THEN '0' ELSE '1' END || '|' || year({_REFERENCE})")
C["g_season_year_peaks"] = C["g_peaks"].replace("g_half_corr", f"g_season_year_corr WHERE n >= {LEAST_SHARED}")
C["g_season_year_best"] = C["g_best"].replace("g_peaks", "g_season_year_peaks")


@query("season_year_motion", "C12", f"""
SELECT CAST(split_part(g, '|', 1) AS INTEGER) AS season, TRY_CAST(split_part(g, '|', 2) AS INTEGER) AS year, pairs, speed, heading, r2
FROM ({_motions("g_season_best")} UNION ALL {_motions("g_season_year_best")})""")
def season_year_motion(t: Tables):
    parts = F.split("g", "[|]")
    names = [F.get(parts, k).cast("int").alias(name) for k, name in enumerate(("season", "year"))]
    return season_year_fits(t).select(*names, "pairs", *[F.round(c, 4).alias(c) for c in ("speed", "heading")], *_r("r2"))


REGIONS = (
    ("A", 0, ((103.60, 1.20), (103.72, 1.20), (103.72, 1.26), (103.60, 1.26))),
    ("B", 0, ((103.72, 1.20), (103.80, 1.20), (103.80, 1.26), (103.72, 1.26))),
    ("C", 0, ((103.80, 1.20), (103.90, 1.20), (103.90, 1.24), (103.86, 1.222), (103.82, 1.24))),
    ("D", 0, ((103.60, 1.27), (103.80, 1.27), (103.80, 1.40), (103.60, 1.40))),
)


def region_table(t: Tables):
    rows = [(r, g, i, x, y) for r, g, points in REGIONS for i, (x, y) in enumerate(points)]
    return t.spark.createDataFrame(rows, "region string, ring int, i int, x double, y double")


_VERTICES = ", ".join(f"('{r}', {i}, {x}::DOUBLE, {y}::DOUBLE, {p[(i + 1) % len(p)][0]}::DOUBLE, {p[(i + 1) % len(p)][1]}::DOUBLE)" for r, _, p in REGIONS for i, (x, y) in enumerate(p))
C["g_edges"] = f"SELECT * FROM (VALUES {_VERTICES}) e(region, i, x1, y1, x2, y2)"
C["g_region"] = """
SELECT s.station_id, coalesce(h.region, v.region) AS region, h.region IS NOT NULL AS is_inside FROM g_stations s
LEFT JOIN (SELECT station_id, min(region) AS region FROM (
   SELECT s.station_id, e.region FROM g_stations s, g_edges e WHERE (e.y1 > s.location_latitude) <> (e.y2 > s.location_latitude)
     AND s.location_longitude < e.x1 + (s.location_latitude - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY 1) h USING (station_id)
LEFT JOIN (SELECT s.station_id, arg_min(e.region, sqrt((e.x1 - s.location_longitude) ** 2 + (e.y1 - s.location_latitude) ** 2)) AS region FROM g_stations s, g_edges e GROUP BY 1) v ON v.station_id = s.station_id"""


@query("point_in_region", "J14 D17", "SELECT * FROM g_region")
def point_in_region(t: Tables):
    return R.region_of(t.stations(), region_table(t))


def _members(t: Tables):
    """Region as the cluster label of every station but each fourth, which stays open for assignment."""
    number = F.substring("station_id", 2, 9).cast("int")
    return R.region_of(t.stations(), region_table(t)).where(number % 4 != 0).select("station_id", F.col("region").alias("cluster"))


@query("cluster_assign", "C07", """
WITH m AS (SELECT station_id, region AS cluster FROM g_region WHERE CAST(substr(station_id, 2) AS INTEGER) % 4 <> 0),
b AS (SELECT i, j, n, r FROM g_corr UNION ALL SELECT j, i, n, r FROM g_corr)
SELECT i AS station_id, arg_max(cluster, (round(r, 12), cluster)) AS cluster, CAST(sum(n) AS BIGINT) AS shared, round(max(r), 6) AS mean_r FROM (
 SELECT b.i, m.cluster, avg(r) AS r, count(*) AS n FROM b JOIN m ON m.station_id = b.j WHERE n >= 20 AND r IS NOT NULL AND b.i NOT IN (SELECT station_id FROM m) GROUP BY 1, 2)
GROUP BY i HAVING sum(n) >= 5""")
def cluster_assign(t: Tables):
    out = R.assign_by_correlation(P.lagged_correlation(t.readings()), _members(t), 20)
    return out.select("station_id", "cluster", "shared", *_r("mean_r"))


@query("rand_index", "C08 O05", """
WITH c AS (SELECT region AS a, CAST(substr(station_id, 2) AS INTEGER) % 3 AS b, count(*) AS n FROM g_region GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS ra,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS rb, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n)
SELECT n, round((ab - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 6) AS ari FROM s""")
def rand_index(t: Tables):
    labels = R.region_of(t.stations(), region_table(t)).withColumn("third", F.substring("station_id", 2, 9).cast("int") % 3)
    return R.rand_index(labels, "region", "third").select("n", *_r("ari"))


C["g_tested"] = """
SELECT CASE WHEN p.dist_km >= 3 AND p.dist_km < 8 THEN '3-8 km' WHEN p.dist_km >= 8 AND p.dist_km < 13 THEN '8-13 km' WHEN p.dist_km >= 13 AND p.dist_km < 20 THEN '13-20 km' END AS band,
       round(c.r, 9) AS r, a.region = b.region AS inside
FROM g_corr c JOIN g_pairs p ON p.s = c.i AND p.j = c.j JOIN g_region a ON a.station_id = c.i JOIN g_region b ON b.station_id = c.j WHERE c.r IS NOT NULL"""


@query("rank_test", "C09 W12", """
SELECT * EXCLUDE (zz, tail), round(zz, 6) AS z, round(CASE WHEN zz >= 0 THEN tail ELSE 1 - tail END, 9) AS p FROM (SELECT *, 0.5 - exp(-zz * zz / 2) / sqrt(2 * pi()) * abs(zz) *
  list_sum(list_transform(range(0, 150), lambda k: exp(k * ln(greatest(zz * zz, 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))) AS tail FROM (
SELECT band, n1 AS n_within, n2 AS n_across, round(within, 6) AS within, round(across, 6) AS across, u, ((u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0))))) AS zz FROM (
 SELECT band, count(*) FILTER (inside) AS n1, count(*) FILTER (NOT inside) AS n2, quantile_cont(r, 0.5) FILTER (inside) AS within, quantile_cont(r, 0.5) FILTER (NOT inside) AS across,
   sum(rk) FILTER (inside) - count(*) FILTER (inside) * (count(*) FILTER (inside) + 1) / 2 AS u, sum(t * t - 1) AS ties FROM (
  SELECT *, rank() OVER (PARTITION BY band ORDER BY r) + (count(*) OVER (PARTITION BY band, r) - 1) / 2 AS rk, count(*) OVER (PARTITION BY band, r) AS t FROM g_tested WHERE band IS NOT NULL) GROUP BY band)))""")
def rank_test(t: Tables):
    members = R.region_of(t.stations(), region_table(t)).select("station_id", F.col("region").alias("cluster"))
    near = P.lagged_correlation(t.readings(), stations=t.stations(), within_km=float(CLUSTER_TEST_BANDS[-1][1]))
    pairs = P.with_distance(near, t.stations()).withColumn("r", F.round("r", 9))
    return R.within_across(pairs, members).select("band", "n_within", "n_across", *_r("within", "across"), "u", *_r("z"), F.round("p", 9).alias("p"))


@query("core_stations", "C04 O05")
def core_stations(t: Tables):
    return R.core_stations(P.lagged_correlation(t.readings()), t.stations(), 178)


@query("region_chain", "C04 C05 C06 C07")
def region_chain(t: Tables):
    """Regions of all stations: clusters of the core stations, the others assigned to them."""
    pairs = stored(P.lagged_correlation(t.readings()))
    return R.region_chain(pairs, t.stations(), 178)


@query("half_agreement", "C08 O05 P31")
def half_agreement(t: Tables):
    """Adjusted Rand index of the clusters of odd and of even days, over the stations that are core stations in both."""
    odd = F.pmod(F.col("slot"), F.lit(16)) < 8
    halves = stored(P.lagged_correlation(t.readings(), 0, F.when(odd, "odd").otherwise("even")))
    return R.rand_index(R.half_clusters(halves, t.stations(), 89), "odd", "even").select("n", *_r("ari"))


@query("station_clusters", "C05 C06")
def station_clusters(t: Tables):
    return R.station_clusters(P.lagged_correlation(t.readings()), t.stations())


# ---- inference ----

REPS = 10_000
C["g_shuffled"] = f"""
SELECT v.rep, v.year, m.month, v.value FROM (
 SELECT rep, year, value, row_number() OVER (PARTITION BY rep, year ORDER BY ('0x' || substr(md5('months|' || rep || '|' || year || '|' || month), 1, 8))::BIGINT, month) AS k
 FROM g_network, (SELECT unnest(range(1, {REPS + 1})) AS rep)) v
JOIN (SELECT year, month, row_number() OVER (PARTITION BY year ORDER BY month) AS k FROM g_network) m ON m.year = v.year AND m.k = v.k"""
_TESTS = f"""SELECT month, (count(*) FILTER (m >= observed) + 1) / (count(*) + 1)::DOUBLE AS p FROM
 (SELECT rep, month, round(avg(value), 9) AS m FROM g_shuffled GROUP BY 1, 2) JOIN (SELECT month, round(avg(value), 9) AS observed FROM g_network GROUP BY 1) USING (month) GROUP BY month"""


@query("permutation_test", "O09 C17", """
WITH o AS (SELECT round(var_samp(m), 9) AS observed FROM (SELECT avg(value) AS m FROM g_network GROUP BY month))
SELECT observed, count(*) AS reps, round((count(*) FILTER (amplitude >= observed) + 1) / (count(*) + 1)::DOUBLE, 6) AS p
FROM (SELECT rep, round(var_samp(m), 9) AS amplitude FROM (SELECT rep, month, avg(value) AS m FROM g_shuffled GROUP BY 1, 2) GROUP BY rep), o GROUP BY observed""")
def permutation_test(t: Tables):
    return I.permutation_test(PP.network(t), REPS).select("observed", "reps", *_r("p"))


@query("holm", "W11 C16", f"""
SELECT month, round(p, 6) AS p, round(least(max((12 - k + 1) * p) OVER (ORDER BY k), 1), 6) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, month) AS k FROM ({_TESTS}))""")
def holm(t: Tables):
    return I.holm(I.month_tests(PP.network(t), REPS)).select("month", *_r("p", "p_holm"))


# fixed values: two-sided 95 % quantiles of Student's t for 1 to 10 degrees of freedom
_T = "[12.7062047362, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818366, 2.4469118511, 2.3646242516, 2.3060041352, 2.2621571628, 2.2281388520]"


@query("mean_interval", "C18", f"""
SELECT month, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round({_T}[n - 1] * sd / sqrt(n), 6) AS half_width FROM (SELECT month, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM g_network GROUP BY month)""")
def mean_interval(t: Tables):
    return I.mean_interval(PP.network(t), "value", "month").select("month", "n", *_r("mean", "sd", "half_width"))


BOOT = 2_000


@query("block_bootstrap", "O11", f"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS pick FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (forecast = 'constant') AS n,
   {", ".join(f"sum(rps) FILTER (forecast = '{n}') AS {n[:4]}" for n in SP.NAMES)} FROM g_rps GROUP BY 1)),
b AS (SELECT rep, {", ".join(f"sum({n[:4]}) / sum(n) AS {n[:4]}" for n in SP.NAMES)} FROM (SELECT rep, ('0x' || substr(md5('boot|' || rep || '|' || i), 1, 8))::BIGINT % (SELECT count(*) FROM d) AS pick
   FROM (SELECT unnest(range(1, {BOOT + 1})) AS rep), (SELECT unnest(range(1, (SELECT count(*) FROM d) + 1)) AS i)) JOIN d USING (pick) GROUP BY rep)
SELECT series, round(avg(x), 6) AS estimate, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(avg(CAST(x < 0 AS INTEGER)), 6) AS below_0 FROM (
 SELECT 'climatology' AS series, clim AS x FROM b UNION ALL SELECT 'constant', cons FROM b UNION ALL SELECT 'persistence', pers FROM b UNION ALL SELECT 'persistence - climatology', pers - clim FROM b) GROUP BY series""")
def block_bootstrap(t: Tables):
    rows = SP.forecasts(t, exceed=True)
    daily = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), *[F.sum(S.rps(n)).alias(n) for n in SP.NAMES])
    return I.block_bootstrap(daily, SP.NAMES, BOOT, [("persistence", "climatology")]).select("series", *_r("estimate", "low", "high", "below_0"))


@query("spearman", "C19 W12 A41", """
WITH c AS (SELECT n.neighbours AS a, r.wet AS b FROM (SELECT st.station_id, count(p.j) AS neighbours FROM g_stations st LEFT JOIN g_pairs p ON p.s = st.station_id AND p.dist_km > 0 AND p.dist_km <= 10 GROUP BY 1) n
 JOIN (SELECT station_id, CAST(count(*) FILTER (value > 0) AS DOUBLE) / count(*) AS wet FROM g_readings GROUP BY 1) r USING (station_id))
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM c)""")
def spearman(t: Tables):
    wet = t.readings().groupBy("station_id").agg((F.count_if(F.col("value") > 0) / F.count("*")).alias("wet"))
    return I.spearman(N.neighbour_counts(t.stations()).join(wet, "station_id"), "neighbours", "wet").select("n", *_r("rho"))


@query("harmonic_fit", "C13 C14")
def harmonic_fit(t: Tables):
    return I.harmonic_fit(PP.network(t), "value", (F.col("month") - 0.5) / 12)


@query("hourly_harmonics", "C13")
def hourly_harmonics(t: Tables):
    rows = PP.P.hourly_by_year(PP.hourly(t), "ts", 1)
    return I.harmonic_fit(rows, "rate", (F.col("hour") + 0.5) / 24)


@query("harmonic_f", "C14")
def harmonic_f(t: Tables):
    return I.nested_f(I.harmonic_fit(PP.network(t), "value", (F.col("month") - 0.5) / 12, (1, 2)), 1, 2)


@query("month_f", "C14")
def month_f(t: Tables):
    """Do twelve month means explain more than two cos/sin pairs?"""
    monthly = PP.network(t)
    return I.level_f(I.harmonic_fit(monthly, "value", (F.col("month") - 0.5) / 12, (2,)), monthly, "value", "month", 2)


def _levels(t: Tables):
    span = PP.network(t).agg(F.min("year"), F.max("year")).first()
    return {"month": list(range(1, 13)), "year": list(range(span[0], span[1] + 1))}


@query("two_way_effects", "C15")
def two_way_effects(t: Tables):
    return I.two_way_effects(PP.network(t), "value", "month", "year", _levels(t))


@query("level_effects", "C16 W11")
def level_effects(t: Tables):
    return I.level_effects(PP.network(t), "value", "year", "month", _levels(t))
