"""Named queries: coverage, seasonal and daily patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugegrid.functions.clock import clock_text, time_of
from gaugegrid.operators import neighbours as N
from gaugegrid.operators import patterns as P
from gaugegrid.operators.grid import block_sum
from gaugegrid.plans import sqltext
from gaugegrid.plans.registry import query
from gaugegrid.sources.fixtures import GRID, Tables

C = sqltext.CTES
C["g_months"] = """
SELECT station_id, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, count(*) AS observations,
       CAST(day(last_day(min(day))) AS INTEGER) AS expected, sum(value) AS rain_mm,
       count(*) / day(last_day(min(day)))::DOUBLE AS coverage, sum(value) / count(*) AS rate
FROM g_daily GROUP BY 1, 2, 3"""
C["g_years"] = """
SELECT station_id, CAST(year(day) AS INTEGER) AS year, count(*) AS observations,
       CAST(date_diff('day', make_date(year(min(day)), 1, 1), make_date(year(min(day)) + 1, 1, 1)) AS INTEGER) AS expected, sum(value) AS rain_mm,
       count(*) / date_diff('day', make_date(year(min(day)), 1, 1), make_date(year(min(day)) + 1, 1, 1))::DOUBLE AS coverage, sum(value) / count(*) AS rate
FROM g_daily GROUP BY 1, 2"""
C["g_network"] = "SELECT year, month, avg(rate) AS value, count(*) AS stations FROM g_months WHERE coverage >= 0.9 GROUP BY 1, 2"
C["g_calendar"] = """
SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month
FROM (SELECT unnest(generate_series((SELECT min(make_date(year, month, 1)) FROM g_months)::TIMESTAMP, (SELECT max(make_date(year, month, 1)) FROM g_months)::TIMESTAMP, INTERVAL 1 MONTH)) AS m)"""
C["g_hours"] = "SELECT station_id, hour(ts) AS hr, month(ts) AS mo, year(ts) AS yr, greatest(value - 150, 0) AS value FROM g_events"


def months(t: Tables):
    return P.station_periods(t.daily(), "day", "month", 1)


def years(t: Tables):
    return P.station_periods(t.daily(), "day", "year", 1)


def network(t: Tables):
    return P.network_monthly(months(t))


def hourly(t: Tables):
    return t.gauge_events().select("station_id", "ts", F.greatest(F.col("value") - 150, F.lit(0.0)).alias("value"))


def _r(*names: str):
    return [F.round(c, 6).alias(c) for c in names]


@query("station_period_rate", "A29", """
SELECT station_id, year, month, observations, expected, rain_mm, round(coverage, 6) AS coverage, round(rate, 6) AS rate FROM g_months""")
def station_period_rate(t: Tables):
    return months(t).select("station_id", "year", "month", "observations", "expected", "rain_mm", *_r("coverage", "rate"))


@query("station_year_rate", "A29", """
SELECT station_id, year, observations, expected, rain_mm, round(coverage, 6) AS coverage, round(rate, 6) AS rate FROM g_years""")
def station_year_rate(t: Tables):
    return years(t).select("station_id", "year", "observations", "expected", "rain_mm", *_r("coverage", "rate"))


@query("network_monthly", "A30", "SELECT year, month, round(value, 6) AS value, stations FROM g_network")
def network_monthly(t: Tables):
    return network(t).select("year", "month", *_r("value"), "stations")


@query("full_calendar", "R07", """
SELECT c.year, c.month, round(n.value, 6) AS value FROM g_calendar c LEFT JOIN g_network n USING (year, month)
WHERE make_date(c.year, c.month, 1) BETWEEN (SELECT min(make_date(year, month, 1)) FROM g_network) AND (SELECT max(make_date(year, month, 1)) FROM g_network)""")
def full_calendar(t: Tables):
    return P.full_calendar(network(t)).select("year", "month", *_r("value"))


@query("climatology_table", "R06", "SELECT year, " + ", ".join(
    f"round(max(CASE WHEN month = {m} THEN value END), 6) AS m{m}" for m in range(1, 13)) + " FROM g_network GROUP BY year")
def climatology_table(t: Tables):
    return P.month_table(network(t)).select("year", *_r(*[f"m{m}" for m in range(1, 13)]))


@query("station_month_table", "R06 A35", "SELECT station_id, year, " + ", ".join(
    f"round(max(CASE WHEN month = {m} THEN coverage END), 6) AS m{m}" for m in range(1, 13)) + " FROM g_months GROUP BY station_id, year")
def station_month_table(t: Tables):
    """Coverage with a row per station and year, so that the columns do not grow with the record."""
    return P.month_table(months(t), "coverage", "station_id", "year").select("station_id", "year", *_r(*[f"m{m}" for m in range(1, 13)]))


@query("cutoff_sensitivity", "A31", """
SELECT year, cutoff, round(rate, 6) AS rate, stations, round(CASE WHEN k = 3 THEN hi - lo END, 6) AS spread FROM
(SELECT *, max(rate) OVER (PARTITION BY year) AS hi, min(rate) OVER (PARTITION BY year) AS lo, count(*) OVER (PARTITION BY year) AS k FROM
 (SELECT year, cutoff, avg(rate) AS rate, count(*) AS stations FROM g_years, (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) c(cutoff) WHERE coverage >= cutoff GROUP BY 1, 2))""")
def cutoff_sensitivity(t: Tables):
    return P.cutoff_sensitivity(years(t)).select("year", "cutoff", "stations", *_r("rate", "spread"))


_RELATIVE = "SELECT station_id, avg(rate / value) AS relative, count(*) AS months FROM g_months JOIN g_network USING (year, month) WHERE coverage >= 0.9 GROUP BY 1 HAVING count(*) >= 12"


@query("relative_wetness", "A32 J11", f"SELECT station_id, round(relative, 6) AS relative, months FROM ({_RELATIVE})")
def relative_wetness(t: Tables):
    return P.relative_wetness(months(t)).select("station_id", *_r("relative"), "months")


@query("wettest_driest", "A32 O02", f"""
SELECT arg_max(station_id, relative) AS largest, round(max(relative), 6) AS largest_value, arg_min(station_id, relative) AS smallest, round(min(relative), 6) AS smallest_value FROM ({_RELATIVE})""")
def wettest_driest(t: Tables):
    return P.extremes_of(P.relative_wetness(months(t)), "relative").select("largest", *_r("largest_value"), "smallest", *_r("smallest_value"))


_PROFILE = """SELECT CAST(hr AS INTEGER) AS hour, count(*) AS stations, avg(rain / n) AS rate, avg(wet / n::DOUBLE) AS frequency, avg(rain / nullif(wet, 0)) AS intensity
 FROM (SELECT station_id, hr, sum(value) AS rain, count(*) FILTER (value > 0) AS wet, count(*) AS n FROM g_hours GROUP BY 1, 2) WHERE n >= 5 GROUP BY 1"""


@query("diurnal_profile", "A33", f"""
SELECT hour, stations, round(rate, 6) AS rate, round(frequency, 6) AS frequency, round(intensity, 6) AS intensity, round(rate / sum(rate) OVER (), 6) AS share FROM ({_PROFILE})""")
def diurnal_profile(t: Tables):
    return P.diurnal_profile(hourly(t), "ts", 5).select("hour", "stations", *_r("rate", "frequency", "intensity", "share"))


@query("afternoon_share", "A33", f"SELECT round(sum(rate) FILTER (hour BETWEEN 13 AND 18) / sum(rate), 6) AS share FROM ({_PROFILE})")
def afternoon_share(t: Tables):
    return P.hour_span_share(P.diurnal_profile(hourly(t), "ts", 5), 13, 18).select(*_r("share"))


@query("peak_hour", "A33 R06 P27", """
SELECT year, peak_hour, lpad(CAST(peak_hour AS VARCHAR), 2, '0') || ':30' AS clock FROM (SELECT CAST(yr AS INTEGER) AS year, CAST(arg_max(hr, rate) AS INTEGER) AS peak_hour FROM (
  SELECT yr, hr, avg(rain / n) AS rate FROM (SELECT station_id, yr, hr, sum(value) AS rain, count(*) AS n FROM g_hours GROUP BY 1, 2, 3) WHERE n >= 5 GROUP BY 1, 2) GROUP BY yr)""")
def peak_hour(t: Tables):
    peaks = P.peak_hours(P.hourly_by_year(hourly(t), "ts", 5))
    return peaks.withColumn("clock", clock_text(F.col("peak_hour") + 0.5))


@query("hour_year_table", "R06 A33", "SELECT CAST(yr AS INTEGER) AS year, " + ", ".join(
    f"round(max(CASE WHEN hr = {h} THEN rate END), 6) AS h{h}" for h in range(24)) + """ FROM (
  SELECT yr, hr, avg(rain / n) AS rate FROM (SELECT station_id, yr, hr, sum(value) AS rain, count(*) AS n FROM g_hours GROUP BY 1, 2, 3) WHERE n >= 5 GROUP BY 1, 2) GROUP BY yr""")
def hour_year_table(t: Tables):
    return P.hour_table(P.hourly_by_year(hourly(t), "ts", 5)).select("year", *_r(*[f"h{h}" for h in range(24)]))


_MONTH_HOUR = """SELECT month, hour, rate, rate / sum(rate) OVER (PARTITION BY month) AS share FROM (SELECT CAST(mo AS INTEGER) AS month, CAST(hr AS INTEGER) AS hour, avg(rain / n) AS rate FROM
 (SELECT station_id, mo, hr, sum(value) AS rain, count(*) AS n FROM g_hours GROUP BY 1, 2, 3) WHERE n >= 5 GROUP BY 1, 2)"""


@query("month_hour", "A34", f"SELECT month, hour, round(rate, 6) AS rate, round(share, 6) AS share FROM ({_MONTH_HOUR})")
def month_hour(t: Tables):
    return P.month_hour(hourly(t), "ts", 5).select("month", "hour", *_r("rate", "share"))


@query("day_part_shares", "A34", f"""
SELECT month, round(sum(CASE WHEN hour BETWEEN 4 AND 9 THEN share ELSE 0 END), 6) AS morning, round(sum(CASE WHEN hour BETWEEN 13 AND 18 THEN share ELSE 0 END), 6) AS afternoon FROM ({_MONTH_HOUR}) GROUP BY month""")
def day_part_shares(t: Tables):
    return P.day_part_shares(P.month_hour(hourly(t), "ts", 5)).select("month", *_r("morning", "afternoon"))


@query("monthly_anomaly", "P28", "SELECT year, month, round(value, 6) AS value, round(value - avg(value) OVER (PARTITION BY month), 6) AS anomaly FROM g_network")
def monthly_anomaly(t: Tables):
    return P.monthly_anomaly(network(t)).select("year", "month", *_r("value", "anomaly"))


@query("coverage_by_month", "A35", "SELECT year, month, count(*) FILTER (coverage >= 0.9) AS qualifying, round(quantile_cont(coverage, 0.5), 6) AS median_coverage FROM g_months GROUP BY 1, 2")
def coverage_by_month(t: Tables):
    return P.coverage_by_month(months(t)).select("year", "month", "qualifying", *_r("median_coverage"))


@query("first_active_month", "A35 W13", """
SELECT station_id, first_month, CAST(row_number() OVER (ORDER BY first_month, station_id) AS INTEGER) AS position FROM (SELECT station_id, min(make_date(year, month, 1)) AS first_month FROM g_months GROUP BY 1)""")
def first_active_month(t: Tables):
    return P.stations_by_first_month(months(t))


@query("coverage_islands", "W10 R07", """
SELECT min(d) AS first_month, max(d) AS last_month, count(*) AS months FROM (SELECT d, i - row_number() OVER (ORDER BY i) AS island FROM
 (SELECT make_date(c.year, c.month, 1) AS d, c.year * 12 + c.month AS i FROM g_calendar c LEFT JOIN (SELECT year, month, count(*) FILTER (coverage >= 0.97) AS q FROM g_months GROUP BY 1, 2) m USING (year, month) WHERE coalesce(q, 0) = 0))
GROUP BY island""")
def coverage_islands(t: Tables):
    return P.coverage_islands(P.coverage_by_month(months(t), 0.97))


@query("wet_day_transition", "A36 W09", """
WITH d AS (SELECT station_id, day, CAST(value >= 60 - 1e-9 AS INTEGER) AS wet FROM g_daily),
p AS (SELECT month(a.day) AS m, a.wet AS t, b.wet AS y FROM d a JOIN d b ON a.station_id = b.station_id AND b.day = a.day - 1)
SELECT CAST(m AS INTEGER) AS month, count(*) AS n, round(avg(t), 6) AS p_wet, round(avg(CASE WHEN y = 1 THEN t END), 6) AS p_wet_after_wet, round(avg(CASE WHEN y = 0 THEN t END), 6) AS p_wet_after_dry FROM p GROUP BY m
UNION ALL SELECT 0, count(*), round(avg(t), 6), round(avg(CASE WHEN y = 1 THEN t END), 6), round(avg(CASE WHEN y = 0 THEN t END), 6) FROM p""")
def wet_day_transition(t: Tables):
    days = t.daily().select("station_id", "value", F.month("day").alias("month"), F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day_no"))
    out = P.wet_day_transition(P.wet_day_pairs(days, 60.0))
    return out.select("month", "n", *_r("p_wet", "p_wet_after_wet", "p_wet_after_dry"))


@query("wet_day_persistence", "A36 R09 W09", f"""
WITH c AS (SELECT station_id, slot // {GRID.per_day} AS d, CAST(round(sum(value), 1) >= 1 - 1e-9 AS INTEGER) AS wet FROM g_readings GROUP BY 1, 2 HAVING count(*) = {GRID.per_day}),
p AS (SELECT month(TIMESTAMP '2024-01-01' + to_days(CAST(a.d AS INTEGER))) AS m, a.wet AS t, b.wet AS y FROM c a JOIN c b ON a.station_id = b.station_id AND b.d = a.d - 1),
g AS (SELECT m, round(avg(CASE WHEN y = 1 THEN t END) - avg(CASE WHEN y = 0 THEN t END), 9) AS gap FROM (SELECT * FROM p UNION ALL SELECT 0, t, y FROM p) GROUP BY m)
SELECT round(max(gap) FILTER (m = 0), 6) AS gap, CAST(arg_max(m, (gap, -m)) FILTER (m > 0 AND gap IS NOT NULL) AS INTEGER) AS widest_month, round(max(gap) FILTER (m > 0), 6) AS widest,
  CAST(arg_min(m, (gap, m)) FILTER (m > 0 AND gap IS NOT NULL) AS INTEGER) AS narrowest_month, round(min(gap) FILTER (m > 0), 6) AS narrowest FROM g""")
def wet_day_persistence(t: Tables):
    """Days whose every slot is there, and whose day before is complete too."""
    complete = block_sum(t.readings(), GRID.per_day).select(
        "station_id", F.col("total").alias("value"), F.col("block").alias("day_no"), F.month(time_of(F.col("block") * GRID.per_day, GRID)).alias("month")
    )
    gaps = P.persistence_gaps(P.wet_day_transition(P.wet_day_pairs(complete)))
    return gaps.select("widest_month", "narrowest_month", *_r("gap", "widest", "narrowest"))


@query("extremes", "A45 O01", "SELECT station_id, slot, value FROM g_readings ORDER BY value DESC, station_id, slot LIMIT 10")
def extremes(t: Tables):
    return P.extremes(t.readings(), 10, "station_id", "slot").select("station_id", "slot", "value")


@query("extreme_days", "A45 R09", """
SELECT station_id, CAST(slot // 8 AS INTEGER) AS block, round(sum(value), 1) AS value FROM g_readings GROUP BY 1, 2 HAVING count(*) = 8 ORDER BY value DESC, station_id, block LIMIT 10""")
def extreme_days(t: Tables):
    return P.extremes(block_sum(t.readings(), 8).withColumnRenamed("total", "value"), 10, "station_id", "block")


@query("neighbour_witness", "A44 J13 R08", """
WITH nb AS (SELECT 'S003' AS station_id, 0.0::DOUBLE AS dist_km UNION ALL (SELECT j, dist_km FROM g_pairs WHERE s = 'S003' AND dist_km > 0 ORDER BY dist_km, j LIMIT 3))
SELECT day, station_id, round(dist_km, 6) AS dist_km, round(sum(value), 1) AS total, count(*) FILTER (value > 0) AS wet, count(*) AS n
FROM (SELECT station_id, CAST(TIMESTAMP '2024-01-01' + to_seconds(CAST(slot AS BIGINT) * 10800) AS DATE) AS day, value FROM g_readings) JOIN nb USING (station_id)
WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY ALL""")
def neighbour_witness(t: Tables):
    days = t.readings().select("station_id", F.to_date(time_of("slot", GRID)).alias("day"), "value")
    rows = P.neighbour_witness(days, N.station_pairs(t.stations(), 50.0), "S003", "2024-01-08", "2024-01-14")
    return rows.select("day", "station_id", *_r("dist_km"), F.round("total", 1).alias("total"), "wet", "n")
