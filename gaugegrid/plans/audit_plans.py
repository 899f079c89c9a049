"""Named queries: audit, alignment and grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugegrid.functions.clock import time_of, wall, year_month
from gaugegrid.operators import align as AL
from gaugegrid.operators import audit as A
from gaugegrid.operators import grid as G
from gaugegrid.plans import sqltext
from gaugegrid.plans.registry import query
from gaugegrid.sources.fixtures import FAULTS, GRID, Tables


QUALITY = """
SELECT source_year, count(*) AS rows, count(DISTINCT station_id) AS stations, min("timestamp") AS first_time, max("timestamp") AS last_time,
  count(*) - count("timestamp") AS missing_timestamp, count(*) - count(station_id) AS missing_station, count(*) - count(reading_value) AS missing_rainfall,
  count(*) - count(location_longitude) AS missing_longitude, count(*) - count(location_latitude) AS missing_latitude, count(*) - count(date) AS missing_date,
  count(*) - count(update_timestamp) AS missing_update_time, count(*) - count(reading_update_timestamp) AS missing_reading_update_time,
  count(*) - count(station_name) AS missing_station_name, count(*) - count(station_device_id) AS missing_device_id,
  count(*) - count(reading_unit) AS missing_unit, count(*) - count(reading_type) AS missing_reading_type,
  min(reading_value) AS minimum_rainfall, max(reading_value) AS maximum_rainfall,
  count(*) FILTER (reading_value < 0) AS negative_values, count(*) FILTER (NOT isfinite(reading_value)) AS nonfinite_rainfall,
  count(*) FILTER (trim(station_id) = '') AS blank_station, count(*) FILTER (trim(station_name) = '') AS blank_station_name,
  count(*) FILTER (trim(station_device_id) = '') AS blank_device_id,
  count(DISTINCT reading_unit) AS unit_types, count(DISTINCT reading_type) AS reading_types,
  count(*) FILTER (date <> CAST("timestamp" AS DATE)) AS date_mismatch, count(*) FILTER (year("timestamp") <> source_year) AS year_mismatch,
  count(*) FILTER (d < 0) AS update_before_observation, count(*) FILTER (reading_update_timestamp < "timestamp") AS reading_update_before_observation,
  count(*) FILTER (update_timestamp <> reading_update_timestamp) AS different_update_times,
  min(d) AS minimum_update_delay_seconds, quantile_disc(d, 0.5) AS median_update_delay_seconds, max(d) AS maximum_update_delay_seconds
FROM (SELECT *, CAST(floor(epoch(update_timestamp)) - floor(epoch("timestamp")) AS BIGINT) AS d FROM g_obs) GROUP BY source_year"""


@query("yearly_quality", "A01 P01 P30", QUALITY)
def yearly_quality(t: Tables):
    return A.yearly_quality(t.observations())


@query("daily_quality", "A01 P01 P30", QUALITY.replace("SELECT source_year, count(*) AS rows", "SELECT date, count(*) AS rows").replace("GROUP BY source_year", "GROUP BY date"))
def daily_quality(t: Tables):
    return A.yearly_quality(t.observations(), "date")


DUPLICATES = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


@query("duplicate_summary", "A02", f"SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM ({DUPLICATES})")
def duplicate_summary(t: Tables):
    return A.duplicate_summary(t.table("lineitem"), "l_orderkey", "l_linenumber")


@query("duplicate_examples", "A02 O01", f"{DUPLICATES} ORDER BY 1, 2 LIMIT 20")
def duplicate_examples(t: Tables):
    return A.duplicate_examples(t.table("lineitem"), "l_orderkey", "l_linenumber")


@query("category_inventory", "A03", """
SELECT source_year, list_sort(list(DISTINCT reading_unit)) AS units, list_sort(list(DISTINCT reading_type)) AS types FROM g_obs GROUP BY source_year""")
def category_inventory(t: Tables):
    return A.category_inventory(t.observations())


@query("identity_versions", "A04", """
SELECT station_id, count(DISTINCT station_name) AS name_versions, count(DISTINCT station_device_id) AS device_versions,
       count(DISTINCT (location_longitude, location_latitude)) AS location_versions,
       arg_max(station_name, ("timestamp", station_name)) AS canonical_station_name, max("timestamp") AS latest_observation FROM g_obs GROUP BY station_id""")
def identity_versions(t: Tables):
    return A.identity_versions(t.observations())


@query("first_times", "A05 O01 O03", 'SELECT DISTINCT "timestamp" FROM g_obs ORDER BY 1 LIMIT 15')
def first_times(t: Tables):
    return A.first_times(t.observations())


SPANS = """
SELECT source_year, station_id, count(*) AS records, min("timestamp") AS first_time, max("timestamp") AS last_time,
       CAST(floor((floor(epoch(max("timestamp"))) - floor(epoch(min("timestamp")))) / 10800) + 1 AS BIGINT) AS expected_records_in_span,
       round(count(*) / (floor((floor(epoch(max("timestamp"))) - floor(epoch(min("timestamp")))) / 10800) + 1), 4) AS coverage_ratio_in_span
FROM g_obs GROUP BY source_year, station_id"""


@query("span_coverage", "A06", SPANS)
def span_coverage(t: Tables):
    return A.span_coverage(t.observations(), GRID.width, "source_year", "station_id")


@query("coverage_by_year", "A07", f"""
SELECT source_year, count(*) AS stations, round(avg(r), 4) AS average_coverage, round(quantile_disc(r, 0.5), 4) AS median_coverage,
       count(*) FILTER (r < 0.8) AS stations_below_80pct, count(*) FILTER (r < 0.5) AS stations_below_50pct
FROM (SELECT source_year, coverage_ratio_in_span AS r FROM ({SPANS})) GROUP BY source_year""")
def coverage_by_year(t: Tables):
    return A.coverage_by_year(A.span_coverage(t.observations(), GRID.width, "source_year", "station_id"))


@query("latest_attributes", "A08 D07", """
SELECT station_id, arg_max(location_longitude, ("timestamp", location_longitude, location_latitude, station_name)) AS location_longitude,
       arg_max(location_latitude, ("timestamp", location_longitude, location_latitude, station_name)) AS location_latitude,
       arg_max(station_name, ("timestamp", location_longitude, location_latitude, station_name)) AS station_name, min("timestamp") AS first_time, max("timestamp") AS last_time, count(*) AS observations
FROM g_obs GROUP BY station_id""")
def latest_attributes(t: Tables):
    return A.latest_attributes(t.observations())


@query("report_delay", "P01", """
SELECT station_device_id, count(*) AS n, min(d) AS min_delay, round(avg(d), 4) AS mean_delay, max(d) AS max_delay, count(*) FILTER (r > d) AS reading_later
FROM (SELECT station_device_id, CAST(floor(epoch(update_timestamp)) - floor(epoch("timestamp")) AS BIGINT) AS d,
             CAST(floor(epoch(reading_update_timestamp)) - floor(epoch("timestamp")) AS BIGINT) AS r FROM g_obs) GROUP BY 1""")
def report_delay(t: Tables):
    return A.report_delay(t.observations(), "station_device_id")


ALIGNED = """
SELECT * FROM (SELECT *, max(CAST("timestamp" = time_5min AS INTEGER)) OVER (PARTITION BY station_id, time_5min) AS any_exact
  FROM (SELECT *, CASE WHEN second("timestamp") = 59 THEN "timestamp" + INTERVAL 1 SECOND ELSE "timestamp" END AS time_5min FROM g_legacy))
WHERE "timestamp" = time_5min OR any_exact = 0"""


@query("align_dedup", "P02 P03 J01 D03", f'SELECT station_id, "timestamp", time_5min, reading_value, event_id FROM ({ALIGNED})')
def align_dedup(t: Tables):
    return AL.align(t.legacy_observations())


@query("align_overlap", "J01 S05", f"""
SELECT station_id, "timestamp", time_5min, reading_value, event_id FROM ({ALIGNED.replace('OR any_exact = 0', 'OR any_exact = 0 OR time_5min > TIMESTAMP ' + repr('2024-01-15'))})""")
def align_overlap(t: Tables):
    change = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return AL.align(t.legacy_observations(), overlap=F.col("time_5min") <= change)


@query("stamp_forms", "P02", """
SELECT CASE WHEN second("timestamp") = 0 AND minute("timestamp") % 5 = 0 THEN 'exact'
            WHEN second("timestamp") = 59 AND minute("timestamp") % 5 = 4 THEN 'legacy' ELSE 'other' END AS form, count(*) AS n
FROM g_legacy GROUP BY 1""")
def stamp_forms(t: Tables):
    return AL.stamp_forms(t.legacy_observations())


@query("off_grid", "P06", """SELECT count(*) FILTER (CAST(epoch("timestamp") AS BIGINT) % 300 <> 0) AS off_grid FROM g_legacy""")
def off_grid(t: Tables):
    return AL.off_mark(t.legacy_observations(), "timestamp")


@query("reconcile_counts", "S08", f"""
SELECT coalesce(a.station_id, e.station_id) AS station_id, actual, expected, actual IS NOT DISTINCT FROM expected AS matches
FROM (SELECT station_id, count(*) AS actual FROM ({ALIGNED}) GROUP BY 1) a
FULL JOIN (SELECT station_id, count(*) AS expected FROM g_legacy GROUP BY 1) e ON a.station_id = e.station_id""")
def reconcile_counts(t: Tables):
    raw = t.legacy_observations()
    expected = raw.groupBy("station_id").agg(F.count("*").alias("expected"))
    return A.reconcile_counts(AL.align(raw), expected, "station_id")


@query("slots", "P04 P05 P07 D04", """
SELECT event_id, slot, TIMESTAMP '2024-01-01' + to_seconds(CAST(slot AS BIGINT) * 10800) AS slot_time, strftime(ts, '%Y-%m') AS ym,
       CAST(hour(ts) AS INTEGER) AS hour, CAST(ts AS DATE) AS day FROM g_events""")
def slots(t: Tables):
    return t.gauge_events().select(
        "event_id", "slot", time_of("slot", GRID).alias("slot_time"), year_month("ts").alias("ym"),
        F.hour("ts").alias("hour"), F.to_date("ts").alias("day"),
    )


IDS = [f"S{k:03d}" for k in range(20)]  # the stations that the sf0.01 tables hold


def station_ids(t: Tables, most: int = 10_000) -> list[str]:
    """The ids of the station dimension. A pivot turns them into columns, so too many are an error, never cut off."""
    ids = [r[0] for r in t.gauge_events().select("station_id").distinct().orderBy("station_id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"a matrix is limited to {most} stations")
    return ids


@query("pivot_matrix", "R01 S09 D05", "SELECT slot, " + ", ".join(
    f"max(CASE WHEN station_id = '{i}' THEN value END) AS {i}" for i in IDS) + " FROM g_readings GROUP BY slot")
def pivot_matrix(t: Tables):
    return G.to_matrix(t.readings(), station_ids(t))


@query("measures_matrix", "R04", "SELECT slot, " + ", ".join(
    f"max(CASE WHEN station_id = '{i}' THEN r{m} END) AS {i}_r{m}" for i in IDS for m in (15, 30)) + " FROM g_rain GROUP BY slot")
def measures_matrix(t: Tables):
    return G.measures_matrix(t.trailing(), station_ids(t), {"r15": "t1_rain_15", "r30": "t1_rain_30"})


@query("unpivot_grid", "R03 D06", """
SELECT u.slot, s.station_id, r.value FROM (SELECT DISTINCT slot FROM g_readings) u CROSS JOIN (SELECT station_id FROM g_stations) s
LEFT JOIN g_readings r ON r.slot = u.slot AND r.station_id = s.station_id""")
def unpivot_grid(t: Tables):
    ids = station_ids(t)
    return G.to_long(G.to_matrix(t.readings(), ids), ids)


@query("dense_grid", "R02 J02", """
SELECT s.station_id, CAST(u.slot AS INTEGER) AS slot, r.value FROM (SELECT unnest(range((SELECT min(slot) FROM g_readings), (SELECT max(slot) FROM g_readings) + 1)) AS slot) u CROSS JOIN g_stations s
LEFT JOIN g_readings r ON r.slot = u.slot AND r.station_id = s.station_id""")
def dense_grid(t: Tables):
    return G.dense_grid(t.readings(), t.stations())


@query("block_sum", "R09", """
SELECT station_id, CAST(slot // 4 AS INTEGER) AS block, round(sum(value), 1) AS total FROM g_readings GROUP BY 1, 2 HAVING count(*) = 4""")
def block_sum(t: Tables):
    return G.block_sum(t.readings(), 4)


@query("network_share", "A09 J04", "SELECT slot, count(*) AS stations, round(avg(CAST(value > 0 AS INTEGER)), 6) AS p_net FROM g_readings GROUP BY slot")
def network_share(t: Tables):
    return G.network_share(t.readings()).withColumn("p_net", F.round("p_net", 6))


def _stuck_sql(period: str, least: float) -> str:
    return f"""SELECT station_id, {period} AS ym, count(*) AS n, CAST(sum(CAST(value > 0 AS INTEGER)) AS DOUBLE) AS observed, sum(p_net) AS expected,
       sum(CAST(value > 0 AS INTEGER)) = 0 AND sum(p_net) >= {least} AS stuck
FROM (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(CAST(slot AS BIGINT) * 10800) AS ts FROM g_readings)
JOIN (SELECT slot, avg(CAST(value > 0 AS INTEGER)) AS p_net FROM g_readings GROUP BY slot) USING (slot) GROUP BY 1, 2"""


@query("stuck_periods", "A10 D09", "SELECT station_id, ym, n, observed, round(expected, 6) AS expected, stuck FROM (" + _stuck_sql("strftime(ts, '%Y-%m')", 30) + ")")
def stuck_periods(t: Tables):
    month = year_month(time_of("slot", GRID))
    return G.stuck_periods(t.readings(), month).withColumn("expected", F.round("expected", 6))


@query("stuck_days", "A10 J10", "SELECT station_id, ym, n, observed, round(expected, 6) AS expected, stuck FROM (" + _stuck_sql("strftime(ts, '%Y-%m-%d')", 1.1) + ") WHERE stuck")
def stuck_days(t: Tables):
    day = F.substring(wall(time_of("slot", GRID)).cast("string"), 1, 10)
    return G.stuck_periods(t.readings(), day, 1.1).where("stuck").withColumn("expected", F.round("expected", 6))


@query("mask_stuck", "J03", """
WITH f AS (""" + _stuck_sql("strftime(ts, '%Y-%m-%d')", 1.1) + """)
SELECT r.station_id, r.slot, CASE WHEN f.stuck THEN NULL ELSE r.value END AS value FROM g_readings r
LEFT JOIN f ON f.station_id = r.station_id AND f.ym = strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(r.slot AS BIGINT) * 10800), '%Y-%m-%d') AND f.stuck""")
def mask_stuck(t: Tables):
    day = F.substring(wall(time_of("slot", GRID)).cast("string"), 1, 10)
    return G.mask_periods(t.readings(), G.stuck_periods(t.readings(), day, 1.1).where("stuck"), day)


def fault_table(t: Tables):
    rows = t.spark.createDataFrame(list(FAULTS), "station_id string, start_time string, end_time string")
    return rows.select("station_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")])


sqltext.CTES["g_clean"] = """
SELECT r.* FROM g_readings r WHERE NOT EXISTS (SELECT 1 FROM g_faults f WHERE f.station_id = r.station_id
   AND TIMESTAMP '2024-01-01' + to_seconds(CAST(r.slot AS BIGINT) * 10800) >= f.start_time
   AND TIMESTAMP '2024-01-01' + to_seconds(CAST(r.slot AS BIGINT) * 10800) < f.end_time)
 AND (station_id, strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(r.slot AS BIGINT) * 10800), '%Y-%m')) NOT IN (SELECT station_id, ym FROM (""" + _stuck_sql("strftime(ts, '%Y-%m')", 30) + """) WHERE stuck)"""
sqltext.CTES["g_clean_labels"] = sqltext.CTES["g_labels"].replace("g_readings", "g_clean")


@query("mask_faults", "P13 D08", """
SELECT r.station_id, r.slot, CASE WHEN EXISTS (SELECT 1 FROM g_faults f WHERE f.station_id = r.station_id
   AND TIMESTAMP '2024-01-01' + to_seconds(CAST(r.slot AS BIGINT) * 10800) >= f.start_time
   AND TIMESTAMP '2024-01-01' + to_seconds(CAST(r.slot AS BIGINT) * 10800) < f.end_time) THEN NULL ELSE r.value END AS value
FROM g_readings r""")
def mask_faults(t: Tables):
    return G.mask_intervals(t.readings(), fault_table(t), GRID)


@query("clean_label_rows", "J03 P13 W01 W02 D10", "SELECT * FROM g_clean_labels")
def clean_label_rows(t: Tables):
    from gaugegrid.operators.labels import label_rows

    return label_rows(G.clean_readings(t.readings(), fault_table(t), GRID), GRID)


@query("label_checks", "J10", """
SELECT count(*) FILTER (y_mm IS NULL OR label IS NULL) AS null_rows, count(*) FILTER (label = 0 AND y_mm >= 0.05 OR label > 0 AND y_mm < 0.05 OR label = 8 AND y_mm < 20.05) AS outside_class,
  count(*) FILTER ((past30_mm IS NULL) <> (regime = 'unknown')) AS regime_conflicts, count(*) - count(DISTINCT (station_id, slot)) AS repeated_keys, 0::BIGINT AS in_flagged_months FROM g_clean_labels""")
def label_checks(t: Tables):
    from gaugegrid.operators.labels import label_rows, label_violations

    month = year_month(time_of("slot", GRID))
    flagged = G.stuck_periods(t.readings(), month).where("stuck")
    clean = G.clean_readings(t.readings(), fault_table(t), GRID)
    return label_violations(label_rows(clean, GRID), flagged)
