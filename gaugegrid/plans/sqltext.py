"""Common table expressions shared by the reference SQL of the queries.

``render`` puts the WITH clause in front of a SELECT: it looks for the names of the common tables in the text
and adds those and the ones they build on.
"""

from __future__ import annotations

import re

from gaugegrid.settings import (
    CHANGE_LAG_SLOTS,
    CHANGED_COLUMNS,
    CLASS_FLOORS,
    EDGES,
    LAT_CENTRE,
    LON_CENTRE,
    MOTION,
    T2_COLUMNS,
    TRAILING_SLOTS,
    UPSTREAM_CUT_KM,
    UPSTREAM_MINUTES,
    UPSTREAM_SIGMA_KM,
)
from gaugegrid.sources.fixtures import FAULTS, TEST_FROM, VALIDATION_FROM

CTES: dict[str, str] = {}


def render(select: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(select)
    clauses = [f"{name} AS MATERIALIZED ({body})" for name, body in CTES.items() if name in needed]
    if not clauses:
        return select
    own = re.match(r"\s*WITH\s+", select)
    if own:
        return "WITH " + ",\n".join(clauses) + ",\n" + select[own.end():]
    return "WITH " + ",\n".join(clauses) + "\n" + select


def season_sql(month: str) -> str:
    return f"CASE WHEN {month} IN (12,1,2,3) THEN 0 WHEN {month} IN (6,7,8,9) THEN 2 ELSE 1 END"


CTES["g_size"] = "SELECT greatest(5, count(DISTINCT user_id) * 2 // 15) AS n FROM events"
CTES["g_events"] = """
SELECT event_id, ts, value, event_type, user_id % n AS k,
       'S' || lpad(CAST(user_id % n AS VARCHAR), 3, '0') AS station_id,
       CAST(floor(epoch(ts) / 10800) - 157784 AS INTEGER) AS slot
FROM events, g_size"""
CTES["g_readings"] = """
SELECT station_id, slot,
       CAST((sum(CAST(round(greatest(value - 150, 0) * 100) AS BIGINT)) + 50) // 100 AS DOUBLE) / 10 AS value
FROM g_events GROUP BY station_id, slot"""
CTES["g_stations"] = f"""
SELECT station_id, k, 'Gauge ' || k AS station_name,
       CAST(k % 20 AS DOUBLE) * 0.02::DOUBLE + 103.62::DOUBLE AS location_longitude,
       CAST(k // 20 AS DOUBLE) * 0.02::DOUBLE + 1.22::DOUBLE + CAST(k % 7 AS DOUBLE) * 0.005::DOUBLE AS location_latitude
FROM (SELECT DISTINCT k, station_id FROM g_events)"""
CTES["g_xy"] = f"""
SELECT station_id, location_longitude, location_latitude,
       (location_longitude - {LON_CENTRE}::DOUBLE) * 111.32::DOUBLE * cos(radians({LAT_CENTRE}::DOUBLE)) AS x_km,
       (location_latitude - {LAT_CENTRE}::DOUBLE) * 110.57::DOUBLE AS y_km
FROM g_stations"""
CTES["g_obs"] = """
SELECT e.event_id, CAST(e.ts AS DATE) AS date, e.ts AS "timestamp",
       e.ts + to_seconds(e.event_id % 900) AS update_timestamp,
       e.ts + to_seconds(e.event_id % 600) AS reading_update_timestamp,
       e.station_id, s.station_name, e.event_type AS station_device_id,
       s.location_longitude, s.location_latitude, e.value AS reading_value,
       'type ' || (e.event_id % 3) AS reading_type, 'mm' AS reading_unit,
       CAST(year(e.ts) AS INTEGER) AS source_year
FROM g_events e JOIN g_stations s USING (station_id)"""
CTES["g_legacy"] = """
SELECT event_id, station_id, value AS reading_value,
       date_trunc('day', ts) + to_seconds((hour(ts) * 60 + minute(ts)) // 5 * 300 - event_id % 2) AS "timestamp"
FROM g_events"""
CTES["g_daily"] = """
SELECT 'D' || (l_suppkey % 10) AS station_id, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS value
FROM lineitem GROUP BY 1, 2"""
CTES["g_labels"] = f"""
SELECT station_id, slot, ts, CAST(year(ts) AS INTEGER) AS year, y_mm,
       CAST({" + ".join(f"CAST(y_mm >= {f} AS INTEGER)" for f in CLASS_FLOORS)} AS DOUBLE) AS label,
       past30_mm,
       CASE WHEN past30_mm IS NULL THEN 'unknown' WHEN past30_mm > 0 THEN 'wet_now' ELSE 'dry_now' END AS regime
FROM (SELECT station_id, slot, TIMESTAMP '2024-01-01' + to_seconds(CAST(slot AS BIGINT) * 10800) AS ts,
             round(sum(value) OVER nxt, 1) AS y_mm, count(value) OVER nxt AS next_n,
             CASE WHEN count(value) OVER past = 6 THEN round(sum(value) OVER past, 1) END AS past30_mm
      FROM g_readings
      WINDOW nxt AS (PARTITION BY station_id ORDER BY slot RANGE BETWEEN 1 FOLLOWING AND 6 FOLLOWING),
             past AS (PARTITION BY station_id ORDER BY slot RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))
WHERE next_n = 6 AND year(ts) = year(ts + to_seconds(64800))"""
CTES["g_train"] = f"SELECT * FROM g_labels WHERE slot < {VALIDATION_FROM}"
CTES["g_val"] = f"SELECT * FROM g_labels WHERE slot BETWEEN {VALIDATION_FROM} AND {TEST_FROM - 1}"
CTES["g_test"] = f"SELECT * FROM g_labels WHERE slot >= {TEST_FROM}"


def _last(slots: int) -> str:
    return f"OVER (PARTITION BY station_id ORDER BY slot RANGE BETWEEN {slots - 1} PRECEDING AND CURRENT ROW)"


CTES["g_t1"] = f"""
SELECT station_id, slot, 2024 AS year, value AS t1_rain_5,
       {", ".join(f"round(sum(value) {_last(n)}, 1) AS t1_rain_{m}" for m, n in TRAILING_SLOTS.items() if n > 1)},
       max(value) {_last(6)} AS t1_max5_30,
       CAST(sum(CAST(value > 0 AS INTEGER)) {_last(12)} AS BIGINT) AS t1_wet_slots_60,
       round(2 * round(sum(value) {_last(3)}, 1) - round(sum(value) {_last(6)}, 1), 1) AS t1_trend_30,
       CAST(least(coalesce((slot - max(CASE WHEN value > 0 THEN slot END) OVER (PARTITION BY station_id ORDER BY slot)) * 5, 1440), 1440) AS INTEGER) AS t1_min_since_rain,
       24 - count(value) {_last(24)} AS t1_missing_120
FROM g_readings"""
CTES["g_pairs"] = """
SELECT a.station_id AS s, b.station_id AS j, a.x_km AS sx, a.y_km AS sy, b.x_km AS jx, b.y_km AS jy,
       b.x_km - a.x_km AS dx, b.y_km - a.y_km AS dy,
       sqrt((b.x_km - a.x_km) ** 2 + (b.y_km - a.y_km) ** 2) AS dist_km,
       ((degrees(atan2(b.x_km - a.x_km, b.y_km - a.y_km)) % 360) + 360) % 360 AS bearing
FROM g_xy a, g_xy b WHERE a.station_id <> b.station_id"""
CTES["g_rain"] = "SELECT station_id, slot, t1_rain_15 AS r15, t1_rain_30 AS r30 FROM g_t1"
# summaries of the neighbours' state at slot u for every station and every slot in which any station reported
_IDW = "1 / greatest(p.dist_km, 0.5) ** 2"


def _wm(w: str, z: str) -> str:
    return f"coalesce(sum({w} * {z}) / nullif(sum({w}), 0), 0)"


def _avg(member: str, z: str) -> str:
    return f"coalesce(avg(CASE WHEN {member} THEN {z} END), 0)"


_NEAR = "p.dist_km > 0 AND p.dist_km <= 10"
_QUADRANT = "CAST(floor(((p.bearing + 45) % 360) / 90) AS INTEGER)"
CTES["g_around"] = f"""
SELECT st.station_id, u.slot,
       {_wm(f"CASE WHEN {_NEAR} THEN {_IDW} ELSE 0 END", "r.r15")} AS idw_rain_15,
       {_wm(f"CASE WHEN {_NEAR} THEN {_IDW} ELSE 0 END", "r.r30")} AS idw_rain_30,
       {_wm(f"CASE WHEN p.dist_km > 10 AND p.dist_km <= 25 THEN {_IDW} ELSE 0 END", "r.r30")} AS far_rain_30,
       coalesce(max(CASE WHEN {_NEAR} THEN r.r30 END), 0) AS max_rain_30,
       {_avg("p.dist_km > 0 AND p.dist_km <= 5", "CAST(r.r30 > 0 AS INTEGER)")} AS wet_frac_5km,
       {_avg(_NEAR, "CAST(r.r30 > 0 AS INTEGER)")} AS wet_frac_10km,
       coalesce(min(CASE WHEN r.r15 > 0 AND p.dist_km > 0 THEN least(p.dist_km, 30) END), 30) AS dist_rain_km,
       CAST(count(CASE WHEN {_NEAR} AND r.r30 IS NOT NULL THEN 1 END) AS DOUBLE) AS nbrs_10km,
       {", ".join(f'''coalesce(CAST(sum(CASE WHEN p.dist_km > 0 AND p.dist_km <= 25 AND {_QUADRANT} = {q} THEN CAST(round(r.r30 * 10) AS BIGINT) END) AS DOUBLE)
         / (10 * count(CASE WHEN p.dist_km > 0 AND p.dist_km <= 25 AND {_QUADRANT} = {q} THEN r.r30 END)), 0) AS rain_30_{n}''' for q, n in enumerate("nesw"))},
       any_value(u.wet) AS island_wet_frac, any_value(u.mean) AS island_rain_30
FROM g_xy st CROSS JOIN
     (SELECT slot, avg(CAST(r30 > 0 AS INTEGER)) AS wet,
             CAST(sum(CAST(round(r30 * 10) AS BIGINT)) AS DOUBLE) / (10 * count(*)) AS mean FROM g_rain GROUP BY slot) u
     LEFT JOIN (g_pairs p JOIN g_rain r ON r.station_id = p.j) ON p.s = st.station_id AND r.slot = u.slot
GROUP BY st.station_id, u.slot"""
CTES["g_t2"] = f"""
SELECT r.station_id, r.slot, 2024 AS year,
       {", ".join(f"round({'2 * a.idw_rain_15 - a.idw_rain_30' if c == 't2_idw_trend' else 'a.' + c[3:]}, 4) AS {c}" for c in T2_COLUMNS)}
FROM g_rain r JOIN g_around a USING (station_id, slot)"""


def _kernel_sql(minutes: int) -> str:
    import math

    cases = []
    for c, (heading, speed) in MOTION.items():
        step = speed * minutes / 60
        ox, oy = step * math.sin(math.radians(heading)), step * math.cos(math.radians(heading))
        d = f"sqrt((p.jx - (p.sx - {ox!r}::DOUBLE)) ** 2 + (p.jy - (p.sy - {oy!r}::DOUBLE)) ** 2)"
        cases.append(f"WHEN season = {c} THEN CASE WHEN {d} <= {UPSTREAM_CUT_KM} THEN exp(-0.5 * ({d} / {UPSTREAM_SIGMA_KM}::DOUBLE) ** 2) ELSE 0 END")
    return f"CASE {' '.join(cases)} END"


CTES["g_up"] = f"""
SELECT s AS station_id, slot,
       {", ".join(f'''{_wm(f"k{m}", "r15")} AS up{m}_rain, {_wm(f"k{m}", "CAST(r15 > 0 AS INTEGER)")} AS up{m}_wet,
       CAST(count(CASE WHEN k{m} > 0 THEN 1 END) AS DOUBLE) AS up{m}_nbrs''' for m in UPSTREAM_MINUTES)}
FROM (SELECT p.s, r.slot, r.r15, {", ".join(f"{_kernel_sql(m)} AS k{m}" for m in UPSTREAM_MINUTES)}
      FROM g_pairs p JOIN (SELECT *, {season_sql("month(TIMESTAMP '2024-01-01' + to_seconds(CAST(slot AS BIGINT) * 10800))")} AS season FROM g_rain) r ON r.station_id = p.j)
GROUP BY s, slot"""
CTES["g_t3"] = f"""
SELECT r.station_id, r.slot, 2024 AS year,
       {", ".join(f"round(a.{c} - coalesce(b.{c}, {30 if c == 'dist_rain_km' else 0}), 4) AS t3_d15_{c}" for c in CHANGED_COLUMNS)},
       {", ".join(f"round(coalesce(up{m}_rain, 0), 4) AS t3_up{m}_rain, round(coalesce(up{m}_wet, 0), 4) AS t3_up{m}_wet" for m in UPSTREAM_MINUTES)},
       coalesce(up30_nbrs, 0) AS t3_up30_nbrs
FROM g_rain r JOIN g_around a USING (station_id, slot)
     LEFT JOIN g_around b ON b.station_id = r.station_id AND b.slot = r.slot - {CHANGE_LAG_SLOTS}
     LEFT JOIN g_up u ON u.station_id = r.station_id AND u.slot = r.slot"""
CTES["g_net"] = """
SELECT slot, avg(CAST(label > 0 AS INTEGER)) AS p_wet, avg(CAST(label >= 6 AS INTEGER)) AS p_heavy
FROM g_train GROUP BY slot"""
CTES["g_ratios"] = """
SELECT station_id, count(*) AS n, CAST(sum(CAST(label > 0 AS INTEGER)) AS DOUBLE) AS o_wet, sum(p_wet) AS e_wet,
       CAST(sum(CAST(label >= 6 AS INTEGER)) AS DOUBLE) AS o_heavy, sum(p_heavy) AS e_heavy,
       (sum(CAST(label > 0 AS INTEGER)) + 500) / (sum(p_wet) + 500) AS t0_wet_ratio,
       (sum(CAST(label >= 6 AS INTEGER)) + 500) / (sum(p_heavy) + 500) AS t0_heavy_ratio
FROM g_train JOIN g_net USING (slot) GROUP BY station_id"""
CTES["g_faults"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for s, a, b in FAULTS
) + ") f(station_id, start_time, end_time)"


def past_class_sql(column: str) -> str:
    return f"coalesce({' + '.join(f'CAST({column} > {e} AS INTEGER)' for e in EDGES)}, -1)"
