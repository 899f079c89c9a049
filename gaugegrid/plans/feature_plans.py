"""Named queries: labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugegrid.functions.amounts import flag, is_event, is_heavy
from gaugegrid.functions.clock import with_calendar_features
from gaugegrid.functions.geo import compass, compass_words
from gaugegrid.operators import labels as L
from gaugegrid.operators import neighbours as N
from gaugegrid.operators import trailing as T
from gaugegrid.plans.registry import query
from gaugegrid.plans.sqltext import season_sql
from gaugegrid.settings import CHANGED_COLUMNS, T2_COLUMNS, UPSTREAM_MINUTES
from gaugegrid.sources.fixtures import GRID, Tables


@query("regime_share", "W01 W02 P09 P10 P12 A18",
       "SELECT regime, count(*) AS n, round(avg(CAST(label > 0 AS INTEGER)), 4) AS p_wet FROM g_labels GROUP BY regime")
def regime_share(t: Tables):
    return L.event_share(t.labels(), "regime")


@query("label_rows", "W01 W02 P09 P10 P11 P12 D10", "SELECT * FROM g_labels")
def label_rows(t: Tables):
    return t.labels()


@query("event_flags", "P08", """
SELECT station_id, slot, CAST(CAST(y_mm > 0 AS INTEGER) AS DOUBLE) AS wet_amount, CAST(CAST(label > 0 AS INTEGER) AS DOUBLE) AS wet_next, CAST(CAST(label >= 6 AS INTEGER) AS DOUBLE) AS heavy_next FROM g_labels""")
def event_flags(t: Tables):
    return t.labels().select(
        "station_id", "slot", flag(F.col("y_mm") > 0).alias("wet_amount"),
        flag(is_event()).alias("wet_next"), flag(is_heavy()).alias("heavy_next"),
    )


@query("label_summary", "A18", """
SELECT label, count(*) AS n, min(y_mm) AS y_min, max(y_mm) AS y_max,
       round(count(*) / (SELECT count(*) FROM g_labels)::DOUBLE, 5) AS share FROM g_labels GROUP BY label""")
def label_summary(t: Tables):
    return L.class_summary(t.labels())


@query("top_hours", "A18 O01 P07", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(avg(CAST(label > 0 AS INTEGER)), 4) AS p_wet
FROM g_labels GROUP BY 1 ORDER BY p_wet DESC, hour LIMIT 3""")
def top_hours(t: Tables):
    return L.top_shares(t.labels(), F.hour("ts"), "hour")


@query("calendar_features", "P05 P07 P14 P15", f"""
WITH c AS (SELECT station_id, slot, month(ts) AS mo, (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE AS h,
                  (dayofyear(ts) - 1 + (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE)
                   / date_diff('day', make_date(year(ts), 1, 1), make_date(year(ts) + 1, 1, 1)) AS d
           FROM (SELECT station_id, slot, TIMESTAMP '2024-01-01' + to_seconds(CAST(slot AS BIGINT) * 10800) AS ts FROM g_readings))
SELECT station_id, slot, {", ".join(f"round(sin(2 * pi() * {k} * h), 6) AS t0_hod_s{k}, round(cos(2 * pi() * {k} * h), 6) AS t0_hod_c{k}" for k in (1, 2, 3))},
       {", ".join(f"round(sin(2 * pi() * {k} * d), 6) AS t0_doy_s{k}, round(cos(2 * pi() * {k} * d), 6) AS t0_doy_c{k}" for k in (1, 2))},
       CAST({season_sql("mo")} AS DOUBLE) AS t0_season
FROM c""")
def calendar_features(t: Tables):
    from gaugegrid.functions.clock import time_of

    rows = with_calendar_features(t.readings().select("station_id", "slot", time_of("slot", GRID).alias("ts")))
    names = [c for c in rows.columns if c.startswith(("t0_hod", "t0_doy"))]
    # + 0.0 turns a rounded -0.0 into 0.0
    return rows.select("station_id", "slot", *[(F.round(c, 6) + 0.0).alias(c) for c in names], "t0_season")


@query("own_trailing", "W03 W04 W05 W06 W07 W08 D11", "SELECT * FROM g_t1")
def own_trailing(t: Tables):
    return t.trailing()


@query("observed_rows", "W01 W02 W03 W04 W05 W06 W07 W08 D10 D11", """
SELECT t.*, l.y_mm, l.label FROM g_t1 t LEFT JOIN g_labels l ON l.station_id = t.station_id AND l.slot = t.slot""")
def observed_rows(t: Tables):
    return T.observed_rows(t.readings(), GRID).drop("ts", "past30_mm", "regime")


@query("time_since_event", "W06 P26 A38", """
SELECT CASE WHEN m = 0 THEN '0 raining now' WHEN m <= 30 THEN '1 within 30 min' WHEN m <= 60 THEN '2 30–60 min'
            WHEN m <= 120 THEN '3 1–2 h' WHEN m <= 360 THEN '4 2–6 h' WHEN m < 1440 THEN '5 6–24 h' ELSE '6 none in 24 h' END AS last_rain,
       count(*) AS n, round(avg(CAST(label > 0 AS INTEGER)), 6) AS p_wet
FROM (SELECT label, t1_min_since_rain AS m FROM g_labels JOIN g_t1 USING (station_id, slot)) GROUP BY 1""")
def time_since_event(t: Tables):
    return T.recency_table(t.labels(), t.trailing())


COMPASS_SQL = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor((bearing + 11.25) / 22.5) AS INTEGER) % 16 + 1]"


@query("station_geometry", "P16 P17 P18 D16 J13", f"""
SELECT s, j, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dist_km, 6) AS dist_km, round(bearing, 6) AS bearing, {COMPASS_SQL} AS point,
       array_to_string(list_transform(string_split({COMPASS_SQL}, ''), lambda c: CASE c WHEN 'N' THEN 'north' WHEN 'E' THEN 'east' WHEN 'S' THEN 'south' ELSE 'west' END), '-') AS words
FROM g_pairs WHERE dist_km <= 50""")
def station_geometry(t: Tables):
    pairs = N.station_pairs(t.stations(), 50.0)
    rounded = [F.round(c, 6).alias(c) for c in ("dx", "dy", "dist_km", "bearing")]
    return pairs.select("s", "j", *rounded, compass(F.col("bearing")).alias("point"), compass_words(F.col("bearing")).alias("words"))


@query("neighbour_counts", "J13 A41", """
SELECT st.station_id, count(p.j) AS neighbours FROM g_stations st
LEFT JOIN g_pairs p ON p.s = st.station_id AND p.dist_km > 0 AND p.dist_km <= 10 GROUP BY st.station_id""")
def neighbour_counts(t: Tables):
    return N.neighbour_counts(t.stations())


def _t2(t: Tables, *columns: str):
    rows = N.neighbour_features(t.trailing(), t.stations(), GRID, ("t2",))
    return rows.select("station_id", "slot", *columns)


T2_VIEWS = {
    "neighbour_idw": ("N01 N02 N03 N04 N05", ("t2_idw_rain_15", "t2_idw_rain_30", "t2_idw_trend", "t2_far_rain_30")),
    "neighbour_fractions": ("N06 N11", ("t2_wet_frac_5km", "t2_wet_frac_10km", "t2_nbrs_10km")),
    "neighbour_quadrants": ("N07", ("t2_rain_30_n", "t2_rain_30_e", "t2_rain_30_s", "t2_rain_30_w")),
    "nearest_event": ("N08 N09", ("t2_max_rain_30", "t2_dist_rain_km")),
    "network_context": ("N10", ("t2_island_wet_frac", "t2_island_rain_30")),
}
for _name, (_items, _columns) in T2_VIEWS.items():
    query(_name, _items, f"SELECT station_id, slot, {', '.join(_columns)} FROM g_t2")(lambda t, c=_columns: _t2(t, *c))


@query("neighbour_tier", "N12 D11 U05", f"SELECT station_id, slot, year, {', '.join(T2_COLUMNS)} FROM g_t2")
def neighbour_tier(t: Tables):
    return N.neighbour_features(t.trailing(), t.stations(), GRID, ("t2",))


@query("neighbour_tier_joined", "N12", f"SELECT station_id, slot, year, {', '.join(T2_COLUMNS)} FROM g_t2")
def neighbour_tier_joined(t: Tables):
    return N.neighbour_features(t.trailing(), t.stations(), GRID, ("t2",), form="joined")


_CHANGES = [f"t3_d15_{c}" for c in CHANGED_COLUMNS]
_UPSTREAM = [f"t3_up{m}_{k}" for m in UPSTREAM_MINUTES for k in ("rain", "wet")] + ["t3_up30_nbrs"]


@query("neighbour_change", "N13 J09", f"SELECT station_id, slot, {', '.join(_CHANGES)} FROM g_t3")
def neighbour_change(t: Tables):
    return N.neighbour_features(t.trailing(), t.stations(), GRID).select("station_id", "slot", *_CHANGES)


@query("upstream", "N14 N15 N16", f"SELECT station_id, slot, {', '.join(_UPSTREAM)} FROM g_t3")
def upstream(t: Tables):
    return N.neighbour_features(t.trailing(), t.stations(), GRID, ("t3",)).select("station_id", "slot", *_UPSTREAM)


@query("upstream_tier", "N17 D11", f"SELECT station_id, slot, year, {', '.join(_CHANGES + _UPSTREAM)} FROM g_t3")
def upstream_tier(t: Tables):
    return N.neighbour_features(t.trailing(), t.stations(), GRID, ("t3",))


@query("oe_ratio", "A11", "SELECT station_id, n, o_wet, round(e_wet, 6) AS e_wet, o_heavy, round(e_heavy, 6) AS e_heavy, round(t0_wet_ratio, 6) AS t0_wet_ratio, round(t0_heavy_ratio, 6) AS t0_heavy_ratio FROM g_ratios")
def oe_ratio(t: Tables):
    r = N.event_ratios(t.train_labels())
    return r.select("station_id", "n", "o_wet", "o_heavy", *[F.round(c, 6).alias(c) for c in ("e_wet", "e_heavy", "t0_wet_ratio", "t0_heavy_ratio")])
