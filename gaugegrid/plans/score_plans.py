"""Named queries: counting forecasts, threshold mapper and scores."""

from __future__ import annotations


from pyspark.sql import functions as F

from gaugegrid.operators import baselines as B
from gaugegrid.operators import inference as I
from gaugegrid.operators import mapper as M
from gaugegrid.operators import neighbours as N
from gaugegrid.operators import scoring as S
from gaugegrid.plans import sqltext
from gaugegrid.plans.registry import query
from gaugegrid.plans.sqltext import past_class_sql
from gaugegrid.settings import BETWEEN_EDGES, CLIMATOLOGY_STRENGTHS, EDGES, SCORE_EDGES, SKILL_THETAS, TRAILING_SLOTS
from gaugegrid.sources.fixtures import TEST_FROM, VALIDATION_FROM, Tables
from gaugegrid.sources.session import stored

K = range(9)
NAMES = ["climatology", "constant", "persistence"]
KEYS = ["station_id", "slot", "ts", "y_mm", "label", "regime", "past30_mm"]
STRENGTH = 100


def _counts(prefix: str = "c") -> str:
    return ", ".join(f"CAST(sum(CAST(label = {k} AS INTEGER)) AS DOUBLE) AS {prefix}{k}" for k in K)


def _sum(prefix: str) -> str:
    return "(" + " + ".join(f"{prefix}{k}" for k in K) + ")"


C = sqltext.CTES
C["g_cells"] = f"SELECT station_id, month(ts) AS mo, hour(ts) AS hr, {_counts()} FROM g_train GROUP BY 1, 2, 3"
C["g_parent"] = f"SELECT month(ts) AS mo, hour(ts) AS hr, {_counts('q')} FROM g_train GROUP BY 1, 2"
C["g_clim"] = f"""
SELECT v.*, {", ".join(f"CASE WHEN c0 IS NULL THEN q{k} / {_sum('q')} ELSE (c{k} + {STRENGTH} * q{k} / {_sum('q')}) / ({_sum('c')} + {STRENGTH}) END AS p{k}" for k in K)}
FROM g_val v LEFT JOIN g_cells c ON c.station_id = v.station_id AND c.mo = month(v.ts) AND c.hr = hour(v.ts)
LEFT JOIN g_parent q ON q.mo = month(v.ts) AND q.hr = hour(v.ts)"""
C["g_const"] = f"SELECT v.*, {', '.join(f'(SELECT avg(CAST(label = {k} AS INTEGER)) FROM g_train) AS p{k}' for k in K)} FROM g_val v"
C["g_pers_fit"] = f"""SELECT "now", {", ".join(f"c{k} / {_sum('c')} AS p{k}" for k in K)}
FROM (SELECT {past_class_sql('past30_mm')} AS "now", {_counts()} FROM g_train GROUP BY 1)"""
C["g_pers"] = f"""SELECT v.*, {", ".join(f"p{k}" for k in K)} FROM g_val v LEFT JOIN g_pers_fit f ON f."now" = {past_class_sql('past30_mm')}"""
C["g_fc_raw"] = " UNION ALL ".join(
    f"SELECT '{n}' AS forecast, * FROM {c}" for n, c in (("climatology", "g_clim"), ("constant", "g_const"), ("persistence", "g_pers"))
)


def _tail(j: int) -> str:
    text = "p8"
    for k in range(7, j, -1):
        text = f"(p{k} + {text})"
    return text


C["g_fc"] = f"SELECT *, {', '.join(f'{_tail(j)} AS e{j}' for j in range(8))} FROM g_fc_raw"
_RPS = " + ".join(f"(e{j} - CAST(label > {j} AS INTEGER)) ** 2" for j in range(8))
C["g_rps"] = f"SELECT *, {_RPS} AS rps FROM g_fc"
C["g_mapper"] = "SELECT CAST(label AS INTEGER) AS label, y_mm, CAST(count(*) AS DOUBLE) AS w FROM g_train WHERE label > 0 GROUP BY 1, 2"


def _theta_cte(thetas) -> str:
    values = ", ".join(f"({float(v)}::DOUBLE)" for v in thetas)
    return f"""(SELECT theta, k, sum(CASE WHEN y_mm > theta THEN w ELSE 0 END) / sum(w) AS q
  FROM (SELECT theta, {" + ".join(f"CAST(theta >= {e} AS INTEGER)" for e in EDGES)} AS k FROM (VALUES {values}) v(theta)) JOIN g_mapper ON label = k GROUP BY theta, k)"""


def _exceed() -> str:
    upper = "CASE k " + " ".join(f"WHEN {k} THEN e{k}" for k in range(1, 8)) + " ELSE 0 END"
    lower = "CASE k " + " ".join(f"WHEN {k} THEN e{k - 1}" for k in range(1, 9)) + " END"
    return f"({upper} + q * ({lower} - {upper}))"


# ---- Spark side: three forecasts for the validation slots ----


def split(t: Tables):
    labels = t.labels()
    return labels.where(F.col("slot") < VALIDATION_FROM), labels.where(F.col("slot").between(VALIDATION_FROM, TEST_FROM - 1))


def forecasts(t: Tables, exceed: bool = False):
    """Validation rows with the three counting forecasts as arrays (class probabilities, or edge exceedances)."""
    train, val = split(t)
    rows = val.select(*KEYS)
    rows = B.predict_climatology(B.fit_climatology(train, STRENGTH), rows, "climatology")
    rows = B.predict_constant(B.fit_constant(train), rows, "constant")
    rows = B.predict_persistence(B.fit_persistence(train), rows, "persistence")
    if exceed:
        rows = rows.select(*KEYS, *[S.exceedances(F.col(n)).alias(n) for n in NAMES])
    return rows


def long_forecasts(t: Tables):
    return S.side_by_side(forecasts(t), NAMES, KEYS)


def _columns(name: str, prefix: str = "p", n: int = 9):
    return [F.round(F.col(name)[k], 6).alias(f"{prefix}{k}") for k in range(n)]


def _r(*names: str):
    return [F.round(c, 6).alias(c) for c in names]


def _rp(prefix: str, n: int = 9, out: str = "p") -> str:
    return ", ".join(f"round({prefix}{k}, 6) AS {out}{k}" for k in range(n))


@query("constant_fit", "A16 A12 R05", "SELECT " + ", ".join(f"round(avg(CAST(label = {k} AS INTEGER)), 6) AS p{k}" for k in K) + " FROM g_train")
def constant_fit(t: Tables):
    return B.fit_constant(t.train_labels()).select(*_columns("probs"))


@query("constant_check", "A39", f"""
SELECT edge, round(f, 6) AS forecast, round(o, 6) AS event_rate, round(o * (1 - f) ** 2 + (1 - o) * f ** 2, 6) AS brier FROM (
{" UNION ALL ".join(f"SELECT {e}::DOUBLE AS edge, (SELECT avg(CAST(label > {j} AS INTEGER)) FROM g_train) AS f, (SELECT avg(CAST(label > {j} AS INTEGER)) FROM g_val) AS o" for j, e in enumerate(EDGES))})""")
def constant_check(t: Tables):
    return B.constant_check(*split(t)).select("edge", *_r("forecast", "event_rate", "brier"))


@query("climatology_fit", "A13 A12", f"""
SELECT station_id, CAST(mo AS INTEGER) AS month, CAST(hr AS INTEGER) AS hour,
       {", ".join(f"round((c{k} + {STRENGTH} * q{k} / {_sum('q')}) / ({_sum('c')} + {STRENGTH}), 6) AS p{k}" for k in K)}
FROM g_cells JOIN g_parent USING (mo, hr)""")
def climatology_fit(t: Tables):
    table, _ = B.fit_climatology(t.train_labels(), STRENGTH)
    return table.select("station_id", "month", "hour", *_columns("cell_probs"))


@query("climatology_forecast", "J07 P25", f"SELECT station_id, slot, {_rp('p')} FROM g_clim")
def climatology_forecast(t: Tables):
    return forecasts(t).select("station_id", "slot", *_columns("climatology"))


_STRENGTH_SQL = " UNION ALL ".join(
    f"""SELECT {m} AS strength, count(*) AS n, avg({_RPS}) AS rps FROM (SELECT *, {', '.join(f'{_tail(j)} AS e{j}' for j in range(8))} FROM (
    SELECT v.label, {", ".join(f"CASE WHEN c0 IS NULL THEN q{k} / {_sum('q')} ELSE (c{k} + {m} * q{k} / {_sum('q')}) / ({_sum('c')} + {m}) END AS p{k}" for k in K)}
    FROM g_val v LEFT JOIN g_cells c ON c.station_id = v.station_id AND c.mo = month(v.ts) AND c.hr = hour(v.ts)
    LEFT JOIN g_parent q ON q.mo = month(v.ts) AND q.hr = hour(v.ts)))""" for m in CLIMATOLOGY_STRENGTHS)


@query("climatology_strength", "A14", f"SELECT strength, n, round(rps, 6) AS rps FROM ({_STRENGTH_SQL})")
def climatology_strength(t: Tables):
    return B.climatology_strengths(*split(t)).select("strength", "n", *_r("rps"))


@query("climatology_best", "A14 O02", f"SELECT arg_min(strength, rps) AS strength, round(min(rps), 6) AS rps FROM ({_STRENGTH_SQL})")
def climatology_best(t: Tables):
    return B.best_strength(B.climatology_strengths(*split(t))).select("strength", *_r("rps"))


@query("persistence_fit", "A15 P19", f'SELECT "now", {_rp("p")} FROM g_pers_fit')
def persistence_fit(t: Tables):
    return B.fit_persistence(t.train_labels()).select("now", *_columns("now_probs"))


@query("persistence_forecast", "J08 P19", f"SELECT station_id, slot, {_rp('p')} FROM g_pers")
def persistence_forecast(t: Tables):
    return forecasts(t).select("station_id", "slot", *_columns("persistence"))


@query("forecast_table", "M14 D14 R10", "SELECT forecast, station_id, slot, " + _rp("e", 8, "e") + " FROM g_fc")
def forecast_table(t: Tables):
    rows = S.side_by_side(forecasts(t, exceed=True), NAMES, ["station_id", "slot"])
    return rows.select("forecast", "station_id", "slot", *_columns("probs", "e", 8))


@query("mapper_fit", "A17 D15", "SELECT * FROM g_mapper")
def mapper_fit(t: Tables):
    return M.fit_mapper(t.train_labels())


@query("exceedance", "P20", "SELECT forecast, station_id, slot, " + ", ".join(
    f"round(e{j}, 6) AS {S.edge_name('p_gt', e)}" for j, e in enumerate(EDGES)) + " FROM g_fc")
def exceedance(t: Tables):
    names = [S.edge_name("p_gt", e) for e in EDGES]
    return S.add_exceedances(long_forecasts(t)).select("forecast", "station_id", "slot", *_r(*names))


@query("threshold_any", "P21 P22 P23", f"""
SELECT f.station_id, f.slot, x.theta, round(max(CASE WHEN forecast = 'climatology' THEN {_exceed()} END), 6) AS climatology,
       round(max(CASE WHEN forecast = 'constant' THEN {_exceed()} END), 6) AS "constant", round(max(CASE WHEN forecast = 'persistence' THEN {_exceed()} END), 6) AS persistence
FROM g_fc f, {_theta_cte(SKILL_THETAS)} x GROUP BY 1, 2, 3""")
def threshold_any(t: Tables):
    mapper = M.fit_mapper(t.train_labels())
    rows = M.with_thresholds(forecasts(t, exceed=True), mapper, list(SKILL_THETAS), *NAMES)
    return rows.select("station_id", "slot", "theta", *_r(*NAMES))


_ADDITIVE = f"""count(*) AS n, {", ".join(f"round(avg((e{j} - CAST(label > {j} AS INTEGER)) ** 2), 6) AS {S.edge_name('brier', e)}" for j, e in enumerate(EDGES))},
  round(avg(rps), 6) AS rps, round(avg(-ln(greatest(CASE CAST(label AS INTEGER) {" ".join(f"WHEN {k} THEN p{k}" for k in K)} END, 1e-15))), 6) AS log_loss"""
_BRIERS = [S.edge_name("brier", e) for e in EDGES]


@query("brier_rps", "A20 P24", "SELECT forecast, n, " + ", ".join(_BRIERS) + f", rps FROM (SELECT forecast, {_ADDITIVE} FROM g_rps GROUP BY forecast)")
def brier_rps(t: Tables):
    return S.additive_scores(long_forecasts(t), "forecast").select("forecast", "n", *_r(*_BRIERS, "rps"))


@query("log_loss", "A21", f"SELECT forecast, n, log_loss FROM (SELECT forecast, {_ADDITIVE} FROM g_rps GROUP BY forecast)")
def log_loss(t: Tables):
    return S.additive_scores(long_forecasts(t), "forecast").select("forecast", "n", *_r("log_loss"))


def _auc_sql(source: str, keys: str) -> str:
    """Area for rows (keys, score, event): ties merged, trapezoids over the running sums."""
    return f"""(SELECT {keys}, sum(h * (prec + coalesce(lag_prec, prec)) / 2) / sum(h) AS auc_pr FROM (
  SELECT *, tp / (tp + fp) AS prec, lag(tp / (tp + fp)) OVER (PARTITION BY {keys} ORDER BY score DESC) AS lag_prec FROM (
    SELECT {keys}, score, h, sum(h) OVER w AS tp, sum(m) OVER w AS fp FROM (
      SELECT {keys}, score, CAST(sum(event) AS DOUBLE) AS h, CAST(sum(1 - event) AS DOUBLE) AS m FROM {source} GROUP BY {keys}, score)
    WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))) GROUP BY {keys})"""


_EDGE_LONG = "(" + " UNION ALL ".join(
    f"SELECT forecast, regime, {e}::DOUBLE AS edge, round(e{j}, 12) AS score, CAST(label > {j} AS INTEGER) AS event FROM g_fc" for j, e in enumerate(EDGES)) + ")"


def _tie_safe(rows):
    """Merge scores that differ by summation noise only, so that both engines see the same ties."""
    return rows.withColumn("probs", F.transform("probs", lambda p: F.round(p, 12)))


@query("auc_pr", "A22", f"SELECT forecast, edge, round(auc_pr, 6) AS auc_pr FROM {_auc_sql(_EDGE_LONG, 'forecast, edge')}")
def auc_pr(t: Tables):
    pairs = F.array(*[F.struct(F.lit(e).alias("edge"), F.round(S.exceedances(F.col("probs"))[j], 12).alias("score"), S.outcome(j).alias("event")) for j, e in enumerate(EDGES)])
    long = long_forecasts(t).select("forecast", F.lit(1.0).alias("w"), F.explode(pairs).alias("c")).select("forecast", "w", "c.*")
    return S.precision_recall_area(long, ["forecast", "edge"]).select("forecast", "edge", *_r("auc_pr"))


@query("score_by_regime", "A25 D18 R10")
def score_by_regime(t: Tables):
    rows = S.score(S.with_subsets(long_forecasts(t)), "forecast", "subset", edges=SCORE_EDGES)
    numbers = [c for c in rows.columns if c not in ("forecast", "subset", "n")]
    return rows.select("forecast", "subset", "n", *_r(*numbers))


@query("scores_additive", "A25 A20 A21", f"""
SELECT forecast, 'all' AS subset, {_ADDITIVE} FROM g_rps GROUP BY forecast
UNION ALL SELECT forecast, regime AS subset, {_ADDITIVE} FROM g_rps WHERE regime <> 'unknown' GROUP BY forecast, regime""")
def scores_additive(t: Tables):
    rows = S.additive_scores(S.with_subsets(long_forecasts(t)), "forecast", "subset")
    return rows.select("forecast", "subset", "n", *_r(*_BRIERS, "rps", "log_loss"))


_BINS = "SELECT forecast, edge, bin, count(*)::DOUBLE AS n, avg(p) AS mean_forecast, avg(o) AS observed FROM (" + " UNION ALL ".join(
    f"SELECT forecast, {e}::DOUBLE AS edge, CAST(least(floor(e{j} * 10), 9) AS INTEGER) AS bin, e{j} AS p, CAST(label > {j} AS INTEGER) AS o FROM g_fc" for j, e in enumerate(EDGES)) + ") GROUP BY forecast, edge, bin"


@query("reliability", "A23", f"SELECT forecast, edge, bin, n, round(mean_forecast, 6) AS mean_forecast, round(observed, 6) AS observed FROM ({_BINS})")
def reliability(t: Tables):
    return S.reliability(long_forecasts(t), "forecast").select("forecast", "edge", "bin", "n", *_r("mean_forecast", "observed"))


@query("brier_decomposition", "A27", f"""
SELECT forecast, edge, round(sum(n * (mean_forecast - observed) ** 2) / sum(n), 6) AS reliability, round(sum(n * (observed - rate) ** 2) / sum(n), 6) AS resolution,
       round(max(rate * (1 - rate)), 6) AS uncertainty
FROM (SELECT *, sum(n * observed) OVER (PARTITION BY forecast, edge) / sum(n) OVER (PARTITION BY forecast, edge) AS rate FROM ({_BINS})) GROUP BY forecast, edge""")
def brier_decomposition(t: Tables):
    bins = S.reliability(long_forecasts(t), "forecast")
    return S.brier_decomposition(bins, "forecast", "edge").select("forecast", "edge", *_r("reliability", "resolution", "uncertainty"))


@query("brier_between", "A24", f"""
SELECT forecast, theta, round(avg(({_exceed()} - CAST(y_mm > theta AS INTEGER)) ** 2), 6) AS brier FROM g_fc, {_theta_cte(BETWEEN_EDGES)} x GROUP BY 1, 2""")
def brier_between(t: Tables):
    rows = S.side_by_side(forecasts(t, exceed=True), NAMES, KEYS)
    at = M.with_thresholds(rows, M.fit_mapper(t.train_labels()), list(BETWEEN_EDGES), "probs")
    return S.brier_at(at, "forecast", forecast="probs").select("forecast", "theta", *_r("brier"))


_WIDE = "(SELECT station_id, slot, any_value(ts) AS ts, any_value(label) AS label, any_value(regime) AS regime, " + ", ".join(
    f"max(CASE WHEN forecast = '{n}' THEN rps END) AS {n[:5]}_rps" for n in NAMES) + " FROM g_rps GROUP BY station_id, slot)"
_MEANS = "count(*) AS n, round(avg(CAST(label > 0 AS INTEGER)), 6) AS rain_share, " + ", ".join(f'round(avg({n[:5]}_rps), 6) AS "{n}"' for n in NAMES)
_SEASON_NAME = "CASE WHEN month(ts) IN (12,1,2,3) THEN 'NE monsoon' WHEN month(ts) IN (6,7,8,9) THEN 'SW monsoon' ELSE 'inter-monsoon' END"
_SLICES = {"month": "CAST(month(ts) AS VARCHAR)", "hour": "CAST(hour(ts) AS VARCHAR)", "season": _SEASON_NAME, "station_id": "station_id", "regime": "regime"}


@query("rps_by_slice", "A26 P07 P15", f"SELECT 'all' AS slice, 'all' AS value, {_MEANS} FROM {_WIDE} " + " ".join(
    f"UNION ALL SELECT '{s}' AS slice, {e} AS value, {_MEANS} FROM {_WIDE} GROUP BY {e}" for s, e in _SLICES.items()))
def rps_by_slice(t: Tables):
    rows = S.rps_by_slices(forecasts(t, exceed=True), NAMES, list(_SLICES))
    return rows.select("slice", "value", "n", *_r("rain_share", *NAMES))


@query("skill_scores", "P29 J17", f"""
SELECT s.station_id, s.station_name, n, round(1 - p / c, 6) AS skill_persistence, round(1 - kk / c, 6) AS skill_constant FROM g_stations s JOIN
(SELECT station_id, count(*) AS n, avg(persi_rps) AS p, avg(clima_rps) AS c, avg(const_rps) AS kk FROM {_WIDE} GROUP BY 1) USING (station_id)""")
def skill_scores(t: Tables):
    rows = S.rps_by_slices(forecasts(t, exceed=True), NAMES, ["station_id"]).where("slice = 'station_id'")
    rated = rows.select(
        F.col("value").alias("station_id"), "n",
        *[F.round(S.skill(f, "climatology"), 6).alias(f"skill_{f}") for f in ("persistence", "constant")],
    )
    return t.stations().select("station_id", "station_name").join(rated, "station_id")


@query("neighbours_and_skill", "A41 C19 P29", f"""
WITH k AS (SELECT station_id, round(1 - p / c, 6) AS skill FROM (SELECT station_id, avg(persi_rps) AS p, avg(clima_rps) AS c FROM {_WIDE} GROUP BY 1 HAVING count(*) >= 5)),
c AS (SELECT k.station_id, skill, count(p.j) AS neighbours FROM k LEFT JOIN g_pairs p ON p.s = k.station_id AND p.dist_km > 0 AND p.dist_km <= 10 GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (ORDER BY neighbours) + (count(*) OVER (PARTITION BY neighbours) - 1) / 2 AS ra, rank() OVER (ORDER BY skill) + (count(*) OVER (PARTITION BY skill) - 1) / 2 AS rb FROM c)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho, round(quantile_cont(skill, 0.25), 6) AS q25, round(quantile_cont(skill, 0.5), 6) AS median, round(quantile_cont(skill, 0.75), 6) AS q75 FROM r""")
def neighbours_and_skill(t: Tables):
    """Rank correlation of a station's number of neighbours with the skill there, and the quartiles of that skill; stations with at least 5 rows."""
    slices = S.rps_by_slices(forecasts(t, exceed=True), NAMES, ["station_id"]).where("slice = 'station_id' AND n >= 5")
    skills = slices.select(F.col("value").alias("station_id"), F.round(S.skill("persistence", "climatology"), 6).alias("skill"))
    rows = stored(skills.join(N.neighbour_counts(t.stations()), "station_id"))  # a row per station, read by several small jobs
    return I.rank_and_quartiles(rows, "neighbours", "skill").select("n", *_r("rho", "q25", "median", "q75"))


@query("skill_by_threshold", "A28 P23", f"""
SELECT theta, events, event_rate, round(1 - cons / nullif(clim, 0), 6) AS bss_constant, round(1 - pers / nullif(clim, 0), 6) AS bss_persistence FROM (
SELECT theta, CAST(sum(CAST(y_mm > theta AS INTEGER)) FILTER (forecast = 'constant') AS BIGINT) AS events, round(avg(CAST(y_mm > theta AS INTEGER)), 6) AS event_rate,
  {", ".join(f"avg(CASE WHEN forecast = '{n}' THEN ({_exceed()} - CAST(y_mm > theta AS INTEGER)) ** 2 END) AS {n[:4]}" for n in NAMES)}
FROM g_fc, {_theta_cte(SKILL_THETAS)} x GROUP BY theta)""")
def skill_by_threshold(t: Tables):
    shares = M.threshold_shares(M.fit_mapper(t.train_labels()), list(SKILL_THETAS))
    out = S.skill_from_sums(forecasts(t, exceed=True), shares, NAMES, "climatology")
    return out.select("theta", "events", *_r("event_rate", "bss_constant", "bss_persistence"))


T1 = [f"t1_rain_{m}" for m in TRAILING_SLOTS] + ["t1_max5_30", "t1_wet_slots_60", "t1_trend_30", "t1_min_since_rain", "t1_missing_120"]


def signal_sql(source: str, features: list[str]) -> str:
    """Direction and areas of single features; ``source`` has the features, ``label`` and ``regime``."""
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, CAST(label > 0 AS INTEGER) AS event, regime FROM {source}" for f in features)
    rows = f"""(SELECT b.feature, b.direction, s.subset, CAST(b.value * b.direction AS DOUBLE) AS score, b.event FROM
 (SELECT *, CASE WHEN round(avg(CASE WHEN event = 1 THEN value END) OVER (PARTITION BY feature) - avg(CASE WHEN event = 0 THEN value END) OVER (PARTITION BY feature), 9) < 0 THEN -1 ELSE 1 END AS direction
  FROM ({long}) WHERE value IS NOT NULL) b
 JOIN (VALUES ('all'), ('dry_now')) s(subset) ON s.subset = 'all' OR b.regime = 'dry_now')"""
    return f"""SELECT feature, direction, round(max(CASE WHEN subset = 'all' THEN auc_pr END), 6) AS auc_pr_all, round(max(CASE WHEN subset = 'dry_now' THEN auc_pr END), 6) AS auc_pr_dry
FROM {_auc_sql(rows, 'feature, direction, subset')} GROUP BY feature, direction"""


@query("feature_signal", "A37", signal_sql("(SELECT * EXCLUDE (year) FROM g_train JOIN (SELECT * EXCLUDE (year) FROM g_t1) USING (station_id, slot))", T1))
def feature_signal(t: Tables):
    rows = t.train_labels().drop("year").join(t.trailing(), ["station_id", "slot"])
    return S.feature_signal(rows, T1).select("feature", "direction", *_r("auc_pr_all", "auc_pr_dry"))


@query("peak_event", "A43 O02", "SELECT station_id, slot, ts, y_mm FROM g_labels ORDER BY y_mm DESC, slot, station_id DESC LIMIT 1")
def peak_event(t: Tables):
    return S.peak_event(t.labels())


@query("storm_window", "R08 A43", """
WITH pk AS (SELECT station_id, slot FROM g_val ORDER BY y_mm DESC, slot, station_id DESC LIMIT 1)
SELECT slot, past30_mm, y_mm, round(max(CASE WHEN forecast = 'persistence' THEN e0 END), 6) AS p_any, round(max(CASE WHEN forecast = 'persistence' THEN e5 END), 6) AS p_5
FROM g_fc f JOIN pk ON f.station_id = pk.station_id AND f.slot BETWEEN pk.slot - 24 AND pk.slot + 12 GROUP BY ALL""".replace("SELECT slot,", "SELECT f.slot,"))
def storm_window(t: Tables):
    rows = S.around_peak(forecasts(t, exceed=True))
    return rows.select("slot", "past30_mm", "y_mm", *[F.round(F.col("persistence")[j], 6).alias(n) for j, n in ((0, "p_any"), (5, "p_5"))])


@query("first_crossing", "A42", f"""
WITH pk AS (SELECT station_id, slot FROM g_val ORDER BY y_mm DESC, slot, station_id DESC LIMIT 1)
SELECT min(CASE WHEN y_mm > 5 THEN ts END) AS onset, {", ".join(f"min(CASE WHEN forecast = '{n}' AND e0 >= 0.5 THEN ts END) AS first_{n}" for n in NAMES)}
FROM g_fc f JOIN pk ON f.station_id = pk.station_id AND f.slot BETWEEN pk.slot - 24 AND pk.slot + 12""")
def first_crossing(t: Tables):
    crossed = S.first_crossing(S.around_peak(forecasts(t, exceed=True)), NAMES, j=0)
    onset = S.first_crossing(S.around_peak(forecasts(t, exceed=True)), [], j=5)
    return crossed.drop("onset").withColumn("onset", onset.select("onset").scalar())
