"""Named queries: model tables, Spark ML models and serving."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from gaugegrid.operators import assembly as AS
from gaugegrid.operators import baselines as B
from gaugegrid.operators import inference as I
from gaugegrid.operators import mapper as MP
from gaugegrid.operators import models as M
from gaugegrid.operators import neighbours as N
from gaugegrid.operators import scoring as S
from gaugegrid.operators import serve as SV
from gaugegrid.operators.trailing import observed_rows
from gaugegrid.plans import feature_plans as FP
from gaugegrid.plans import score_plans as SP
from gaugegrid.plans import sqltext
from gaugegrid.plans.registry import query
from gaugegrid.plans.sqltext import season_sql
from gaugegrid.settings import BAND_CUTS, STATION_FEATURES, T2_COLUMNS
from gaugegrid.sources.fixtures import GRID, TEST_FROM, VALIDATION_FROM, Tables
from gaugegrid.sources.session import stored, use_checkpoints
from gaugegrid.sources.sinks import write_bucketed
from gaugegrid.sources.store import FIT_BYTES, Store, content_key, digest

KEEP = 0.25
#: Settings of the final fits, as chosen by the tuning and the screening on the full data; trees of every forest.
TREES = 150
LR_SPEC = {"reg": 1e-6, "bands": True}
RF_SPEC = {"max_depth": 24, "min_instances": 50, "feature_subset": "onethird", "max_bins": 256, "impurity": "entropy"}


def assembled(t: Tables):
    observed = observed_rows(t.readings(), GRID)
    stations, labels = t.stations(), observed.where("label is not null")
    statics = N.station_statics(labels.where(F.col("slot") < VALIDATION_FROM), stations)
    return AS.assemble(labels, statics, N.neighbour_features(observed, stations, GRID))


def _store(t: Tables) -> Store:
    use_checkpoints(t.spark)
    return Store(t.spark)


def _key(t: Tables) -> str:
    """What the model table depends on: the events, the grid and the splits."""
    return digest("assembled", content_key(t.table("events")), repr(GRID), VALIDATION_FROM, TEST_FROM)


def _model_table(t: Tables):
    """The model table, made once for all queries on the same events."""
    return _store(t).table("assembled", _key(t), lambda: assembled(t))


def _parts(t: Tables):
    """Sampled training rows, validation rows and test rows."""
    rows = _model_table(t)
    parts = AS.chronological_split(rows, "slot", VALIDATION_FROM, TEST_FROM)
    return AS.stratified_sample(parts["train"].drop("w"), KEEP), parts["val"], parts["test"]


def _fit(t: Tables, name: str):
    """Fits that are made once for the same rows and settings."""
    store = _store(t)
    return lambda pipeline, rows: store.model(name, pipeline, rows)


def _lr(features):
    return M.logistic_pipeline(features, **LR_SPEC)


def _rf(features):
    return M.forest_pipeline(features, trees=TREES, **RF_SPEC)


_T3 = "t3.* EXCLUDE (station_id, slot, year)"
_CAL = ", ".join(f"round(sin(2 * pi() * {k} * h), 6) AS t0_hod_s{k}, round(cos(2 * pi() * {k} * h), 6) AS t0_hod_c{k}" for k in (1, 2, 3)) + ", " + ", ".join(
    f"round(sin(2 * pi() * {k} * d), 6) AS t0_doy_s{k}, round(cos(2 * pi() * {k} * d), 6) AS t0_doy_c{k}" for k in (1, 2))


C = sqltext.CTES
C["g_assembled"] = f"""
SELECT l.station_id, l.slot, ts, l.year, y_mm, label, 1.0::DOUBLE AS w, past30_mm, regime, round(x.x_km, 6) AS t0_x_km, round(x.y_km, 6) AS t0_y_km,
  round(r.t0_wet_ratio, 6) AS t0_wet_ratio, round(r.t0_heavy_ratio, 6) AS t0_heavy_ratio, {_CAL}, CAST({season_sql("month(ts)")} AS DOUBLE) AS t0_season,
  t1.* EXCLUDE (station_id, slot, year), t2.* EXCLUDE (station_id, slot, year), {_T3}
FROM (SELECT *, (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE AS h, (dayofyear(ts) - 1 + (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE) / 366 AS d FROM g_labels) l
JOIN g_xy x USING (station_id) JOIN g_ratios r ON r.station_id = l.station_id
LEFT JOIN g_t1 t1 ON t1.station_id = l.station_id AND t1.slot = l.slot LEFT JOIN g_t2 t2 ON t2.station_id = l.station_id AND t2.slot = l.slot
LEFT JOIN g_t3 t3 ON t3.station_id = l.station_id AND t3.slot = l.slot"""


@query("assembled", "J05 J06 D12 S11 M01", "SELECT * FROM g_assembled")
def assembled_table(t: Tables):
    return _rounded_statics(assembled(t))


def _bucketed(t: Tables, name: str, rows, buckets: int):
    """The rows as a bucketed table of the session, written once for the same events."""
    table = f"gaugegrid_{name}_{_key(t)}_{buckets}"
    if not t.spark.catalog.tableExists(table):
        write_bucketed(rows, table, f"{use_checkpoints(t.spark)}/{table}-{uuid.uuid4().hex}", buckets)
    return t.spark.table(table)


def assembled_from_tables(t: Tables):
    """The model table from a table of labels and trailing features and one of neighbourhood features, bucketed alike, ``FIT_BYTES`` a bucket."""
    buckets = max(8, -(-t.readings().count() * len(_SIGNALS) * 8 // FIT_BYTES))
    observed = observed_rows(t.readings(), GRID).withColumn("year", F.year("ts"))
    stations = t.stations()
    rows = _bucketed(t, "observed", observed, buckets)
    tiers = _bucketed(t, "neighbours", N.neighbour_features(observed, stations, GRID), buckets)
    labels = rows.where("label is not null")
    statics = stored(N.station_statics(labels.where(F.col("slot") < VALIDATION_FROM), stations))  # of known size, so the optimizer sees that it is small
    return AS.assemble(labels, statics, tiers)


@query("assembled_bucketed", "J05 J06 S11", "SELECT * FROM g_assembled")
def assembled_bucketed(t: Tables):
    return _rounded_statics(assembled_from_tables(t))


def _rounded_statics(rows):
    rounded = [c for c in rows.columns if c.startswith("t0_") and c != "t0_season"]
    return rows.select(*[(F.round(c, 6) + 0.0).alias(c) if c in rounded else c for c in rows.columns])


_STATIC = [*STATION_FEATURES, *[f"t0_{p}_{w}{k}" for p, ks in (("hod", (1, 2, 3)), ("doy", (1, 2))) for k in ks for w in ("s", "c")], "t0_season"]
_SIGNALS = _STATIC + SP.T1 + list(T2_COLUMNS) + FP._CHANGES + FP._UPSTREAM
C["g_drawn"] = f"""SELECT * FROM g_assembled WHERE slot < {VALIDATION_FROM} AND ('0x' || substr(md5('42|' || station_id || '|' || slot), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2"""


@query("feature_signal_tiers", "A37 O08", f"""
SELECT * FROM ({SP.signal_sql("g_drawn", _SIGNALS)})
UNION ALL SELECT 'event_rate', 0, round(avg(CAST(label > 0 AS INTEGER)), 6), round(avg(CASE WHEN regime = 'dry_now' THEN CAST(label > 0 AS INTEGER) END), 6) FROM g_drawn""")
def feature_signal_tiers(t: Tables):
    """All features of the four tiers on a fifth of the training rows, beside what no skill reaches."""
    train = AS.chronological_split(_rounded_statics(_model_table(t)), "slot", VALIDATION_FROM, TEST_FROM)["train"]
    rows = AS.bernoulli_sample(train, 0.2)
    found = S.feature_signal(rows, AS.feature_columns(rows.columns)).unionByName(S.event_rate_row(rows))
    return found.select("feature", "direction", *[F.round(c, 6).alias(c) for c in ("auc_pr_all", "auc_pr_dry")])


_SAMPLE = f"""SELECT station_id, slot, label, CASE WHEN label = 0 THEN {1 / KEEP} ELSE 1.0 END::DOUBLE AS w FROM g_train
WHERE label > 0 OR ('0x' || substr(md5('42|' || station_id || '|' || slot), 1, 8))::BIGINT / 4294967296.0::DOUBLE < {KEEP}"""


@query("stratified_sample", "O07 O06", _SAMPLE)
def stratified_sample(t: Tables):
    return AS.stratified_sample(t.train_labels(), KEEP).select("station_id", "slot", "label", "w")


@query("bernoulli_sample", "O08", "SELECT station_id, slot FROM g_labels WHERE ('0x' || substr(md5('42|' || station_id || '|' || slot), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2")
def bernoulli_sample(t: Tables):
    return AS.bernoulli_sample(t.labels(), 0.2).select("station_id", "slot")


@query("split_summary", "A19 O06 O04", f"""
SELECT part, count(*) AS rows, count(*) FILTER (label > 0) AS wet_rows, sum(w) AS sum_w, round(sum(w * CAST(label > 0 AS INTEGER)) / sum(w), 6) AS weighted_wet_share FROM (
 SELECT 'train' AS part, label, w FROM ({_SAMPLE}) UNION ALL SELECT 'val', label, 1 FROM g_val UNION ALL SELECT 'test', label, 1 FROM g_test) GROUP BY part""")
def split_summary(t: Tables):
    parts = AS.chronological_split(t.labels(), "slot", VALIDATION_FROM, TEST_FROM)
    parts["train"] = AS.stratified_sample(parts["train"], KEEP)
    rows = None
    for name, part in parts.items():
        part = part if "w" in part.columns else part.withColumn("w", F.lit(1.0))
        part = part.select(F.lit(name).alias("part"), "label", "w")
        rows = part if rows is None else rows.unionByName(part)
    return AS.split_summary(rows, "part").withColumn("weighted_wet_share", F.round("weighted_wet_share", 6))


def _scored(rows):
    numbers = [f"p{k}" for k in range(9)]
    return rows.select("station_id", "slot", "label", *[F.round(F.col("probs")[k], 6).alias(n) for k, n in enumerate(numbers)])


@query("lr_forecast", "M02 M03 M04 M05 M06 M07 U03")
def lr_forecast(t: Tables):
    train, val, _ = _parts(t)
    model = _fit(t, "LR-train")(_lr(AS.feature_columns(train.columns)), train)
    return _scored(M.class_probabilities(model, val, "station_id", "slot", "label"))


@query("rf_forecast", "M08")
def rf_forecast(t: Tables):
    train, val, _ = _parts(t)
    model = _fit(t, "RF-train")(_rf(AS.feature_columns(train.columns)), train)
    return _scored(M.class_probabilities(model, val, "station_id", "slot", "label"))


@query("tuning", "M09")
def tuning(t: Tables):
    train, val, _ = _parts(t)
    return M.tune_logistic(train, val, AS.feature_columns(train.columns), fit=_store(t).fit)


@query("forest_screening", "M10 O02")
def forest_screening(t: Tables):
    """All five settings of the grid."""
    train, val, _ = _parts(t)
    return M.screen_forest(train, val, AS.feature_columns(train.columns), TREES, fit=_fit(t, "RF-screening"))


@query("tier_ablation", "M11 R10")
def tier_ablation(t: Tables):
    train, val, _ = _parts(t)
    return M.tier_ablation(train, val, {"LR": _lr, "RF": _rf}, _fit(t, "tiers"))


_LR_FEATURES = ["t1_rain_30", "t1_trend_30", "t0_season", "t0_hod_s1", "t0_hod_c1"]


@query("lr_inputs", "M02 M03 M04 M05 M06", f"""
WITH i AS (
  SELECT station_id, slot, ln(1 + t1_rain_30) AS log_t1_rain_30, sign(t1_trend_30) * ln(1 + abs(t1_trend_30)) AS log_t1_trend_30,
    round(sin(2 * pi() * h), 6) AS t0_hod_s1, round(cos(2 * pi() * h), 6) AS t0_hod_c1, CAST(season = 0 AS DOUBLE) AS season_0,
    CAST(season = 1 AS DOUBLE) AS season_1, len(list_filter({list(BAND_CUTS["t1_rain_30"])}, lambda c: c <= t1_rain_30)) AS band
  FROM (SELECT station_id, slot, ts, (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE AS h, {season_sql("month(ts)")} AS season FROM g_labels) JOIN g_t1 USING (station_id, slot)
)
SELECT station_id, slot, round(log_t1_rain_30 / (SELECT stddev_samp(log_t1_rain_30) FROM i), 6) AS log_t1_rain_30,
  round(log_t1_trend_30 / (SELECT stddev_samp(log_t1_trend_30) FROM i), 6) AS log_t1_trend_30, season_0, season_1,
  {", ".join(f"CAST(band = {k} AS DOUBLE) AS t1_rain_30_band_{k}" for k in range(len(BAND_CUTS["t1_rain_30"])))},
  {", ".join(f"round(season_{c} * t0_hod_{w}, 6) AS season_{c}_t0_hod_{w}" for c in (0, 1) for w in ("s1", "c1"))}
FROM i""")
def lr_inputs(t: Tables):
    """The linear terms of some features of each kind; the logged ones divided by their standard deviation, as before a fit."""
    terms = M.linear_terms(_LR_FEATURES, bands=True)
    rows = assembled(t).selectExpr("station_id", "slot", *[f"{sql} AS {name}" for name, sql in terms.items()])
    scale = {n: rows.select(F.stddev_samp(n)).scalar() for n in ("log_t1_rain_30", "log_t1_trend_30")}
    values = [F.round(F.col(n) / scale[n], 6) if n in scale else F.round(F.col(n), 6) for n in terms if n not in ("t0_hod_s1", "t0_hod_c1")]
    return rows.select("station_id", "slot", *[(v + 0.0).alias(n) for v, n in zip(values, [n for n in terms if n not in ("t0_hod_s1", "t0_hod_c1")])])


def _final(t: Tables, *names: str):
    """The final models of these names, fitted on training and validation rows; features, those rows, test rows."""
    train, val, test = _parts(t)
    rows, features = train.unionByName(val), AS.feature_columns(train.columns)
    pipelines = {"LR": _lr, "RF": _rf}
    models = M.at_once(t.spark, [partial(_fit(t, f"{name}-final"), pipelines[name](features), rows) for name in names])
    return dict(zip(names, models)), features, rows, test


@query("importance", "M13 M12 O04")
def importance(t: Tables):
    models, features, _, _ = _final(t, "RF")
    return M.importance(models["RF"], features, t.spark)


@query("tier_permutation", "O10")
def tier_permutation(t: Tables):
    models, _, _, test = _final(t, "LR", "RF")
    return M.tier_permutation(models, test, keep=1.0)


@query("final_scores", "M12 M14 A25")
def final_scores(t: Tables):
    """Scores by regime of both refitted models on the test rows."""
    models, _, _, test = _final(t, "LR", "RF")
    out = None
    for name, model in models.items():
        rows = M.class_probabilities(model, test, "label", "w", "regime")
        table = S.score(S.with_subsets(rows), "subset", weight="w").withColumn("model", F.lit(name))
        out = table if out is None else out.unionByName(table)
    return out


def publish(t: Tables) -> None:
    """Put what serving needs into the store: the final forest and the mapper of its rows."""
    _, _, rows, _ = _final(t, "RF")
    _store(t).table("mapper", _key(t), lambda: MP.fit_mapper(rows, F.col("w")))


def served_by_newest(t: Tables, asked):
    """Chances by the forest that was published last and its mapper; nothing is fitted."""
    store = _store(t)
    model, mapper = store.newest_model("RF-final"), t.spark.read.parquet(store.entries("tables", "mapper")[-1])
    return SV.serve_model(asked, _parts(t)[2], model, mapper, GRID)


@query("serve_many", "M15 J15 J16 P22")
def serve_many(t: Tables):
    """Ask for every test-period event at its own time, at three thresholds; a session that has published its models only loads them."""
    asked = (
        t.gauge_events().where(F.col("slot") >= TEST_FROM)
        .select("station_id", F.col("ts").alias("at"), F.explode(F.array(F.lit(0.0), F.lit(3.0), F.lit(10.0))).alias("theta"))
    )
    publish(t)
    return SV.with_outcome(served_by_newest(t, asked), t.labels(), GRID)


def _five(t: Tables):
    """Test rows with the probabilities of the three counting forecasts and of both models, all fitted on the rows before; made once."""
    return _store(t).table("five", digest(_key(t), LR_SPEC, RF_SPEC, TREES, SP.STRENGTH), lambda: _five_built(t))


def _five_built(t: Tables):
    models, _, _, test = _final(t, "LR", "RF")
    before = t.labels().where(F.col("slot") < TEST_FROM)
    rows = test.select("station_id", "slot", "ts", "y_mm", "label", "past30_mm", "regime")
    rows = B.predict_climatology(B.fit_climatology(before, SP.STRENGTH), rows, "climatology")
    rows = B.predict_persistence(B.fit_persistence(before), B.predict_constant(B.fit_constant(before), rows, "constant"), "persistence")
    for name, model in models.items():
        rows = rows.join(M.class_probabilities(model, test, "station_id", "slot").withColumnRenamed("probs", name), ["station_id", "slot"])
    return rows


FIVE = [*SP.NAMES, "LR", "RF"]
#: Resampled days of the intervals.
RESAMPLES = 2000


@query("five_scores", "M14 A25")
def five_scores(t: Tables):
    """All scores of the five forecasts on the test rows, by regime."""
    long = S.side_by_side(_five(t), FIVE, ["station_id", "slot", "label", "regime"])
    return S.score(S.with_subsets(long), "forecast", "subset")


@query("five_bootstrap", "O11 M14")
def five_bootstrap(t: Tables):
    """RPS of the five forecasts over resampled days, and what the forest gains on the regression and on persistence."""
    rows = _five(t).select("ts", "label", *[S.exceedances(F.col(n)).alias(n) for n in FIVE])
    daily = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), *[F.sum(S.rps(n)).alias(n) for n in FIVE])
    return I.block_bootstrap(daily, FIVE, RESAMPLES, [("RF", "LR"), ("RF", "persistence")])


@query("serve_counting", "M15 J15 J16 P22", f"""
SELECT a.station_id, a.at, x.theta, f.ts AS from_time, round({SP._exceed()}, 6) AS p, f.y_mm FROM (
  SELECT station_id, ts AS at, slot FROM g_events WHERE slot BETWEEN {VALIDATION_FROM} AND {TEST_FROM - 1}) a
CROSS JOIN {SP._theta_cte((0.0, 3.0, 10.0))} x LEFT JOIN (SELECT * FROM g_fc WHERE forecast = 'climatology') f ON f.station_id = a.station_id AND f.slot = a.slot""")
def serve_counting(t: Tables):
    """Every event of the validation period asks the climatology for its own time, at three thresholds."""
    asked = t.gauge_events().where(F.col("slot").between(VALIDATION_FROM, TEST_FROM - 1))
    asked = asked.select("station_id", F.col("ts").alias("at"), F.explode(F.array(F.lit(0.0), F.lit(3.0), F.lit(10.0))).alias("theta"))
    forecast = SP.forecasts(t).select("station_id", "slot", S.exceedances(F.col("climatology")).alias("exc"))
    served = SV.with_outcome(SV.serve(asked, forecast, MP.fit_mapper(t.train_labels()), GRID), t.labels(), GRID)
    return served.select("station_id", "at", "theta", F.when(F.col("p").isNotNull(), F.col("from_time")).alias("from_time"), F.round("p", 6).alias("p"), "y_mm")


@query("feature_columns", "M01 S07", "SELECT * FROM (VALUES ('t0', 15), ('t1', 11), ('t2', 15), ('t3', 17)) v(tier, columns) WHERE (SELECT count(*) FROM g_labels) > 0")
def feature_count(t: Tables):
    rows = assembled(t)
    counts = F.array(*[F.struct(F.lit(p).alias("tier"), F.lit(len(AS.feature_columns(rows.columns, (p,)))).alias("columns")) for p in AS.TIERS])
    return rows.agg(F.count("*").alias("n")).where("n > 0").select(F.explode(counts).alias("c")).select("c.*")
