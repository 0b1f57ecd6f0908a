"""Queries that train.

The models of m1_logistic to m10 and x8 have no SQL twin; tests run them on a small
frame. The twins of `*_table` and `*_scores` train the same model in SQL, on few
columns: the logistic optimum by Newton's method, boosted stumps round by round.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators import calibration, guards
from stopflow.operators import metrics as M
from stopflow.operators.features import cause_features
from stopflow.operators.graph import betweenness
from stopflow.operators.splits import with_split
from stopflow.plans import causes, model_tables, training
from stopflow.plans.adapter import EVENT_SPLITS, Tables
from stopflow.plans.catalog.features import feature_store
from stopflow.plans.registry import query
from stopflow.session import checkpointed, scratch_path, written


# Numbers of the test tables that no feed has.
HELPERS = ("seq", "k", "user_id", "delay_int")


def store(t: Tables):
    """Feature store with splits, written once: several fits read it, each its columns only."""
    return written(with_split(feature_store(t), splits=EVENT_SPLITS), "store")


def columns_for(data, scenario: str) -> list[str]:
    return [c for c in guards.model_columns(data, scenario) if c not in HELPERS]


def _summary(model: training.StopModel, data):
    test = model.score(data.where("split = 'test'")).withColumns({"model": F.lit(model.name), "scenario": F.lit(model.scenario)})
    out = M.full_metrics(test, ["model", "scenario"])
    return out.withColumns({c: C.r6(c) for c in out.columns if c not in ("model", "scenario", "n")})


def _summaries(data, names: Sequence[str]):
    """One row per model and scenario."""
    facts = training.TrainFacts.of(data, [c for s in "AB" for c in columns_for(data, s)])
    rows = [_summary(training.fit(name, data, s, columns_for(data, s), facts), data) for name in names for s in "AB"]
    return reduce(DataFrame.unionByName, rows)


@query("m1_logistic")
def m1(t: Tables):
    return _summaries(store(t), ["logreg"])


@query("m2_boosted_trees")
def m2(t: Tables):
    return _summaries(store(t), ["boost_deep", "boost_shallow"])


# -- the same training in SQL ---------------------------------------------------------

LINEAR_COLUMNS = ["weather_severity", "position_norm"]
STUMP_COLUMNS = ["weather_severity", "train_class_code", "hour_of_day", "day_of_week"]
STUMP_ROUNDS = 3
FRAME_SQL = """fr AS MATERIALIZED (SELECT seq, split, y_stop, weather_severity::DOUBLE AS weather_severity, position_norm, train_class_code::DOUBLE AS train_class_code,
      hour(scheduled_time)::DOUBLE AS hour_of_day, (isodow(date) - 1)::DOUBLE AS day_of_week FROM positioned),
    pw AS (SELECT greatest(1.0::DOUBLE, sum(1 - y_stop)::DOUBLE / sum(y_stop)) AS pos_weight FROM fr WHERE split = 'train'),
    tr AS MATERIALIZED (SELECT fr.*, CASE WHEN y_stop = 1 THEN pos_weight ELSE 1.0::DOUBLE END AS w FROM fr, pw WHERE split = 'train')"""


def stop_frame(t: Tables):
    """Stops with their split and a few columns of the feature store."""
    df = with_split(t.positioned, splits=EVENT_SPLITS).where("split IS NOT NULL")
    return checkpointed(df.select("seq", "split", "y_stop", "weather_severity", "position_norm", "train_class_code", F.hour("scheduled_time").alias("hour_of_day"), F.weekday("date").alias("day_of_week")))


def _newton_sql(rounds: int = 9) -> str:
    """Newton's method for intercept and two columns; the penalty is that of a mean
    loss with a share of 1/n, on standardised columns."""
    x, z = LINEAR_COLUMNS
    parts = [f"""st AS (SELECT sum(w) AS sw, count(*) AS n, sum(w * {x}) / sum(w) AS mx, sum(w * {z}) / sum(w) AS mz, sum(w) - sum(w * w) / sum(w) AS den FROM tr),
    lam AS (SELECT sw, sum(w * ({x} - mx) * ({x} - mx)) / any_value(den) / any_value(n) AS lx, sum(w * ({z} - mz) * ({z} - mz)) / any_value(den) / any_value(n) AS lz FROM tr, st GROUP BY sw),
    b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"""]
    for k in range(rounds):
        parts.append(f"""h{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sum(g) / any_value(sw) AS ga, sum(g * x) / any_value(sw) + any_value(lx * b) AS gb, sum(g * z) / any_value(sw) + any_value(lz * c) AS gc,
      sum(v) / any_value(sw) AS haa, sum(v * x) / any_value(sw) AS hab, sum(v * z) / any_value(sw) AS hac, sum(v * x * x) / any_value(sw) + any_value(lx) AS hbb, sum(v * x * z) / any_value(sw) AS hbc, sum(v * z * z) / any_value(sw) + any_value(lz) AS hcc
      FROM (SELECT *, w * (p - y_stop) AS g, w * p * (1 - p) AS v FROM (SELECT *, {x} AS x, {z} AS z, 1 / (1 + exp(-(a + b * {x} + c * {z}))) AS p FROM tr, b{k}, lam))),
    b{k + 1} AS (SELECT a - (ga * (hbb * hcc - hbc * hbc) - gb * (hab * hcc - hac * hbc) + gc * (hab * hbc - hac * hbb)) / det AS a,
      b - (-ga * (hab * hcc - hbc * hac) + gb * (haa * hcc - hac * hac) - gc * (haa * hbc - hab * hac)) / det AS b,
      c - (ga * (hab * hbc - hbb * hac) - gb * (haa * hbc - hab * hac) + gc * (haa * hbb - hab * hab)) / det AS c
      FROM (SELECT *, haa * (hbb * hcc - hbc * hbc) - hab * (hab * hcc - hbc * hac) + hac * (hab * hbc - hbb * hac) AS det FROM h{k}))""")
    return ",\n    ".join(parts) + f",\n    beta AS MATERIALIZED (SELECT * FROM b{rounds})"


def _logistic(t: Tables):
    data = stop_frame(t)
    model = training.fit("logreg", data, "B", LINEAR_COLUMNS, rounds=500, tol=1e-12)
    return data, model_tables.linear_table(model_tables.classifier_of(model.pipeline), LINEAR_COLUMNS, t.spark)


@query("m1_logistic_table", f"""
    WITH {FRAME_SQL}, {_newton_sql()}
    SELECT NULL AS feature, round(a, 4) AS coefficient FROM beta UNION ALL SELECT '{LINEAR_COLUMNS[0]}', round(b, 4) FROM beta UNION ALL SELECT '{LINEAR_COLUMNS[1]}', round(c, 4) FROM beta""", "positioned")
def m1_table(t: Tables):
    return _logistic(t)[1].withColumn("coefficient", F.round("coefficient", 4))


@query("m1_logistic_scores", f"""
    WITH {FRAME_SQL}, {_newton_sql()}
    SELECT seq, round(1 / (1 + exp(-(a + b * {LINEAR_COLUMNS[0]} + c * {LINEAR_COLUMNS[1]}))), 5) AS p_disrupted FROM fr, beta WHERE split = 'test'""", "positioned")
def m1_scores(t: Tables):
    data, table = _logistic(t)
    return model_tables.score_linear(data.where("split = 'test'"), table, LINEAR_COLUMNS).select("seq", F.round("p_disrupted", 5).alias("p_disrupted"))


def _stumps_sql(rounds: int = STUMP_ROUNDS, step: float = 0.1) -> str:
    """Boosted stumps on the logistic loss of labels -1 and 1: each round fits the
    slope of the loss by the cut with the largest loss of variance."""
    parts = ["f0 AS MATERIALIZED (SELECT *, 2.0 * y_stop - 1 AS y, 0.0::DOUBLE AS m FROM tr)"]
    pick = lambda t: f"CASE {t}.feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in STUMP_COLUMNS) + " END"
    for k in range(rounds):
        slope = "y" if k == 0 else "4 * y / (1 + exp(2 * y * m))"
        long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, w, r FROM r{k}" for c in STUMP_COLUMNS)
        parts.append(f"""r{k} AS MATERIALIZED (SELECT *, {slope} AS r FROM f{k}),
    v{k} AS (SELECT feature, v, count(*) AS n, sum(w) AS w, sum(w * r) AS s, sum(w * r * r) AS q FROM ({long}) GROUP BY ALL),
    c{k} AS (SELECT feature, (v + lead(v) OVER o) / 2 AS cut, sum(n) OVER o AS nl, sum(w) OVER o AS wl, sum(s) OVER o AS sl, sum(q) OVER o AS ql, sum(n) OVER p AS n, sum(w) OVER p AS w, sum(s) OVER p AS s, sum(q) OVER p AS q
      FROM v{k} WINDOW o AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
    t{k} AS MATERIALIZED (SELECT {k} AS tree, {1.0 if k == 0 else step}::DOUBLE AS weight, feature, cut, s / w AS root, sl / wl AS lv, (s - sl) / (w - wl) AS rv FROM c{k} WHERE cut IS NOT NULL AND nl >= 20 AND n - nl >= 20
      ORDER BY (q - s * s / w) - (ql - sl * sl / wl) - ((q - ql) - (s - sl) * (s - sl) / (w - wl)) DESC LIMIT 1),
    f{k + 1} AS MATERIALIZED (SELECT f{k}.* EXCLUDE (m), m + weight * CASE WHEN {pick(f't{k}')} <= cut THEN lv ELSE rv END AS m FROM f{k}, t{k})""")
    trees = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(rounds))
    return ",\n    ".join(parts) + f""",
    trees AS MATERIALIZED ({trees}),
    way AS MATERIALIZED (SELECT seq, tree, feature, weight, root, CASE WHEN {pick('trees')} <= cut THEN lv ELSE rv END AS leaf FROM fr, trees WHERE split = 'test')"""


def _stumps(t: Tables):
    data = stop_frame(t)
    model = training.fit("boost_shallow", data, "B", STUMP_COLUMNS, rounds=STUMP_ROUNDS, depth=1, share=1.0, early_stop=False)
    return data.where("split = 'test'"), model_tables.tree_table(model_tables.classifier_of(model.pipeline), STUMP_COLUMNS, t.spark)


@query("m2_boosted_table", f"""
    WITH {FRAME_SQL}, {_stumps_sql()}
    SELECT CAST(tree AS INTEGER) AS tree, 0 AS node, weight, feature, cut, round(root, 6) AS value FROM trees UNION ALL SELECT tree, 1, weight, NULL, NULL, round(lv, 6) FROM trees
    UNION ALL SELECT tree, 2, weight, NULL, NULL, round(rv, 6) FROM trees""", "positioned")
def m2_table(t: Tables):
    return _stumps(t)[1].select("tree", "node", "weight", "feature", "cut", C.r6("value").alias("value"))


@query("m2_boosted_scores", f"WITH {FRAME_SQL}, {_stumps_sql()} SELECT seq, round(1 / (1 + exp(-2 * sum(weight * leaf))), 6) AS p_disrupted FROM way GROUP BY seq", "positioned")
def m2_scores(t: Tables):
    test, nodes = _stumps(t)
    return model_tables.score_trees(test, nodes, STUMP_COLUMNS).select("seq", C.r6("p_disrupted").alias("p_disrupted"))


@query("x1_path_contributions", f"""
    WITH {FRAME_SQL}, {_stumps_sql()}
    SELECT seq, feature, round(sum(weight * (leaf - root)), 6) AS contribution FROM way GROUP BY seq, feature
    UNION ALL SELECT seq, NULL, round(sum(weight * root), 6) FROM way GROUP BY seq""", "positioned")
def x1_paths(t: Tables):
    test, nodes = _stumps(t)
    return model_tables.contributions(test, nodes, STUMP_COLUMNS, ["seq"]).withColumn("contribution", C.r6("contribution"))


@query("m3_graph_model")
def m3(t: Tables):
    data = store(t).drop(*HELPERS)
    stations = t.stations.join(betweenness(t.edges, t.stations), "station_id")
    rows = [_summary(*fitted) for fitted in training.fit_graph_models(data, stations, t.edges, "AB")]
    return reduce(DataFrame.unionByName, rows)


@query("m5_run_matrix")
def m5(t: Tables):
    out = training.run_matrix(store(t).drop(*HELPERS), scratch_path(t.spark, "runs"))
    return out.withColumns({c: C.r6(c) for c in out.columns if c not in ("model", "scenario", "n", "status")})


def cause_columns(data) -> list[str]:
    """All numbers that describe a stop that is known to be disrupted, its delay included."""
    return [c for c in guards.numeric_columns(data) if c not in (*HELPERS, "y_stop", "delay_minutes", "y_cause")]


def cause_data(t: Tables):
    df = with_split(feature_store(t), splits=EVENT_SPLITS)
    return written(causes.label_causes(cause_features(df), t.faults, country=None), "cause-data")


@query("m7_cause_models")
def m7(t: Tables):
    data = cause_data(t)
    models = causes.fit_models(data, cause_columns(data))
    out = causes.benchmark(models, data)
    return out.withColumns({"accuracy": C.r6("accuracy"), "macro_f1": C.r6("macro_f1")})


@query("m8_stacked_causes")
def m8(t: Tables):
    data = cause_data(t)
    models = causes.fit_models(data, cause_columns(data))
    stack = causes.fit_stack(models, data)
    out = causes.benchmark(models, data, stack)
    return out.withColumns({"accuracy": C.r6("accuracy"), "macro_f1": C.r6("macro_f1")})


@query("m10_transfer_scoring")
def m10(t: Tables):
    """Fit on NL causes, score disrupted stops of the other countries."""
    data = written(cause_features(with_split(feature_store(t), splits=EVENT_SPLITS)), "stops")
    labelled = written(causes.label_causes(data, t.faults, country="NL"), "cause-data")
    models = causes.fit_models(labelled, cause_columns(data))
    name = causes.pick_for_transfer(causes.benchmark(models, labelled))
    scored = models.score(data.where("y_stop = 1 AND country <> 'NL'"), name)
    return causes.transfer_summary(scored).withColumns({"share": C.r6("share"), "mean_confidence": F.round("mean_confidence", 3)})


@query("m10_overall_confidence", """
    SELECT country, count(*) AS n, round(avg(p_b), 6) AS overall_mean_confidence FROM predictions WHERE y_stop = 1 AND country <> 'NL' GROUP BY country""", "predictions")
def m10_overall(t: Tables):
    scored = t.predictions.where("y_stop = 1 AND country <> 'NL'").withColumn("pred_max_proba", F.col("p_b"))
    return causes.overall_confidence(scored).withColumn("overall_mean_confidence", C.r6("overall_mean_confidence"))


# the fit by its max-min formula: at each score the largest of the least means of what begins at or before it
ISOTONIC_SQL = """pt AS (SELECT p_disrupted AS p, avg(y_stop) AS y, count(*) AS w, row_number() OVER (ORDER BY p_disrupted) AS i FROM runs WHERE split = 'val' AND scenario = 'A' GROUP BY 1),
    c AS (SELECT *, sum(y * w) OVER (ORDER BY i) AS cy, sum(w) OVER (ORDER BY i) AS cw FROM pt),
    m AS (SELECT a.i AS lo, b.i AS hi, (b.cy - a.cy + a.y * a.w) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON b.i >= a.i),
    g AS (SELECT lo, hi AS k, min(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS v FROM m),
    iso AS MATERIALIZED (SELECT p, max(v) AS v FROM g JOIN pt ON pt.i = g.k GROUP BY p)"""


@query("e11_isotonic_calibration", f"""
    WITH {ISOTONIC_SQL},
    e AS (SELECT quantile_cont(p_disrupted, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM runs WHERE split = 'val' AND scenario = 'A'),
    bins AS (SELECT avg(p_disrupted) AS ms, avg(y_stop) AS sp FROM runs, e WHERE split = 'val' AND scenario = 'A' GROUP BY len(list_filter(q, lambda x: x < p_disrupted))),
    ece AS (SELECT avg(abs(sp - ms)) > 0.05 AS applied FROM bins),
    val AS (SELECT v, y_stop FROM runs JOIN iso ON iso.p = p_disrupted WHERE split = 'val' AND scenario = 'A'),
    grid AS (SELECT t / 100.0::DOUBLE AS t FROM (SELECT unnest(range(5, 100, 5)) AS t)),
    f AS (SELECT t, coalesce(2.0 * sum(y_stop) FILTER (WHERE v >= t) / (count(*) FILTER (WHERE v >= t) + sum(y_stop)), 0) AS f1 FROM val, grid GROUP BY t),
    best AS (SELECT arg_max(t, (f1, -t)) AS t FROM f),
    test AS (SELECT seq, p_disrupted AS raw, y_pred FROM runs WHERE split = 'test' AND scenario = 'A'),
    near AS (SELECT raw, max(p) FILTER (WHERE p <= raw) AS b, min(p) FILTER (WHERE p >= raw) AS a FROM (SELECT DISTINCT raw FROM test), iso GROUP BY raw),
    cal AS (SELECT raw, CASE WHEN b IS NULL THEN x.v WHEN a IS NULL OR a = b THEN y.v ELSE y.v + (x.v - y.v) * (raw - b) / (a - b) END AS p FROM near LEFT JOIN iso x ON x.p = a LEFT JOIN iso y ON y.p = b)
    SELECT seq, raw AS p_disrupted_raw, round(CASE WHEN applied THEN p ELSE raw END, 6) AS p_disrupted, CASE WHEN applied THEN CAST(p >= best.t AS INTEGER) ELSE y_pred END AS y_pred
    FROM test JOIN cal USING (raw), ece, best""", "runs")
def e11(t: Tables):
    val, test = (t.runs.where((F.col("split") == s) & (F.col("scenario") == "A")) for s in ("val", "test"))
    out, info = training.calibrate(val, test)
    if not info["applied"]:
        out = out.withColumn("p_disrupted_raw", F.col("p_disrupted"))
    return out.select("seq", "p_disrupted_raw", C.r6("p_disrupted").alias("p_disrupted"), "y_pred")


@query("e11_isotonic_fit", f"WITH {ISOTONIC_SQL} SELECT p, round(v, 6) AS calibrated FROM iso", "runs")
def e11_fit(t: Tables):
    val = t.runs.where((F.col("split") == "val") & (F.col("scenario") == "A"))
    points = val.select(F.col("p_disrupted").alias("p")).distinct()
    return calibration.apply(points, "p", calibration.blocks(val, "p_disrupted", "y_stop"), "calibrated").select("p", C.r6("calibrated").alias("calibrated"))


@query("x1_permutation_importance")
def x1_permutation(t: Tables):
    data = store(t)
    facts = training.TrainFacts.of(data, [c for s in "AB" for c in columns_for(data, s)])
    parts = []
    for s in "AB":
        model = training.fit("boost_shallow", data, s, columns_for(data, s), facts)
        parts.append(training.permutation_importance(model, data.where("split = 'test'"), ["seq"]).withColumn("scenario", F.lit(s)))
    return reduce(DataFrame.unionByName, parts).withColumn("drop", C.r6("drop"))


@query("x8_lag_ablation")
def x8(t: Tables):
    data = store(t).drop(*HELPERS)
    facts = training.shared_facts(data, "AB")
    out = reduce(DataFrame.unionByName, [training.lag_ablation(data, s, facts=facts) for s in "AB"])
    return out.withColumn("pr_auc", C.r6("pr_auc"))
