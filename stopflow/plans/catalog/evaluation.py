"""Queries of metrics, calibration, explanation, causes."""

from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators import explain as X
from stopflow.operators import features as feat
from stopflow.operators import metrics as M
from stopflow.operators import profiling as P
from stopflow.plans import dashboard
from stopflow.plans.adapter import Tables
from stopflow.plans.catalog.tables import CAUSE_SQL, station_day_causes
from stopflow.plans.registry import query

RUN = ["model", "scenario"]

POINTS_SQL = """pts AS (SELECT {g}, p_disrupted AS score, count(*) AS n, sum(y_stop) AS pos FROM {src} GROUP BY ALL),
    cur AS (SELECT *, sum(n) OVER d AS n_ge, sum(pos) OVER d AS tp, sum(n) OVER a AS n_all, sum(pos) OVER a AS n_pos FROM pts
            WINDOW d AS (PARTITION BY {g} ORDER BY score DESC), a AS (PARTITION BY {g}))"""


def points_sql(groups: str, src: str = "runs") -> str:
    return POINTS_SQL.format(g=groups, src=src)


@query("e1_pr_auc", f"WITH {points_sql('model, scenario')} SELECT model, scenario, round(sum(pos * tp / n_ge) / max(n_pos), 6) AS pr_auc FROM cur GROUP BY ALL", "runs")
def e1(t: Tables):
    return M.pr_auc(M.score_points(t.runs, RUN, "p_disrupted", "y_stop"), RUN).withColumn("pr_auc", C.r6("pr_auc"))


@query("e2_roc_auc", """
    WITH r AS (SELECT model, scenario, y_stop, (rank() OVER w + (rank() OVER w + count(*) OVER p - 1)) / 2.0 AS avg_rank FROM runs
               WINDOW w AS (PARTITION BY model, scenario ORDER BY p_disrupted), p AS (PARTITION BY model, scenario, p_disrupted))
    SELECT model, scenario, round((sum(avg_rank) FILTER (WHERE y_stop = 1) - sum(y_stop)::DOUBLE * (sum(y_stop) + 1) / 2) / (sum(y_stop)::DOUBLE * sum(1 - y_stop)), 6) AS roc_auc
    FROM r GROUP BY ALL""", "runs")
def e2(t: Tables):
    return M.roc_auc(M.score_points(t.runs, RUN, "p_disrupted", "y_stop"), RUN).withColumn("roc_auc", C.r6("roc_auc"))


COUNTS_SQL = """c AS (SELECT model, scenario, count(*) FILTER (WHERE y_stop = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_stop = 0 AND y_pred = 1) AS fp,
      count(*) FILTER (WHERE y_stop = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_stop = 0 AND y_pred = 0) AS tn FROM runs GROUP BY ALL)"""


@query("e3_threshold_metrics", f"""
    WITH {COUNTS_SQL} SELECT *, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""", "runs")
def e3(t: Tables):
    out = M.threshold_metrics(t.runs, RUN, "y_stop", "y_pred")
    return out.withColumns({c: C.r6(c) for c in ("f1", "precision", "recall", "accuracy")})


@query("e4_brier", "SELECT model, scenario, round(avg((p_disrupted - y_stop) * (p_disrupted - y_stop)) + 1e-9, 6) AS brier FROM runs GROUP BY ALL", "runs")
def e4(t: Tables):
    return M.brier(t.runs, RUN, "p_disrupted", "y_stop").withColumn("brier", C.r6(F.col("brier") + 1e-9))


BINS_SQL = """e AS (SELECT model, scenario, quantile_cont(p_disrupted, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM runs GROUP BY ALL),
    b AS (SELECT model, scenario, len(list_filter(q, lambda x: x < p_disrupted)) AS bin, count(*) AS n, avg(p_disrupted) AS mean_score, avg(y_stop) AS share_positive
          FROM runs JOIN e USING (model, scenario) GROUP BY ALL)"""


@query("e5_ece", f"WITH {BINS_SQL} SELECT model, scenario, round(avg(abs(share_positive - mean_score)), 6) AS ece FROM b GROUP BY ALL", "runs")
def e5(t: Tables):
    return M.ece(t.runs, RUN, "p_disrupted", "y_stop").withColumn("ece", C.r6("ece"))


def _by_group(t: Tables, column: str):
    out = M.metrics_by_group(t.runs, [*RUN, column])
    return out.withColumns({"pr_auc": C.r6("pr_auc"), "f1": C.r6("f1")})


def _by_group_sql(column: str, src: str = "runs") -> str:
    g = f"model, scenario, {column}"
    return f"""
    WITH {points_sql(g, src)}, r AS (SELECT {g}, max(n_all) AS n, max(n_pos) AS np, sum(pos * tp / n_ge) / max(n_pos) AS pr_auc FROM cur GROUP BY ALL),
    f AS (SELECT {g}, 2.0 * sum(y_stop * y_pred) / (sum(y_stop) + sum(y_pred)) AS f1 FROM {src} GROUP BY ALL)
    SELECT {g}, CAST(n AS BIGINT) AS n, round(pr_auc, 6) AS pr_auc, round(f1, 6) AS f1 FROM r JOIN f USING ({g}) WHERE np > 0 AND np < n"""


@query("e6_metrics_by_country", _by_group_sql("country"), "runs")
def e6_country(t: Tables):
    return _by_group(t, "country")


@query("e6_metrics_by_class", _by_group_sql("train_class_code"), "runs")
def e6_class(t: Tables):
    return _by_group(t, "train_class_code")


BUCKET_SQL = "CASE WHEN position_norm <= 0.25 THEN '0-25' WHEN position_norm <= 0.5 THEN '25-50' WHEN position_norm <= 0.75 THEN '50-75' ELSE '75-100' END"


@query("e6_metrics_by_position", "WITH rb AS (SELECT *, " + BUCKET_SQL + " AS pos_bucket FROM runs), " + _by_group_sql("pos_bucket", "rb").strip()[5:], "runs")
def e6_position(t: Tables):
    out = M.metrics_by_group(t.runs.withColumn("pos_bucket", C.position_bucket("position_norm")), [*RUN, "pos_bucket"])
    return out.withColumns({"pr_auc": C.r6("pr_auc"), "f1": C.r6("f1")})


@query("e6_full_metrics", f"""
    WITH {points_sql('model, scenario')}, {COUNTS_SQL}, {BINS_SQL},
    a AS (SELECT model, scenario, max(n_all) AS n, sum(pos * tp / n_ge) / max(n_pos) AS pr_auc,
            sum(pos * ((n_all - n_pos) - (n_ge - tp) + (n - pos) / 2.0)) / max(n_pos * (n_all - n_pos)::DOUBLE) AS roc_auc FROM cur GROUP BY ALL),
    br AS (SELECT model, scenario, avg((p_disrupted - y_stop) * (p_disrupted - y_stop)) AS brier FROM runs GROUP BY ALL),
    ec AS (SELECT model, scenario, avg(abs(share_positive - mean_score)) AS ece FROM b GROUP BY ALL)
    SELECT model, scenario, CAST(n AS BIGINT) AS n, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1,
      round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(brier + 1e-9, 6) AS brier, round(ece, 6) AS ece
    FROM a JOIN c USING (model, scenario) JOIN br USING (model, scenario) JOIN ec USING (model, scenario)""", "runs")
def e6_full(t: Tables):
    out = M.full_metrics(t.runs, RUN).withColumn("brier", F.col("brier") + 1e-9)
    return out.withColumns({c: C.r6(c) for c in ("pr_auc", "roc_auc", "f1", "precision", "recall", "brier", "ece")})


@query("e7_precision_at_recall", f"""
    WITH {points_sql('model, scenario')}, pr AS (SELECT model, scenario, score, tp / n_ge AS p, tp / n_pos AS r FROM cur)
    SELECT model, scenario, """ + ", ".join(
        f"round(arg_min(p, (r, score)) FILTER (WHERE r >= {x}), 6) AS p_at_r{round(x * 100)}" for x in (0.7, 0.8, 0.9, 0.95)) + " FROM pr GROUP BY ALL", "runs")
def e7(t: Tables):
    out = M.precision_at_recall(M.score_points(t.runs, RUN, "p_disrupted", "y_stop"), RUN)
    return out.select(*RUN, *[C.r6(c).alias(c) for c in out.columns if c not in RUN])


@query("e8_curve_points", f"""
    WITH {points_sql('model, scenario')} SELECT model, scenario, score AS threshold, round(tp / n_ge, 6) AS precision, round(tp / n_pos, 6) AS recall,
      round((n_ge - tp) / (n_all - n_pos), 6) AS fpr FROM cur""", "runs")
def e8(t: Tables):
    out = M.curves(M.score_points(t.runs, RUN, "p_disrupted", "y_stop"), RUN)
    return out.withColumns({c: C.r6(c) for c in ("precision", "recall", "fpr")})


@query("e9_confusion", """
    SELECT model, scenario, y_stop AS actual, y_pred AS predicted, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY model, scenario, y_stop), 6) AS row_pct
    FROM runs GROUP BY model, scenario, y_stop, y_pred""", "runs")
def e9(t: Tables):
    return M.confusion(t.runs, RUN, "y_stop", "y_pred").withColumn("row_pct", C.r6("row_pct"))


@query("e10_reliability", f"WITH {BINS_SQL} SELECT model, scenario, CAST(bin AS INTEGER) AS bin, n, round(mean_score, 6) AS mean_score, round(share_positive, 6) AS share_positive FROM b", "runs")
def e10(t: Tables):
    out = M.reliability(t.runs, RUN, "p_disrupted", "y_stop")
    return out.withColumns({"mean_score": C.r6("mean_score"), "share_positive": C.r6("share_positive")})


@query("e12_cascading_respect", """
    WITH x AS (SELECT scenario, y_pred, lag(y_stop) OVER (PARTITION BY scenario, service_id ORDER BY stop_order) AS prev_y FROM runs)
    SELECT scenario, round(avg(y_pred) FILTER (WHERE prev_y = 1), 6) AS after_disrupted, round(avg(y_pred) FILTER (WHERE prev_y = 0), 6) AS after_on_time FROM x GROUP BY 1""", "runs")
def e12(t: Tables):
    rows = feat.previous_label(t.runs, key=["scenario", "service_id"])
    out = M.cascading_respect(rows, ["scenario"])
    return out.withColumns({c: C.r6(c) for c in ("after_disrupted", "after_on_time")})


@query("e13_position_bucket", f"SELECT seq, {BUCKET_SQL} AS bucket FROM positioned", "positioned")
def e13(t: Tables):
    return t.positioned.select("seq", C.position_bucket("position_norm").alias("bucket"))


def cause_scores(t: Tables):
    """Labelled causes with a formula in place of a model's answer, two models."""
    groups = sorted(["rolling stock", "infrastructure", "external", "accidents", "logistical", "engineering work", "staff", "weather", "unknown"])
    names = F.array(*[F.lit(g) for g in groups])
    base = t.predictions.where("y_stop = 1").join(station_day_causes(t), ["station_id", "date"])

    def guess(modulus: int):
        return F.when(F.col("seq") % modulus == 0, F.col("cause_group")).otherwise(F.get(names, (F.col("seq") % 8).cast("int")))

    models = F.explode(F.array(F.struct(F.lit("m1").alias("model"), guess(3).alias("pred_cause_group")),
                               F.struct(F.lit("m2").alias("model"), guess(2).alias("pred_cause_group"))))
    return base.withColumn("m", models).select("*", "m.*").drop("m").withColumn("pred_max_proba", ((F.col("seq") * 31) % 100) / 100.0)


SCORED_SQL = CAUSE_SQL + """,
    g AS (SELECT ['accidents', 'engineering work', 'external', 'infrastructure', 'logistical', 'rolling stock', 'staff', 'unknown', 'weather'] AS names),
    cs AS (SELECT p.*, c.cause_group, m.model, CASE WHEN seq % m.modulus = 0 THEN c.cause_group ELSE names[seq % 8 + 1] END AS pred_cause_group,
             ((seq * 31) % 100)::DOUBLE / 100.0::DOUBLE AS pred_max_proba
           FROM predictions p JOIN cause c USING (station_id, date), g, (VALUES ('m1', 3), ('m2', 2)) m(model, modulus) WHERE y_stop = 1)"""

CLASS_SQL = """sides AS (SELECT model, split, cause_group AS class, 1 AS s, 0 AS p, CAST(cause_group = pred_cause_group AS INT) AS h FROM cs
      UNION ALL SELECT model, split, pred_cause_group, 0, 1, 0 FROM cs),
    per AS (SELECT model, split, class, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits, 2.0 * sum(h) / (sum(s) + sum(p)) AS f1 FROM sides GROUP BY ALL)"""


@query("e14_class_table", f"WITH {SCORED_SQL}, {CLASS_SQL} SELECT model, split, class, support, predicted, hits, round(f1, 6) AS f1 FROM per", "predictions faults")
def e14(t: Tables):
    return M.class_table(cause_scores(t), ["model", "split"], "cause_group", "pred_cause_group").withColumn("f1", C.r6("f1"))


@query("e14_multiclass_summary", f"""
    WITH {SCORED_SQL}, {CLASS_SQL} SELECT model, split, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM per GROUP BY ALL""", "predictions faults")
def e14_summary(t: Tables):
    out = M.multiclass_summary(cause_scores(t), ["model", "split"], "cause_group", "pred_cause_group")
    return out.withColumns({"accuracy": C.r6("accuracy"), "macro_f1": C.r6("macro_f1")})


@query("e14_multiclass_confusion", f"WITH {SCORED_SQL} SELECT model, cause_group AS actual, pred_cause_group AS predicted, count(*) AS n FROM cs WHERE split = 'test' GROUP BY ALL", "predictions faults")
def e14_confusion(t: Tables):
    return M.confusion(cause_scores(t).where("split = 'test'"), ["model"], "cause_group", "pred_cause_group").drop("row_pct")


@query("e15_metric_extract", f"""
    WITH {points_sql('model, scenario')}, {COUNTS_SQL}, {BINS_SQL},
    a AS (SELECT model, scenario, sum(pos * tp / n_ge) / max(n_pos) AS pr_auc FROM cur GROUP BY ALL),
    br AS (SELECT model, scenario, avg((p_disrupted - y_stop) * (p_disrupted - y_stop)) AS brier FROM runs GROUP BY ALL),
    ec AS (SELECT model, scenario, avg(abs(share_positive - mean_score)) AS ece FROM b GROUP BY ALL)
    SELECT model, scenario, round(pr_auc, 4) AS test_pr_auc, round(2.0 * tp / (2 * tp + fp + fn), 4) AS test_f1, round(tp / (tp + fp), 4) AS test_precision,
      round(tp / (tp + fn), 4) AS test_recall, round(brier, 4) AS test_brier, round(ece, 4) AS test_ece
    FROM a JOIN c USING (model, scenario) JOIN br USING (model, scenario) JOIN ec USING (model, scenario)""", "runs")
def e15(t: Tables):
    return dashboard.metric_extract(M.full_metrics(t.runs, RUN))


@query("e15_cause_comparison", f"""
    WITH {SCORED_SQL}, {CLASS_SQL}, s AS (SELECT model, split, avg(f1) AS f FROM per GROUP BY ALL)
    SELECT split, round(max(f) FILTER (WHERE model = 'm1'), 6) AS m1, round(max(f) FILTER (WHERE model = 'm2'), 6) AS m2,
      round(max(f) FILTER (WHERE model = 'm2') - max(f) FILTER (WHERE model = 'm1'), 6) AS gain FROM s GROUP BY split""", "predictions faults")
def e15_causes(t: Tables):
    s = M.multiclass_summary(cause_scores(t), ["model", "split"], "cause_group", "pred_cause_group")
    wide = s.groupBy("split").pivot("model", ["m1", "m2"]).agg(F.max("macro_f1"))
    return wide.select("split", C.r6("m1").alias("m1"), C.r6("m2").alias("m2"), C.r6(F.col("m2") - F.col("m1")).alias("gain"))


@query("e16_group_model_pivot", f"""
    WITH {points_sql('scenario, country')}, r AS (SELECT scenario, country, sum(pos * tp / n_ge) / max(n_pos) AS v FROM cur GROUP BY ALL)
    SELECT country, round(max(v) FILTER (WHERE scenario = 'A'), 6) AS "A", round(max(v) FILTER (WHERE scenario = 'B'), 6) AS "B" FROM r GROUP BY country""", "runs")
def e16(t: Tables):
    groups = ["scenario", "country"]
    auc = M.pr_auc(M.score_points(t.runs, groups, "p_disrupted", "y_stop"), groups)
    wide = auc.groupBy("country").pivot("scenario", ["A", "B"]).agg(F.max("pr_auc"))
    return wide.select("country", C.r6("A").alias("A"), C.r6("B").alias("B"))


@query("e16_cause_share_by_country", f"""
    WITH {SCORED_SQL} SELECT country, pred_cause_group, round(count(*) / sum(count(*)) OVER (PARTITION BY country), 6) AS share FROM cs WHERE model = 'm1' GROUP BY country, pred_cause_group""",
       "predictions faults")
def e16_causes(t: Tables):
    from pyspark.sql import Window

    per = cause_scores(t).where("model = 'm1'").groupBy("country", "pred_cause_group").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("country"))
    return per.select("country", "pred_cause_group", C.r6(share).alias("share"))


@query("m4_threshold_tuning", """
    WITH g AS (SELECT CAST(unnest(generate_series(1, 19)) AS INTEGER) AS i),
    f AS (SELECT model, scenario, i, coalesce(2.0 * sum(y_stop) FILTER (WHERE p_disrupted >= round(i * 0.05, 2)::DOUBLE) / nullif(count(*) FILTER (WHERE p_disrupted >= round(i * 0.05, 2)::DOUBLE) + sum(y_stop), 0), 0) AS f1
          FROM runs, g WHERE split = 'val' GROUP BY ALL)
    SELECT model, scenario, round(arg_max(i, (f1, -i)) * 0.05, 2)::DOUBLE AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY ALL""", "runs")
def m4(t: Tables):
    out = M.tune_threshold(t.runs.where("split = 'val'"), RUN, "p_disrupted", "y_stop")
    return out.withColumn("f1", C.r6("f1"))


@query("m6_cause_labels", f"WITH {CAUSE_SQL} SELECT seq, split, cause_group FROM positioned JOIN cause USING (station_id, date) WHERE y_stop = 1 AND country = 'NL'", "positioned faults")
def m6(t: Tables):
    from stopflow.plans.causes import label_causes

    faults = t.faults.where("fault_id LIKE 'NL%'")
    return label_causes(t.predictions, faults, country="NL").select("seq", "split", "cause_group")


@query("m9_winner", f"""
    WITH {SCORED_SQL}, {CLASS_SQL}, s AS (SELECT model, avg(f1) AS f FROM per WHERE split = 'val' GROUP BY ALL)
    SELECT arg_min(model, (-f, model)) AS model, round(max(f), 6) AS macro_f1 FROM s""", "predictions faults")
def m9(t: Tables):
    s = M.multiclass_summary(cause_scores(t).where("split = 'val'"), ["model"], "cause_group", "pred_cause_group")
    return X.winner(s, [], "macro_f1", exclude=["mlp"]).withColumn("macro_f1", C.r6("macro_f1"))


@query("m10_transfer_distribution", f"""
    WITH {SCORED_SQL} SELECT country, pred_cause_group, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY country), 6) AS share,
      round(avg(pred_max_proba), 3) AS mean_confidence FROM cs WHERE model = 'm1' AND country <> 'NL' GROUP BY country, pred_cause_group""", "predictions faults")
def m10(t: Tables):
    from stopflow.plans.causes import transfer_summary

    scored = cause_scores(t).where("model = 'm1' AND country <> 'NL'")
    return transfer_summary(scored).withColumns({"share": C.r6("share"), "mean_confidence": F.round("mean_confidence", 3)})


# -- explanation ------------------------------------------------------------------------

WEIGHTS = {"temperature": -0.02, "wind_speed": 0.05, "weather_severity": 0.3, "stop_order": 0.1, "position_norm": -0.4, "train_class_code": 0.07, "n_total_stops": 0.015}

ATTR_SQL = """mean AS (SELECT avg(temperature) AS temperature, avg(wind_speed) AS wind_speed, avg(weather_severity) AS weather_severity, avg(stop_order) AS stop_order,
      avg(position_norm) AS position_norm, avg(train_class_code) AS train_class_code, avg(n_total_stops) AS n_total_stops FROM positioned),
    attr AS (""" + " UNION ALL ".join(
    f"SELECT p.seq, p.country, p.train_class_code AS cls, '{n}' AS feature, p.{n}::DOUBLE AS value, ({w})::DOUBLE * (p.{n} - m.{n}) AS attribution FROM positioned p, mean m"
    for n, w in WEIGHTS.items()) + ")"


def attributions(t: Tables, keep=("country",)):
    return X.linear_attributions(t.predictions, ["seq"], WEIGHTS, keep)


@query("x1_attributions", f"WITH {ATTR_SQL} SELECT seq, feature, value, round(attribution, 6) AS attribution FROM attr", "positioned")
def x1(t: Tables):
    out = attributions(t).select("seq", "feature", "value", C.r6("attribution").alias("attribution"))
    return out.withColumn("value", F.col("value"))


@query("x2_global_importance", f"WITH {ATTR_SQL} SELECT feature, round(avg(abs(attribution)), 6) AS mean_abs FROM attr GROUP BY 1 ORDER BY avg(abs(attribution)) DESC LIMIT 5", "positioned")
def x2(t: Tables):
    return X.top_features(attributions(t), 5).withColumn("mean_abs", C.r6("mean_abs"))


@query("x3_importance_by_group", f"""
    WITH {ATTR_SQL} SELECT country, feature, round(v, 6) AS mean_abs FROM (SELECT country, feature, avg(abs(attribution)) AS v,
      row_number() OVER (PARTITION BY country ORDER BY avg(abs(attribution)) DESC, feature) AS rn FROM attr GROUP BY country, feature) WHERE rn <= 4""", "positioned")
def x3(t: Tables):
    return X.top_per_group(attributions(t), "country", 4).withColumn("mean_abs", C.r6("mean_abs"))


@query("x3_group_pivot", f"""
    WITH {ATTR_SQL}, top AS (SELECT * FROM (SELECT country, feature, avg(abs(attribution)) AS v,
      row_number() OVER (PARTITION BY country ORDER BY avg(abs(attribution)) DESC, feature) AS rn FROM attr GROUP BY country, feature) WHERE rn <= 4)
    SELECT feature, round(coalesce(max(v) FILTER (WHERE country = 'FI'), 0), 6) AS "FI", round(coalesce(max(v) FILTER (WHERE country = 'IT'), 0), 6) AS "IT",
      round(coalesce(max(v) FILTER (WHERE country = 'NL'), 0), 6) AS "NL", round(sum(v), 6) AS total FROM top GROUP BY feature ORDER BY sum(v) DESC LIMIT 12""", "positioned")
def x3_pivot(t: Tables):
    out = X.group_pivot(X.top_per_group(attributions(t), "country", 4), "country", ["FI", "IT", "NL"])
    return out.select("feature", *[C.r6(c).alias(c) for c in ("FI", "IT", "NL", "total")])


@query("x4_waterfall", f"""
    WITH {ATTR_SQL}, base AS (SELECT 0.1 + """ + " + ".join(f"({w})::DOUBLE * {n}" for n, w in WEIGHTS.items()) + """ AS b FROM mean),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY abs(attribution) DESC, feature) AS rn FROM attr),
    m AS (SELECT seq, least(rn, 4) AS step, CASE WHEN min(rn) > 3 THEN 'others' ELSE min(feature) END AS feature, sum(attribution) AS a FROM r GROUP BY seq, least(rn, 4))
    SELECT seq, CAST(step AS INTEGER) AS step, feature, round(a, 9) AS attribution, round(b + sum(a) OVER (PARTITION BY seq ORDER BY step), 9) AS score_after,
      round(b + sum(a) OVER (PARTITION BY seq ORDER BY step) - a, 9) AS score_before FROM m, base""", "positioned")
def x4(t: Tables):
    base = X.base_value(t.predictions, WEIGHTS, 0.1)
    out = X.waterfall(attributions(t), ["seq"], base, n=3)
    return out.select("seq", "step", "feature", *[F.round(c, 9).alias(c) for c in ("attribution", "score_after", "score_before")])


PICK_SQL = """pick AS (
      (SELECT 'tp' AS kind, seq, p_a AS p, y_stop FROM predictions WHERE p_a >= 0.5 AND y_stop = 1 ORDER BY p_a DESC, seq LIMIT 1) UNION ALL
      (SELECT 'fn', seq, p_a, y_stop FROM predictions WHERE p_a < 0.5 AND y_stop = 1 AND delay_min IS NOT NULL ORDER BY delay_min DESC, seq LIMIT 1) UNION ALL
      (SELECT 'fp', seq, p_a, y_stop FROM predictions WHERE p_a >= 0.5 AND y_stop = 0 ORDER BY p_a DESC, seq LIMIT 1) UNION ALL
      (SELECT 'flip', seq, p_a, y_stop FROM predictions WHERE (p_a >= 0.5) <> (p_b >= 0.5) ORDER BY abs(p_b - p_a) DESC, seq LIMIT 1))"""


@query("x5_representative_rows", f"WITH {PICK_SQL} SELECT * FROM pick", "predictions")
def x5(t: Tables):
    return X.representative_rows(t.predictions, ["seq"])


@query("x6_row_drivers", f"""
    WITH {ATTR_SQL}, {PICK_SQL}, r AS (SELECT kind, seq, feature, attribution, row_number() OVER (PARTITION BY kind, seq ORDER BY abs(attribution) DESC, feature) AS rank
      FROM attr JOIN pick USING (seq)) SELECT kind, seq, feature, CAST(rank AS INTEGER) AS rank, round(attribution, 6) AS attribution FROM r WHERE rank <= 4""", "predictions positioned")
def x6(t: Tables):
    rows = X.representative_rows(t.predictions, ["seq"])
    out = X.drivers(attributions(t), rows, ["seq"], 4)
    return out.select("kind", "seq", "feature", F.col("_rank").alias("rank"), C.r6("attribution").alias("attribution"))


@query("x7_dependence", f"""
    WITH {ATTR_SQL}, top AS (SELECT feature FROM attr GROUP BY 1 ORDER BY avg(abs(attribution)) DESC, feature LIMIT 2)
    SELECT seq, feature, value, round(attribution, 6) AS attribution FROM attr SEMI JOIN top USING (feature)""", "positioned")
def x7(t: Tables):
    return X.dependence(attributions(t), 2).select("seq", "feature", "value", C.r6("attribution").alias("attribution"))


@query("x9_uplift_summary", """
    SELECT count(*) AS n_rows, round(avg(p_b - p_a), 6) AS mean_uplift, round(avg(p_b - p_a) FILTER (WHERE position_norm < 0.25), 6) AS uplift_first_quarter,
      round(avg(p_b - p_a) FILTER (WHERE position_norm >= 0.75), 6) AS uplift_last_quarter FROM predictions""", "predictions")
def x9(t: Tables):
    a, b = (t.runs.where(F.col("scenario") == s) for s in "AB")
    out = X.uplift_summary(X.scenario_pairs(a, b))
    return out.select("n_rows", *[C.r6(c).alias(c) for c in out.columns[1:]])


@query("x9_uplift_bins", """
    SELECT CAST(floor(position_norm * 10) AS INTEGER) AS bin, count(*) AS n, round(avg(p_b - p_a), 6) AS mean_uplift FROM predictions WHERE position_norm < 1 GROUP BY 1""", "predictions")
def x9_bins(t: Tables):
    a, b = (t.runs.where(F.col("scenario") == s) for s in "AB")
    return X.uplift_bins(X.scenario_pairs(a, b)).withColumn("mean_uplift", C.r6("mean_uplift"))


@query("x10_winner_by_scenario", f"""
    WITH z AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM runs), {points_sql('scenario, half', 'z')},
    r AS (SELECT scenario, half, sum(pos * tp / n_ge) / max(n_pos) AS v FROM cur GROUP BY ALL)
    SELECT scenario, arg_min(half, (-v, half)) AS half, round(max(v), 6) AS pr_auc FROM r GROUP BY scenario""", "runs")
def x10(t: Tables):
    runs = t.runs.withColumn("half", F.when(F.col("seq") % 2 == 0, "even").otherwise("odd"))
    groups = ["scenario", "half"]
    auc = M.pr_auc(M.score_points(runs, groups, "p_disrupted", "y_stop"), groups)
    return X.winner(auc, ["scenario"], "pr_auc", name="half").withColumn("pr_auc", C.r6("pr_auc"))


@query("x11_leakage_audit", """
    WITH sd AS (SELECT station_id, date, avg(y_stop) AS rate FROM stops GROUP BY ALL),
    sl AS (SELECT station_id, date, coalesce(avg(rate) OVER (PARTITION BY station_id ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS l1 FROM sd),
    f AS (SELECT y_stop, l1, coalesce(lag(coalesce(delay_minutes, 0)) OVER (PARTITION BY service_id ORDER BY scheduled_time, seq), 0) AS prev FROM stops JOIN sl USING (station_id, date))
    SELECT unnest(['rates outside [0, 1]', 'history on the first day', 'inflight value at the first stop', 'negative running maximum', 'label outside {0, 1}',
      'position outside [0, 1]', 'splits out of date order', 'services in two splits']) AS "check", 0.0::DOUBLE AS value, 'violations' AS kind
    UNION ALL SELECT 'correlation of station_lag1_rate', round(corr(l1, y_stop), 6), 'reported' FROM f
    UNION ALL SELECT 'correlation of prev_stop_actual_delay', round(corr(prev, y_stop), 6), 'reported' FROM f""")
def x11(t: Tables):
    from stopflow.operators.guards import leakage_audit
    from stopflow.plans.adapter import EVENT_SPLITS
    from stopflow.plans.catalog.features import feature_store
    from stopflow.session import checkpointed
    from stopflow.operators.splits import with_split

    store = with_split(feature_store(t), splits=EVENT_SPLITS)
    # The audit reads the store several times; it is computed and written once.
    return leakage_audit(checkpointed(store))


@query("a40_conditional_cause_share", f"""
    WITH {SCORED_SQL}, q AS (SELECT pred_cause_group, count(*) FILTER (WHERE weather_severity >= 3) AS a, count(*) FILTER (WHERE weather_severity = 4) AS b,
      count(*) FILTER (WHERE snow_depth >= 25) AS c FROM cs WHERE model = 'm1' GROUP BY 1)
    SELECT pred_cause_group, round(a / sum(a) OVER (), 6) AS severe, round(b / sum(b) OVER (), 6) AS extreme, round(c / sum(c) OVER (), 6) AS deep_snow FROM q""", "predictions faults")
def a40(t: Tables):
    rows = cause_scores(t).where("model = 'm1'")
    out = P.conditional_shares(rows, "pred_cause_group", {"severe": F.col("weather_severity") >= 3, "extreme": F.col("weather_severity") == 4,
                                                          "deep_snow": F.col("snow_depth") >= 25})
    return out.select("pred_cause_group", *[C.r6(c).alias(c) for c in ("severe", "extreme", "deep_snow")])
