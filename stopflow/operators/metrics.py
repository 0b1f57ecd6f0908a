"""Ranking, calibration and classification metrics.

Everything starts from cells: one row per distinct score with its rows,
positives, predicted positives and hits, from one aggregate of the predictions.
Running totals over the scores are taken in ranges of sorted scores
(`ranges.py`), so no task sees a whole curve, however the scores crowd. Ranking
metrics, calibration bins and counts all read the same cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.functions import constants as K
from stopflow.operators import ranges


def _ratio(a: Column, b: Column) -> Column:
    """0 when the denominator is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def cells(preds: DataFrame, groups: Sequence[str], score: str, label: str, pred: str | None = None) -> DataFrame:
    """Distinct scores per group in sorted ranges: `n` rows, `pos` positives and,
    with `pred`, `called` predicted positives and `hits` true ones."""
    sums = {"n": F.count(F.lit(1)), "pos": F.sum(F.col(label).cast("long"))}
    if pred:
        sums |= {"called": F.sum(F.col(pred).cast("long")), "hits": F.sum((F.col(pred) * F.col(label)).cast("long"))}
    rows = preds.groupBy(*groups, F.col(score).alias("score")).agg(*[v.alias(k) for k, v in sums.items()])
    return ranges.spread(rows, groups, "score", "cells")


def _above(running: DataFrame) -> DataFrame:
    """Rows and positives at or above each score, from those below it."""
    return running.withColumns({"n_ge": F.col("all_n") - F.col("below_n"), "tp": F.col("all_pos") - F.col("below_pos")}).withColumnsRenamed({"all_n": "n_all", "all_pos": "n_pos"})


def score_points(preds: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Distinct scores per group with `n_ge`, `tp` (rows and positives at or
    above the score) and group totals `n_all`, `n_pos`."""
    groups = list(groups)
    keys = groups or ["_all"]
    placed = cells(preds if groups else preds.withColumn("_all", F.lit(1)), keys, score, label)
    out = _above(ranges.running(placed, keys, "score", ["n", "pos"]))
    return out.select(*groups, "score", "n", "pos", "n_ge", "tp", "n_all", "n_pos")


def pr_auc(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Average precision (step sum; ties are one step). 0 without positives."""
    total = F.max("n_pos")
    return points.groupBy(*groups).agg(
        _ratio(F.sum(F.col("pos") * F.col("tp") / F.col("n_ge")), total).alias("pr_auc"))


def roc_auc(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mann-Whitney form with half weight for ties. 0 for one-class groups."""
    neg = F.col("n") - F.col("pos")
    neg_all = F.col("n_all") - F.col("n_pos")
    neg_below = neg_all - (F.col("n_ge") - F.col("tp"))
    return points.groupBy(*groups).agg(
        _ratio(F.sum(F.col("pos") * (neg_below + neg / 2.0)), F.max(F.col("n_pos") * neg_all)).alias("roc_auc"))


def binary_counts(preds: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return preds.groupBy(*groups).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def f1_value(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def threshold_metrics(preds: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """F1, precision, recall, accuracy; 0 on zero division."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return binary_counts(preds, groups, label, pred).select(
        *groups, "tp", "fp", "fn", "tn", f1_value(tp, fp, fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def brier(preds: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    d = F.col(score) - F.col(label)
    return preds.groupBy(*groups).agg(F.avg(d * d).alias("brier"))


def reliability(preds: DataFrame, groups: Sequence[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Quantile bins: mean score, share of positives, rows. A score belongs to
    the bin numbered by the inner edges strictly below it."""
    groups = list(groups)
    keys = groups or ["_all"]
    placed = cells(preds if groups else preds.withColumn("_all", F.lit(1)), keys, score, label)
    edges = _edges(ranges.running(placed, keys, "score", ["n"]), keys, bins)
    return _binned(placed, edges, keys, bins).drop(*([] if groups else ["_all"]))


def _edges(running: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Inner edges of the quantile bins, as an array."""
    names = {f"e{i}": i / bins for i in range(1, bins)}
    return ranges.picks(running, keys, "score", "n", names).select(*keys, F.array(*names).alias("edges"))


def _binned(placed: DataFrame, edges: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    bin_no = F.aggregate("edges", F.lit(0), lambda a, e: a + (e < F.col("score")).cast("int"))
    n = F.sum("n")
    return placed.join(edges, list(keys)).groupBy(*keys, bin_no.alias("bin")).agg(
        n.alias("n"), (F.sum(F.col("score") * F.col("n")) / n).alias("mean_score"), (F.sum("pos") / n).alias("share_positive"))


def ece(preds: DataFrame, groups: Sequence[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Unweighted mean of |share - score| over non-empty quantile bins; 0 for one class."""
    table = reliability(preds, groups, score, label, bins)
    pos = F.sum(F.col("share_positive") * F.col("n"))
    n = F.sum("n")
    gap = F.avg(F.abs(F.col("share_positive") - F.col("mean_score")))
    one_class = (F.round(pos) == 0) | (F.round(pos) == n)
    return table.groupBy(*groups).agg(F.when(one_class, F.lit(0.0)).otherwise(gap).alias("ece"))


def full_metrics(preds: DataFrame, groups: Sequence[str], score: str = "p_disrupted", label: str = "y_stop",
                 pred: str = "y_pred", bins: int = 10) -> DataFrame:
    """All headline metrics per group; zeros for groups with one class.

    The predictions are aggregated once; everything else reads the cells.
    """
    groups = list(groups)
    placed = cells(preds, groups, score, label, pred)
    below = ranges.running(placed, groups, "score", ["n", "pos"])
    neg = F.col("n") - F.col("pos")
    neg_all = F.col("n_all") - F.col("n_pos")
    neg_below = neg_all - (F.col("n_ge") - F.col("tp"))
    d0, d1 = F.col("score"), F.col("score") - 1
    ranking = _above(below).groupBy(*groups).agg(
        F.max("n_all").alias("n"), F.max("n_pos").alias("n_pos"),
        _ratio(F.sum(F.col("pos") * F.col("tp") / F.col("n_ge")), F.max("n_pos")).alias("pr_auc"),
        _ratio(F.sum(F.col("pos") * (neg_below + neg / 2.0)), F.max(F.col("n_pos") * neg_all)).alias("roc_auc"),
        (F.sum(neg * d0 * d0 + F.col("pos") * d1 * d1) / F.max("n_all")).alias("brier"),
        _ratio(2.0 * F.sum("hits"), F.sum("called") + F.sum("pos")).alias("f1"),
        _ratio(F.sum("hits"), F.sum("called")).alias("precision"), _ratio(F.sum("hits"), F.sum("pos")).alias("recall"))
    binned = _binned(placed, _edges(below, groups, bins), groups, bins)
    gap = binned.groupBy(*groups).agg(F.avg(F.abs(F.col("share_positive") - F.col("mean_score"))).alias("ece"))
    out = ranking.join(gap, groups)
    names = ["pr_auc", "roc_auc", "f1", "precision", "recall", "brier", "ece"]
    one_class = (F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n"))
    return out.select(*groups, "n", *[F.when(one_class, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in names])


def metrics_by_group(preds: DataFrame, groups: Sequence[str], score: str = "p_disrupted", label: str = "y_stop",
                     pred: str = "y_pred") -> DataFrame:
    """PR-AUC and F1 per group; groups with one class are left out."""
    groups = list(groups)
    points = _above(ranges.running(cells(preds, groups, score, label, pred), groups, "score", ["n", "pos"]))
    return points.groupBy(*groups).agg(
        F.max("n_all").alias("n"), F.max("n_pos").alias("_pos"),
        _ratio(F.sum(F.col("pos") * F.col("tp") / F.col("n_ge")), F.max("n_pos")).alias("pr_auc"),
        _ratio(2.0 * F.sum("hits"), F.sum("called") + F.sum("pos")).alias("f1")).where("_pos > 0 AND _pos < n").drop("_pos")


def precision_at_recall(points: DataFrame, groups: Sequence[str], targets: Sequence[float] = K.RECALL_TARGETS) -> DataFrame:
    """Precision at the smallest recall that meets each target; among equal
    recalls the lowest threshold counts."""
    recall = F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0))
    precision = F.col("tp") / F.col("n_ge")
    order = F.struct(recall.alias("r"), F.col("score").alias("t"))
    return points.groupBy(*groups).agg(*[
        F.coalesce(F.min_by(F.when(recall >= t, precision), F.when(recall >= t, order)), F.lit(0.0))
        .alias(f"p_at_r{round(t * 100):d}") for t in targets])


def curves(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """PR and ROC coordinates at every distinct score."""
    fp = F.col("n_ge") - F.col("tp")
    return points.select(
        *groups, F.col("score").alias("threshold"), (F.col("tp") / F.col("n_ge")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("recall"), _ratio(fp, F.col("n_all") - F.col("n_pos")).alias("fpr"))


def confusion(preds: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """Cell counts and row percentages."""
    cells = preds.groupBy(*groups, F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups, "actual")
    return cells.withColumn("row_pct", 100.0 * F.col("n") / F.sum("n").over(w))


def tune_threshold(preds: DataFrame, groups: Sequence[str], score: str, label: str,
                   grid: Sequence[float] = K.THRESHOLDS) -> DataFrame:
    """Threshold of the best F1 on a fixed grid (first maximum, 0.5 for one class).

    Rows are reduced to counts per interval of the grid before thresholds are
    compared, so nothing is multiplied by the grid.
    """
    below = sum(((F.col(score) >= t).cast("int") for t in grid), F.lit(0))
    cells = preds.groupBy(*groups, below.alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(grid)])
    tried = cells.withColumn("s", F.explode(steps)).groupBy(*groups, F.col("s.t").alias("threshold")).agg(
        F.sum(F.when(F.col("_k") >= F.col("s.i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_k") >= F.col("s.i"), F.col("n")).otherwise(0)).alias("flagged"),
        F.sum("pos").alias("n_pos"), F.sum("n").alias("n_all"))
    f1 = _ratio(2.0 * F.col("tp"), F.col("flagged") + F.col("n_pos"))
    best = F.max_by("threshold", F.struct(f1, -F.col("threshold")))
    one_class = (F.max("n_pos") == 0) | (F.max("n_pos") == F.max("n_all"))
    return tried.groupBy(*groups).agg(F.when(one_class, F.lit(0.5)).otherwise(best).alias("threshold"),
                                      F.max(f1).alias("f1"))


def cascading_respect(stops_with_prev: DataFrame, groups: Sequence[str], pred: str = "y_pred") -> DataFrame:
    """Share predicted disrupted after a disrupted and after a punctual stop."""
    p = F.col(pred)
    return stops_with_prev.groupBy(*groups).agg(
        F.coalesce(F.avg(F.when(F.col("prev_y") == 1, p)), F.lit(0.0)).alias("after_disrupted"),
        F.coalesce(F.avg(F.when(F.col("prev_y") != 1, p)), F.lit(0.0)).alias("after_on_time"))


# -- several classes ------------------------------------------------------------

def class_table(scored: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """Support, hits, precision, recall and F1 for every class seen in either column."""
    pairs = scored.groupBy(*groups, F.col(label).alias("_y"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(*groups, F.explode(F.array(
        F.struct(F.col("_y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("_y") == F.col("_p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")))).alias("c")).select(*groups, "c.*")
    per = sides.groupBy(*groups, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    return per.withColumn("f1", _ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted")))


def multiclass_summary(scored: DataFrame, groups: Sequence[str], label: str, pred: str) -> DataFrame:
    """Accuracy and macro F1 (mean over the classes that occur)."""
    return class_table(scored, groups, label, pred).groupBy(*groups).agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
