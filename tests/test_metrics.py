import numpy as np
import pytest
from pyspark.sql import functions as F

from stopflow.operators import metrics as M


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_stop int, p_disrupted double")


def average_precision(y, p):
    total, out, before = sum(y), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = [a for a, b in zip(y, p) if b >= t]
        recall = sum(hit) / total
        out += (recall - before) * sum(hit) / len(hit)
        before = recall
    return out


def auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    p = np.round(rng.random(400), 2)  # many ties
    p[:60] = 0.30
    y = (rng.random(400) < p).astype(int)
    return y.tolist(), p.tolist()


def test_ranking_metrics_with_ties(spark, sample):
    y, p = sample
    points = M.score_points(frame(spark, y, p), [], "p_disrupted", "y_stop")
    assert M.pr_auc(points, []).first()[0] == pytest.approx(average_precision(y, p))
    assert M.roc_auc(points, []).first()[0] == pytest.approx(auc(y, p))


def test_scores_in_one_slice(spark):
    y, p = [0, 1, 0, 1], [1e-9, 2e-9, 3e-9, 4e-9]
    points = M.score_points(frame(spark, y, p), [], "p_disrupted", "y_stop")
    assert M.pr_auc(points, []).first()[0] == pytest.approx(average_precision(y, p))


def test_ece_bins(spark, sample):
    y, p = map(np.array, sample)
    edges = np.quantile(p, np.linspace(0, 1, 11))
    bins = np.searchsorted(edges[1:-1], p)
    gaps = [abs(y[bins == b].mean() - p[bins == b].mean()) for b in range(10) if (bins == b).any()]
    assert M.ece(frame(spark, y, p), [], "p_disrupted", "y_stop").first()["ece"] == pytest.approx(np.mean(gaps))


def test_one_class_gives_zero(spark):
    df = frame(spark, [0, 0], [0.1, 0.9]).withColumn("y_pred", F.lit(0)).withColumn("g", F.lit("x"))
    row = M.full_metrics(df, ["g"]).first()
    assert [row[c] for c in ("pr_auc", "roc_auc", "f1", "brier", "ece")] == [0, 0, 0, 0, 0]
    assert M.tune_threshold(df, [], "p_disrupted", "y_stop").first()["threshold"] == 0.5
    assert M.metrics_by_group(df, ["g"]).count() == 0


def test_precision_at_recall_takes_lowest_threshold_of_equal_recalls(spark):
    # Recall 1.0 is reached at 0.6 and stays there at 0.2 with lower precision.
    points = M.score_points(frame(spark, [1, 1, 0], [0.9, 0.6, 0.2]), [], "p_disrupted", "y_stop")
    row = M.precision_at_recall(points, [], [0.5, 0.9]).first()
    assert row["p_at_r50"] == pytest.approx(1.0)
    assert row["p_at_r90"] == pytest.approx(2 / 3)


def test_threshold_is_the_first_maximum(spark):
    best = M.tune_threshold(frame(spark, [0, 1], [0.2, 0.8]), [], "p_disrupted", "y_stop").first()
    assert best["threshold"] == pytest.approx(0.25) and best["f1"] == 1.0


def test_macro_f1_counts_classes_seen_anywhere(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "y string, p string")
    row = M.multiclass_summary(df, [], "y", "p").first()
    assert row["accuracy"] == pytest.approx(1 / 3)
    assert row["macro_f1"] == pytest.approx((2 / 3 + 0 + 0) / 3)
