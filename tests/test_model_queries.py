"""Training plans on small frames: fitted models against plain versions of themselves."""

import math
import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopflow.operators import guards
from stopflow.operators import metrics as M
from stopflow.plans import causes, model_tables, training
from stopflow.plans.catalog import models as Q
from stopflow import session
from stopflow.session import fit_parts, shared_folder, written

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    df = spark.range(1500).select(F.col("id").alias("seq"), h(1).alias("a"), F.floor(h(2) * 6).cast("int").alias("b"), h(3).alias("c"), h(4).alias("e"))
    df = df.withColumn("y_stop", (F.col("a") + F.col("b") / 10 + 0.4 * F.col("e") > 0.9).cast("int"))
    df = df.withColumn("split", F.when(F.col("seq") < 900, "train").when(F.col("seq") < 1200, "val").otherwise("test"))
    return df.persist()


def rows_of(frame, split):
    return sorted(frame.where(F.col("split") == split).collect(), key=lambda r: r["seq"])


def newton(x, y, w, n):
    """The logistic optimum with MLlib's penalty, by Newton's method."""
    mean = (w[:, None] * x).sum(0) / w.sum()
    var = (w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w * w).sum() / w.sum())
    z = np.column_stack([np.ones(len(x)), x])
    penalty = np.concatenate([[0.0], var / n])
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        g = z.T @ (w * (p - y)) / w.sum() + penalty * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(penalty)
        beta = beta - np.linalg.solve(hess, g)
    return beta


def test_logistic_is_the_optimum(spark, frame):
    model = training.fit("logreg", frame, "B", COLUMNS, rounds=500, tol=1e-12)
    table = model_tables.linear_table(model_tables.classifier_of(model.pipeline), COLUMNS, spark)
    got = {r["feature"]: r["coefficient"] for r in table.collect()}
    train = rows_of(frame, "train")
    x, y = np.array([[r[c] for c in COLUMNS] for r in train], float), np.array([r["y_stop"] for r in train], float)
    w = np.where(y == 1, max(1.0, (y == 0).sum() / y.sum()), 1.0)
    assert [got[None], *[got[c] for c in COLUMNS]] == pytest.approx(newton(x, y, w, len(y)), rel=1e-4)
    test = frame.where("split = 'test'")
    by_table = {r["seq"]: r["p"] for r in model_tables.score_linear(test, table, COLUMNS, "p").collect()}
    by_model = {r["seq"]: r["p_disrupted"] for r in model.score(test).collect()}
    assert by_table == pytest.approx(by_model, abs=1e-9)


@pytest.mark.parametrize("name, depth", [("boost_shallow", 3), ("boost_deep", 5)])
def test_tree_tables_score_and_explain_like_the_model(spark, frame, name, depth):
    model = training.fit(name, frame, "B", COLUMNS, rounds=6, depth=depth)
    nodes = model_tables.tree_table(model_tables.classifier_of(model.pipeline), COLUMNS, spark)
    assert dict(nodes.dtypes) == {c.split()[0]: {"long": "bigint"}.get(c.split()[1], c.split()[1]) for c in model_tables.NODE.split(", ")}
    test = frame.where("split = 'test'")
    scored = model_tables.score_trees(test, nodes, COLUMNS, "p", margin="m", depth=depth).collect()
    by_model = {r["seq"]: r["p_disrupted"] for r in model.score(test).collect()}
    assert {r["seq"]: r["p"] for r in scored} == pytest.approx(by_model, abs=1e-9)
    again = model_tables.score_trees(test, nodes, COLUMNS, "p")
    assert {r["seq"]: r["p"] for r in again.collect()} == pytest.approx(by_model, abs=1e-9)
    # the contributions are those of a walk by hand, and add up to the margin
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    parts = {(r["seq"], r["feature"]): r["contribution"] for r in model_tables.contributions(test, nodes, COLUMNS, ["seq"], depth=depth).collect()}
    for r in scored:
        want = {}
        for t in {t for t, _ in table}:
            n = table[t, 0]
            want[None] = want.get(None, 0) + n["weight"] * n["value"]
            while n["feature"] is not None:
                child = table[t, n["left"] if r[n["feature"]] <= n["cut"] else n["right"]]
                want[n["feature"]] = want.get(n["feature"], 0) + n["weight"] * (child["value"] - n["value"])
                n = child
        mine = {f: v for (s, f), v in parts.items() if s == r["seq"]}
        assert mine == pytest.approx(want, abs=1e-12)
        assert math.isclose(sum(mine.values()), r["m"], abs_tol=1e-9)


def average_precision(p, y):
    order = sorted(set(p), reverse=True)
    return sum(sum(b for a, b in zip(p, y) if a == s) * sum(b for a, b in zip(p, y) if a >= s) / sum(a >= s for a in p) for s in order) / sum(y)


def test_permutation_importance_against_plain_scores(spark, frame):
    model = training.fit("logreg", frame, "B", COLUMNS, rounds=50)
    test = frame.where("split = 'test'")
    moved = training.exchanged(test, COLUMNS, ["seq"], bucket_rows=40)
    for c in COLUMNS:
        part = moved.where(F.col("_moved") == c)
        # a permutation of one column, the others untouched
        assert part.select(c).exceptAll(test.select(c)).count() == 0 and part.count() == test.count()
        assert part.drop("_moved", c).exceptAll(test.drop(c)).count() == 0
    got = {r["feature"]: r["drop"] for r in training.permutation_importance(model, test, ["seq"]).collect()}
    scored = model.score(training.exchanged(test, COLUMNS, ["seq"])).collect()
    auc = {k: average_precision([r["p_disrupted"] for r in scored if r["_moved"] == k], [r["y_stop"] for r in scored if r["_moved"] == k]) for k in ("", *COLUMNS)}
    assert got == pytest.approx({c: auc[""] - auc[c] for c in COLUMNS}, abs=1e-9)
    assert got["a"] > 10 * abs(got["c"])


def test_ablation_is_two_fits(frame):
    df = frame.withColumnRenamed("a", "station_lag1_rate").drop("e")
    rows = {r["variant"]: r for r in training.lag_ablation(df, "A", name="logreg", rounds=30).collect()}
    test = df.where("split = 'test'")
    for variant, columns in (("all", guards.model_columns(df, "A")), ("without history", [c for c in guards.model_columns(df, "A") if c != "station_lag1_rate"])):
        scored = training.fit("logreg", df, "A", columns, rounds=30).score(test).collect()
        want = average_precision([r["p_disrupted"] for r in scored], [r["y_stop"] for r in scored])
        assert rows[variant]["pr_auc"] == pytest.approx(want) and rows[variant]["n_columns"] == len(columns)
    assert rows["all"]["pr_auc"] > rows["without history"]["pr_auc"]


def test_run_matrix_against_single_fits(frame, tmp_path):
    df = frame.select("seq", "y_stop", "split", *COLUMNS, *[F.lit(1).alias(c) for c in ("service_id", "station_id", "country", "date", "train_class_code", "stop_order", "position_norm", "delay_min")])
    names = ("logreg", "boost_shallow")
    out = {(r["model"], r["scenario"]): r for r in training.run_matrix(df, str(tmp_path / "runs"), names, ("A", "B"), rounds=4, depth=2).collect()}
    assert set(out) == {(n, s) for n in names for s in "AB"} and {r["status"] for r in out.values()} == {"ok"}
    for (name, scenario), row in out.items():
        scored = training.fit(name, df, scenario, rounds=4, depth=2).score(df.where("split = 'test'"))
        want = M.full_metrics(scored.withColumn("g", F.lit(1)), ["g"]).first()
        assert all(row[c] == pytest.approx(want[c]) for c in ("n", "pr_auc", "roc_auc", "f1", "brier", "ece"))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.range(600).select(
        F.concat(F.lit("c"), (F.col("id") % 3)).alias("cause_group"), F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") / 200).cast("int") + 1).alias("split"),
        *[(F.when(F.col("id") % 3 == k, 1.0).otherwise(0.0) + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)) / 200.0).alias(f"f{k}") for k in range(3)])
    return rows.persist()


def test_stack_over_all_bases(labelled):
    models = causes.fit_models(labelled, ["f0", "f1", "f2"], rounds=2, trees=3, depth=2)
    assert list(models.models) == ["logreg", "gbt", "gbt_deep", "rf", "mlp"]
    stack = causes.fit_stack(models, labelled, rounds=20)
    assert stack.stages[-2].getInputCols() == [f"prob_{n}" for n in models.models]
    test = labelled.where("split = 'test'")
    scored = causes.score_stack(models, stack, test)
    assert scored.where("pred_cause_group = cause_group").count() > 180
    one = scored.select(F.aggregate(causes.vector_to_array("prob_gbt_deep"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert one.where("abs(s - 1) > 1e-9").count() == 0
    # every base model separates these classes, and the benchmark says how well
    table = causes.benchmark(models, labelled, stack).collect()
    for r in table:
        rows = (causes.score_stack(models, stack, labelled) if r["model"] == "stack" else models.score(labelled, r["model"])).where(F.col("split") == r["split"])
        hits = rows.where("pred_cause_group = cause_group").count() / 200
        assert r["accuracy"] == pytest.approx(hits) and (hits > 0.9 or r["model"] == "mlp")
    p = models.score(test, "gbt").agg(F.min("pred_max_proba"), F.max("pred_max_proba")).first()
    assert 1 / 3 <= p[0] <= p[1] <= 1


def test_the_picker_needs_no_validation_rows(spark):
    table = spark.createDataFrame([("mlp", "test", 0.9), ("rf", "test", 0.4), ("gbt", "test", 0.5)], "model string, split string, macro_f1 double")
    assert causes.pick_for_transfer(table) == "gbt"


def test_columns_of_the_registered_models(spark):
    """Both scenarios, with betweenness; causes see everything but ids and labels."""
    df = spark.createDataFrame([], "seq long, k int, user_id long, delay_int int, y_stop int, betweenness_centrality double, prev_stop_actual_delay double, delay_min double, delay_log double, delay_minutes double, station_id string")
    a, b = Q.columns_for(df, "A"), Q.columns_for(df, "B")
    assert "betweenness_centrality" in a and "delay_min" not in b and set(b) - set(a) == {"prev_stop_actual_delay"}
    assert Q.cause_columns(df) == ["betweenness_centrality", "prev_stop_actual_delay", "delay_min", "delay_log"]


def test_fits_deal_their_rows_by_number_and_score_without_python(spark, labelled, monkeypatch):
    """Many shuffle partitions and a crowded class do not shape the rows of a fit;
    one-against-rest is a projection with the margins of its binary models."""
    seen = []

    class Spy(causes.LogisticRegression):
        def fit(self, dataset, params=None):
            seen.append(dataset.rdd.getNumPartitions())
            return super().fit(dataset, params)

    monkeypatch.setattr(causes, "LogisticRegression", Spy)
    models = causes.fit_models(labelled.repartition(60, "f0"), ["f0", "f1", "f2"], rounds=2, depth=2, names=("logreg", "gbt"))
    causes.fit_stack(models, labelled.repartition(60, "f0"), rounds=5)
    assert seen == [1, 1]
    assert [fit_parts(n) for n in (0, 25_001, 1_200_000, 12_000_000, 12_000_001)] == [1, 2, 48, 48, 49]
    test = labelled.where("split = 'test'")
    scored = models.score(test, "gbt")
    assert "EvalPython" not in scored._jdf.queryExecution().toString()
    margins = [[r["rawPrediction"][1] for r in m.transform(models.prepare(test)).orderBy("f0", "f1").collect()] for m in models.models["gbt"].models]
    want = [models.classes[max(range(3), key=lambda k: (row[k], -k))] for row in zip(*margins)]
    assert [r["pred_cause_group"] for r in scored.orderBy("f0", "f1").collect()] == want


def test_fits_share_what_they_know_of_the_train_rows(frame, tmp_path, monkeypatch):
    """The medians are taken once for all fits over a frame, and a fit reads vectors
    dealt by number; the models are those of single fits."""
    calls, dealt = [], []
    plain = training.train_medians
    monkeypatch.setattr(training, "train_medians", lambda *a: calls.append(1) or plain(*a))
    df = frame.select("seq", "y_stop", "split", "a", F.when(F.col("b") > 0, F.col("b")).alias("station_lag1_rate"), "c").repartition(40)
    facts = training.shared_facts(df, "AB")
    out = [r["pr_auc"] for s in "AB" for r in training.lag_ablation(df, s, name="logreg", facts=facts, rounds=20).collect()]
    assert len(calls) == 1
    assert [r["pr_auc"] for s in "AB" for r in training.lag_ablation(df, s, name="logreg", rounds=20).collect()] == pytest.approx(out)
    assert len(calls) == 3
    maker = training.MODELS["logreg"]
    fitted = training.LogisticRegression.fit
    monkeypatch.setattr(training.LogisticRegression, "fit", lambda self, rows: dealt.append((rows.columns, rows.rdd.getNumPartitions())) or fitted(self, rows))
    training.fit("logreg", df, "A", facts=facts, rounds=5)
    assert maker is training.MODELS["logreg"] and dealt == [(["features", "y_stop", "_weight", "_is_val"], 1)]


def test_waterfalls_are_dealt_by_number(spark, monkeypatch):
    """Small parts give the same waterfalls, repeated and null ids included."""
    from stopflow.operators import explain as X

    rows = spark.range(300).selectExpr("if(id % 50 = 0, null, id % 200) AS seq", "explode(array('a', 'b', 'c', 'd')) AS feature", "sin(id * ascii(feature)) AS attribution")
    base = spark.sql("SELECT 0.5D AS b")
    whole = sorted(map(str, X.waterfall(rows, ["seq"], base, 2).selectExpr("seq", "step", "feature", "round(attribution, 9)", "round(score_after, 9)").collect()))
    monkeypatch.setattr(X, "PART_ENTRIES", 100)
    small = X.waterfall(rows, ["seq"], base, 2)
    assert small.select(F.spark_partition_id()).distinct().count() > 6
    assert sorted(map(str, small.selectExpr("seq", "step", "feature", "round(attribution, 9)", "round(score_after, 9)").collect())) == whole


def test_a_fit_leaves_no_rows_behind_and_shuffles_few(spark, frame, monkeypatch):
    """Many rows are read where they were written, for the same model; the written rows go
    when the fit ends, well or not."""
    folder = Path(urlparse(shared_folder(spark)).path)
    tables = lambda: {p.name for p in folder.glob("fit-rows-*")}
    before, seen = tables(), []
    plain = training.LogisticRegression.fit
    # the frame comes in eight parts, rows of a fit are in several of them
    monkeypatch.setattr(training.LogisticRegression, "fit", lambda self, rows: seen.append(
        (rows.rdd.getNumPartitions(), rows.count(), "Exchange" in rows._jdf.queryExecution().executedPlan().toString(), len(tables() - before))) or plain(self, rows))
    fitted = lambda: training.fit("logreg", frame, "B", COLUMNS, rounds=200, tol=1e-12)
    few = fitted()
    monkeypatch.setattr(session, "FEW_ROWS", 100)
    monkeypatch.setattr(session, "SOME_PARTS", 2)
    monkeypatch.setattr(session, "MANY_ROWS", 300)
    many = fitted()
    assert seen == [(1, 900, True, 1), (3, 900, False, 1)] and tables() == before
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    coefficients = lambda m: list(model_tables.classifier_of(m.pipeline).coefficients)
    assert coefficients(many) == pytest.approx(coefficients(few), rel=1e-6)
    monkeypatch.setattr(training.LogisticRegression, "fit", lambda self, rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        fitted()
    assert tables() == before


def test_a_written_frame_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p.name for d in disk.localDirs() for p in Path(str(d)).rglob("shuffle_*.data")}
    before = files()
    rows = spark.range(5000).withColumn("k", F.col("id") % 7).repartition(3, "id")
    table = written(rows.join(rows.groupBy("k").count(), "k"), "shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and table.count() == 5000
