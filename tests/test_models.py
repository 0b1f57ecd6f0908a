import pytest
from pyspark.sql import functions as F

from stopflow.operators import guards
from stopflow.plans import causes, training


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(60 * 4).select(
        F.concat(F.lit("S"), F.floor(F.col("id") / 4)).alias("service_id"), F.concat(F.lit("ST"), F.col("id") % 10).alias("station_id"),
        (F.col("id") % 4).cast("int").alias("stop_order"), F.lit("IT").alias("country"), F.expr("date_add(DATE'2024-02-01', CAST(id / 4 AS INT))").alias("date"),
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0).alias(f"f{i}") for i in range(6)],
        F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 5).cast("double").alias("station_lag1_rate"))
    df = df.withColumn("y_stop", (F.col("f0") + 0.3 * F.col("f1") > 0.8).cast("int")).withColumn("prev_stop_actual_delay", F.col("f0") * 10)
    df = df.withColumn("split", F.when(F.col("date") <= "2024-03-10", "train").when(F.col("date") <= "2024-03-20", "val").otherwise("test"))
    return df.persist()


@pytest.mark.parametrize("name", list(training.MODELS))
def test_fit_score_save_load(data, name, tmp_path):
    model = training.fit(name, data, "A", rounds=5, depth=3)
    assert "prev_stop_actual_delay" not in model.columns
    assert 0 < model.threshold < 1
    test = data.where("split = 'test'")
    scored = model.score(test)
    low, high, n = scored.agg(F.min("p_disrupted"), F.max("p_disrupted"), F.count("p_disrupted")).first()
    assert 0 <= low <= high <= 1 and n == test.count()
    again = training.StopModel.load(model.save(str(tmp_path / name))).score(test)
    assert again.exceptAll(scored).count() == 0


def test_leaking_column_is_refused(data):
    with pytest.raises(ValueError, match="Leakage"):
        training.fit("logreg", data, "A", ["f0", "prev_stop_actual_delay"])


def test_every_run_has_a_row(data, tmp_path, monkeypatch):
    monkeypatch.setitem(training.MODELS, "broken", lambda n, s: 1 / 0)
    path = str(tmp_path / "runs")
    for _ in range(2):  # a second call replaces the runs
        out = training.run_matrix(data, path, names=("broken", "logreg"), scenarios=("A",), rounds=3)
    rows = {r["model"]: r.asDict() for r in out.collect()}
    assert rows["logreg"]["status"] == "ok" and rows["logreg"]["pr_auc"] is not None
    assert rows["broken"]["status"].startswith("ZeroDivisionError") and rows["broken"]["pr_auc"] is None
    stored = data.sparkSession.read.parquet(path)
    assert stored.count() == data.where("split IN ('val', 'test')").count()


def test_ablation_drops_history(data):
    rows = {r["variant"]: r["n_columns"] for r in training.lag_ablation(data, "B", name="logreg", rounds=5).collect()}
    n_history = len([c for c in guards.model_columns(data, "B") if guards.is_history_column(c)])
    assert rows["all"] - rows["without history"] == n_history == 2


def test_calibration_only_when_needed(spark):
    good = spark.range(1000).selectExpr("id % 10 / 10.0D + 0.05D AS p_disrupted", "CAST(pmod(hash(id), 100) < (id % 10) * 10 + 5 AS INT) AS y_stop")
    assert training.calibrate(good, good)[1]["applied"] is False
    bad = good.withColumn("p_disrupted", F.col("p_disrupted") / 3)
    out, info = training.calibrate(bad, bad)
    assert info["applied"]
    steps = out.select("p_disrupted_raw", "p_disrupted").distinct().orderBy("p_disrupted_raw").collect()
    assert all(a["p_disrupted"] <= b["p_disrupted"] + 1e-12 for a, b in zip(steps, steps[1:]))


def test_perceptron_never_transfers(spark):
    table = spark.createDataFrame([("mlp", "val", 0.9), ("rf", "val", 0.4), ("gbt", "val", 0.4), ("rf", "test", 1.0)], "model string, split string, macro_f1 double")
    assert causes.pick_for_transfer(table) == "gbt"
