import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stopflow.operators.quantiles import column_quantiles, quantiles

PROBS = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.77, "e": 1.0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=60))
def test_against_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles(df, [], "v", PROBS).first()
    assert row["n_values"] == len(values)
    for name, q in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(values, q), abs=1e-6)


def test_groups_with_a_hot_value_and_a_long_tail(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") == 1, 1e12)
                                  .otherwise((F.col("id") * 7919 % 1000).cast("double")).alias("v"))
    pdf = df.toPandas()
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", {"q": 0.5, "p": 0.999}).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g]["q"] == pytest.approx(np.quantile(part.v, 0.5))
        assert got[g]["p"] == pytest.approx(np.quantile(part.v, 0.999))


def test_missing_values_are_skipped(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, null), (null, null), (3D, null), (double('NaN'), null) AS t(x, y)").withColumn("y", F.col("y").cast("double"))
    rows = column_quantiles(df, ["x", "y"], {"m": 0.5}).collect()
    assert [(r["column"], r["m"], r["n_values"]) for r in rows] == [("x", 2.0, 2)]


def test_ranges_are_even_whatever_the_values(spark):
    """One enormous value, a crowd in a narrow interval and a point mass."""
    from stopflow.operators import ranges
    from stopflow.operators.quantiles import counted

    df = spark.range(100_000).select(F.when(F.col("id") == 7, 1e30).when(F.col("id") % 3 == 0, 5.0).otherwise(100 + F.col("id") / 1e6).alias("v"), F.lit(1).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranges.spread(counted(df, ["g"], "v"), ["g"], "_v").groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 6 and max(sizes) < 2 * sum(sizes) / len(sizes)
    row = quantiles(df, [], "v", {"m": 0.5, "top": 1.0}).first()
    assert row["top"] == 1e30 and row["m"] == pytest.approx(float(np.quantile(df.toPandas().v, 0.5)))


def test_scores_that_crowd_near_zero(spark):
    from stopflow.operators import metrics as M
    from stopflow.operators import ranges

    df = spark.range(50_000).select((F.col("id") / 1e11).alias("p"), (F.col("id") % 9 == 0).cast("int").alias("y"), F.lit("m").alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in M.cells(df, ["g"], "p", "y").groupBy(ranges.PART).count().collect()]
        auc = M.roc_auc(M.score_points(df, ["g"], "p", "y"), ["g"]).first()["roc_auc"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 6 and max(sizes) < 2 * sum(sizes) / len(sizes)
    pos = np.arange(50_000)[::9]
    below = pos - np.arange(len(pos))
    assert auc == pytest.approx(below.sum() / (len(pos) * (50_000 - len(pos))))
