"""A hot key must give the same result whether or not it is sliced."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stopflow.operators.scan import keyed_scan, tag_slices


@pytest.fixture(scope="module")
def rows(spark):
    # One key holds a third of the rows, the others are tiny; times are uneven.
    return spark.range(3000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"),
        (F.pow(F.col("id") % 1000, F.lit(1.5)) + F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("id"))).alias("at"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101 - 50).cast("double")).alias("v"))


ARGS = dict(prev=["v", "seq"], nxt=["seq"], sums=["v"], peaks=["v"], lows=["at"], tops=["v"])


def result(sliced):
    out = keyed_scan(sliced, ["at", "seq"], **ARGS).plain
    return sorted(tuple(r) for r in out.select("key", "seq", *[c for c in sorted(out.columns) if c not in ("key", "seq", "at", "v")]).na.fill(-999.0).na.fill(-999).collect())


def test_sliced_equals_plain_window(rows):
    sliced = tag_slices(rows, ["key"], ["at", "seq"], hot_rows=100)
    assert sliced.hot
    plain = tag_slices(rows, ["key"], ["at", "seq"])
    assert not plain.hot
    assert result(sliced) == result(plain)


def test_plain_matches_spark_windows(rows):
    w = Window.partitionBy("key").orderBy("at", "seq")
    want = rows.select("key", "seq", (F.row_number().over(w) - 1).alias("rn"), F.lag("seq").over(w).alias("p"),
                       F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("b"))
    sliced = keyed_scan(tag_slices(rows, ["key"], ["at", "seq"], hot_rows=100), ["at", "seq"], prev=["seq"], sums=["v"]).plain
    got = sliced.select("key", "seq", F.col("_rn").alias("rn"), F.col("prev_seq").alias("p"), F.col("before_v").alias("b"))
    assert sorted(map(tuple, want.na.fill(-1).collect())) == sorted(map(tuple, got.na.fill(-1).collect()))


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranges_hold_even_numbers_of_rows(rows, many_ranges):
    sliced = tag_slices(rows, ["key"], ["at", "seq"], hot_rows=100)
    sizes = [r["count"] for r in sliced.df.where("_hot").groupBy("_slice").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert result(sliced) == result(tag_slices(rows, ["key"], ["at", "seq"]))


def test_one_key_at_one_time_is_cut(spark, many_ranges):
    rows = spark.range(5000).selectExpr("'x' AS key", "id AS seq", "1.0D AS at", "1.0D AS v")
    sliced = tag_slices(rows, ["key"], ["at", "seq"], hot_rows=10)
    sizes = [r["count"] for r in sliced.df.groupBy("_slice").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * 5000 / len(sizes)
    out = keyed_scan(sliced, ["at", "seq"], sums=["v"]).plain
    got = out.orderBy("seq").collect()
    assert [r["before_v"] for r in got] == [float(i) for i in range(5000)] and dict(out.dtypes)["_rn"] == "bigint"
