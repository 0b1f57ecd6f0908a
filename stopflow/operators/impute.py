"""Filling missing measurements. Medians come from exact distributed quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.functions import constants as K
from stopflow.operators.quantiles import column_quantiles, median, melt, quantiles


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def missing_log(df: DataFrame, columns: Sequence[str], strategy: str) -> DataFrame:
    """Rows each column would have filled in."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_imputed").withColumn("strategy", F.lit(strategy))


def monthly_median_fill(df: DataFrame, columns: Sequence[str], date: str, train_end=K.TRAIN_END) -> DataFrame:
    """Median of the calendar month, else of all rows; both from rows up to
    `train_end` only (None = all rows). One pass serves all columns."""
    train = df if train_end is None else df.where(F.col(date) <= F.lit(train_end).cast("date"))
    long = melt(train.withColumn("_m", F.month(date)), ["_m"], columns)
    by_month = quantiles(long, ["_m", "column"], "value", {"med": 0.5}).groupBy("_m").agg(
        *[F.max(F.when(F.col("column") == c, F.col("med"))).alias(f"_m_{c}") for c in columns])
    overall = column_quantiles(train, columns, {"med": 0.5}).agg(
        *[F.max(F.when(F.col("column") == c, F.col("med"))).alias(c) for c in columns])
    # At most twelve months: the lookup is small by definition.
    out = df.withColumn("_m", F.month(date)).join(F.broadcast(by_month), "_m", "left")
    g = overall.select(F.struct(*columns)).scalar()
    return out.withColumn("_g", g).withColumns(
        {c: F.coalesce(c, f"_m_{c}", F.col(f"_g.{c}")) for c in columns}).select(*df.columns)


def monthly_median_log(df: DataFrame, columns: Sequence[str], date: str, train_end=K.TRAIN_END) -> DataFrame:
    train = df if train_end is None else df.where(F.col(date) <= F.lit(train_end).cast("date"))
    overall = column_quantiles(train, columns, {"global_median_train": 0.5}).select("column", "global_median_train")
    return missing_log(df, columns, "monthly_median_train_only").join(overall, "column", "left")


def cross_fill(df: DataFrame, target: str, source: str) -> DataFrame:
    return df.withColumn(target, F.coalesce(target, source))


def median_fill(df: DataFrame, column: str) -> DataFrame:
    m = median(df, [], column, "m").scalar()
    return df.withColumn(column, F.coalesce(F.col(column), m))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def train_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of medians for scoring; a column without values gets 0."""
    return column_quantiles(train, columns, {"med": 0.5}).agg(
        *[F.coalesce(F.max(F.when(F.col("column") == c, F.col("med"))), F.lit(0.0)).alias(c) for c in columns])


def apply_medians(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = medians.select(F.struct(*columns)).scalar()
    return df.withColumn("_g", m).withColumns({c: F.coalesce(F.col(c), F.col(f"_g.{c}")) for c in columns}).drop("_g")
