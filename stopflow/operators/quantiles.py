"""Exact quantiles without a single-task aggregate.

Spark's `percentile` keeps every distinct value of a group in one task. Here
values are counted first (map-side combined) and sorted into ranges, and only
the ranges that hold a wanted rank are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.operators import ranges


def counted(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values `_v` per group with their number of rows `_c`; NULL and NaN are skipped."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated exact quantiles per group: one column per entry of
    `probs` (name -> probability), plus `n_values`. NULL and NaN values are
    skipped, and so are NULL groups. Without groups, no values give no row."""
    groups = list(groups)
    keys = groups or ["_all"]
    known = df.dropna(subset=groups) if groups else df.withColumn("_all", F.lit(1))
    placed = ranges.spread(counted(known, keys, value), keys, "_v", "values")
    return of_counted(placed, keys, probs).select(*groups, F.col("_total").alias("n_values"), *probs)


def of_counted(placed: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of counted values that are already spread."""
    near = ranges.wanted(ranges.range_totals(placed, keys, ["_c"]), "_c", probs)
    return ranges.picks(ranges.running(placed, keys, "_v", ["_c"], near), keys, "_v", "_c", probs)


def median(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    return quantiles(df, groups, value, {name: 0.5}).drop("n_values")


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str],
         name: str = "column", value: str = "value") -> DataFrame:
    """Wide to long with a common double type."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), name, value)


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns in one pass: one row per column."""
    return quantiles(melt(df, [], columns), ["column"], "value", probs)
