"""Leakage rules: which columns may be model inputs, and checks that they hold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from stopflow.functions import constants as K


# What a model must not see: A scores before departure, B while the train runs.
FORBIDDEN = {"A": ("outcome", "inflight"), "B": ("outcome",)}


def family(*names: str) -> set[str]:
    return {c for n in names for c in K.COLUMN_FAMILY[n]}


def banned(scenario: str) -> set[str]:
    families = FORBIDDEN.get(scenario)
    if families is None:
        raise ValueError(f"unknown scenario {scenario!r}: one of {', '.join(FORBIDDEN)}")
    return family(*families)


def check_no_leak(columns: Iterable[str], scenario: str) -> None:
    bad = [c for c in columns if c in banned(scenario)]
    if bad:
        raise ValueError(f"Leakage: scenario {scenario} must not use {', '.join(sorted(bad))}")


def leak_report(df: DataFrame, scenarios: Iterable[str]) -> DataFrame:
    """One row per scenario and column: whether a model of the scenario must not use
    the column, and how many distinct values it would give away."""
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n_values")
    rules = F.array(*[F.struct(F.lit(s).alias("scenario"), F.col("column").isin(*banned(s)).alias("leaks")) for s in scenarios])
    return counts.withColumn("r", F.explode(rules)).select("r.scenario", "column", "r.leaks", "n_values")


def legal_columns(columns: Iterable[str], scenario: str) -> list[str]:
    out = banned(scenario)
    return [c for c in columns if c not in out and not c.startswith("_meta_")]


def numeric_columns(df: DataFrame, within: Iterable[str] | None = None) -> list[str]:
    allowed = set(df.columns if within is None else within)
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name in allowed]


def column_report(df: DataFrame) -> DataFrame:
    """One row per column: which scenario's models may use it, and its distinct values."""
    legal = {s: legal_columns(df.columns, s) for s in FORBIDDEN}
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n_values")
    return counts.select("column", *[F.col("column").isin(c).alias(f"in_{s.lower()}") for s, c in legal.items()], "n_values")


def model_columns(df: DataFrame, scenario: str) -> list[str]:
    """Legal columns first, numeric ones second: a text column that leaks must
    trip the check instead of being filtered away."""
    legal = legal_columns(df.columns, scenario)
    check_no_leak(legal, scenario)
    return numeric_columns(df, legal)


def is_history_column(name: str) -> bool:
    """Columns that know what happened before this stop."""
    return name in family("history", "inflight")


def split_overlap(df: DataFrame, key: str = "service_id", split: str = "split") -> DataFrame:
    """Keys found in more than one split."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def check_disjoint(df: DataFrame, key: str = "service_id", split: str = "split") -> None:
    found = split_overlap(df, key, split).limit(5).collect()
    if found:
        raise AssertionError(f"{key} in more than one split, e.g. {[r[key] for r in found]}")


def leakage_audit(features: DataFrame, split: str = "split") -> DataFrame:
    """Ten-point audit, one row per check: `value` must be 0 where `kind` is
    'violations'; correlations are reported for reading."""
    rates = ["station_lag1_rate", "station_lag7_rate", "train_lag1_rate", "train_lag7_rate",
             "train_station_lag7_rate", "nbr_lag1_rate"]
    first_day = F.lit(None).cast("date") if "date" not in features.columns else F.col("date")
    start = features.agg(F.min("date")).scalar()
    out_of_range = sum((F.count_if((F.col(c) < 0) | (F.col(c) > 1)) for c in rates), F.lit(0))
    overlap = split_overlap(features, split=split)
    order = features.groupBy(split).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).agg(
        F.max(F.when(F.col(split) == "train", F.col("hi"))).alias("train_hi"),
        F.min(F.when(F.col(split) == "val", F.col("lo"))).alias("val_lo"),
        F.max(F.when(F.col(split) == "val", F.col("hi"))).alias("val_hi"),
        F.min(F.when(F.col(split) == "test", F.col("lo"))).alias("test_lo"))
    y = F.col("y_stop")
    one = features.agg(
        out_of_range.cast("double").alias("rates outside [0, 1]"),
        F.count_if((first_day == start) & (sum((F.col(c) for c in rates[:5]), F.lit(0.0)) != 0)).cast("double").alias("history on the first day"),
        F.count_if((F.col("stop_order") == 0) & (F.col("prev_stop_actual_delay") != 0)).cast("double").alias("inflight value at the first stop"),
        F.count_if(F.col("max_actual_delay_so_far") < 0).cast("double").alias("negative running maximum"),
        F.count_if(~y.isin(0, 1)).cast("double").alias("label outside {0, 1}"),
        F.count_if((F.col("position_norm") < 0) | (F.col("position_norm") > 1)).cast("double").alias("position outside [0, 1]"),
        F.round(F.corr("station_lag1_rate", "y_stop"), 6).alias("correlation of station_lag1_rate"),
        F.round(F.corr("prev_stop_actual_delay", "y_stop"), 6).alias("correlation of prev_stop_actual_delay"),
    )
    first = one.unpivot([], one.columns, "check", "value")
    dates = order.select(
        F.lit("splits out of date order").alias("check"),
        ((F.col("train_hi") >= F.col("val_lo")).cast("int") + (F.col("val_hi") >= F.col("test_lo")).cast("int"))
        .cast("double").alias("value"))
    shared = overlap.agg(F.lit("services in two splits").alias("check"), F.count(F.lit(1)).cast("double").alias("value"))
    kind = F.when(F.col("check").startswith("correlation"), "reported").otherwise("violations")
    return first.unionByName(dates).unionByName(shared.select("check", "value")).withColumn("kind", kind)
