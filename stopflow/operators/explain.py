"""Explanation tables: additive attributions, importance, waterfalls, uplift.

Attributions live in long form (row id, feature, value, attribution).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.operators.splits import sample_per_group

# Entries (row x feature) that one task sorts for waterfalls.
PART_ENTRIES = 500_000


def linear_attributions(df: DataFrame, ids: Sequence[str], weights: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """Exact contributions w * (x - mean(x)) of a linear score, in long form.

    The means are one aggregate row, read as a scalar subquery.
    """
    names = list(weights)
    means = df.agg(*[F.avg(n).alias(n) for n in names]).select(F.struct(*names)).scalar()
    cells = F.array(*[F.struct(
        F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
        (F.lit(float(w)) * (F.col(n) - F.col(f"_mean.{n}"))).alias("attribution")) for n, w in weights.items()])
    return df.withColumn("_mean", means).select(*ids, *keep, F.explode(cells).alias("c")).select(*ids, *keep, "c.*")


def base_value(df: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """Expected score: intercept + sum of w * mean(x)."""
    total = F.lit(float(intercept))
    for n, w in weights.items():
        total = total + F.lit(float(w)) * F.avg(n)
    return df.agg(total.alias("base_value"))


def importance(attributions: DataFrame, groups: Sequence[str] = (), name: str = "mean_abs") -> DataFrame:
    return attributions.groupBy(*groups, "feature").agg(F.avg(F.abs("attribution")).alias(name))


def top_features(attributions: DataFrame, n: int = 20) -> DataFrame:
    return importance(attributions).orderBy(F.desc("mean_abs"), "feature").limit(n)


def top_per_group(attributions: DataFrame, group: str, n: int = 6) -> DataFrame:
    """Most important features of every group (few rows: groups x features)."""
    per = importance(attributions, [group])
    return sample_per_group(per, [group], n, [F.desc("mean_abs"), F.col("feature")])


def group_pivot(top: DataFrame, group: str, values: Sequence[str], n: int = 12) -> DataFrame:
    """Features x groups table of the largest rows by their sum."""
    wide = top.groupBy("feature").pivot(group, list(values)).agg(F.max("mean_abs")).na.fill(0.0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0.0))
    return wide.withColumn("total", total).orderBy(F.desc("total"), "feature").limit(n)


def waterfall(attributions: DataFrame, row: Sequence[str], base: DataFrame, n: int = 12) -> DataFrame:
    """Per row: its n largest contributions, one 'others' entry, and the running
    score before and after each. Entries are counted first and dealt by row id into
    parts of about PART_ENTRIES, so that a task's sorts do not grow with the table."""
    n_parts = max(1, -(-attributions.count() // PART_ENTRIES))
    attributions = attributions.repartition(n_parts, *row)
    ranked = attributions.withColumn("step", F.row_number().over(
        Window.partitionBy(*row).orderBy(F.desc(F.abs("attribution")), "feature")))
    merged = ranked.groupBy(*row, F.least("step", F.lit(n + 1)).alias("step")).agg(
        F.when(F.min("step") > n, F.lit("others")).otherwise(F.min("feature")).alias("feature"),
        F.sum("attribution").alias("attribution"))
    w = Window.partitionBy(*row).orderBy("step")
    after = base.scalar() + F.sum("attribution").over(w)
    return merged.withColumn("score_after", after).withColumn("score_before", F.col("score_after") - F.col("attribution"))


def representative_rows(preds: DataFrame, ids: Sequence[str], threshold: float = 0.5, p: str = "p_a", other: str = "p_b") -> DataFrame:
    """Four rows in one pass: surest true positive, worst miss, surest false
    alarm, largest gap among flipped decisions. Ties go to the smallest id."""
    y, hit = F.col("y_stop"), F.col(p) >= threshold
    flip = hit != (F.col(other) >= threshold)
    gap = F.abs(F.col(other) - F.col(p))

    def pick(name: str, cond: Column, score: Column) -> Column:
        order = F.struct(-score, *[F.col(i) for i in ids])
        row = F.struct(F.lit(name).alias("kind"), *ids, F.col(p).alias("p"), F.col("y_stop"))
        return F.min_by(F.when(cond, row), F.when(cond, order)).alias(name)

    one = preds.agg(
        pick("tp", hit & (y == 1), F.col(p)), pick("fn", ~hit & (y == 1) & F.col("delay_min").isNotNull(), F.col("delay_min")),
        pick("fp", hit & (y == 0), F.col(p)), pick("flip", flip, gap))
    return one.select(F.explode(F.array("tp", "fn", "fp", "flip")).alias("r")).where("r IS NOT NULL").select("r.*")


def drivers(attributions: DataFrame, rows: DataFrame, ids: Sequence[str], n: int = 8) -> DataFrame:
    """Largest contributions of selected rows (at most four rows)."""
    mine = attributions.join(F.broadcast(rows.select("kind", *ids)), list(ids))
    return sample_per_group(mine, ["kind", *ids], n, [F.desc(F.abs("attribution")), F.col("feature")], keep_rank=True)


def dependence(attributions: DataFrame, n: int = 5) -> DataFrame:
    """(value, attribution) of the n most important features."""
    return attributions.join(F.broadcast(top_features(attributions, n).select("feature")), "feature", "left_semi")


def scenario_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("service_id", "stop_order")) -> DataFrame:
    """Predictions of both scenarios on one row."""
    right = b.select(*keys, F.col("p_disrupted").alias("p_b"))
    return a.withColumnRenamed("p_disrupted", "p_a").join(right, list(keys)).withColumn("uplift", F.col("p_b") - F.col("p_a"))


def uplift_summary(pairs: DataFrame, position: str = "position_norm") -> DataFrame:
    u, x = F.col("uplift"), F.col(position)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(u).alias("mean_uplift"),
        F.avg(F.when(x < 0.25, u)).alias("uplift_first_quarter"), F.avg(F.when(x >= 0.75, u)).alias("uplift_last_quarter"))


def uplift_bins(pairs: DataFrame, position: str = "position_norm", bins: int = 10) -> DataFrame:
    """Mean uplift per left-closed bin of [0, 1); position 1.0 is outside."""
    inside = pairs.where((F.col(position) >= 0) & (F.col(position) < 1))
    return inside.groupBy(F.floor(F.col(position) * bins).cast("int").alias("bin")).agg(
        F.avg("uplift").alias("mean_uplift"), F.count(F.lit(1)).alias("n"))


def winner(metrics: DataFrame, groups: Sequence[str], metric: str, name: str = "model", exclude: Sequence[str] = ()) -> DataFrame:
    """Best model per group; ties go to the alphabetically first."""
    pool = metrics.where(~F.col(name).isin(list(exclude))) if exclude else metrics
    return pool.groupBy(*groups).agg(
        F.min_by(name, F.struct(-F.col(metric), F.col(name))).alias(name), F.max(metric).alias(metric))
