"""Splits, folds, scaling, sampling, weights and indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.functions import constants as K
from stopflow.operators import ranges
from stopflow.session import checkpointed


def with_split(df: DataFrame, date: str = "date", splits: dict = K.SPLITS) -> DataFrame:
    """Add `split` by day; rows outside all windows drop."""
    if date not in df.columns:
        raise KeyError(f"date column {date!r} is missing")
    out = F.lit(None).cast("string")
    for name, (start, end) in splits.items():
        inside = F.col(date).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = F.when(inside, name).otherwise(out)
    return df.withColumn("split", out).where("split IS NOT NULL")


def rolling_folds(df: DataFrame, n_folds: int = 4, date: str = "date", start=K.SPLITS["train"][0]) -> DataFrame:
    """Rolling-origin folds inside the training window: `fold` and `role`.

    Fold k trains on weeks before k blocks and validates on the next block. A
    row is repeated only for the folds it belongs to.
    """
    week = F.floor(F.date_diff(F.col(date), F.lit(start).cast("date")) / F.lit(7))
    n_weeks = df.agg(F.max(week) + 1).scalar()
    block = F.greatest(F.lit(1), F.floor(n_weeks / F.lit(n_folds + 1)))
    folds = F.transform(F.sequence(F.lit(1), F.lit(n_folds)), lambda k: F.struct(
        k.alias("fold"),
        F.when(F.col("_week") < k * F.col("_block"), "train")
        .when(F.col("_week") < (k + 1) * F.col("_block"), "val").alias("role")))
    out = df.withColumns({"_week": week, "_block": block})
    return out.withColumn("_f", F.explode(folds)).where("_f.role IS NOT NULL").select(
        *df.columns, "_f.fold", "_f.role")


# -- scaling --------------------------------------------------------------------

def scaler_statistics(train: DataFrame, columns: Sequence[str], floor: float | None = None) -> DataFrame:
    """One row: mean and population standard deviation of each column. NULLs are
    skipped; a zero deviation becomes 1 (or `floor` when one is given)."""
    aggs = []
    for c in columns:
        sd = F.stddev_pop(c)
        sd = F.greatest(sd, F.lit(floor)) if floor is not None else F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        aggs += [F.avg(c).alias(f"{c}__mean"), sd.alias(f"{c}__scale")]
    return train.agg(*aggs)


def scale(df: DataFrame, statistics: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Standardise next to the raw values. The statistics are one row, read as
    one scalar subquery, so no join is planned."""
    s = statistics.select(F.struct(*statistics.columns)).scalar()
    out = df.withColumn("_s", s)
    scaled = {f"{c}{suffix}": (F.col(c) - F.col(f"_s.{c}__mean")) / F.col(f"_s.{c}__scale") for c in columns}
    return out.withColumns(scaled).drop("_s")


# -- sampling --------------------------------------------------------------------

def _mix(ids: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def _below(ids: Sequence[str], seed: int, n: int, rows: Column) -> Column:
    """True for about n of so many rows, those with the smallest hashes, and some
    more: ten standard deviations, so that the first n are among them."""
    share = F.conv(F.substring(_mix(ids, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return share * rows <= n + 10 * n ** 0.5 + 50


def sample_rows(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """The n rows with the smallest hashes of their id (fewer, if there are not so
    many; ids must be unique): the same rows however data is partitioned. Only
    keys are sorted, in ranges, whatever n is."""
    total = df.agg(F.count(F.lit(1))).scalar()
    near = df.where(_below(ids, seed, n, total))
    # the n-th smallest (hash, ids): sorted ranges of the keys alone, then a filter
    keys = [_mix(ids, seed).alias("_h"), *[F.col(i) for i in ids]]
    placed = ranges.spread(near.select(F.struct(*keys).alias("_k"), F.lit(1).alias("_one")), [], "_k", "sample")
    totals = ranges.range_totals(placed, [], ["_one"])
    holds = totals.where((F.col("below__one") < n) & (F.col("below__one") + F.col("part__one") >= n))
    last = ranges.running(placed, [], "_k", ["_one"], holds).where(F.col("below__one") == n - 1).select("_k").scalar()
    return near.withColumn("_last", last).where(F.col("_last").isNull() | (F.struct(*keys) <= F.col("_last"))).drop("_last")


def hash_sample_per_group(df: DataFrame, group: str, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows per group in hash order of their id. Groups are counted
    first, so that about n rows of each reach its window, whatever its size."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_rows"))
    near = df.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).where(_below(ids, seed, n, F.col("_rows"))).drop("_g", "_rows")
    return sample_per_group(near, [group], n, hash_order(ids, seed))


def sample_per_group(df: DataFrame, group: Sequence[str], n: int, order: Sequence[Column | str],
                     keep_rank: bool = False) -> DataFrame:
    """At most n rows per group in a fixed order. The rank filter is applied per
    input partition first (group limit), so a hot group is cut before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return out if keep_rank else out.drop("_rank")


def hash_order(ids: Sequence[str], seed: int = 42) -> list[Column]:
    return [_mix(ids, seed), *[F.col(i) for i in ids]]


# -- indexes, weights, deduplication -----------------------------------------------

def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dense 0-based index of distinct ids in sorted order.

    The sort is range-partitioned and written once (checkpoint), so partition
    numbers stay fixed; a position is then the offset of its partition (one row
    per partition) plus the row's place inside it.
    """
    ids = df.select(key).distinct().orderBy(key)
    placed = checkpointed(ids.select(key, F.spark_partition_id().alias("_b"), F.monotonically_increasing_id().alias("_m")))
    sized = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_b").select(key, (inside + F.col("_o")).cast("long").alias(name))


def label_index(df: DataFrame, label: str, name: str) -> DataFrame:
    """Sorted label encoding (few labels)."""
    w = Window.orderBy(label)
    return df.select(label).distinct().where(F.col(label).isNotNull()).withColumn(
        name, (F.row_number().over(w) - 1).cast("int"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * rows of the class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))
    return per.select(label, "n", (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """max(1, negatives / positives) as one row."""
    pos = F.sum(label)
    neg = F.count(label) - pos
    return df.agg(F.greatest(F.lit(1.0), neg / F.greatest(pos, F.lit(1))).alias("positive_weight"))


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(*df.columns)
