"""Running totals and ranks over sorted values, spread over tasks by range.

Values are counted before they come here, so equal ones are one row. Spark cuts
the sorted (group, value) rows into ranges of about equal numbers of rows by
splitters it samples, whatever the values look like: an outlier, a crowd of
values in a narrow interval or one large group move splitters, not load. The
totals of the ranges before are added afterwards, from one row per group and
range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopflow.session import written

PART = "_part"


def spread(counted: DataFrame, groups: Sequence[str], value: str, name: str = "ranges") -> DataFrame:
    """The rows in sorted ranges, with the number of each row's range in `_part`.
    Written once, so that all plans see the same ranges."""
    dealt = counted.repartitionByRange(*groups, value).sortWithinPartitions(*groups, value)
    return written(dealt.withColumn(PART, F.spark_partition_id()), name)


def range_totals(placed: DataFrame, groups: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """One row per group and range: `below_c` (total of the group's smaller ranges),
    `part_c` (the range's own) and `all_c` (the group's) for each column c."""
    parts = placed.groupBy(*groups, PART).agg(*[F.sum(c).alias(f"part_{c}") for c in sums])
    whole = Window.partitionBy(*groups)
    below = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *[F.coalesce(F.sum(f"part_{c}").over(below), F.lit(0)).alias(f"below_{c}") for c in sums],
                        *[F.sum(f"part_{c}").over(whole).alias(f"all_{c}") for c in sums])


def running(placed: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str], totals: DataFrame | None = None) -> DataFrame:
    """Adds `below_c` (total over the group's smaller values) and `all_c` for each
    column c. `totals` may hold some of the ranges only; then only their rows stay."""
    totals = range_totals(placed, groups, sums) if totals is None else totals
    inside = Window.partitionBy(*groups, PART).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(totals.drop(*[f"part_{c}" for c in sums]), [*groups, PART])
    return joined.withColumns({f"below_{c}": F.col(f"below_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).drop(PART)


def picks(ranked: DataFrame, groups: Sequence[str], value: str, count: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group from `running` rows: one column per
    entry of `probs`, and the group's total count."""
    total = F.col(f"all_{count}")
    aggs = [F.max(total).alias("_total")]
    for i, q in enumerate(probs.values()):
        rank = (total - 1) * F.lit(float(q))
        for side, r in (("l", F.floor(rank)), ("h", F.ceil(rank))):
            hit = (r >= F.col(f"below_{count}")) & (r < F.col(f"below_{count}") + F.col(count))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*groups).agg(*aggs)
    rank = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    return found.select(*groups, "_total", *[
        (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (rank(q) - F.floor(rank(q)))).alias(name)
        for i, (name, q) in enumerate(probs.items())])


def wanted(totals: DataFrame, count: str, probs: dict[str, float]) -> DataFrame:
    """The ranges that hold a rank of one of the quantiles."""
    hit = F.lit(False)
    for q in probs.values():
        rank = (F.col(f"all_{count}") - 1) * F.lit(float(q))
        for r in (F.floor(rank), F.ceil(rank)):
            hit = hit | ((r >= F.col(f"below_{count}")) & (r < F.col(f"below_{count}") + F.col(f"part_{count}")))
    return totals.where(hit)
