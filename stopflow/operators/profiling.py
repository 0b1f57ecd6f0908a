"""Profiles of a table: completeness, distributions, group statistics, rankings.

Group statistics are plain aggregates (combined before the shuffle). Quantiles
use the distributed form, so no group has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators.quantiles import column_quantiles, melt, quantiles

LATE_EDA = 3  # minutes, punctuality threshold of the profiles


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: missing and present rows, share missing in percent, type."""
    names = list(columns or df.columns)
    n = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    types = F.create_map(*[F.lit(x) for k, v in df.dtypes for x in (k, v)])
    long = n.unpivot(["_n"], names, "column", "missing_count")
    return long.select(
        "column", "missing_count", (F.col("_n") - F.col("missing_count")).alias("present_count"),
        F.round(100.0 * F.col("missing_count") / F.nullif(F.col("_n"), F.lit(0)), 2).alias("missing_pct"),
        F.try_element_at(types, F.col("column")).alias("dtype"))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[(1.0 - F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "completeness")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
EXTREMES = {"p01": 0.01, "p05": 0.05, **QUARTILES, "p95": 0.95, "p99": 0.99}


def describe(df: DataFrame, columns: Sequence[str], probs: dict[str, float] = EXTREMES) -> DataFrame:
    """Count, mean, deviation, extremes and quantiles of every column."""
    long = melt(df, [], columns)
    basic = long.where("value IS NOT NULL").groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return basic.join(column_quantiles(df, columns, probs).drop("n_values"), "column")


def delay_statistics(df: DataFrame, delay: str, late: float = LATE_EDA) -> DataFrame:
    """One row: size, centre, spread and share late, plus how many rows lie in [p05, p95]."""
    q = quantiles(df, [], delay, {"p05": 0.05, "median": 0.5, "p95": 0.95}).drop("n_values")
    row = df.where(F.col(delay).isNotNull()).withColumn("_q", q.select(F.struct("p05", "median", "p95")).scalar())
    d = F.col(delay)
    return row.agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.max("_q.median").alias("median"),
        F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"), F.max("_q.p95").alias("p95"),
        (100.0 * F.avg((d > late).cast("int"))).alias("pct_late"),
        F.count_if(d.between(F.col("_q.p05"), F.col("_q.p95"))).alias("n_clipped"))


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None,
              groups: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram; with bounds, values are clipped to them first."""
    v = F.col(value)
    rows = df.where(v.isNotNull())
    if low is not None:
        rows = rows.withColumn(value, F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.struct("lo", "hi")).scalar()
    placed = rows.withColumn("_e", ends)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    return placed.groupBy(*groups, C.bin_index(value, lo, hi, bins).alias("bin"), "_e").agg(
        F.count(F.lit(1)).alias("n")).select(
        *groups, "bin", (lo + (hi - lo) / bins * F.col("bin")).alias("bin_from"), "n")


def binned_mean(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """Mean with a 95 % band per right-closed bin of `by`; `worst` marks the highest."""
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    ends = rows.agg(F.min(by).alias("lo"), F.max(by).alias("hi")).select(F.struct("lo", "hi")).scalar()
    placed = rows.withColumn("_e", ends)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    per = placed.groupBy(C.bin_index_right(by, lo, hi, bins).alias("bin"), "_e").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("sem"))
    whole = Window.partitionBy(F.lit(1))  # one row per bin
    return per.select(
        "bin", (lo + (hi - lo) / bins * (F.col("bin") + 0.5)).alias("mid"), "n", "mean", "sem",
        (F.col("mean") - 1.96 * F.col("sem")).alias("low"), (F.col("mean") + 1.96 * F.col("sem")).alias("high"),
        (F.col("mean") == F.max("mean").over(whole)).cast("int").alias("worst"))


def mean_sem(value: str | Column) -> list[Column]:
    v = C.col(value)
    return [F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem")]


def group_delays(df: DataFrame, group: str, delay: str, min_rows: int = 500, late: float = LATE_EDA) -> DataFrame:
    """Mean, median, deviation, share late and size per group of at least `min_rows`."""
    rows = df.where(F.col(group).isNotNull() & F.col(delay).isNotNull())
    basic = rows.groupBy(group).agg(
        F.avg(delay).alias("mean_delay"), F.stddev_samp(delay).alias("std_delay"), F.count(F.lit(1)).alias("n_stops"),
        (100.0 * F.avg((F.col(delay) > late).cast("int"))).alias("pct_late")).where(F.col("n_stops") >= min_rows)
    med = quantiles(rows, [group], delay, {"median_delay": 0.5}).drop("n_values")
    return basic.join(med, group)


def conditional_delays(df: DataFrame, group: str, delay: str, cancelled: str = "cancelled",
                       min_rows: int = 0, late: float = LATE_EDA) -> DataFrame:
    """Mean and standard error over stops that ran, cancellation share over all."""
    ran = F.when(~C.truth(F.col(cancelled)), F.col(delay))
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(ran).alias("mean_delay"), (F.stddev_samp(ran) / F.sqrt(F.count(ran))).alias("sem_delay"),
        (100.0 * F.avg((ran > late).cast("int"))).alias("pct_late"),
        (100.0 * F.avg(C.truth(F.col(cancelled)).cast("int"))).alias("cancellation_rate"),
        F.count(delay).alias("n_stops")).where(F.col("n_stops") >= min_rows)


def trend(df: DataFrame, period: Column, value: str, name: str = "period") -> DataFrame:
    """Mean, median and standard error per period."""
    rows = df.where(F.col(value).isNotNull()).withColumn(name, period)
    med = quantiles(rows, [name], value, {"median": 0.5}).drop("n_values")
    return rows.groupBy(name).agg(*mean_sem(value)).join(med, name)


def rates_by(df: DataFrame, label: str, sets: Sequence[str]) -> DataFrame:
    """Share of `label` along several dimensions in one pass (grouping sets)."""
    cube = df.groupingSets([[F.col(s)] for s in sets], *[F.col(s) for s in sets]).agg(
        F.avg(label).alias("rate"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    bits = {s: 1 << (len(sets) - 1 - i) for i, s in enumerate(sets)}
    all_bits = sum(bits.values())
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("string")
    for s in sets:
        mine = F.col("_g") == all_bits - bits[s]
        dim = F.when(mine, F.lit(s)).otherwise(dim)
        val = F.when(mine, F.col(s).cast("string")).otherwise(val)
    return cube.select(dim.alias("dimension"), val.alias("value"), "rate", "n")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair, complete rows per pair, in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}")
                   for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def correlates_of(corr: DataFrame, target: str) -> DataFrame:
    """Correlates of one column, strongest first (`rank`)."""
    mine = corr.where((F.col("a") == target) | (F.col("b") == target)).select(
        F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("column"), F.abs("r").alias("abs_r"))
    return mine.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("abs_r"), "column")))


def top_totals(df: DataFrame, group: str, amount: str, order: str, n: int = 10) -> DataFrame:
    """Count, total and mean of an amount per group, the n largest by `order`."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(amount).alias("total"), F.avg(amount).alias("mean")).orderBy(
        F.desc(order), group).limit(n)


def top_counts(df: DataFrame, group: str, n: int) -> DataFrame:
    return value_counts(df, group).orderBy(F.desc("n"), group).limit(n)


def value_counts(df: DataFrame, group: str) -> DataFrame:
    """Rows and share of every value (NULL left out)."""
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n")).scalar()
    return per.select(group, "n", (F.col("n") / total).alias("share"))


def undirected(edges: DataFrame, a: str = "station_from", b: str = "station_to") -> DataFrame:
    """One row per unordered pair."""
    return edges.where(F.col(a) < F.col(b)).select(a, b, *[c for c in edges.columns if c not in (a, b)]).distinct()


def connection_counts(pairs: DataFrame, a: str = "station_from", b: str = "station_to", n: int = 15) -> DataFrame:
    ends = pairs.select(F.explode(F.array(a, b)).alias("station_id"))
    return ends.groupBy("station_id").agg(F.count(F.lit(1)).alias("connections")).orderBy(F.desc("connections"), "station_id").limit(n)


def mean_distance_ends(edges: DataFrame, n: int = 5) -> DataFrame:
    """The n remotest and the n most central stations by mean distance."""
    per = edges.groupBy("station_from").agg(F.avg("distance_km").alias("mean_km"))
    far = per.orderBy(F.desc("mean_km"), "station_from").limit(n).withColumn("side", F.lit("remote"))
    near = per.orderBy("mean_km", "station_from").limit(n).withColumn("side", F.lit("central"))
    return far.unionByName(near)


def ccdf(df: DataFrame, key: str, order: str) -> DataFrame:
    """Longest order per key, and the share of keys above each length."""
    lengths = df.groupBy(key).agg(F.max(order).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("length")  # one row per distinct length
    total = Window.partitionBy(F.lit(1))
    return lengths.select("length", "n", (1.0 - F.sum("n").over(w) / F.sum("n").over(total)).alias("share_longer"))


def size_distribution(df: DataFrame, key: Sequence[str], clip: int, name: str = "size") -> DataFrame:
    """How many keys have 1, 2, ... rows, clipped."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).groupBy(
        F.least("c", F.lit(clip)).alias(name)).agg(F.count(F.lit(1)).alias("n_keys"))


def contingency(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def keywords(df: DataFrame, text: str, n: int = 30, pattern: str = r"([a-zà-ù]{4,})") -> DataFrame:
    """Most frequent words of at least four letters, over whole texts."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)


def frequent_means(df: DataFrame, group: str, value: str, more_than: int) -> DataFrame:
    """Mean per label with more than `more_than` rows."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def threshold_counts(df: DataFrame, columns: Sequence[str], above: Sequence[float] = (30, 120)) -> DataFrame:
    """Negative, zero and large values per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.explode(cells).alias("x")).select("x.*").where("v IS NOT NULL")
    return long.groupBy("column").agg(
        F.count_if(F.col("v") < 0).alias("n_negative"), F.count_if(F.col("v") == 0).alias("n_zero"),
        *[F.count_if(F.col("v") > a).alias(f"n_above_{a:g}") for a in above])


def dataset_summary(df: DataFrame, distinct: Sequence[str], date: str, delay: str, cancelled: str = "cancelled") -> DataFrame:
    """Rows, dates, distinct ids, cancellations and delays in one pass."""
    ran = F.when(~C.truth(F.col(cancelled)), F.col(delay))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).cast("string").alias("first_date"), F.max(date).cast("string").alias("last_date"),
        *[F.countDistinct(c).alias(f"n_{c}") for c in distinct],
        F.count_if(C.truth(F.col(cancelled))).alias("n_cancelled"), F.avg(ran).alias("mean_delay"),
        (100.0 * F.avg((ran > LATE_EDA).cast("int"))).alias("pct_late"))


def mode_per_key(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key; ties go to the alphabetically first."""
    counts = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias(value))


def conditional_shares(df: DataFrame, label: str, conditions: dict[str, Column]) -> DataFrame:
    """Share of every label inside several subsets, in one pass."""
    per = df.groupBy(label).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    whole = Window.partitionBy(F.lit(1))  # one row per label
    return per.select(label, *[(F.col(n) / F.nullif(F.sum(n).over(whole), F.lit(0))).alias(n) for n in conditions])


def bounding_boxes(stations: DataFrame, group: str = "country") -> DataFrame:
    return stations.groupBy(group).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
