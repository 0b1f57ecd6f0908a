"""Ordered scans within a key (position, neighbouring row, running totals) that
survive a hot key.

A plain `Window.partitionBy(key)` puts all rows of a key into one task. That is
the right plan while every key is small, so `tag_slices` counts rows per key
where a table is large enough to hold a hot one. The rows of keys that hold a
noticeable share of it are sorted by key and order into ranges of about equal
numbers of rows, whatever the order's values look like: also a key whose rows
all have the same time is cut. The window runs per (key, range); what a range
needs to know about the ranges before it is one summary row, brought back by a
join.

Both helper tables have a proven size: at most `HOT_SHARE` keys can each hold
more than 1/HOT_SHARE of the rows, and the ranges are the partitions of one
shuffle. That is why those two may be broadcast. Ranges only affect how work is
spread, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.session import checkpointed, written

# A key is hot when it holds more than 1/HOT_SHARE of all rows and more than
# HOT_ROWS rows, below which one task copes easily.
HOT_SHARE = 100_000
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Sliced:
    """A frame ready for `keyed_scan`; `hot` says whether `_slice` exists."""

    df: DataFrame
    key: tuple[str, ...]
    hot: bool

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Sliced:
        """Apply row-wise steps or joins that keep `_hot` and `_slice`."""
        return Sliced(fn(self.df), self.key, self.hot)

    @property
    def plain(self) -> DataFrame:
        return self.df.drop("_hot", "_slice") if self.hot else self.df


def hot_keys(df: DataFrame, key: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with a noticeable share of a large table, or None."""
    total = df.count()
    if total <= hot_rows:
        return None
    limit = max(hot_rows, total // HOT_SHARE)
    hot = checkpointed(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit).select(*key))
    return None if hot.isEmpty() else hot


def tag_slices(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], hot_rows: int | None = None) -> Sliced:
    """Prepare a frame for `keyed_scan` in this order, which must be unique within a
    key. The rows of hot keys are written in sorted ranges, whose numbers are
    their slices; rows of ordinary keys stay where they are, in slice 0."""
    hot = hot_keys(df, key, HOT_ROWS if hot_rows is None else hot_rows)
    if hot is None:
        return Sliced(df, tuple(key), False)
    hot = F.broadcast(hot)
    by = {f"_by{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    rows = df.join(hot, list(key), "left_semi").withColumns(by)
    dealt = rows.repartitionByRange(*key, *by).withColumn("_slice", F.spark_partition_id().cast("long")).drop(*by)
    cut = written(dealt.withColumn("_hot", F.lit(True)), "slices")
    rest = df.join(hot, list(key), "left_anti").withColumns({"_hot": F.lit(False), "_slice": F.lit(0).cast("long")})
    names = [*df.columns, "_hot", "_slice"]
    return Sliced(cut.select(*names).unionByName(rest.select(*names)), tuple(key), True)


def keyed_scan(sliced: Sliced, order: Sequence[Column | str], *, prev: Sequence[str] = (), nxt: Sequence[str] = (),
               sums: Sequence[str] = (), peaks: Sequence[str] = (), lows: Sequence[str] = (),
               tops: Sequence[str] = ()) -> Sliced:
    """Ordered scan over the rows of each key.

    `order` must be unique within a key. Adds `_rn` (0-based position), `_n`
    (rows of the key) and, per requested column c: `prev_c` / `next_c` (the
    neighbouring row's value), `before_c` and `total_c` (sum over earlier rows
    and over the key), `peak_c` (maximum over earlier rows), `low_c` and
    `top_c` (extremes over the key).
    """
    df, key = sliced.df, list(sliced.key)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    group = Window.partitionBy(*key, "_slice") if sliced.hot else Window.partitionBy(*key)
    seq = group.orderBy(*order)
    earlier = seq.rowsBetween(Window.unboundedPreceding, -1)

    inside = {"_rn": F.row_number().over(seq).cast("long") - 1, "_n": F.count(F.lit(1)).over(group)}
    inside |= {f"prev_{c}": F.lag(c).over(seq) for c in prev}
    inside |= {f"next_{c}": F.lead(c).over(seq) for c in nxt}
    inside |= {f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums}
    inside |= {f"total_{c}": F.sum(c).over(group) for c in sums}
    inside |= {f"peak_{c}": F.max(c).over(earlier) for c in peaks}
    inside |= {f"low_{c}": F.min(c).over(group) for c in lows}
    inside |= {f"top_{c}": F.max(c).over(group) for c in tops}
    scanned = df.select(*df.columns, *[v.alias(k) for k, v in inside.items()])
    if not sliced.hot:
        return Sliced(scanned, sliced.key, False)

    offsets = _offsets(df, key, order, prev, nxt, sums, peaks, lows, tops)
    joined = scanned.join(F.broadcast(offsets), [*key, "_slice"], "left")
    zero = F.lit(0)
    out = {
        "_rn": F.col("_rn") + F.coalesce("c_rn", zero), "_n": F.coalesce("c_n", "_n")}
    out |= {f"prev_{c}": F.when(F.col("_rn") == 0, F.col(f"c_last.{c}")).otherwise(F.col(f"prev_{c}")) for c in prev}
    out |= {f"next_{c}": F.when(F.col("_rn") == F.col("_n") - 1, F.col(f"c_first.{c}")).otherwise(F.col(f"next_{c}")) for c in nxt}
    out |= {f"before_{c}": F.col(f"before_{c}") + F.coalesce(f"c_sum_{c}", zero) for c in sums}
    out |= {f"total_{c}": F.coalesce(f"c_total_{c}", f"total_{c}") for c in sums}
    out |= {f"peak_{c}": F.greatest(f"c_peak_{c}", f"peak_{c}") for c in peaks}
    out |= {f"low_{c}": F.coalesce(f"c_low_{c}", f"low_{c}") for c in lows}
    out |= {f"top_{c}": F.coalesce(f"c_top_{c}", f"top_{c}") for c in tops}
    return Sliced(joined.select(*df.columns, *[v.alias(k) for k, v in out.items()]), sliced.key, True)


def _offsets(df, key, order, prev, nxt, sums, peaks, lows, tops) -> DataFrame:
    """What each slice of a hot key inherits from its neighbours: one row per slice."""
    carried = list(dict.fromkeys([*prev, *nxt]))
    aggs = [F.count(F.lit(1)).alias("s_n")]
    aggs += [F.sum(c).alias(f"s_sum_{c}") for c in sums]
    aggs += [F.max(c).alias(f"s_max_{c}") for c in dict.fromkeys([*peaks, *tops])]
    aggs += [F.min(c).alias(f"s_min_{c}") for c in lows]
    if prev:
        aggs.append(F.max_by(F.struct(*carried), F.struct(*order)).alias("s_last"))
    if nxt:
        aggs.append(F.min_by(F.struct(*carried), F.struct(*order)).alias("s_first"))
    per_slice = df.where("_hot").groupBy(*key, "_slice").agg(*aggs)
    chain = Window.partitionBy(*key).orderBy("_slice")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    out = [F.sum("s_n").over(before).alias("c_rn"), F.sum("s_n").over(whole).alias("c_n")]
    for c in sums:
        out += [F.sum(f"s_sum_{c}").over(before).alias(f"c_sum_{c}"), F.sum(f"s_sum_{c}").over(whole).alias(f"c_total_{c}")]
    out += [F.max(f"s_max_{c}").over(before).alias(f"c_peak_{c}") for c in peaks]
    out += [F.max(f"s_max_{c}").over(whole).alias(f"c_top_{c}") for c in tops]
    out += [F.min(f"s_min_{c}").over(whole).alias(f"c_low_{c}") for c in lows]
    if prev:
        out.append(F.lag("s_last").over(chain).alias("c_last"))
    if nxt:
        out.append(F.lead("s_first").over(chain).alias("c_first"))
    return per_slice.select(*key, "_slice", *out)
