"""Isotonic calibration: pooled blocks of scores, merged in a tree, and their use.

The isotonic fit is the lower hull of the running totals (rows, positives) over
sorted scores, one block per edge of the hull. Each range of scores is pooled by
itself; a block that a range's neighbours would not join can still join later,
a pooled one never comes apart, so neighbours merge in groups until one is left.
Blocks of a hull have different shares of positives, and so many different
fractions need many rows: N rows give less than 3 N^(2/3) blocks, however many
distinct scores there are. That bounds what the last merge holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.operators import metrics as M
from stopflow.operators import ranges
from stopflow.session import written

# Neighbouring ranges that are merged by one task.
TOGETHER = 16
_BLOCK = "lo double, hi double, n long, pos long"


def pool(lo: list[float], hi: list[float], n: list[int], pos: list[int]) -> list[tuple[float, float, int, int]]:
    """Adjacent violators pooled: ascending blocks with strictly growing shares."""
    out: list[tuple[float, float, int, int]] = []
    for block in zip(lo, hi, n, pos):
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            last = out.pop()
            block = (last[0], block[1], last[2] + block[2], last[3] + block[3])
        out.append(block)
    return out


def _pooled(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("lo")
    return pd.DataFrame(pool(*[rows[c].tolist() for c in ("lo", "hi", "n", "pos")]), columns=["lo", "hi", "n", "pos"])


def blocks(preds: DataFrame, score: str, label: str, together: int = TOGETHER) -> DataFrame:
    """(lo, hi, n, pos, value): the isotonic fit of a 0/1 label as blocks of scores.
    Rows without a score or a label are left out; no rows, no blocks."""
    known = preds.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn(score, F.col(score).cast("double"))
    placed = M.cells(known, [], score, label).select(F.col("score").alias("lo"), F.col("score").alias("hi"), "n", "pos", F.col(ranges.PART).alias("part"))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _pooled(rows).assign(part=key[0])

    width = 1
    while True:
        group = F.floor(F.col("part") / width).alias("part")
        placed = written(placed.select("lo", "hi", "n", "pos", "part").groupBy(group).applyInPandas(merge, f"{_BLOCK}, part long"), "blocks")
        width = together
        if (placed.agg(F.max("part")).first()[0] or 0) == 0:
            return placed.select("lo", "hi", "n", "pos", (F.col("pos") / F.col("n")).alias("value"))


def apply(df: DataFrame, score: str, fitted: DataFrame, out: str) -> DataFrame:
    """Adds the calibrated score: a block's value inside it, straight lines between
    blocks, the end values beyond. Distinct scores meet the blocks in sorted
    ranges; a null score, or a fit without blocks, gives null."""
    asked = df.select(F.col(score).cast("double").alias("at")).where("at IS NOT NULL").distinct()
    block = F.struct("lo", "hi", "value")
    both = asked.select("at", F.lit(None).cast("struct<lo:double,hi:double,value:double>").alias("block")).union(fitted.select(F.col("lo").alias("at"), block.alias("block")))
    placed = ranges.spread(both, [], "at", "calibrated")
    parts = placed.groupBy(ranges.PART).agg(F.max("block").alias("top"), F.min("block").alias("low"))
    # one row per range
    order = Window.orderBy(ranges.PART)
    carried = parts.select(ranges.PART, F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                           F.min("low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy(ranges.PART).orderBy("at")
    # a block that begins at the score itself is on both sides
    before = F.max("block").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("block").over(Window.partitionBy(ranges.PART).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = placed.withColumns({"_b": before, "_a": after}).join(carried, ranges.PART)
    ends = met.where("block IS NULL").select("at", F.coalesce("_b", "_before").alias("b"), F.coalesce("_a", "_after").alias("a"))
    table = ends.select("at", value_between(F.col("at"), F.col("b"), F.col("a")).alias(out))
    return df.join(table.withColumnRenamed("at", "_at"), F.col(score).cast("double") == F.col("_at"), "left").drop("_at")


def value_between(at: Column, b: Column, a: Column) -> Column:
    """The value at a score whose last block at or before is `b` and next one `a`."""
    line = b["value"] + (a["value"] - b["value"]) * (at - b["hi"]) / (a["lo"] - b["hi"])
    return F.when(b.isNull(), a["value"]).when((at <= b["hi"]) | a.isNull() | (a["lo"] <= b["hi"]), b["value"]).otherwise(line)
