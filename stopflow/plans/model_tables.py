"""Fitted models as tables, scored and explained with expressions.

A linear model is a row per column with its coefficient; trees are a row per
node. Both are small (columns; trees x nodes), so they reach the rows as one
packed value, and scoring is a projection: no shuffle, no Python, no model
object. Any engine that reads the tables gets the same scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.session import scratch_path

NODE = "tree int, node int, feature string, cut double, left int, right int, value double, rows long, weight double"


def linear_table(model: Model, columns: Sequence[str], spark) -> DataFrame:
    """(feature, coefficient) of a fitted binary linear model; the intercept has no feature."""
    rows = [*zip(columns, map(float, model.coefficients)), (None, float(model.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def tree_table(model: Model, columns: Sequence[str], spark) -> DataFrame:
    """One row per node of fitted trees: `feature` and `cut` lead to `left` (at most
    the cut) or `right`, leaves have none; `value` is the node's mean, `rows` the
    training rows in it and `weight` the tree's share of the margin."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    names = F.array(*[F.lit(c) for c in columns])
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "tree int, weight double")
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, F.get(names, n["split"]["featureIndex"])).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], 0)).alias("cut"), F.when(inner, n["leftChild"]).alias("left"),
        F.when(inner, n["rightChild"]).alias("right"), n["prediction"].alias("value"), n["rawCount"].alias("rows"))
    return nodes.join(F.broadcast(weights), "tree")


def classifier_of(pipeline: PipelineModel) -> Model:
    return pipeline.stages[-1]


def _number(c: str, fill: dict[str, float] | None) -> Column:
    v = F.col(c).cast("double")
    return F.coalesce(v, F.lit(float(fill[c]))) if fill else v


def score_linear(df: DataFrame, table: DataFrame, columns: Sequence[str], out: str = "p_disrupted", fill: dict[str, float] | None = None) -> DataFrame:
    """Probability of a linear table: the logistic of the weighted sum."""
    packed = table.select(F.map_from_entries(F.collect_list(F.struct(F.coalesce("feature", F.lit("")), "coefficient")))).scalar()
    df = df.withColumn("_m", packed)
    margin = F.col("_m")[""]
    for c in columns:
        margin = margin + F.col("_m")[c] * _number(c, fill)
    return df.withColumn(out, 1 / (1 + F.exp(-margin))).drop("_m")


def _packed(nodes: DataFrame, columns: Sequence[str]) -> Column:
    """All trees as an array of (weight, nodes by number); bounded by the model."""
    index = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature")).cast("int"), F.lit(0))
    node = F.struct("node", index.alias("at"), "cut", "left", "right", "value")
    trees = nodes.groupBy("tree").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list(node)).alias("nodes"))
    return trees.select(F.sort_array(F.collect_list(F.struct("tree", "weight", "nodes")))).scalar()


def _walk(tree: Column, x: Column, depth: int) -> Column:
    """Numbers of the nodes on a row's way through a tree, leaf last."""
    def step(way: Column, _: Column) -> Column:
        n = F.get(tree["nodes"], F.element_at(way, -1))
        ahead = F.when(F.element_at(x, n["at"]) <= n["cut"], n["left"]).otherwise(n["right"])
        return F.when(n["at"] == 0, way).otherwise(F.concat(way, F.array(ahead)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(F.lit(0)), step)


def _depth(nodes: DataFrame) -> int:
    """No way is longer than half the nodes of the largest tree."""
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    return max(1, int(most) // 2)


def score_trees(df: DataFrame, nodes: DataFrame, columns: Sequence[str], out: str = "p_disrupted", margin: str | None = None,
                fill: dict[str, float] | None = None, depth: int | None = None) -> DataFrame:
    """Probability of boosted trees: the logistic of twice the weighted sum of the
    leaves. `margin` also keeps that sum; `depth` bounds the ways, if it is known."""
    x, trees, depth = F.array(*[_number(c, fill) for c in columns]), _packed(nodes, columns), depth or _depth(nodes)
    leaf = lambda t: F.get(t["nodes"], F.element_at(_walk(t, F.col("_x"), depth), -1))["value"]
    total = F.aggregate("_t", F.lit(0.0), lambda a, t: a + t["weight"] * leaf(t))
    done = df.withColumns({"_x": x, "_t": trees}).withColumn("_margin", total).drop("_x", "_t").withColumn(out, 1 / (1 + F.exp(-2 * F.col("_margin"))))
    return done.withColumnRenamed("_margin", margin) if margin else done.drop("_margin")


def contributions(df: DataFrame, nodes: DataFrame, columns: Sequence[str], ids: Sequence[str], fill: dict[str, float] | None = None,
                  depth: int | None = None) -> DataFrame:
    """(ids, feature, contribution): what each step down the trees adds to a row's
    margin, by the column that decided it. A step adds the difference of the
    means of the two nodes, so a row's contributions and the `base` row (the
    roots' means, with no feature) add up to its margin."""
    x, trees, depth = F.array(*[_number(c, fill) for c in columns]), _packed(nodes, columns), depth or _depth(nodes)
    names = F.array(*[F.lit(c) for c in columns])

    def steps(t: Column) -> Column:
        way = _walk(t, F.col("_x"), depth)
        at = lambda i: F.get(t["nodes"], F.get(way, i))
        root = F.struct(F.lit(None).cast("string").alias("feature"), (t["weight"] * F.get(t["nodes"], 0)["value"]).alias("c"))
        if_any = F.when(F.size(way) > 1, F.transform(F.sequence(F.lit(1), F.size(way) - 1), lambda i: F.struct(
            F.element_at(names, at(i - 1)["at"]).alias("feature"), (t["weight"] * (at(i)["value"] - at(i - 1)["value"])).alias("c"))))
        return F.concat(F.array(root), F.coalesce(if_any, F.array().cast("array<struct<feature:string,c:double>>")))

    walked = df.withColumns({"_x": x, "_t": trees}).select(*ids, F.explode(F.flatten(F.transform("_t", steps))).alias("s"))
    return walked.groupBy(*ids, F.col("s.feature").alias("feature")).agg(F.sum("s.c").alias("contribution"))
