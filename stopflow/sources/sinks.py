"""Writers. All of them write to a fresh path and never collect rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopflow.functions import columns as C
from stopflow.sources import schemas
from stopflow.sources.readers import exists


def save_standard(df: DataFrame, path: str, table: str, fmt: str = "parquet") -> str:
    """One of the five tables, checked against its schema."""
    out = schemas.validate(df, table)
    writer = out.write.option("header", True) if fmt == "csv" else out.write
    writer.format(fmt).save(path)
    return path


def save_features(df: DataFrame, path: str) -> str:
    """Feature store, one folder per split."""
    df.write.partitionBy("split").parquet(path)
    return path


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, order: Sequence[str] = ()) -> str:
    """Table bucketed (and sorted) by a key. Scans, windows and joins on that key
    then need no shuffle; choose `buckets` so that one bucket fits a task."""
    (df.write.option("path", path).bucketBy(buckets, key).sortBy(*(order or [key])).mode("overwrite").saveAsTable(table))
    return table


def manifest(df: DataFrame) -> DataFrame:
    """Rows, label rate, services and dates per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("y_stop").alias("y_stop_rate"),
        F.countDistinct("service_id").alias("n_services"), F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date"))


def scored(df: DataFrame, probability, threshold: float, model: str, scenario: str, extra: Sequence[str] = ()) -> DataFrame:
    """Prediction rows in the common layout."""
    p = C.col(probability)
    keep = [c for c in schemas.PREDICTIONS if c in df.columns and c not in ("p_disrupted", "y_pred")]
    more = [c for c in extra if c in df.columns and c not in keep]
    return df.select(*keep, *more, p.alias("p_disrupted"), (p >= threshold).cast("int").alias("y_pred"),
                     F.lit(model).alias("model"), F.lit(scenario).alias("scenario"))


def save_predictions(df: DataFrame, path: str) -> str:
    """Replaces the runs (model, scenario) that the rows belong to, so that saving
    a run twice leaves it there once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "scenario").parquet(path)
    return path


def cached_table(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read a table if it was written before, else compute and write it once."""
    if not exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column, so JSON stays valid."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[C.finite_or_null(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def save_json(df: DataFrame, path: str) -> str:
    json_safe(df).write.json(path)
    return path


def save_graph(graph, path: str) -> dict[str, str]:
    """The six tables of the property graph."""
    out = {}
    for name, df in graph.tables().items():
        out[name] = f"{path}/{name}"
        df.write.parquet(out[name])
    return out


def output_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """File, rows and columns of every output, counted in one job per table."""
    parts = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))
        parts = one if parts is None else parts.unionByName(one)
    return parts
