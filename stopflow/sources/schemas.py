"""Types of the standard tables and of the raw feeds."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopflow.functions import constants as K

log = logging.getLogger("stopflow")

_TYPES = {
    "station_id": "string", "lat": "double", "lon": "double", "avg_historical_delay": "double", "degree": "int",
    "service_id": "string", "train_class_code": "int", "date": "date", "is_disrupted": "int",
    "delay_minutes": "double", "weather_severity": "int", "temperature": "double", "wind_speed": "double",
    "precipitation": "double", "snow_depth": "double", "station_from": "string", "station_to": "string",
    "distance_km": "double", "fault_id": "string", "description": "string",
}


_CLASSES = {
    "string": T.StringType(), "int": T.IntegerType(), "smallint": T.ShortType(), "tinyint": T.ByteType(), "double": T.DoubleType(),
    "float": T.FloatType(), "date": T.DateType(), "boolean": T.BooleanType(),
}


def struct(columns: dict[str, str]) -> T.StructType:
    """Schema from names and type names; works before any session exists."""
    return T.StructType([T.StructField(n, _CLASSES[t]) for n, t in columns.items()])


def standard(table: str) -> T.StructType:
    return struct({c: _TYPES[c] for c in K.STANDARD_TABLES[table]})


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return [c for c in K.STANDARD_TABLES[table] if c not in df.columns]


def column_report(df: DataFrame, table: str) -> DataFrame:
    """One row per standard column of a table: whether it is there, and its known values."""
    known = {c: F.count(c) if c in df.columns else F.lit(0).cast("long") for c in K.STANDARD_TABLES[table]}
    counts = df.agg(*[v.alias(c) for c, v in known.items()]).unpivot([], list(known), "column", "n_values")
    return counts.select(F.lit(table).alias("table"), "column", F.col("column").isin(df.columns).alias("present"), "n_values")


def validate(df: DataFrame, table: str, strict: bool = False) -> DataFrame:
    """Warn about (or refuse) a table that lacks standard columns."""
    missing = missing_columns(df, table)
    if missing and strict:
        raise ValueError(f"{table} lacks columns {missing}")
    if missing:
        log.warning("table %s lacks columns %s", table, missing)
    return df


def empty_faults(spark) -> DataFrame:
    """Typed empty fault table for countries without a structured fault log."""
    return spark.createDataFrame([], standard("nodes_fault"))


# Raw IT operations: declared types for the numeric columns, delays as text.
OPERATIONS = struct({
    "train_id": "string", "train_number": "int", "train_class": "string", "date": "date", "station_name": "string",
    "station_order": "smallint", "week": "tinyint", "arrival_delay": "string", "departure_delay": "string",
    "initial_delay": "string", "final_delay": "string", "scheduled_running_time": "string", "scheduled_stop_time": "string",
    "weather": "string", "wind_speed": "float", "temperature_min": "float", "temperature_max": "float", "holiday": "boolean",
})

# Predictions, the same for every model.
PREDICTIONS = ["service_id", "station_id", "country", "date", "train_class_code", "stop_order", "position_norm",
               "y_stop", "delay_min", "p_disrupted", "y_pred"]

_NUMBERS = T.ArrayType(T.DoubleType())
WEATHER_PAYLOAD = T.StructType([
    T.StructField("station_code", T.StringType()),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())), T.StructField("temperature_2m_mean", _NUMBERS),
        T.StructField("wind_speed_10m_max", _NUMBERS), T.StructField("precipitation_sum", _NUMBERS),
        T.StructField("snow_depth_max", _NUMBERS)])),
])
