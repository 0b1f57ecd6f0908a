"""Readers. Filters are plain predicates on declared columns, so they reach the
file scan; nothing infers a schema from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators.parse import rename_known
from stopflow.sources import schemas



def source_file(pattern: str = r"([^/]+)$"):
    """Part of the input path that names the file (or the folder of its parts)."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, encoding: str | None = None) -> DataFrame:
    """CSV with a header. A schema declares types by *name*; columns of the file
    it does not know stay text. Only the header line is read to plan this."""
    reader = spark.read.option("header", True)
    if encoding:
        reader = reader.option("encoding", encoding)
    plain = reader.csv(path)
    if schema is None:
        return plain
    known = {f.name: f.dataType for f in schema}
    typed = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in plain.columns])
    return reader.schema(typed).csv(path)


def in_window(date: str = "date", start=K.WINDOW_START, end=K.WINDOW_END):
    return F.col(date).cast("date").between(F.lit(start), F.lit(end))


def operations(spark: SparkSession, path: str, start=K.WINDOW_START, end=K.WINDOW_END) -> DataFrame:
    """IT operations with the date filter applied while reading."""
    return csv(spark, path, schemas.OPERATIONS).where(in_window("date", start, end))


def load_log(df: DataFrame, kept, pattern: str = r"([^/]+)$") -> DataFrame:
    """Per file: rows read, rows kept, and kept rows so far (files in name order)."""
    per_file = df.groupBy(source_file(pattern).alias("file")).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(kept).alias("kept_rows"))
    return per_file.withColumn("cum_kept", F.sum("kept_rows").over(Window.orderBy("file")))


def yearly_files(folder: str, start=K.WINDOW_START, end=K.WINDOW_END) -> list[str]:
    """Glob patterns of the monthly FI files for the years of the window."""
    return [f"{folder}/matched_data_{y}_*" for y in sorted({start.year, end.year})]


def finland(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly FI files, all text, with the name of their file."""
    raw = csv(spark, yearly_files(folder))
    return raw.withColumn("file", source_file(r"(matched_data_[^/]+)"))


def netherlands_services(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly NL files: renamed, filtered by date, delays and cancellation parsed."""
    raw = csv(spark, f"{folder}/services-2024-*").withColumn("file", source_file(r"(services-2024-[^/]+)"))
    df = rename_known(raw, K.NL_HEADERS)
    df = df.withColumn("date", F.col("date").try_cast("date")).where(in_window())
    flags = cancellation_sources(df)
    return df.withColumns(flags | {"cancelled": C.any_of(*flags.values())}).withColumns({
        "arrival_delay": C.delay_value("arrival_delay"), "departure_delay": C.delay_value("departure_delay"),
        "max_delay_min": F.col("max_delay_min").try_cast("float").cast("double"),
        "station_code": C.code("station_code"), "train_type": F.trim("train_type")})


def cancellation_sources(df: DataFrame) -> dict:
    """The five signs of a cancelled NL stop ('partly cancelled' is not one)."""
    def of(c):
        return C.tolerant_bool(c, accept_digits=False) if c in df.columns else F.lit(False)

    return {
        "s_arrival": C.delay_cancelled("arrival_delay"), "s_departure": C.delay_cancelled("departure_delay"),
        "fully_cancelled": of("fully_cancelled"), "arrival_cancelled": of("arrival_cancelled"),
        "departure_cancelled": of("departure_cancelled"),
    }


def file_rows(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows per file and running total."""
    per = df.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"))
    return per.withColumn("cum_rows", F.sum("n_rows").over(Window.orderBy(file)))


def file_inventory(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows and mean share of missing cells per file."""
    columns = [c for c in df.columns if c != file]
    missing = sum((F.avg(F.col(f"`{c}`").isNull().cast("int")) for c in columns), F.lit(0.0)) / len(columns)
    return df.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("nan_rate"))


def weather_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed weather responses (arrays per station) to one row per station and day."""
    raw = spark.read.schema("value string").text(path).select(F.from_json("value", schemas.WEATHER_PAYLOAD).alias("p"))
    return explode_payload(raw.select("p.*"))


def explode_payload(df: DataFrame) -> DataFrame:
    d = "daily"
    zipped = F.arrays_zip(
        F.col(f"{d}.time").alias("time"), F.col(f"{d}.temperature_2m_mean").alias("temperature"),
        F.col(f"{d}.wind_speed_10m_max").alias("wind_speed"), F.col(f"{d}.precipitation_sum").alias("precipitation"),
        F.col(f"{d}.snow_depth_max").alias("snow_depth"))
    return df.select("station_code", F.explode(zipped).alias("r")).select(
        "station_code", F.col("r.time").try_cast("date").alias("date"), "r.temperature", "r.wind_speed",
        "r.precipitation", "r.snow_depth")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, as the reader sees it; an empty folder does."""
    try:
        spark.read.format("text").load(path).schema  # noqa: B018  (the path is looked up here)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_countries(spark: SparkSession, folders: Sequence[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """The five tables of all countries. Missing files are skipped, but four of
    the five tables must exist; faults default to an empty table. Stations and
    services are unique by id (first folder wins)."""
    out: dict[str, DataFrame] = {}
    for table in K.STANDARD_TABLES:
        parts = None
        for rank, folder in enumerate(folders):
            path = f"{folder}/{table}"
            if not exists(spark, path):
                schemas.log.warning("missing %s", path)
                continue
            reader = spark.read.option("header", True)
            one = (reader.schema(schemas.standard(table)) if fmt == "csv" else reader).format(fmt).load(path)
            one = one.withColumn("_rank", F.lit(rank))
            parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
        if parts is not None:
            out[table] = parts
    absent = [t for t in K.STANDARD_TABLES if t not in out and t != "nodes_fault"]
    if absent:
        raise FileNotFoundError(f"standard tables missing: {absent}")
    for table, key in (("nodes_station", "station_id"), ("nodes_service", "service_id")):
        rest = [c for c in out[table].columns if c not in (key, "_rank")]
        out[table] = out[table].groupBy(key).agg(
            F.min_by(F.struct(*rest), F.struct("_rank", *rest)).alias("r")).select(key, "r.*")
    out.setdefault("nodes_fault", schemas.empty_faults(spark))
    return {k: v.drop("_rank") for k, v in out.items()}


def predictions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame | None:
    """All prediction runs under one folder as one scan; None when there are none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df if split is None else df.where(F.col("split") == split)


def training_inputs(spark: SparkSession, store: str, scenario: str) -> tuple[DataFrame, list[str]]:
    """Feature store with the legal model columns of a scenario (checked again)."""
    from stopflow.operators.guards import check_no_leak, model_columns

    df = spark.read.parquet(store)
    columns = [c for c in model_columns(df, scenario) if c not in ("seq",)]
    check_no_leak(columns, scenario)
    return df, columns


def columns(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Column-pruned scan."""
    return spark.read.parquet(path).select(*names)


def verify_files(spark: SparkSession, path: str, expected: DataFrame, pattern: str = r"([^/]+)$") -> DataFrame:
    """Landed files against a manifest (file, n_lines, n_chars, hash_a, hash_b)
    made by `fingerprints` at the sender: whole contents, in splittable scans,
    whatever the size of a file. A missing file fails both checks."""
    found = fingerprints(spark, path, pattern).toDF("file", "f_lines", "f_chars", "f_a", "f_b")
    size = (F.col("f_lines") == F.col("n_lines")) & (F.col("f_chars") == F.col("n_chars"))
    content = (F.col("f_a") == F.col("hash_a")) & (F.col("f_b") == F.col("hash_b"))
    return expected.join(found, "file", "left").select("file", C.truth(size).cast("int").alias("size_ok"), C.truth(content).cast("int").alias("content_ok"))


def fingerprints(spark: SparkSession, path: str, pattern: str = r"([^/]+)$") -> DataFrame:
    """Order-free content fingerprint per file from a splittable scan: lines,
    characters and two sums of line hashes."""
    lines = spark.read.text(path).withColumn("file", source_file(pattern))
    h = F.xxhash64("value")
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("n_chars"),
        F.sum(F.pmod(h, F.lit(1_000_003))).alias("hash_a"), F.bit_xor(h).alias("hash_b"))
