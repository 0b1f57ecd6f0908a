"""Incremental load of operations files: the chunked load as a stream.

New files are picked up in micro-batches, filtered by date and appended to a
table. The counts of a batch come from an observation on its rows while they
are written, and go to a table of their own, so the log holds every batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopflow.functions import constants as K
from stopflow.sources.readers import csv, exists, in_window, source_file

KEPT = "_kept"


def operations_stream(spark: SparkSession, folder: str, schema: T.StructType, start=K.WINDOW_START, end=K.WINDOW_END,
                      files_per_batch: int = 8) -> DataFrame:
    """Streaming frame of all rows; `_kept` marks those inside the window."""
    declared = csv(spark, folder, schema).schema
    raw = (spark.readStream.schema(declared).option("header", True).option("maxFilesPerTrigger", files_per_batch)
           .option("recursiveFileLookup", True).csv(folder).withColumn("file", source_file()))
    return raw.withColumn(KEPT, F.coalesce(in_window("date", start, end), F.lit(False)))


def load(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Write the kept rows of everything available below `out`, one folder per
    batch, and return one row (batch, raw_rows, kept_rows, cum_kept) for every
    batch of this checkpoint. A batch that is run again replaces its folders."""
    spark = stream.sparkSession
    log = f"{checkpoint}/counts"

    def write(rows: DataFrame, batch: int) -> None:
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("raw_rows"), F.count_if(KEPT).alias("kept_rows"))
        counted.where(KEPT).drop(KEPT).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        n = seen.get
        spark.range(1).select(F.lit(n["raw_rows"]).cast("long").alias("raw_rows"), F.lit(n["kept_rows"]).cast("long").alias("kept_rows")).write.mode(
            "overwrite").parquet(f"{log}/batch={batch}")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/offsets")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    counts = spark.read.schema("raw_rows long, kept_rows long, batch long").parquet(log) if exists(spark, log) else spark.createDataFrame(
        [], "raw_rows long, kept_rows long, batch long")
    # one row per batch
    return counts.select("batch", "raw_rows", "kept_rows", F.sum("kept_rows").over(Window.orderBy("batch")).alias("cum_kept"))
