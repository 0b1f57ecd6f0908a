"""Session settings and the shared scratch folder.

Nothing here pins a machine size: partition counts are left to adaptive
execution, and only the options the semantics depend on (UTC) are set on a
session that somebody else created.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime options which are safe to set on any session.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Top-n per group is cut inside every input partition for any n.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2147483647",
}

# Aim of one shuffle partition.
SHUFFLE_PARTITION_BYTES = 256 * 1024 * 1024

# A fit runs hundreds of short jobs over the same rows: parts below FEW_ROWS cost more
# to start than to work through, so there are no more than SOME_PARTS of them until
# MANY_ROWS are in each.
FEW_ROWS, SOME_PARTS, MANY_ROWS = 25_000, 48, 250_000

# Row groups of the rows of a fit: a part is read as some of them, so they are small.
FIT_GROUP_BYTES = 8 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the options the operators rely on to an existing session."""
    for name, value in RUNTIME_OPTIONS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def options_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle and scan sizes for an input of this size: enough shuffle
    partitions to keep each near 256 MB (adaptive execution merges small ones,
    it never splits ordinary ones), and larger scan splits for large inputs."""
    partitions = max(cores * 2, -(-input_bytes // SHUFFLE_PARTITION_BYTES))
    split = "256m" if input_bytes > 1 << 40 else "128m"
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": split,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    }


def local_session(cores: int | str = 8, name: str = "stopflow") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("STOPFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_folder(spark)
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; without that, the checkpoint
    folder that somebody has set on the context is used. A session on a single
    machine that has neither gets a folder of its own, where every task sees the
    same disk, and which goes when the program ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        own = tempfile.mkdtemp(prefix="stopflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(Path(own).as_uri())
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df):
    """Cut lineage through the shared folder (survives executor loss)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A runtime option that holds while the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df, name: str):
    """The frame as a table in the shared folder: its size is known to later plans."""
    return _written_at(df, scratch_path(df.sparkSession, name))


def _written_at(df, path: str, **options):
    """What the write shuffled goes with it, not when the driver next collects garbage."""
    spark = df.sparkSession
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fit_parts(n_rows: int) -> int:
    """Parts for the rows of a fit, from their number alone."""
    return max(1, min(-(-n_rows // FEW_ROWS), SOME_PARTS), -(-n_rows // MANY_ROWS))


def dealt(df, name: str):
    """The rows of a fit, written once and dealt evenly into `fit_parts` parts, which
    are kept in memory and on disk: every job over them has as many tasks as the rows
    are worth, whatever plan made them. Unpersist when the fit is done."""
    rows = written(df, name)
    return rows.repartition(fit_parts(rows.count())).persist()


@contextmanager
def fit_rows(df, name: str):
    """The rows of one fit, written once; the table goes when the block ends. While a
    part is worth FEW_ROWS, they are dealt evenly into `fit_parts` parts by a shuffle. A
    fit shuffles its rows several times, so more rows are read where they are, in about
    as many parts."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        rows = _written_at(df, path, **{"parquet.block.size": FIT_GROUP_BYTES})
        n_rows = rows.count()
        parts = fit_parts(n_rows)
        if n_rows <= FEW_ROWS * SOME_PARTS:
            yield rows.repartition(parts)
        else:
            with setting(spark, "spark.sql.files.minPartitionNum", str(parts)):
                yield rows.coalesce(parts)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
