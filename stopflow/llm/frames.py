"""Small helpers every operator uses: column picking, shared storage, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: later plans start
    from files that outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Remainder of the CRC-32 of the id written as text; a null id counts as an
    empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links: one row (id, component_id) for every
    id that occurs, component_id being the smallest id that can be reached.

    Alternating large-star and small-star steps. Both aggregate before they
    shuffle and join back, so a hub with any number of links is never gathered
    in one task. Null ends and loops are ignored. Fails rather than stopping
    early when `rounds` do not suffice (the bound is logarithmic in practice).
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    done = links.isEmpty()
    for _ in range(rounds):
        if done:
            break
        # large star: every larger neighbour of u is tied to u's smallest one
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = stored(tied, "links")
        # a forest of stars: no end is a centre of another
        centre = after.select(F.col("v").alias("u")).distinct()
        done = after.join(centre, "u", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty()
        links = after
    if not done:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(links.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
