"""Joins with the exact matching rules of the data model. Sides are never
hinted: adaptive execution broadcasts a side only after measuring it, and splits
skewed partitions of the larger one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators.features import fault_count


def stop_grain(stops: DataFrame, services: DataFrame) -> DataFrame:
    """Stops with date and class of their service; stops without a dated service drop."""
    dim = services.where("date IS NOT NULL").groupBy("service_id").agg(
        F.min(F.struct("date", "train_class_code")).alias("_s")).select("service_id", "_s.*")
    out = stops.drop("date", "train_class_code").join(dim, "service_id")
    cancelled = "cancelled" if "cancelled" in stops.columns else None
    return out.withColumns({"y_stop": C.late("delay_minutes", cancelled), "delay_min": F.col("delay_minutes").cast("double")})


def with_fallback(facts: DataFrame, key: str, first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns from the first source, from the second where the first has none."""
    a = first.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = second.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    out = facts.join(a, key, "left").join(b, key, "left")
    return out.withColumns({c: F.coalesce(f"_a_{c}", f"_b_{c}") for c in columns}).drop(
        *[f"_{s}_{c}" for s in "ab" for c in columns])


def with_label(facts: DataFrame, key: str, names: DataFrame, name: str, out: str = "label") -> DataFrame:
    """Readable name, or the key itself."""
    return facts.join(names.select(key, F.col(name).alias("_name")), key, "left").withColumn(
        out, F.coalesce("_name", F.col(key))).drop("_name")


def recent_faults(stops: DataFrame, faults: DataFrame, days: int = 14) -> DataFrame:
    """Faults of the inclusive window [d-days, d] at each stop's station. Counted
    per station and day before stops are touched, so hubs do not multiply rows."""
    grain = stops.select("station_id", "date").distinct()
    counted = fault_count(grain, faults, first=days, last=0, name="recent_faults", calendar=None)
    return stops.join(counted, ["station_id", "date"], "left").withColumn(
        "recent_faults", F.coalesce("recent_faults", F.lit(0.0)).cast("long"))


def lookup_name(names: DataFrame, name: str, wanted: Sequence[str], columns: Sequence[str], key: str = "wanted") -> DataFrame:
    """Rows of a short list of names: exact match, else the first name (in order)
    that contains the first word of the wanted one. Every row is tested against
    the list in place, so no join is needed to find the candidates."""
    options = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(w.split(" ")[0]).alias("word")) for w in wanted])
    fits = F.filter(options, lambda o: F.col(name).contains(o["word"]))
    found = names.withColumn("_o", F.explode(fits)).groupBy(F.col("_o.w").alias(key)).agg(
        F.min(F.struct((F.col(name) != F.col("_o.w")).cast("int").alias("_rank"), name, *columns)).alias("_m"))
    asked = names.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} string")
    return asked.join(found, key, "left").select(key, f"_m.{name}", *[f"_m.{c}" for c in columns])


def on_stop(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("service_id", "station_id", "stop_order")) -> DataFrame:
    """One-to-one join of stop tables: the stop order is part of the key, so a
    service that visits a station twice does not multiply."""
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*keys, *extra), list(keys), "left")
