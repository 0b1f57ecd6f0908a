"""Extracts and filters of the dashboard, as plain DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators.splits import hash_sample_per_group


def _domestic():
    out = F.lit(True)
    lat, lon = F.col("lat"), F.col("lon")
    for country, (a, b, c, d) in K.COUNTRY_BOX.items():
        out = F.when(F.col("country") == country, lat.between(a, b) & lon.between(c, d)).otherwise(out)
    return out.cast("int")


def stations_on_map(stations: DataFrame) -> DataFrame:
    """Stations with usable coordinates inside the European envelope, rounded,
    with a flag for lying inside their own country."""
    a, b, c, d = K.EUROPE_BOX
    lat, lon = F.col("lat"), F.col("lon")
    usable = stations.where(lat.between(a, b) & lon.between(c, d) & ~((lat == 0) & (lon == 0)))
    return usable.withColumns({"lat": F.round("lat", 4), "lon": F.round("lon", 4)}).withColumn("domestic", _domestic())


def coverage_by_country(stations: DataFrame) -> DataFrame:
    """Domestic, foreign and missing-coordinate stations per country."""
    a, b, c, d = K.EUROPE_BOX
    lat, lon = F.col("lat"), F.col("lon")
    shown = C.truth(lat.between(a, b) & lon.between(c, d) & ~((lat == 0) & (lon == 0)))
    rounded = stations.withColumns({"_shown": shown, "_lost": lat.isNull() | lon.isNull(), "lat": F.round("lat", 4), "lon": F.round("lon", 4)})
    home = F.coalesce(_domestic(), F.lit(0)) == 1
    return rounded.groupBy("country").agg(
        F.count_if(F.col("_shown") & home).alias("n_domestic"), F.count_if(F.col("_shown") & ~home).alias("n_international"),
        F.count_if("_lost").alias("n_missing"))


def filter_predictions(preds: DataFrame, country: str | None = None, band: str | None = None, service: str | None = None,
                       first: str | None = None, last: str | None = None) -> DataFrame:
    out = preds.withColumn("band", C.probability_band("p_b"))
    if country:
        out = out.where(F.col("country") == country)
    if band:
        out = out.where(F.col("band") == band)
    if service:
        out = out.where(F.col("service_id").contains(service))
    if first:
        out = out.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last or first).cast("date")))
    return out


def case_flags(preds: DataFrame) -> DataFrame:
    y, yp, p = F.col("y_stop"), F.col("yp_b"), F.col("p_b")
    return preds.withColumns({
        "is_tp": C.flag((y == 1) & (yp == 1) & (p > 0.95)), "is_fp": C.flag((y == 0) & (yp == 1) & (p > 0.7)),
        "is_fn": C.flag((y == 1) & (yp == 0) & (F.col("delay_min") > 30)), "is_flip": C.flag(F.abs(p - F.col("p_a")) > 0.4)})


def outcome(preds: DataFrame) -> DataFrame:
    """Truth against prediction, and whether scenario B moved the score by 30 points."""
    y, yp = F.col("y_stop"), F.col("yp_b")
    points = (F.col("p_b") - F.col("p_a")) * 100
    tag = F.when(y == yp, F.when(y == 1, "hit").otherwise("quiet")).when(yp == 1, "false alarm").otherwise("miss")
    moved = F.abs(points) > 30
    return preds.withColumns({
        "outcome": tag, "shifted": C.flag(moved),
        "direction": F.when(moved, F.when(points > 0, "up").otherwise("down"))})


def prediction_sample(preds: DataFrame, n: int = 1250, seed: int = 42) -> DataFrame:
    """Up to n rows of every probability bucket, chosen by the hash of their stop."""
    bucketed = preds.withColumn("bucket", C.probability_bucket("p_b"))
    return hash_sample_per_group(bucketed, "bucket", n, ["service_id", "stop_order"], seed)


def cause_sample(scored: DataFrame, n: int = 1500, seed: int = 42) -> DataFrame:
    """Up to n scored rows of every country."""
    return hash_sample_per_group(scored, "country", n, ["service_id", "stop_order"], seed)


def cause_distribution(rows: DataFrame, label: str, weather: int | None = None, hour: int | None = None,
                       position: str | None = None, train_class: int | None = None) -> DataFrame:
    """Causes of the rows that pass the chosen filters, with shares."""
    out = rows
    if weather is not None:
        out = out.where(F.col("weather_severity") == weather)
    if hour is not None:
        out = out.where(F.col("scheduled_arrival_hour") == hour)
    if position is not None:
        out = out.where(C.position_category("is_origin", "is_terminus", "position_norm") == position)
    if train_class is not None:
        out = out.where(F.col("train_class_code") == train_class)
    per = out.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n")).scalar()
    return per.withColumn("share", F.col("n") / total)


def display_scores(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores for display: population deviation over all rows, 1 where it is 0."""
    from stopflow.operators.splits import scale, scaler_statistics

    return scale(rows, scaler_statistics(rows, columns), columns, suffix="_z")


def metric_extract(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """Model x scenario rows with rounded metrics."""
    names = ["pr_auc", "f1", "precision", "recall", "brier", "ece"]
    return metrics.select("model", "scenario", *[F.round(n, digits).alias(f"test_{n}") for n in names])
