"""Builders of the five standard tables from cleaned country feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators.scan import keyed_scan, tag_slices


# -- adjacency --------------------------------------------------------------------

def consecutive_pairs(df: DataFrame, key: Sequence[str], order: Sequence[str], station: str,
                      distance: str | None = None) -> DataFrame:
    """Neighbouring stations along an ordered route: `a`, `b`, `d` (|difference|)."""
    columns = [station] + ([distance] if distance else [])
    slim = df.select(*dict.fromkeys([*key, *order, *columns]))
    scanned = keyed_scan(tag_slices(slim, key, order), order, nxt=columns).df
    gap = F.abs(F.col(f"next_{distance}") - F.col(distance)) if distance else F.lit(0.0)
    return scanned.where(F.col("_rn") < F.col("_n") - 1).select(
        F.col(station).alias("a"), F.col(f"next_{station}").alias("b"), gap.alias("d"))


def both_directions(pairs: DataFrame) -> DataFrame:
    """Mean distance per directed pair, self-loops dropped, both directions.

    Pairs are aggregated once before they are mirrored, which halves the shuffle.
    """
    once = pairs.where("a <> b").groupBy("a", "b").agg(
        F.sum("d").alias("s"), F.count("d").alias("n"))
    twice = once.select(F.explode(F.array(
        F.struct(F.col("a").alias("f"), F.col("b").alias("t")),
        F.struct(F.col("b").alias("f"), F.col("a").alias("t")))).alias("p"), "s", "n")
    return twice.groupBy(F.col("p.f").alias("station_from"), F.col("p.t").alias("station_to")).agg(
        F.round(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), 2).alias("distance_km"))


def adjacency_from_order(df: DataFrame, key: Sequence[str], order: Sequence[str], station: str,
                         distance: str | None = None) -> DataFrame:
    """Edges from the order of stops: IT (with distances) and FI (distance 0)."""
    return both_directions(consecutive_pairs(df, key, order, station, distance))


def order_column(columns: Sequence[str]) -> str | None:
    """First of the columns that can order a route."""
    return next((c for c in ("scheduled_time", "station_order", "stop_sequence") if c in columns), None)


def unpivot_matrix(matrix: DataFrame, row_key: str) -> DataFrame:
    """Wide distance matrix to (from_code, to_code, cell)."""
    columns = [c for c in matrix.columns if c != row_key]
    text = matrix.select(row_key, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return text.unpivot([row_key], columns, "to_code", "cell").withColumnRenamed(row_key, "from_code")


def adjacency_from_matrix(matrix: DataFrame, row_key: str, station_map: DataFrame) -> DataFrame:
    """Edges from a tariff matrix: unreadable cells, unknown codes and self-pairs drop."""
    cells = unpivot_matrix(matrix, row_key).select(
        C.code("from_code").alias("from_code"), C.code("to_code").alias("to_code"),
        F.col("cell").try_cast("double").alias("km")).where("km IS NOT NULL")
    origin = station_map.select(F.col("station_code").alias("from_code"), F.col("station_id").alias("station_from"))
    target = station_map.select(F.col("station_code").alias("to_code"), F.col("station_id").alias("station_to"))
    return cells.join(origin, "from_code").join(target, "to_code").where(
        "station_from <> station_to").select("station_from", "station_to", F.round("km", 2).alias("distance_km"))


def matrix_statistics(matrix: DataFrame, row_key: str, station_map: DataFrame) -> DataFrame:
    """Cells, marked diagonal, unreadable cells and usable edges. A cell's codes
    are looked up in the small station map; nothing is counted on the driver."""
    cells = unpivot_matrix(matrix, row_key)
    known = station_map.select("station_code", "station_id")
    origin = known.select(F.col("station_code").alias("fc"), F.col("station_id").alias("f"))
    target = known.select(F.col("station_code").alias("tc"), F.col("station_id").alias("t"))
    km = F.col("cell").try_cast("double")
    joined = cells.join(origin, C.code("from_code") == F.col("fc"), "left").join(
        target, C.code("to_code") == F.col("tc"), "left")
    edge = km.isNotNull() & F.col("f").isNotNull() & F.col("t").isNotNull() & (F.col("f") != F.col("t"))
    return joined.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("cell") == "XXX").alias("n_xxx"),
        F.count_if(km.isNull()).alias("n_nan"), F.count_if(edge).alias("n_edges"))


# -- stations -----------------------------------------------------------------------

def _history(delay: str, cancelled: str, date: str, ref_end) -> Column:
    usable = ~C.truth(F.col(cancelled))
    if ref_end is not None:
        usable = usable & (F.col(date) <= F.lit(ref_end).cast("date"))
    return F.coalesce(F.avg(F.when(usable, F.col(delay))), F.lit(0.0))


def italy_stations(ops: DataFrame, master: DataFrame, mileage: DataFrame, ref_end=K.HISTORY_REF_END) -> DataFrame:
    """Stations by name: early mean delay, degree from route neighbours, coordinates."""
    measured = ops.where(F.col("station_name").isNotNull()).groupBy("station_name").agg(
        _history("arrival_delay", "cancelled", "date", ref_end).alias("avg_historical_delay"))
    pairs = consecutive_pairs(mileage, ["train_id"], ["station_order", "station_name"], "station_name").select("a", "b").distinct()
    degree = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(
        F.col("a").alias("station_name")).agg(F.countDistinct("b").alias("degree"))
    coords = master.groupBy(C.code("name").alias("station_name")).agg(
        F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    out = measured.join(coords, "station_name", "left").join(degree, "station_name", "left")
    return out.select(C.prefixed_id("IT", "station_name").alias("station_id"), "lat", "lon",
                      "avg_historical_delay", F.coalesce("degree", F.lit(1)).cast("int").alias("degree"))


def finland_stations(stops: DataFrame, train: str = "train_number", ref_end=K.HISTORY_REF_END) -> DataFrame:
    """Stations by code: mean delay, distinct trains, first known coordinates."""
    return stops.groupBy("station_code").agg(
        F.min_by("lat", F.when(F.col("lat").isNotNull(), F.col("seq"))).alias("lat"),
        F.min_by("lon", F.when(F.col("lon").isNotNull(), F.col("seq"))).alias("lon"),
        _history("delay_minutes", "cancelled", "departure_date", ref_end).alias("avg_historical_delay"),
        F.countDistinct(train).cast("int").alias("degree"),
    ).select(C.prefixed_id("FI", "station_code").alias("station_id"), "lat", "lon",
             "avg_historical_delay", "degree")


def netherlands_stations(stops: DataFrame, master: DataFrame, ref_end=K.HISTORY_REF_END) -> DataFrame:
    measured = stops.where(F.col("station_code").isNotNull()).groupBy("station_code").agg(
        _history("arrival_delay", "cancelled", "date", ref_end).alias("avg_historical_delay"),
        F.countDistinct("service_id_raw").cast("int").alias("degree"))
    coords = master.groupBy(C.code("code").alias("station_code")).agg(
        F.min("geo_lat").alias("lat"), F.min("geo_lng").alias("lon"))
    return measured.join(coords, "station_code", "left").select(
        C.prefixed_id("NL", "station_code").alias("station_id"), "lat", "lon", "avg_historical_delay", "degree")


def stations_from_rows(rows: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Station table rebuilt from stop rows: the first row of each station wins."""
    return rows.groupBy("station_id").agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select("station_id", "r.*")


# -- services and stops ----------------------------------------------------------------

def services(df: DataFrame, service_id: Column, date: str, train_type: str, delay: str,
             cancelled: str = "cancelled", extra: Sequence[str] = ()) -> DataFrame:
    """One row per service with class code and 'any stop late or cancelled'."""
    return df.groupBy(service_id.alias("service_id"), F.col(date).alias("date"),
                      F.col(train_type).alias("_type"), *extra).agg(
        F.max(C.late(delay, cancelled)).alias("is_disrupted")).select(
        "service_id", C.train_class("_type").alias("train_class_code"), "date", "is_disrupted", *extra)


WEATHER = ["temperature", "wind_speed", "precipitation", "snow_depth"]


def stops_at(df: DataFrame, service_id: Column, station: str, delay: str, station_map: DataFrame,
             rename: dict[str, str] | None = None, missing: float | None = None,
             extras: Sequence[str] = ()) -> DataFrame:
    """Stop edges. Rows of unknown stations drop; a weather column the feed does
    not have becomes `missing` (NULL, or 0 for the FI feed)."""
    df = df.withColumnsRenamed(rename or {})
    present = {c: F.col(c) if c in df.columns else F.lit(missing).cast("double") for c in WEATHER}
    severity = F.col("weather_severity") if "weather_severity" in df.columns else F.lit(0)
    known = station_map.select(F.col("station_code").alias(station), "station_id")
    slim = df.drop("station_id") if station != "station_id" else df
    return slim.withColumn("_service", service_id).join(known, station).select(
        F.col("_service").alias("service_id"), "station_id", F.col(delay).cast("double").alias("delay_minutes"),
        severity.cast("int").alias("weather_severity"),
        *[c.cast("double").alias(n) for n, c in present.items()], *extras)


# -- faults -------------------------------------------------------------------------

def explode_codes(df: DataFrame, column: str, out: str = "station_code") -> DataFrame:
    """Comma list to rows."""
    return df.withColumn(out, F.explode_outer(F.split(column, ","))).withColumn(out, C.code(out))


def faults(log: DataFrame, station_map: DataFrame, start=K.WINDOW_START, end=K.WINDOW_END) -> DataFrame:
    """Fault rows per (incident, station). An unknown station keeps a NULL id."""
    window = log.where(F.col("start_time").between(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    rows = explode_codes(window, "rdt_station_codes")
    return rows.join(station_map.select("station_code", "station_id"), "station_code", "left").select(
        F.concat(F.lit("NL_FAULT_"), F.col("rdt_id")).alias("fault_id"),
        F.col("start_time").cast("date").alias("date"), "station_id",
        C.fault_description("cause_en", "cause_group").alias("description"), "cause_en")


def top_causes(fault_rows: DataFrame, n: int = 20) -> DataFrame:
    return fault_rows.where("cause_en IS NOT NULL").groupBy("cause_en").agg(
        F.countDistinct("fault_id").alias("n_faults")).orderBy(F.desc("n_faults"), "cause_en").limit(n)


# -- weather ------------------------------------------------------------------------

def weather_by_station(rows: DataFrame) -> DataFrame:
    """Daily weather, one row per (station, day), with severity."""
    clean = rows.select(
        C.code("station_code").alias("station_code"), F.col("date").cast("date").alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in WEATHER], "seq")
    first = clean.groupBy("station_code", "date").agg(
        F.min_by(F.struct(*WEATHER), "seq").alias("w")).select("station_code", "date", "w.*")
    return first.withColumn("weather_severity", C.weather_severity("precipitation", "snow_depth"))


def join_weather(stops: DataFrame, weather: DataFrame, defaults: dict = K.WEATHER_DEFAULTS) -> DataFrame:
    """Stops with daily weather; defaults where nothing was observed, and a
    column that says whether something was."""
    w = weather.select("station_code", "date", *defaults, F.lit(1).alias("_seen"))
    out = stops.drop(*defaults).join(w, ["station_code", "date"], "left")
    return out.withColumn("weather_observed", F.coalesce("_seen", F.lit(0))).drop("_seen").withColumns(
        {c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
