"""From the raw feed of a country to its five standard tables, one lazy plan each.

The frames passed in are raw reads (`sources.readers`); the result maps table
names to DataFrames. Stops carry three columns beyond the standard ones:
`cancelled`, `scheduled_time` and the tie-break `seq`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators import builders as B
from stopflow.operators import impute, parse
from stopflow.sources import schemas
from stopflow.sources.readers import in_window

EXTRAS = ["cancelled", "scheduled_time", "seq"]


def _names(df: DataFrame, station: str, country: str) -> DataFrame:
    """Known stations of a feed and their ids."""
    return df.where(F.col(station).isNotNull()).select(F.col(station).alias("station_code")).distinct().withColumn(
        "station_id", C.prefixed_id(country, "station_code"))


def italy(operations: DataFrame, master: DataFrame, mileage: DataFrame) -> dict[str, DataFrame]:
    """Operations with delay text, station master, mileage along routes."""
    ops = operations.where(in_window("date")).withColumns({
        "cancelled": C.any_of(C.delay_cancelled("arrival_delay"), C.delay_cancelled("departure_delay")),
        "arrival_delay": C.delay_value("arrival_delay"), "departure_delay": C.delay_value("departure_delay"),
        "station_name": C.code("station_name"), "weather_severity": C.weather_text_severity("weather"),
        "scheduled_time": F.lit(None).cast("timestamp_ntz"), "seq": F.col("station_order").cast("long")})
    routes = mileage.withColumns({
        "station_name": C.code("station_name"), "distance": C.decimal_comma("distance"),
        "station_order": F.col("station_order").try_cast("int")})
    coords = master.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")})
    names = _names(ops, "station_name", "IT")
    on_route = routes.join(names.withColumnRenamed("station_code", "station_name"), "station_name")
    service = C.prefixed_id("IT", "train_id", "date")
    return {
        "nodes_station": B.italy_stations(ops, coords, routes),
        "nodes_service": B.services(ops, service, "date", "train_class", "arrival_delay"),
        "edges_stops_at": B.stops_at(ops, service, "station_name", "arrival_delay", names, extras=EXTRAS),
        "edges_adjacent": B.adjacency_from_order(on_route, ["train_id"], ["station_order", "station_id"], "station_id", "distance"),
        "nodes_fault": schemas.empty_faults(operations.sparkSession),
    }


def _first_time(df: DataFrame, *columns: str) -> Column:
    """The first of these times that is there: a stop without an arrival keeps its
    place by its departure."""
    times = [F.col(c).try_cast("timestamp").cast("timestamp_ntz") for c in columns if c in df.columns]
    return F.coalesce(*times) if times else F.lit(None).cast("timestamp_ntz")


def finland(raw: DataFrame) -> dict[str, DataFrame]:
    """Train rows with nested stop lists, all text."""
    rows = parse.normalise_codes(parse.explode_stops(parse.with_stops(raw)))
    rows = parse.coerce(rows, ["delay_minutes", "air_temp", "wind_speed", "precipitation_1h", "snow_depth", "visibility"],
                        ["cancelled"], ["departure_date"], ["scheduled_time"]).where(in_window("departure_date"))
    rows = impute.monthly_median_fill(impute.zero_fill(rows, ["precipitation_1h", "snow_depth"]), ["air_temp", "visibility"], "departure_date")
    rows = rows.withColumns({
        "weather_severity": C.weather_severity("precipitation_1h", "snow_depth", "visibility"), "seq": F.col("stop_no").cast("long"),
        "train_number": F.col("train_number").cast("long").cast("string"),
        **{c: F.col(c).try_cast("double") if c in rows.columns else F.lit(None).cast("double") for c in ("lat", "lon")}})
    names = _names(rows, "station_code", "FI")
    service = C.prefixed_id("FI", "train_number", "departure_date")
    placed = rows.join(names, "station_code")
    return {
        "nodes_station": B.finland_stations(rows.where("station_code IS NOT NULL")),
        "nodes_service": B.services(rows, service, "departure_date", "train_type", "delay_minutes"),
        "edges_stops_at": B.stops_at(rows, service, "station_code", "delay_minutes", names,
                                     rename={"air_temp": "temperature", "precipitation_1h": "precipitation"}, missing=0.0, extras=EXTRAS),
        "edges_adjacent": B.adjacency_from_order(placed, ["train_number", "departure_date"], ["scheduled_time", "seq"], "station_id"),
        "nodes_fault": schemas.empty_faults(raw.sparkSession),
    }


def netherlands(services: DataFrame, master: DataFrame, disruptions: DataFrame, distances: DataFrame,
                weather: DataFrame | None = None, matrix_key: str = "Station") -> dict[str, DataFrame]:
    """Services (already renamed and parsed by the reader), station master,
    disruption log, distance matrix and, optionally, daily weather."""
    stops = services.withColumns({
        "scheduled_time": _first_time(services, "arrival_time", "departure_time"),
        "seq": F.col("stop_id").try_cast("long")})
    if weather is not None:
        stops = B.join_weather(stops, B.weather_by_station(weather))
    coords = master.withColumns({c: F.col(c).try_cast("double") for c in ("geo_lat", "geo_lng")})
    names = _names(stops, "station_code", "NL")
    service = C.prefixed_id("NL", "service_id_raw")
    log = disruptions.withColumn("start_time", F.col("start_time").try_cast("timestamp_ntz"))
    return {
        "nodes_station": B.netherlands_stations(stops, coords),
        "nodes_service": B.services(stops, service, "date", "train_type", "arrival_delay"),
        "edges_stops_at": B.stops_at(stops, service, "station_code", "arrival_delay", names, extras=EXTRAS),
        "edges_adjacent": B.adjacency_from_matrix(distances, matrix_key, names),
        "nodes_fault": B.faults(log, names).drop("cause_en"),
    }


def union(countries: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """All countries together; the first row wins for station and service ids."""
    out: dict[str, DataFrame] = {}
    for tables in countries:
        for name, df in tables.items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    for name, key in (("nodes_station", "station_id"), ("nodes_service", "service_id")):
        rest = [c for c in out[name].columns if c != key]
        out[name] = out[name].groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return {k: out[k] for k in K.STANDARD_TABLES}
