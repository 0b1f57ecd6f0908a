"""Property graph held as node and edge tables, and the queries over it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators.features import fault_count
from stopflow.operators.splits import sample_per_group
from stopflow.sources.sinks import save_bucketed


@dataclass(frozen=True)
class PropertyGraph:
    stations: DataFrame
    services: DataFrame
    faults: DataFrame
    stops_at: DataFrame
    adjacent: DataFrame
    reported_at: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def _number(c: str, default: float | None = None):
    v = C.finite_or_null(F.col(c).cast("double"))
    return v if default is None else F.coalesce(v, F.lit(default))


def build(stations: DataFrame, services: DataFrame, stops: DataFrame, edges: DataFrame, faults: DataFrame,
          one_station_per_fault: bool = False) -> PropertyGraph:
    """Typed node and edge tables; edges with an unknown end drop.

    A fault keeps every station it was reported at. `one_station_per_fault`
    keeps only the first, the older form.
    """
    sta = stations.groupBy("station_id").agg(F.min(F.struct(
        C.country_of("station_id").alias("country"), _number("lat").alias("lat"), _number("lon").alias("lon"),
        _number("avg_historical_delay").alias("avg_historical_delay"),
        F.coalesce(F.col("degree").cast("long"), F.lit(0)).alias("degree"))).alias("r")).select("station_id", "r.*")
    svc = services.groupBy("service_id").agg(F.min(F.struct(
        F.coalesce(F.col("train_class_code").cast("long"), F.lit(K.OTHER_CLASS)).alias("train_class_code"),
        F.unix_date("date").alias("epoch_day"),
        F.coalesce(F.col("is_disrupted").cast("long"), F.lit(0)).alias("is_disrupted"))).alias("r")).select("service_id", "r.*")
    known = sta.select("station_id")
    base = faults.groupBy("fault_id").agg(F.min("station_id").alias("station_id")) if one_station_per_fault else faults.select(
        "fault_id", "station_id").distinct()
    reported = base.join(known, "station_id", "left_semi").select("fault_id", "station_id")
    nodes = faults.groupBy("fault_id").agg(F.min(F.struct(
        F.unix_date("date").alias("epoch_day"), "description")).alias("r"))
    nodes = nodes.join(reported.select("fault_id"), "fault_id", "left_semi").select("fault_id", "r.*")
    adjacent = edges.groupBy("station_from", "station_to").agg(F.min("distance_km").alias("distance_km"))
    for side in ("station_from", "station_to"):
        adjacent = adjacent.join(known.withColumnRenamed("station_id", side), side, "left_semi")
    adjacent = adjacent.select("station_from", "station_to", _number("distance_km", 0.0).alias("distance_km"))
    carried = [c for c in ("seq",) if c in stops.columns]
    stops_at = stops.join(known, "station_id", "left_semi").join(svc.select("service_id"), "service_id", "left_semi").select(
        *carried, "service_id", "station_id", *[_number(c, 0.0).alias(c) for c in (
            "delay_minutes", "weather_severity", "temperature", "wind_speed", "precipitation", "snow_depth")])
    return PropertyGraph(sta, svc, nodes, stops_at, adjacent, reported)


def counts(graph: PropertyGraph) -> DataFrame:
    """Rows per node and edge type, with totals of both."""
    kinds = {"stations": "node", "services": "node", "faults": "node", "stops_at": "edge", "adjacent": "edge", "reported_at": "edge"}
    parts = None
    for name, df in graph.tables().items():
        one = df.agg(F.lit(name).alias("name"), F.lit(kinds[name]).alias("kind"), F.count(F.lit(1)).alias("n"))
        parts = one if parts is None else parts.unionByName(one)
    totals = parts.groupBy("kind").agg(F.sum("n").alias("n")).select(F.concat(F.lit("total_"), "kind").alias("name"), "kind", "n")
    return parts.unionByName(totals)


def hub_subgraph(graph: PropertyGraph, hub: str) -> PropertyGraph:
    """The hub with its neighbours in either direction, the stops that touch
    them, the services of those stops, edges inside and faults there."""
    a = graph.adjacent
    ids = a.where(F.col("station_from") == hub).select(F.col("station_to").alias("station_id")).union(
        a.where(F.col("station_to") == hub).select("station_from")).union(
        graph.stations.where(F.col("station_id") == hub).select("station_id")).distinct()
    stations = graph.stations.join(ids, "station_id", "left_semi")
    stops_at = graph.stops_at.join(ids, "station_id", "left_semi")
    services = graph.services.join(stops_at.select("service_id"), "service_id", "left_semi")
    adjacent = a
    for side in ("station_from", "station_to"):
        adjacent = adjacent.join(ids.withColumnRenamed("station_id", side), side, "left_semi")
    reported = graph.reported_at.join(ids, "station_id", "left_semi")
    faults = graph.faults.join(reported.select("fault_id"), "fault_id", "left_semi")
    return PropertyGraph(stations, services, faults, stops_at, adjacent, reported)


def out_neighbours(adjacent: DataFrame, n: int = 5) -> DataFrame:
    """Number of out-neighbours and the first n of them. The cut to n happens
    before ids are collected."""
    total = adjacent.groupBy("station_from").agg(F.countDistinct("station_to").alias("n_neighbours"))
    head = sample_per_group(adjacent.select("station_from", "station_to").distinct(), ["station_from"], n, [F.col("station_to")])
    listed = head.groupBy("station_from").agg(F.array_sort(F.collect_list("station_to")).alias("sample_neighbours"))
    return total.join(listed, "station_from").withColumnRenamed("station_from", "station_id")


def bridge(flagged: DataFrame, graph: PropertyGraph, faults: DataFrame, days: int = 14) -> DataFrame:
    """Neighbourhood answer for every flagged stop at once: attributes of the
    station, faults reported there in [d-days, d], and its out-neighbours.
    `flagged` carries service_id, station_id, date and the stop's own values."""
    station_days = flagged.select("station_id", "date").distinct()
    recent = fault_count(station_days, faults, first=days, last=0, name="recent_faults", calendar=None)
    return (
        flagged.join(graph.stations.select("station_id", F.col("avg_historical_delay").alias("station_avg_delay"), "degree"), "station_id")
        .join(recent, ["station_id", "date"], "left")
        .join(out_neighbours(graph.adjacent), "station_id", "left")
        .withColumns({"recent_faults": F.coalesce("recent_faults", F.lit(0.0)).cast("long"),
                      "n_neighbours": F.coalesce("n_neighbours", F.lit(0))})
    )


# -- one station at a time ------------------------------------------------------------

@dataclass(frozen=True)
class StationIndex:
    """Names of stored tables, all bucketed by station: attributes, neighbours, and
    faults per day. A lookup reads one bucket of each."""

    stations: str
    neighbours: str
    faults: str


def index_stations(graph: PropertyGraph, faults: DataFrame, name: str, path: str, buckets: int) -> StationIndex:
    """Write the tables of a `StationIndex`. Choose `buckets` so that one bucket is
    quickly read: its size is the time of a lookup."""
    per_day = faults.where("station_id IS NOT NULL AND date IS NOT NULL").groupBy("station_id", "date").agg(F.count(F.lit(1)).alias("n_faults"))
    tables = {
        "stations": graph.stations.select("station_id", F.col("avg_historical_delay").alias("station_avg_delay"), "degree"),
        "neighbours": out_neighbours(graph.adjacent),
        "faults": per_day,
    }
    for kind, df in tables.items():
        save_bucketed(df.repartition(buckets, "station_id"), f"{name}_{kind}", f"{path}/{kind}", "station_id", buckets)
    return StationIndex(*[f"{name}_{kind}" for kind in tables])


def lookup(spark: SparkSession, index: StationIndex, station: str, day, days: int = 14) -> DataFrame:
    """Neighbourhood answer for one station and day, one row; none for an unknown
    station. The buckets are already apart by station, so nothing is shuffled
    but the counts of the few days."""
    here = F.col("station_id") == F.lit(station)
    last = F.lit(day).cast("date")
    recent = spark.table(index.faults).where(here & F.col("date").between(F.date_sub(last, days), last))
    recent = recent.groupBy("station_id").agg(F.sum("n_faults").alias("recent_faults"))
    return (
        spark.table(index.stations).where(here).join(spark.table(index.neighbours).where(here), "station_id", "left").join(recent, "station_id", "left")
        .withColumns({"recent_faults": F.coalesce("recent_faults", F.lit(0)).cast("long"), "n_neighbours": F.coalesce("n_neighbours", F.lit(0))})
    )


def bridge_seed(preds: DataFrame, ids: Sequence[str], p: str = "p_disrupted", pred: str = "y_pred") -> DataFrame:
    """The surest true positive, else the highest probability."""
    tp = ((F.col("y_stop") == 1) & (F.col(pred) == 1)).cast("int")
    return preds.orderBy(tp.desc(), F.desc(p), *ids).limit(1)


def hub_sample(stations: DataFrame, adjacent: DataFrame, hubs: int = 12, neighbours: int = 4) -> tuple[DataFrame, DataFrame]:
    """Stations with the highest degree per country, some neighbours of each,
    and the edges between all of them. Returns (nodes, edges)."""
    top = sample_per_group(stations, ["country"], hubs, [F.desc("degree"), F.col("station_id")]).select("station_id")
    near = adjacent.join(top.withColumnRenamed("station_id", "station_from"), "station_from", "left_semi")
    near = sample_per_group(near, ["station_from"], neighbours, [F.col("station_to")]).select(F.col("station_to").alias("station_id"))
    ids = top.select("station_id", F.lit(1).alias("hub")).union(near.select("station_id", F.lit(0))).groupBy("station_id").agg(
        F.max("hub").alias("is_hub"))
    nodes = stations.join(ids, "station_id")
    edges = adjacent
    for side in ("station_from", "station_to"):
        edges = edges.join(ids.select(F.col("station_id").alias(side)), side, "left_semi")
    return nodes, edges


def hub_services(stops: DataFrame, hubs: DataFrame, n: int = 3) -> DataFrame:
    """First n distinct services of every hub."""
    pairs = stops.join(hubs.select("station_id"), "station_id", "left_semi").select("station_id", "service_id").distinct()
    return sample_per_group(pairs, ["station_id"], n, [F.col("service_id")])


def hub_faults(faults: DataFrame, hubs: DataFrame, n: int = 5, width: int | None = None) -> DataFrame:
    """First n faults at the hubs, description shortened where a width is given."""
    at = faults.join(hubs.select("station_id"), "station_id", "left_semi").groupBy("fault_id").agg(
        F.min(F.struct("station_id", "date", "description")).alias("r")).select("fault_id", "r.*")
    if width is None:
        return at.orderBy("fault_id").limit(n)
    short = F.when(F.length("description") > width, F.concat(F.substring("description", 1, width), F.lit("…"))).otherwise(F.col("description"))
    return at.orderBy("fault_id").limit(n).withColumn("description", short)


def induced(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str], country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the chosen kinds (and country, where a node has one) and the
    edges whose two ends survive. Nodes: id, kind, country. Edges: source, target, kind."""
    keep = nodes.where(F.col("kind").isin(list(kinds)))
    if country is not None:
        keep = keep.where(F.col("country").isNull() | (F.col("country") == country))
    out = edges
    for side in ("source", "target"):
        out = out.join(keep.select(F.col("id").alias(side)), side, "left_semi")
    return keep, out


def search(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Nodes whose id contains the text, and everything next to them."""
    hits = nodes.where(F.lower("id").contains(text.strip().lower())).select("id")
    near = edges.join(hits.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).union(
        edges.join(hits.withColumnRenamed("id", "target"), "target", "left_semi").select("source"))
    marked = hits.select("id", F.lit(1).alias("m")).union(near.select("id", F.lit(0))).groupBy("id").agg(F.max("m").alias("is_match"))
    return nodes.join(marked, "id")


def routes(stops: DataFrame, stations: DataFrame, page: int = 500) -> DataFrame:
    """Ordered stops with coordinates as nested arrays. A route longer than
    `page` stops continues on its next page, so no array grows without bound."""
    placed = stops.join(stations.select("station_id", "lat", "lon"), "station_id", "left")
    step = F.struct("stop_order", "station_id", F.round("delay_min", 1).alias("delay_min"), "y_stop", "lat", "lon")
    return placed.groupBy("service_id", F.floor(F.col("stop_order") / page).cast("int").alias("page")).agg(
        F.max("n_total_stops").alias("n_stops"), F.sort_array(F.collect_list(step)).alias("stops"))
