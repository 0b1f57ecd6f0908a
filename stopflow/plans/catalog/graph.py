"""Queries of the station graph and the property graph."""

import uuid

from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators import graph as G
from stopflow.operators import kg
from stopflow.operators.splits import dense_index
from stopflow.plans.adapter import Tables
from stopflow.plans.registry import query
from stopflow.session import scratch_path

HUB = "NL_2"


def property_graph(t: Tables) -> kg.PropertyGraph:
    return kg.build(t.stations, t.services, t.stops, t.edges, t.faults)


KG_SQL = """st AS (SELECT * FROM stations),
    rep AS (SELECT fault_id, station_id FROM faults SEMI JOIN st USING (station_id)),
    fl AS (SELECT fault_id, date, description FROM faults SEMI JOIN st USING (station_id)),
    adj AS (SELECT * FROM edges WHERE station_from IN (SELECT station_id FROM st) AND station_to IN (SELECT station_id FROM st)),
    sa AS (SELECT * FROM stops SEMI JOIN st USING (station_id))"""
KG_NEEDS = "stops services stations edges faults"


@query("g1_edge_index", """
    WITH ix AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS idx FROM stations)
    SELECT a.idx AS src, b.idx AS dst, round(distance_km / max(distance_km) OVER (), 6) AS attr
    FROM edges e JOIN ix a ON a.station_id = e.station_from JOIN ix b ON b.station_id = e.station_to""", "edges stations")
def g1(t: Tables):
    index = dense_index(t.stations, "station_id", "idx")
    return G.edge_index(t.edges, index).withColumn("attr", C.r6("attr"))


def betweenness_sql(squarings: int = 7, hops: int = 110) -> str:
    """Distances by repeated squaring, path counts hop by hop, dependencies over
    all triples: another route to the same numbers."""
    parts = ["""w AS MATERIALIZED (SELECT station_from AS u, station_to AS v, min(CASE WHEN coalesce(distance_km, 0) = 0 THEN 1.0 ELSE distance_km END)::DOUBLE AS w
      FROM edges WHERE station_from <> station_to GROUP BY ALL)""",
             """d0 AS MATERIALIZED (SELECT u, v, min(d) AS d FROM (SELECT u, v, w AS d FROM w UNION ALL SELECT station_id, station_id, 0.0::DOUBLE FROM stations) GROUP BY ALL)"""]
    for k in range(squarings):
        parts.append(f"d{k + 1} AS MATERIALIZED (SELECT a.u, b.v, min(a.d + b.d) AS d FROM d{k} a JOIN d{k} b ON a.v = b.u GROUP BY ALL)")
    parts.append(f"""dag AS MATERIALIZED (SELECT a.u AS s, w.u, w.v FROM d{squarings} a JOIN w ON w.u = a.v JOIN d{squarings} b ON b.u = a.u AND b.v = w.v AND a.d + w.w = b.d)""")
    parts.append("c0 AS MATERIALIZED (SELECT DISTINCT station_id AS s, station_id AS u, 1.0::DOUBLE AS c FROM stations)")
    for k in range(hops):
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT s, v AS u, sum(c) AS c FROM c{k} JOIN dag USING (s, u) GROUP BY ALL)")
    every = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(hops + 1))
    parts.append(f"p AS MATERIALIZED (SELECT n.s, n.u, d, c FROM (SELECT s, u, sum(c) AS c FROM ({every}) GROUP BY ALL) n JOIN d{squarings} d ON d.u = n.s AND d.v = n.u)")
    parts.append("""b AS (SELECT x.u AS station_id, sum(x.c * y.c / z.c) AS score FROM p x JOIN p y ON y.s = x.u JOIN p z ON z.s = x.s AND z.u = y.u
      WHERE x.s <> x.u AND y.u <> x.u AND y.u <> x.s AND x.d + y.d = z.d GROUP BY 1)""")
    parts.append("n AS (SELECT count(DISTINCT station_id) AS n FROM stations)")
    return "WITH " + ",\n    ".join(parts) + """
    SELECT s.station_id, round(coalesce(score, 0) / ((n - 1) * (n - 2)), 6) AS betweenness_centrality
    FROM (SELECT DISTINCT station_id FROM stations) s CROSS JOIN n LEFT JOIN b USING (station_id)"""


@query("g2_betweenness", betweenness_sql(), "stations edges")
def g2(t: Tables):
    return G.betweenness(t.edges, t.stations).withColumn("betweenness_centrality", C.r6("betweenness_centrality"))


@query("g3_station_nodes", "SELECT station_id, country, round(lat, 6) AS lat, round(avg_historical_delay, 6) AS avg_historical_delay, degree::BIGINT AS degree FROM stations", "stations")
def g3(t: Tables):
    return property_graph(t).stations.select("station_id", "country", C.r6("lat").alias("lat"), C.r6("avg_historical_delay").alias("avg_historical_delay"), "degree")


@query("g3_fault_nodes", f"WITH {KG_SQL} SELECT fault_id, CAST(date_diff('day', DATE '1970-01-01', date) AS INTEGER) AS epoch_day, description FROM fl", KG_NEEDS)
def g3_faults(t: Tables):
    return property_graph(t).faults


@query("g3_stop_edges", f"""
    WITH {KG_SQL} SELECT seq, service_id, station_id, coalesce(delay_minutes, 0) AS delay_minutes, weather_severity::DOUBLE AS weather_severity,
      coalesce(precipitation, 0) AS precipitation, coalesce(snow_depth, 0) AS snow_depth FROM sa""", KG_NEEDS)
def g3_stops(t: Tables):
    return property_graph(t).stops_at.select("seq", "service_id", "station_id", "delay_minutes", "weather_severity", "precipitation", "snow_depth")


HUB_SQL = KG_SQL + f""",
    ids AS (SELECT station_to AS station_id FROM adj WHERE station_from = '{HUB}' UNION SELECT station_from FROM adj WHERE station_to = '{HUB}' UNION SELECT '{HUB}'),
    hsa AS (SELECT * FROM sa SEMI JOIN ids USING (station_id)),
    hadj AS (SELECT * FROM adj WHERE station_from IN (SELECT station_id FROM ids) AND station_to IN (SELECT station_id FROM ids)),
    hrep AS (SELECT * FROM rep SEMI JOIN ids USING (station_id))"""


@query("g4_hub_subgraph", f"""
    WITH {HUB_SQL}, c AS (SELECT 'stations' AS name, 'node' AS kind, count(*) AS n FROM st SEMI JOIN ids USING (station_id)
      UNION ALL SELECT 'services', 'node', count(DISTINCT service_id) FROM hsa UNION ALL SELECT 'faults', 'node', count(DISTINCT fault_id) FROM hrep
      UNION ALL SELECT 'stops_at', 'edge', count(*) FROM hsa UNION ALL SELECT 'adjacent', 'edge', count(*) FROM hadj UNION ALL SELECT 'reported_at', 'edge', count(*) FROM hrep)
    SELECT * FROM c UNION ALL SELECT 'total_' || kind, kind, CAST(sum(n) AS BIGINT) FROM c GROUP BY kind""", KG_NEEDS)
def g4(t: Tables):
    return kg.counts(kg.hub_subgraph(property_graph(t), HUB))


@query("g5_bridge", f"""
    WITH {KG_SQL}, nb AS (SELECT station_from AS station_id, count(DISTINCT station_to) AS n, list_slice(list_sort(list(DISTINCT station_to)), 1, 5) AS five FROM adj GROUP BY 1),
    d AS (SELECT DISTINCT station_id, date FROM predictions),
    rf AS (SELECT d.station_id, d.date, count(f.fault_id) AS n FROM d LEFT JOIN faults f ON f.station_id = d.station_id AND f.date BETWEEN d.date - 14 AND d.date GROUP BY ALL)
    SELECT p.seq, p.station_id, round(s.avg_historical_delay, 6) AS station_avg_delay, s.degree::BIGINT AS degree, p.delay_min, p.weather_severity,
      rf.n AS recent_faults, coalesce(nb.n, 0) AS n_neighbours, array_to_string(nb.five, ',') AS sample_neighbours
    FROM predictions p JOIN st s USING (station_id) JOIN rf ON rf.station_id = p.station_id AND rf.date = p.date LEFT JOIN nb ON nb.station_id = p.station_id
    WHERE p.y_stop = 1 AND p.yp_b = 1""", KG_NEEDS + " predictions")
def g5(t: Tables):
    t = t.landed()
    flagged = t.predictions.where("y_stop = 1 AND yp_b = 1").select("seq", "service_id", "station_id", "date", "delay_min", "weather_severity")
    out = kg.bridge(flagged, property_graph(t), t.faults)
    return out.select("seq", "station_id", C.r6("station_avg_delay").alias("station_avg_delay"), "degree", "delay_min", "weather_severity",
                      "recent_faults", "n_neighbours", F.array_join("sample_neighbours", ",").alias("sample_neighbours"))


@query("g5_station_lookup", f"""
    WITH {KG_SQL}, seed AS (SELECT station_id, date FROM predictions ORDER BY (y_stop = 1 AND yp_a = 1) DESC, p_a DESC, seq LIMIT 1),
    nb AS (SELECT count(DISTINCT station_to) AS n, list_slice(list_sort(list(DISTINCT station_to)), 1, 5) AS five FROM adj JOIN seed ON station_from = seed.station_id)
    SELECT s.station_id, round(s.avg_historical_delay, 6) AS station_avg_delay, s.degree::BIGINT AS degree, (SELECT n FROM nb) AS n_neighbours, (SELECT array_to_string(five, ',') FROM nb) AS sample_neighbours,
      (SELECT count(*) FROM faults f JOIN seed ON f.station_id = seed.station_id AND f.date BETWEEN seed.date - 14 AND seed.date) AS recent_faults
    FROM st s SEMI JOIN seed USING (station_id)""", KG_NEEDS + " predictions")
def g5_lookup(t: Tables):
    """The station of the surest stop, from tables that are stored for lookups."""
    t = t.landed()
    seed = kg.bridge_seed(t.predictions, ["seq"], p="p_a", pred="yp_a").first()
    name = f"stations_{uuid.uuid4().hex[:12]}"
    index = kg.index_stations(property_graph(t), t.faults, name, scratch_path(t.spark, name), buckets=8)
    out = kg.lookup(t.spark, index, seed["station_id"], seed["date"])
    return out.select("station_id", C.r6("station_avg_delay").alias("station_avg_delay"), "degree", "n_neighbours", F.array_join("sample_neighbours", ",").alias("sample_neighbours"), "recent_faults")


@query("g6_bridge_seed", "SELECT seq, station_id, p_a FROM predictions ORDER BY (y_stop = 1 AND yp_a = 1) DESC, p_a DESC, seq LIMIT 1", "predictions")
def g6(t: Tables):
    return kg.bridge_seed(t.predictions, ["seq"], p="p_a", pred="yp_a").select("seq", "station_id", "p_a")


@query("g7_graph_counts", f"""
    WITH {KG_SQL}, c AS (SELECT 'stations' AS name, 'node' AS kind, count(*) AS n FROM st UNION ALL SELECT 'services', 'node', count(*) FROM services
      UNION ALL SELECT 'faults', 'node', count(*) FROM fl UNION ALL SELECT 'stops_at', 'edge', count(*) FROM sa UNION ALL SELECT 'adjacent', 'edge', count(*) FROM adj
      UNION ALL SELECT 'reported_at', 'edge', count(*) FROM rep)
    SELECT * FROM c UNION ALL SELECT 'total_' || kind, kind, CAST(sum(n) AS BIGINT) FROM c GROUP BY kind""", KG_NEEDS)
def g7(t: Tables):
    return kg.counts(property_graph(t))


HUBS_SQL = KG_SQL + """,
    top AS (SELECT station_id FROM (SELECT station_id, row_number() OVER (PARTITION BY country ORDER BY degree DESC, station_id) AS rn FROM st) WHERE rn <= 3),
    nb AS (SELECT station_to AS station_id FROM (SELECT station_to, row_number() OVER (PARTITION BY station_from ORDER BY station_to) AS rn FROM adj
           WHERE station_from IN (SELECT station_id FROM top)) WHERE rn <= 2),
    ids AS (SELECT station_id, max(h) AS is_hub FROM (SELECT station_id, 1 AS h FROM top UNION ALL SELECT station_id, 0 FROM nb) GROUP BY 1)"""


def hubs(t: Tables):
    g = property_graph(t)
    return g, *kg.hub_sample(g.stations, g.adjacent, hubs=3, neighbours=2)


@query("g8_hub_sample_nodes", f"WITH {HUBS_SQL} SELECT station_id, is_hub, degree::BIGINT AS degree FROM st JOIN ids USING (station_id)", KG_NEEDS)
def g8(t: Tables):
    return hubs(t)[1].select("station_id", "is_hub", "degree")


@query("g8_hub_sample_edges", f"""
    WITH {HUBS_SQL} SELECT station_from, station_to FROM adj WHERE station_from IN (SELECT station_id FROM ids) AND station_to IN (SELECT station_id FROM ids)""", KG_NEEDS)
def g8_edges(t: Tables):
    return hubs(t)[2].select("station_from", "station_to")


@query("g9_hub_services", f"""
    WITH {HUBS_SQL} SELECT station_id, service_id FROM (SELECT station_id, service_id, row_number() OVER (PARTITION BY station_id ORDER BY service_id) AS rn
      FROM (SELECT DISTINCT station_id, service_id FROM sa SEMI JOIN top USING (station_id))) WHERE rn <= 3""", KG_NEEDS)
def g9(t: Tables):
    g, nodes, _ = hubs(t)
    return kg.hub_services(g.stops_at, nodes.where("is_hub = 1"))


@query("g9_hub_faults", f"""
    WITH {HUBS_SQL} SELECT fault_id, station_id, CAST(date AS VARCHAR) AS date, description
    FROM faults SEMI JOIN top USING (station_id) ORDER BY fault_id LIMIT 5""", KG_NEEDS)
def g9_faults(t: Tables):
    _, nodes, _ = hubs(t)
    out = kg.hub_faults(t.faults, nodes.where("is_hub = 1"))
    return out.select("fault_id", "station_id", F.col("date").cast("string").alias("date"), "description")


def drawing(t: Tables):
    """Nodes and edges of all kinds in the layout of the drawing."""
    g = property_graph(t)
    nodes = g.stations.select(F.col("station_id").alias("id"), F.lit("Station").alias("kind"), "country").unionByName(
        g.services.select(F.col("service_id").alias("id"), F.lit("TrainService").alias("kind"), F.lit(None).cast("string").alias("country"))).unionByName(
        g.faults.select(F.col("fault_id").alias("id"), F.lit("FaultEvent").alias("kind"), F.lit(None).cast("string").alias("country")))
    edges = g.adjacent.select(F.col("station_from").alias("source"), F.col("station_to").alias("target"), F.lit("ADJACENT_TO").alias("kind")).unionByName(
        g.stops_at.select(F.col("service_id").alias("source"), F.col("station_id").alias("target"), F.lit("STOPS_AT").alias("kind"))).unionByName(
        g.reported_at.select(F.col("fault_id").alias("source"), F.col("station_id").alias("target"), F.lit("REPORTED_AT").alias("kind")))
    return nodes, edges


DRAW_SQL = KG_SQL + """,
    nd AS (SELECT station_id AS id, 'Station' AS kind, country FROM st UNION ALL SELECT service_id, 'TrainService', NULL FROM services UNION ALL SELECT fault_id, 'FaultEvent', NULL FROM fl),
    eg AS (SELECT station_from AS source, station_to AS target, 'ADJACENT_TO' AS kind FROM adj UNION ALL SELECT service_id, station_id, 'STOPS_AT' FROM sa
           UNION ALL SELECT fault_id, station_id, 'REPORTED_AT' FROM rep)"""


@query("g10_induced_subgraph", f"""
    WITH {DRAW_SQL}, keep AS (SELECT id FROM nd WHERE kind IN ('Station', 'FaultEvent') AND (country IS NULL OR country = 'NL'))
    SELECT kind, count(*) AS n FROM eg WHERE source IN (SELECT id FROM keep) AND target IN (SELECT id FROM keep) GROUP BY kind""", KG_NEEDS)
def g10(t: Tables):
    _, edges = kg.induced(*drawing(t), ["Station", "FaultEvent"], "NL")
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("g10_search", f"""
    WITH {DRAW_SQL}, hit AS (SELECT id FROM nd WHERE contains(lower(id), 'nl_5')),
    near AS (SELECT target AS id FROM eg WHERE source IN (SELECT id FROM hit) UNION SELECT source FROM eg WHERE target IN (SELECT id FROM hit))
    SELECT id, kind, CAST(id IN (SELECT id FROM hit) AS INTEGER) AS is_match FROM nd WHERE id IN (SELECT id FROM hit) OR id IN (SELECT id FROM near)""", KG_NEEDS)
def g10_search(t: Tables):
    return kg.search(*drawing(t), "NL_5").select("id", "kind", "is_match")


@query("g11_routes", """
    SELECT service_id, CAST(stop_order // 3 AS INTEGER) AS page, max(n_total_stops) AS n_stops,
      string_agg(stop_order || ':' || station_id || ':' || CAST(y_stop AS VARCHAR) || ':' || coalesce(CAST(CAST(round(lat * 10) AS INTEGER) AS VARCHAR), '-'), ',' ORDER BY stop_order) AS stops
    FROM positioned LEFT JOIN (SELECT station_id, lat FROM stations) USING (station_id) GROUP BY service_id, stop_order // 3""", "positioned stations")
def g11(t: Tables):
    out = kg.routes(t.positioned, t.stations, page=3)
    text = F.transform("stops", lambda s: F.concat_ws(":", s["stop_order"].cast("string"), s["station_id"], s["y_stop"].cast("string"),
                                                      F.coalesce(F.round(s["lat"] * 10).cast("int").cast("string"), F.lit("-"))))
    return out.select("service_id", "page", "n_stops", F.array_join(text, ",").alias("stops"))


@query("g12_neighbour_means", """
    WITH h0 AS (SELECT station_id, lat, degree::DOUBLE AS degree FROM stations),
    h1 AS (SELECT s.station_id, coalesce(avg(h0.lat), 0) AS lat, coalesce(avg(h0.degree), 0) AS degree FROM stations s LEFT JOIN edges e ON e.station_from = s.station_id LEFT JOIN h0 ON h0.station_id = e.station_to GROUP BY 1),
    h2 AS (SELECT s.station_id, coalesce(avg(h1.lat), 0) AS lat, coalesce(avg(h1.degree), 0) AS degree FROM stations s LEFT JOIN edges e ON e.station_from = s.station_id LEFT JOIN h1 ON h1.station_id = e.station_to GROUP BY 1)
    SELECT station_id, round(h0.lat, 6) AS h0_lat, h0.degree AS h0_degree, round(h1.lat + 1e-9, 6) AS h1_lat, round(h1.degree + 1e-9, 6) AS h1_degree,
      round(h2.lat + 1e-9, 6) AS h2_lat, round(h2.degree + 1e-9, 6) AS h2_degree FROM h0 JOIN h1 USING (station_id) JOIN h2 USING (station_id)""", "stations edges")
def g12(t: Tables):
    out = G.neighbour_means(t.stations, t.edges, ["lat", "degree"])
    return out.select("station_id", *[C.r6(F.col(c) + 1e-9).alias(c) for c in out.columns if c != "station_id"])
