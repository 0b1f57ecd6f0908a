"""Queries of sources and sinks. Each one writes what it needs from the given
tables to a fresh folder of the shared scratch space and reads it back."""

from datetime import date

from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators import builders as B
from stopflow.operators import kg
from stopflow.plans.adapter import EVENT_SPLITS, Tables
from stopflow.plans.catalog.cleaning import station_map, trains, wide_matrix
from stopflow.plans.catalog.graph import KG_NEEDS, KG_SQL, property_graph
from stopflow.plans.catalog.tables import five_tables
from stopflow.plans.registry import query
from stopflow.operators.splits import with_split
from stopflow.session import scratch_path
from stopflow.sources import readers, sinks


def _operations(t: Tables):
    """Operations feed as CSV, ten days per folder."""
    path = scratch_path(t.spark, "operations")
    rows = t.feed.select(
        F.concat(F.lit("T"), "user_id").alias("train_id"), F.col("seq").alias("train_number"), F.col("type_text").alias("train_class"), "date",
        F.col("code_text").alias("station_name"), F.col("arrival_text").alias("arrival_delay"), "wind_speed",
        F.floor(F.dayofmonth("date") / 10).cast("int").alias("chunk"))
    rows.write.option("header", True).option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).partitionBy("chunk").csv(path)
    return path


@query("s1_operations_csv", """
    SELECT seq AS train_number, 'T' || user_id AS train_id, CAST(date AS VARCHAR) AS date, arrival_text AS arrival_delay, wind_speed FROM feed WHERE date <= DATE '2024-01-15'""", "feed")
def s1(t: Tables):
    ops = readers.operations(t.spark, _operations(t), end=date(2024, 1, 15))
    return ops.select(F.col("train_number").cast("long").alias("train_number"), "train_id", F.col("date").cast("string").alias("date"), "arrival_delay",
                      F.col("wind_speed").cast("double").alias("wind_speed"))


@query("s2_load_telemetry", """
    SELECT 'chunk=' || (day(date) // 10) AS file, count(*) AS raw_rows, count(*) FILTER (WHERE date <= DATE '2024-01-15') AS kept_rows,
      CAST(sum(count(*) FILTER (WHERE date <= DATE '2024-01-15')) OVER (ORDER BY day(date) // 10) AS BIGINT) AS cum_kept FROM stops GROUP BY day(date) // 10""")
def s2(t: Tables):
    from stopflow.sources.schemas import OPERATIONS

    raw = readers.csv(t.spark, _operations(t), OPERATIONS)
    return readers.load_log(raw, readers.in_window(end=date(2024, 1, 15)), r"(chunk=\d+)")


def _monthly(t: Tables, df, prefix: str, by):
    """One folder per part, named like the monthly files of a feed."""
    folder = scratch_path(t.spark, "monthly")
    for n in (1, 2, 3):
        df.where(by == n - 1).write.option("header", True).csv(f"{folder}/{prefix}{n:02d}.csv")
    return folder


def _finland(t: Tables):
    df = trains(t).drop("file")
    return _monthly(t, df, "matched_data_2024_", F.col("trainNumber") % 3)


@query("s3_monthly_nested_files", """
    SELECT 'matched_data_2024_0' || (seq % 3 + 1) || '.csv' AS file, count(*) AS n_trains,
      CAST(sum(CASE WHEN seq % 53 = 0 OR seq % 59 = 0 OR seq % 61 = 0 OR seq % 67 = 0 OR seq % 3 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS n_stops,
      count(*) FILTER (WHERE seq % 53 <> 0 AND seq % 59 <> 0 AND seq % 61 <> 0 AND seq % 67 <> 0) AS n_success,
      count(*) FILTER (WHERE seq % 53 = 0 OR seq % 59 = 0 OR seq % 61 = 0) AS n_empty,
      count(*) FILTER (WHERE seq % 67 = 0 AND NOT (seq % 53 = 0 OR seq % 59 = 0 OR seq % 61 = 0)) AS n_error FROM stops GROUP BY 1""")
def s3(t: Tables):
    from stopflow.operators.parse import parse_log, with_stops

    return parse_log(with_stops(readers.finland(t.spark, _finland(t))), "file")


def _netherlands(t: Tables):
    df = t.feed.select(
        F.col("service_id").alias("Service:RDT-ID"), F.col("date").alias("Service:Date"), F.col("type_text").alias("Service:Type"),
        F.col("full_text").alias("Service:Completely cancelled"), F.col("bool_text").alias("Service:Partly cancelled"),
        F.col("delay_int").alias("Service:Maximum delay"), F.col("seq").alias("Stop:RDT-ID"), F.col("code_text").alias("Stop:Station code"),
        F.col("arrival_text").alias("Stop:Arrival delay"), F.lit("false").alias("Stop:Arrival cancelled"),
        F.col("departure_text").alias("Stop:Departure delay"), F.lit("FALSE").alias("Stop:Departure cancelled"))
    return _monthly(t, df, "services-2024-", F.col("Stop:RDT-ID") % 3)


@query("s4_monthly_services", """
    SELECT CAST(seq AS VARCHAR) AS stop_id, service_id AS service_id_raw, upper(trim(code_text)) AS station_code, CAST(TRY_CAST(trim(arrival_text) AS FLOAT) AS DOUBLE) AS arrival_delay,
      CAST(coalesce(trim(arrival_text) = 'S', false) OR coalesce(trim(departure_text) = 'S', false) OR full_text = 'true' AS INTEGER) AS cancelled FROM feed""", "feed")
def s4(t: Tables):
    df = readers.netherlands_services(t.spark, _netherlands(t))
    return df.select("stop_id", "service_id_raw", "station_code", "arrival_delay", F.col("cancelled").cast("int").alias("cancelled"))


@query("s5_file_rows", """
    SELECT 'services-2024-0' || (seq % 3 + 1) || '.csv' AS file, count(*) AS n_rows, CAST(sum(count(*)) OVER (ORDER BY seq % 3) AS BIGINT) AS cum_rows FROM stops GROUP BY seq % 3""")
def s5(t: Tables):
    return readers.file_rows(readers.netherlands_services(t.spark, _netherlands(t)))


@query("s6_file_inventory", """
    SELECT 'f' || (seq % 4) AS file, count(*) AS n_rows, round((avg(CAST(delay_minutes IS NULL AS INT)) + avg(CAST(snow_depth IS NULL AS INT))) / 3, 6) AS nan_rate FROM stops GROUP BY 1""")
def s6(t: Tables):
    df = t.stops.select(F.concat(F.lit("f"), F.col("seq") % 4).alias("file"), "delay_minutes", "snow_depth", "temperature")
    return readers.file_inventory(df).withColumn("nan_rate", C.r6("nan_rate"))


@query("s7_encoded_csv", "SELECT seq, 'Città n° ' || k AS station_name FROM stops")
def s7(t: Tables):
    path = scratch_path(t.spark, "latin1")
    t.stops.select("seq", F.concat(F.lit("Città n° "), "k").alias("station_name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.csv(t.spark, path, encoding="ISO-8859-1").select(F.col("seq").cast("long").alias("seq"), "station_name")


@query("s8_matrix_csv", "SELECT 'NL_' || station_from AS station_from, 'NL_' || station_to AS station_to, round(distance_km, 0) AS distance_km FROM edges", "edges")
def s8(t: Tables):
    path = scratch_path(t.spark, "matrix")
    wide_matrix(t).write.option("header", True).csv(path)
    return B.adjacency_from_matrix(readers.csv(t.spark, path), "Station", station_map(t))


def _country_folders(t: Tables):
    base = scratch_path(t.spark, "countries")
    folders = []
    for c in ("IT", "FI", "NL"):
        for name, df in five_tables(t).items():
            if name == "nodes_fault" and c != "NL":
                continue
            key = {"nodes_service": None, "edges_adjacent": "station_from"}.get(name, "station_id")
            mine = df.where(C.country_of(key) == c) if key else df
            sinks.save_standard(mine, f"{base}/{c}/{name}", name)
        folders.append(f"{base}/{c}")
    return folders


@query("s9_load_countries", """
    SELECT 'nodes_station' AS file, count(*) AS n_rows FROM stations UNION ALL SELECT 'nodes_service', count(*) FROM services
    UNION ALL SELECT 'edges_stops_at', count(*) FROM stops UNION ALL SELECT 'edges_adjacent', count(*) FROM edges UNION ALL SELECT 'nodes_fault', count(*) FROM faults WHERE station_id LIKE 'NL%'""",
       "stations services edges faults")
def s9(t: Tables):
    return sinks.output_summary(readers.load_countries(t.spark, _country_folders(t))).select("file", "n_rows")


@query("s10_cached_table", "SELECT station_id, count(*) AS n FROM stops GROUP BY 1")
def s10(t: Tables):
    path = scratch_path(t.spark, "cache")
    sinks.cached_table(t.spark, path, lambda: t.stops.groupBy("station_id").agg(F.count(F.lit(1)).alias("n")))
    return sinks.cached_table(t.spark, path, lambda: t.stops.where("false"))


@query("s11_weather_payload", """
    SELECT station_id AS station_code, CAST(date AS VARCHAR) AS date, min(temperature) AS temperature, max(wind_speed) AS wind_speed, max(precipitation) AS precipitation FROM stops GROUP BY ALL""")
def s11(t: Tables):
    daily = t.stops.groupBy("station_id", "date").agg(
        F.min("temperature").alias("temperature"), F.max("wind_speed").alias("wind_speed"), F.max("precipitation").alias("precipitation"), F.max("snow_depth").alias("snow_depth"))
    # At most one entry per day of the window and station.
    days = F.sort_array(F.collect_list(F.struct(F.col("date").cast("string").alias("d"), "temperature", "wind_speed", "precipitation", "snow_depth")))
    payload = daily.groupBy("station_id").agg(days.alias("x")).select(F.to_json(F.struct(
        F.col("station_id").alias("station_code"),
        F.struct(F.col("x.d").alias("time"), F.col("x.temperature").alias("temperature_2m_mean"), F.col("x.wind_speed").alias("wind_speed_10m_max"),
                 F.col("x.precipitation").alias("precipitation_sum"), F.col("x.snow_depth").alias("snow_depth_max")).alias("daily"))).alias("value"))
    path = scratch_path(t.spark, "weather")
    payload.write.text(path)
    return readers.weather_payloads(t.spark, path).select("station_code", F.col("date").cast("string").alias("date"), "temperature", "wind_speed", "precipitation")


@query("s12_standard_csv", "SELECT station_from, station_to, distance_km FROM edges", "edges")
def s12(t: Tables):
    from stopflow.sources.schemas import standard

    path = sinks.save_standard(t.edges, scratch_path(t.spark, "edges"), "edges_adjacent", fmt="csv")
    return readers.csv(t.spark, path, standard("edges_adjacent"))


@query("s13_feature_store", "SELECT split, count(*) AS n, round(avg(wind_speed), 6) AS mean_wind FROM positioned GROUP BY split", "positioned")
def s13(t: Tables):
    path = sinks.save_features(with_split(t.positioned, splits=EVENT_SPLITS), scratch_path(t.spark, "store"))
    return t.spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), C.r6(F.avg("wind_speed")).alias("mean_wind"))


@query("s14_manifest", """
    SELECT split, count(*) AS n_rows, round(avg(y_stop), 6) AS y_stop_rate, count(DISTINCT service_id) AS n_services, CAST(min(date) AS VARCHAR) AS first_date,
      CAST(max(date) AS VARCHAR) AS last_date FROM positioned GROUP BY split""", "positioned")
def s14(t: Tables):
    return sinks.manifest(with_split(t.labelled, splits=EVENT_SPLITS)).withColumn("y_stop_rate", C.r6("y_stop_rate"))


@query("s15_prediction_sink", """
    SELECT seq, station_id, p_a AS p_disrupted, CAST(p_a >= 0.4 AS INTEGER) AS y_pred, 'logreg' AS model, 'A' AS scenario FROM predictions""", "predictions")
def s15(t: Tables):
    out = sinks.scored(t.predictions, "p_a", 0.4, "logreg", "A", extra=["seq"])
    path = sinks.save_predictions(out, scratch_path(t.spark, "predictions"))
    return t.spark.read.parquet(path).select("seq", "station_id", "p_disrupted", "y_pred", "model", "scenario")


@query("s16_prediction_scan", "SELECT model, scenario, count(*) AS n, round(avg(p_disrupted), 6) AS mean_p, 0 AS n_before FROM runs WHERE split = 'test' GROUP BY ALL", "runs")
def s16(t: Tables):
    path = scratch_path(t.spark, "predictions")
    # a folder that does not exist yet has no predictions
    before = readers.predictions(t.spark, path)
    for s in "AB":
        sinks.save_predictions(t.runs.where(F.col("scenario") == s), path)
    return readers.predictions(t.spark, path, "test").groupBy("model", "scenario").agg(
        F.count(F.lit(1)).alias("n"), C.r6(F.avg("p_disrupted")).alias("mean_p"), F.lit(0 if before is None else 1).alias("n_before"))


@query("s17_graph_tables", f"""
    WITH {KG_SQL} SELECT 'stations' AS name, 'node' AS kind, count(*) AS n FROM st UNION ALL SELECT 'services', 'node', count(*) FROM services
      UNION ALL SELECT 'faults', 'node', count(*) FROM fl UNION ALL SELECT 'stops_at', 'edge', count(*) FROM sa UNION ALL SELECT 'adjacent', 'edge', count(*) FROM adj
      UNION ALL SELECT 'reported_at', 'edge', count(*) FROM rep""", KG_NEEDS)
def s17(t: Tables):
    paths = sinks.save_graph(property_graph(t), scratch_path(t.spark, "graph"))
    stored = kg.PropertyGraph(**{n: t.spark.read.parquet(p) for n, p in paths.items()})
    return kg.counts(stored).where("NOT name LIKE 'total%'")


@query("s18_json_records", "SELECT seq, CASE WHEN seq % 5 <> 0 AND seq % 7 <> 0 THEN wind_speed END AS wind_speed FROM stops")
def s18(t: Tables):
    s = F.col("seq")
    dirty = F.when(s % 5 == 0, F.lit(float("nan"))).when(s % 7 == 0, F.lit(float("inf"))).otherwise(F.col("wind_speed"))
    path = sinks.save_json(t.stops.select("seq", dirty.alias("wind_speed")), scratch_path(t.spark, "json"))
    return t.spark.read.schema("seq long, wind_speed double").json(path)


@query("s19_training_inputs", "SELECT seq, weather_severity, stop_order, round(position_norm, 6) AS position_norm FROM positioned", "positioned")
def s19(t: Tables):
    df = t.positioned.select("seq", "service_id", "weather_severity", "stop_order", C.r6("position_norm").alias("position_norm"), "y_stop", "delay_min", "cancelled")
    path = scratch_path(t.spark, "inputs")
    df.write.parquet(path)
    store, names = readers.training_inputs(t.spark, path, "A")
    return store.select("seq", *names).withColumn("position_norm", C.r6("position_norm"))


@query("s20_pruned_scan", "SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1", "")
def s20(t: Tables):
    df = readers.columns(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    return df.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))


def _drops(t: Tables):
    folder = scratch_path(t.spark, "drops")
    t.stops.select("station_id", "seq", (F.col("seq") % 3).alias("drop_no")).write.partitionBy("drop_no").csv(folder)
    return folder


@query("s21_file_checks", """
    SELECT CAST(d AS VARCHAR) AS file, CAST(d <> 0 AND d < 3 AS INTEGER) AS size_ok, CAST(d IN (0, 2) AS INTEGER) AS content_ok FROM range(4) t(d)""", "")
def s21(t: Tables):
    # The manifest comes from the rows, not from the files: what the sender wrote as lines.
    line, drop = F.concat_ws(",", "station_id", "seq"), (F.col("seq") % 3).cast("string")
    h = F.xxhash64(line)
    sent = t.stops.select(drop.alias("file"), line.alias("line"), h.alias("h")).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.sum(F.pmod("h", F.lit(1_000_003))).alias("hash_a"), F.bit_xor("h").alias("hash_b"))
    # Drop 0 is said to be longer, one line of drop 1 to be another, and drop 3 never arrived.
    wrong = sent.withColumn("n_chars", F.col("n_chars") + (F.col("file") == "0").cast("int")).withColumn("hash_b", F.col("hash_b").bitwiseXOR((F.col("file") == "1").cast("long")))
    missing = t.spark.range(1).select(F.lit("3").alias("file"), *[F.lit(1).cast("long").alias(c) for c in ("n_lines", "n_chars", "hash_a", "hash_b")])
    return readers.verify_files(t.spark, _drops(t), wrong.unionByName(missing), r"drop_no=(\d)")


@query("s21_fingerprints", """
    SELECT CAST(seq % 3 AS VARCHAR) AS drop_no, count(*) AS n_lines, CAST(sum(length(station_id || ',' || seq)) AS BIGINT) AS n_chars FROM stops GROUP BY 1""")
def s21_fingerprints(t: Tables):
    out = readers.fingerprints(t.spark, _drops(t), r"drop_no=(\d)")
    return out.select(F.col("file").alias("drop_no"), "n_lines", "n_chars")


@query("s2_stream_load", """
    SELECT count(*) AS raw_rows, count(*) FILTER (WHERE date <= DATE '2024-01-15') AS kept_rows, count(*) FILTER (WHERE date <= DATE '2024-01-15') AS stored_rows FROM stops""")
def s2_stream(t: Tables):
    from stopflow.sources.schemas import OPERATIONS
    from stopflow.streaming.ingest import load, operations_stream

    stream = operations_stream(t.spark, _operations(t), OPERATIONS, end=date(2024, 1, 15), files_per_batch=2)
    out = scratch_path(t.spark, "streamed")
    log = load(stream, out, scratch_path(t.spark, "offsets"))
    stored = t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n")).scalar()
    return log.agg(F.sum("raw_rows").alias("raw_rows"), F.sum("kept_rows").alias("kept_rows")).withColumn("stored_rows", stored)
