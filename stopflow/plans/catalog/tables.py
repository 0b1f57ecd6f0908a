"""Queries of the standard-table builders, joins, splits and set operations."""

from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators import builders as B
from stopflow.operators import guards, relate
from stopflow.operators import splits as S
from stopflow.plans.adapter import EVENT_REF_END, EVENT_SPLITS, EVENT_TRAIN_END, Tables, split_column
from stopflow.plans.registry import query
from stopflow.sources import schemas
from stopflow.sources.sinks import output_summary


def _ops(t: Tables):
    return t.feed.select(
        "seq", "date", "service_id", "user_id", "k", C.code("code_text").alias("station_name"), "type_text",
        C.delay_value("arrival_text").alias("arrival_delay"),
        C.any_of(C.delay_cancelled("arrival_text"), C.delay_cancelled("departure_text")).alias("cancelled"))


OPS_SQL = """ops AS (SELECT seq, date, service_id, user_id, k, upper(trim(code_text)) AS station_name, type_text,
      CAST(TRY_CAST(trim(arrival_text) AS FLOAT) AS DOUBLE) AS arrival_delay,
      coalesce(trim(arrival_text) = 'S', false) OR coalesce(trim(departure_text) = 'S', false) AS cancelled FROM feed)"""


@query("b1_it_stations", f"""
    WITH {OPS_SQL},
    nxt AS (SELECT 'ST ' || k AS a, 'ST ' || lead(k) OVER (PARTITION BY service_id ORDER BY scheduled_time, seq) AS b FROM stops),
    deg AS (SELECT a, count(DISTINCT b) AS degree FROM (SELECT a, b FROM nxt WHERE b IS NOT NULL UNION ALL SELECT b, a FROM nxt WHERE b IS NOT NULL) GROUP BY a),
    m AS (SELECT station_name, avg(arrival_delay) FILTER (WHERE NOT cancelled AND date <= DATE '2024-01-10') AS d FROM ops GROUP BY 1),
    master AS (SELECT 'ST ' || k AS station_name, lat, lon FROM stations)
    SELECT 'IT_' || replace(m.station_name, ' ', '_') AS station_id, round(lat, 6) AS lat, round(lon, 6) AS lon,
           round(coalesce(d, 0), 6) AS avg_historical_delay, CAST(coalesce(degree, 1) AS INTEGER) AS degree
    FROM m LEFT JOIN master USING (station_name) LEFT JOIN deg ON deg.a = m.station_name""", "feed stations")
def b1(t: Tables):
    master = t.stations.select(F.concat(F.lit(" st "), "k").alias("name"), "lat", "lon")
    mileage = t.positioned.select(F.col("service_id").alias("train_id"), F.col("stop_order").alias("station_order"),
                                  F.concat(F.lit("ST "), "k").alias("station_name"))
    out = B.italy_stations(_ops(t), master, mileage, EVENT_REF_END)
    return out.withColumns({c: C.r6(c) for c in ("lat", "lon", "avg_historical_delay")})


@query("b2_fi_stations", """
    SELECT 'FI_K' || k AS station_id, CASE WHEN k % 10 <> 0 THEN arg_min(CASE WHEN seq % 2 = 0 THEN temperature END, seq) FILTER (WHERE seq % 2 = 0) END AS lat,
      CASE WHEN k % 10 <> 0 THEN arg_min(CASE WHEN seq % 2 = 0 THEN wind_speed END, seq) FILTER (WHERE seq % 2 = 0) END AS lon,
      round(coalesce(avg(delay_minutes) FILTER (WHERE NOT cancelled AND date <= DATE '2024-01-10'), 0) + 1e-9, 6) AS avg_historical_delay,
      CAST(count(DISTINCT user_id) AS INTEGER) AS degree FROM stops GROUP BY k""")
def b2(t: Tables):
    known = (F.col("seq") % 2 == 0) & (F.col("k") % 10 != 0)
    df = t.stops.select("seq", F.concat(F.lit("K"), "k").alias("station_code"), F.col("user_id").alias("train_number"), "delay_minutes", "cancelled",
                        F.col("date").alias("departure_date"), F.when(known, F.col("temperature")).alias("lat"), F.when(known, F.col("wind_speed")).alias("lon"))
    return B.finland_stations(df, ref_end=EVENT_REF_END).withColumn("avg_historical_delay", C.r6(F.col("avg_historical_delay") + 1e-9))


@query("b3_nl_stations", f"""
    WITH {OPS_SQL}
    SELECT 'NL_' || replace(o.station_name, ' ', '_') AS station_id, round(max(s.lat), 6) AS lat, round(max(s.lon), 6) AS lon,
      round(coalesce(avg(arrival_delay) FILTER (WHERE NOT cancelled AND date <= DATE '2024-01-10'), 0), 6) AS avg_historical_delay,
      CAST(count(DISTINCT service_id) AS INTEGER) AS degree
    FROM ops o LEFT JOIN (SELECT 'ST ' || k AS station_name, lat, lon FROM stations) s USING (station_name) GROUP BY o.station_name""", "feed stations")
def b3(t: Tables):
    master = t.stations.select(F.concat(F.lit("st "), "k").alias("code"), F.col("lat").alias("geo_lat"), F.col("lon").alias("geo_lng"))
    df = _ops(t).withColumnsRenamed({"station_name": "station_code", "service_id": "service_id_raw"})
    return B.netherlands_stations(df, master, EVENT_REF_END).withColumns({c: C.r6(c) for c in ("lat", "lon", "avg_historical_delay")})


@query("b4_services", f"""
    WITH {OPS_SQL}
    SELECT 'IT_' || user_id || '_' || strftime(date, '%Y-%m-%d') AS service_id, type_text, CAST(date AS VARCHAR) AS date,
      CAST(bool_or(cancelled OR coalesce(arrival_delay > 5, false)) AS INTEGER) AS is_disrupted FROM ops GROUP BY ALL""", "feed")
def b4(t: Tables):
    df = _ops(t).withColumn("kind", F.col("type_text"))
    out = B.services(df, C.prefixed_id("IT", "user_id", "date"), "date", "type_text", "arrival_delay", extra=["kind"])
    return out.select("service_id", F.col("kind").alias("type_text"), F.col("date").cast("string").alias("date"), "is_disrupted")


@query("b5_stops_at", f"""
    WITH {OPS_SQL}
    SELECT o.seq, 'IT_' || user_id || '_' || strftime(date, '%Y-%m-%d') AS service_id, 'IT_ST_' || k AS station_id, arrival_delay AS delay_minutes,
      0 AS weather_severity, 0.0::DOUBLE AS temperature, CAST(NULL AS DOUBLE) AS snow_depth FROM ops o""", "feed")
def b5(t: Tables):
    names = t.stations.select(F.concat(F.lit("ST "), "k").alias("station_code"), F.concat(F.lit("IT_ST_"), "k").alias("station_id"))
    ops = _ops(t).withColumn("snow", F.lit(None).cast("double"))
    out = B.stops_at(ops, C.prefixed_id("IT", "user_id", "date"), "station_name", "arrival_delay", names,
                     rename={"snow": "snow_depth"}, missing=0.0, extras=["seq"])
    return out.select("seq", "service_id", "station_id", "delay_minutes", "weather_severity", "temperature", "snow_depth")


@query("b6_it_adjacency", "SELECT station_from, station_to, distance_km FROM edges", "edges")
def b6(t: Tables):
    mileage = t.positioned.select(F.col("service_id").alias("train_id"), F.col("stop_order").alias("station_order"), "station_id",
                                  F.col("k").cast("double").alias("distance"))
    return B.adjacency_from_order(mileage, ["train_id"], ["station_order"], "station_id", distance="distance")


@query("b7_fi_adjacency", "SELECT station_from, station_to, 0.0::DOUBLE AS distance_km FROM edges", "edges")
def b7(t: Tables):
    order = B.order_column(t.stops.columns)
    return B.adjacency_from_order(t.stops, ["user_id", "date"], [order, "seq"], "station_id")


@query("b8_nl_adjacency", """
    SELECT 'NL_' || station_from AS station_from, 'NL_' || station_to AS station_to, distance_km FROM edges WHERE station_from LIKE 'NL%' AND station_to LIKE 'NL%'""", "edges")
def b8(t: Tables):
    wide = t.edges.where("station_from LIKE 'NL%' AND station_to LIKE 'NL%'").groupBy(F.col("station_from").alias("Station")).pivot("station_to").agg(
        F.max(F.col("distance_km").cast("string")))
    names = t.stations.select(F.col("station_id").alias("station_code"), F.concat(F.lit("NL_"), "station_id").alias("station_id"))
    return B.adjacency_from_matrix(wide, "Station", names)


FAULT_SQL = """x AS (SELECT seq, date, cause_en, cause_group, upper(trim(c)) AS code FROM (
      SELECT f.seq, f.date, f.cause_en, f.cause_group, unnest(string_split(fd.codes_text, ',')) AS c FROM faults f JOIN feed fd USING (seq)
      WHERE fd.scheduled_time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'))"""


def nl_fault_rows(t: Tables):
    log = t.feed.where("event_type = 'error'").select(
        F.col("seq").alias("rdt_id"), F.col("scheduled_time").alias("start_time"), F.col("codes_text").alias("rdt_station_codes"),
        F.concat(F.lit("cause "), (F.col("seq") % 9)).alias("cause_en"), F.lit(None).cast("string").alias("cause_group"))
    names = t.stations.select(F.col("k").cast("string").alias("station_code"), "station_id")
    return B.faults(log, names, "2024-01-03", "2024-01-28")


@query("b9_nl_faults", f"""
    WITH {FAULT_SQL} SELECT 'NL_FAULT_' || seq AS fault_id, CAST(x.date AS VARCHAR) AS date, s.station_id, cause_en || ' | nan' AS description
    FROM x LEFT JOIN stations s ON CAST(s.k AS VARCHAR) = x.code""", "feed faults stations")
def b9(t: Tables):
    return nl_fault_rows(t).select("fault_id", F.col("date").cast("string").alias("date"), "station_id", "description")


@query("b10_top_causes", f"""
    WITH {FAULT_SQL} SELECT cause_en, count(DISTINCT seq) AS n_faults FROM x GROUP BY cause_en ORDER BY n_faults DESC, cause_en LIMIT 20""", "feed faults")
def b10(t: Tables):
    return B.top_causes(nl_fault_rows(t))


@query("b11_empty_faults", """
    SELECT s.country, count(f.fault_id) AS n_faults, count(f.description) AS n_described, max(f.date) AS last_day
    FROM (SELECT DISTINCT country FROM stops) s LEFT JOIN faults f ON left(f.fault_id, 2) = s.country AND s.country = 'NL' GROUP BY s.country""", "stops faults")
def b11(t: Tables):
    """Countries without a fault log take the empty table, which goes with a real one."""
    logs = schemas.empty_faults(t.spark).unionByName(t.faults.where("fault_id LIKE 'NL%'").select(*K.STANDARD_TABLES["nodes_fault"]))
    known = logs.select(F.substring("fault_id", 1, 2).alias("country"), "fault_id", "description", "date")
    return t.stops.select("country").distinct().join(known, "country", "left").groupBy("country").agg(
        F.count("fault_id").alias("n_faults"), F.count("description").alias("n_described"), F.max("date").alias("last_day"))


@query("b12_weather_by_station", """
    WITH w AS (SELECT station_id AS station_code, date, min_by(struct_pack(p := precipitation, s := snow_depth), seq) AS r FROM stops GROUP BY ALL)
    SELECT station_code, CAST(date AS VARCHAR) AS date, r.p AS precipitation, r.s AS snow_depth,
      CAST(greatest(CASE WHEN r.p >= 5 THEN 3 WHEN r.p >= 2 THEN 2 WHEN r.p >= 0.5 THEN 1 ELSE 0 END,
           CASE WHEN r.s >= 40 THEN 4 WHEN r.s >= 15 THEN 3 WHEN r.s >= 5 THEN 2 ELSE 0 END) AS INTEGER) AS weather_severity FROM w""")
def b12(t: Tables):
    out = B.weather_by_station(t.stops.withColumn("station_code", F.col("station_id")))
    return out.select("station_code", F.col("date").cast("string").alias("date"), "precipitation", "snow_depth", "weather_severity")


@query("b13_stations_from_rows", """
    SELECT station_id, arg_min(temperature, seq) AS temperature, arg_min(wind_speed, seq) AS wind_speed FROM stops WHERE date <= DATE '2024-01-20' GROUP BY station_id""")
def b13(t: Tables):
    train = t.stops.where(F.col("date") <= EVENT_TRAIN_END)
    return B.stations_from_rows(train, ["seq"], ["temperature", "wind_speed"])


def five_tables(t: Tables):
    return {"nodes_station": t.stations.select("station_id", "lat", "lon", "avg_historical_delay", "degree"),
            "nodes_service": t.services, "edges_stops_at": t.stops, "edges_adjacent": t.edges, "nodes_fault": t.faults}


@query("b14_schema_check", """
    SELECT 'edges_adjacent' AS "table", unnest(['station_from', 'station_to', 'distance_km']) AS "column", true AS present, unnest([count(station_from), count(station_to), count(distance_km)]) AS n_values FROM edges
    UNION ALL SELECT 'nodes_service', unnest(['service_id', 'train_class_code', 'date', 'is_disrupted']), true, unnest([count(service_id), count(train_class_code), count(date), count(is_disrupted)]) FROM services
    UNION ALL SELECT 'nodes_fault', unnest(['fault_id', 'date', 'station_id', 'description']), unnest([true, true, true, false]), unnest([count(fault_id), count(date), count(station_id), 0]) FROM faults""", "edges services faults")
def b14(t: Tables):
    tables = five_tables(t)
    tables["nodes_fault"] = tables["nodes_fault"].drop("description")
    parts = [schemas.column_report(tables[n], n) for n in ("edges_adjacent", "nodes_service", "nodes_fault")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b15_output_summary", """
    SELECT 'nodes_station' AS file, count(*) AS n_rows, 5 AS n_cols FROM stations UNION ALL SELECT 'nodes_service', count(*), 4 FROM services
    UNION ALL SELECT 'edges_adjacent', count(*), 3 FROM edges""", "stations services edges")
def b15(t: Tables):
    tables = five_tables(t)
    return output_summary({n: tables[n] for n in ("nodes_station", "nodes_service", "edges_adjacent")})


# -- joins --------------------------------------------------------------------------

@query("j1_stop_grain", """
    SELECT s.seq, s.y_stop, v.train_class_code, CAST(v.date AS VARCHAR) AS date FROM stops s
    JOIN services v ON v.service_id = s.service_id AND s.user_id % 10 <> 0""", "stops services")
def j1(t: Tables):
    gone = F.split("service_id", "_")[1].cast("int") % 10 == 0
    services = t.services.withColumn("date", F.when(~gone, F.col("date")))
    return relate.stop_grain(t.stops, services).select("seq", "y_stop", "train_class_code", F.col("date").cast("string").alias("date"))


@query("j2_dimension_lookup", """
    SELECT s.seq, coalesce(n.degree, 0) AS degree, coalesce(v.train_class_code, 6) AS class FROM stops s
    LEFT JOIN (SELECT * FROM stations) n USING (station_id) LEFT JOIN (SELECT * FROM services) v USING (service_id)""",
       "stops stations services")
def j2(t: Tables):
    sta = t.stations.select("station_id", "degree")
    svc = t.services.select("service_id", F.col("train_class_code").alias("class"))
    return t.stops.join(sta, "station_id", "left").join(svc, "service_id", "left").select(
        "seq", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("class", F.lit(6)).alias("class"))


@query("j3_segment_distance", """
    WITH p AS (SELECT seq, station_id, lag(station_id) OVER (PARTITION BY service_id ORDER BY scheduled_time, seq) AS prev FROM stops)
    SELECT seq, coalesce(distance_km, 0) AS seg_km FROM p LEFT JOIN edges e ON e.station_from = p.prev AND e.station_to = p.station_id""", "stops edges")
def j3(t: Tables):
    from stopflow.operators.features import with_segment_km
    from stopflow.operators.scan import keyed_scan, tag_slices

    hops = keyed_scan(tag_slices(t.stops, ["service_id"], ["scheduled_time", "seq"]), ["scheduled_time", "seq"], prev=["station_id"]).plain
    return with_segment_km(hops, t.edges).select("seq", "seg_km")


@query("j4_feature_back_join", """
    WITH d AS (SELECT station_id, date, avg(y_stop) AS rate FROM stops GROUP BY ALL)
    SELECT seq, round(coalesce(rate, 0), 6) AS daily_rate FROM stops LEFT JOIN d USING (station_id, date)""")
def j4(t: Tables):
    from stopflow.operators.features import attach, daily_rates

    daily = daily_rates(t.stops, ["station_id"]).select("station_id", "date", "daily_rate")
    return attach(t.stops, daily, ["station_id", "date"]).select("seq", C.r6("daily_rate").alias("daily_rate"))


@query("j5_weather_join", """
    WITH w AS (SELECT station_id, date, min_by(struct_pack(t := temperature), seq).t AS temp FROM stops GROUP BY ALL)
    SELECT seq, coalesce(temp, 10.0)::DOUBLE AS temperature FROM stops LEFT JOIN w USING (station_id, date)""")
def j5(t: Tables):
    coded = t.stops.withColumn("station_code", F.col("station_id"))
    return B.join_weather(coded, B.weather_by_station(coded)).select("seq", "temperature")


@query("j6_edge_daily_rate", """
    WITH d AS (SELECT station_id, date, avg(y_stop) AS rate FROM stops GROUP BY ALL)
    SELECT e.station_from, CAST(d.date AS VARCHAR) AS date, round(avg(rate) + 1e-9, 6) AS nbr_rate FROM edges e JOIN d ON d.station_id = e.station_to GROUP BY ALL""", "stops edges")
def j6(t: Tables):
    from stopflow.operators.features import daily_rates, neighbour_lag

    daily = daily_rates(t.stops, ["station_id"]).withColumnRenamed("daily_rate", "station_lag1_rate")
    return neighbour_lag(daily, t.edges).select(F.col("station_id").alias("station_from"), F.col("date").cast("string").alias("date"),
                                                C.r6(F.col("nbr_lag1_rate") + 1e-9).alias("nbr_rate"))


@query("j7_foreign_key_filter", """
    SELECT seq FROM stops WHERE station_id IN (SELECT station_id FROM stations) AND service_id IN (SELECT service_id FROM services WHERE is_disrupted = 1)""",
       "stops stations services")
def j7(t: Tables):
    return t.stops.join(t.stations, "station_id", "left_semi").join(
        t.services.where("is_disrupted = 1"), "service_id", "left_semi").select("seq")


CAUSE_SQL = """cause AS (SELECT station_id, date, cause_group FROM (
      SELECT station_id, date, cause_group, row_number() OVER (PARTITION BY station_id, date ORDER BY count(*) DESC, cause_group) AS rn
      FROM faults GROUP BY station_id, date, cause_group) WHERE rn = 1)"""


def station_day_causes(t: Tables):
    from stopflow.operators.profiling import mode_per_key

    return mode_per_key(t.faults, ["station_id", "date"], "cause_group")


@query("j8_stops_with_cause", f"WITH {CAUSE_SQL} SELECT seq, cause_group FROM stops JOIN cause USING (station_id, date) WHERE y_stop = 1", "stops faults")
def j8(t: Tables):
    return t.labelled.where("y_stop = 1").join(station_day_causes(t), ["station_id", "date"]).select("seq", "cause_group")


@query("j9_scenario_pairs", "SELECT seq, p_a, p_b, round(p_b - p_a, 6) AS uplift FROM predictions", "predictions")
def j9(t: Tables):
    from stopflow.operators.explain import scenario_pairs

    a, b = (t.runs.where(F.col("scenario") == s) for s in "AB")
    return scenario_pairs(a, b).select("seq", "p_a", "p_b", C.r6("uplift").alias("uplift"))


@query("j10_predictions_with_features", """
    SELECT seq, p_a, p_b, wind_speed, hour(scheduled_time)::INTEGER AS hour FROM predictions""", "predictions")
def j10(t: Tables):
    p = t.predictions
    keys = ["service_id", "station_id", "stop_order"]
    features = t.positioned.select(*keys, F.hour("scheduled_time").alias("hour"))
    return relate.on_stop(relate.on_stop(p.select("seq", *keys, "p_a", "wind_speed"), p.select(*keys, "p_b")), features).select(
        "seq", "p_a", "p_b", "wind_speed", "hour")


@query("j11_fallback_source", """
    WITH top AS (SELECT station_id, count(*) AS n FROM stops GROUP BY 1 ORDER BY n DESC, station_id LIMIT 40)
    SELECT t.station_id, t.n, coalesce(a.lat, b.temperature) AS lat FROM top t LEFT JOIN (SELECT * FROM stations) a USING (station_id)
    LEFT JOIN (SELECT station_id, min_by(temperature, seq) AS temperature FROM stops GROUP BY 1) b USING (station_id)""", "stops stations")
def j11(t: Tables):
    top = t.stops.groupBy("station_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "station_id").limit(40)
    second = t.stops.groupBy("station_id").agg(F.min_by("temperature", "seq").alias("lat"))
    return relate.with_fallback(top, "station_id", t.stations, second, ["lat"])


@query("j12_label_fallback", """
    SELECT s.station_id, count(*) AS n, coalesce(max(n.name), s.station_id) AS label FROM stops s
    LEFT JOIN (SELECT station_id, 'Station ' || k AS name FROM stations) n USING (station_id) GROUP BY s.station_id""", "stops stations")
def j12(t: Tables):
    counts = t.stops.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    names = t.stations.select("station_id", F.concat(F.lit("Station "), "k").alias("name"))
    return relate.with_label(counts, "station_id", names, "name")


@query("j13_recent_faults", """
    WITH d AS (SELECT DISTINCT station_id, date FROM stops),
    c AS (SELECT d.station_id, d.date, count(f.fault_id) AS n FROM d LEFT JOIN faults f ON f.station_id = d.station_id AND f.date BETWEEN d.date - 14 AND d.date GROUP BY ALL)
    SELECT seq, n AS recent_faults FROM stops JOIN c USING (station_id, date)""", "stops faults")
def j13(t: Tables):
    return relate.recent_faults(t.stops, t.faults).select("seq", "recent_faults")


@query("j14_split_overlap", """
    SELECT user_id, count(DISTINCT split) AS n_splits FROM positioned GROUP BY 1 HAVING count(DISTINCT split) > 1""", "positioned")
def j14(t: Tables):
    return guards.split_overlap(t.stops.withColumn("split", split_column()), "user_id")


@query("j15_running_distance_on_row", """
    WITH p AS (SELECT *, lag(station_id) OVER (PARTITION BY service_id ORDER BY scheduled_time, seq) AS prev FROM stops)
    SELECT seq, round(sum(coalesce(distance_km, 0)) OVER (PARTITION BY service_id ORDER BY scheduled_time, seq), 6) AS cum_distance_km
    FROM p LEFT JOIN edges e ON e.station_from = p.prev AND e.station_to = p.station_id""", "stops edges")
def j15(t: Tables):
    from stopflow.operators.features import service_identity

    out = service_identity(t.stops.drop("train_class_code"), t.services, t.edges)
    return out.select("seq", C.r6("cum_distance_km").alias("cum_distance_km"))


@query("j16_cause_sample_features", """
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5(service_id || '|' || stop_order || '|42'), service_id, stop_order) AS rn
               FROM predictions WHERE y_stop = 1 AND country <> 'NL')
    SELECT seq, country, hour(scheduled_time)::INTEGER AS hour FROM s WHERE rn <= 150""", "predictions")
def j16(t: Tables):
    from stopflow.plans.dashboard import cause_sample

    sample = cause_sample(t.predictions.where("y_stop = 1 AND country <> 'NL'"), 150)
    keys = ["service_id", "station_id", "stop_order"]
    return relate.on_stop(sample, t.positioned.select(*keys, F.hour("scheduled_time").alias("hour"))).select("seq", "country", "hour")


# -- splits, scaling, sampling ----------------------------------------------------------

@query("t1_day_split", "SELECT seq, split FROM positioned WHERE date <= DATE '2024-01-28'", "positioned")
def t1(t: Tables):
    splits = EVENT_SPLITS | {"test": ("2024-01-26", "2024-01-28")}
    return S.with_split(t.stops, splits=splits).select("seq", "split")


@query("t2_disjoint_services", "SELECT split, count(DISTINCT service_id) AS n_services FROM positioned GROUP BY split", "positioned")
def t2(t: Tables):
    df = S.with_split(t.stops, splits=EVENT_SPLITS)
    guards.check_disjoint(df)
    return df.groupBy("split").agg(F.countDistinct("service_id").alias("n_services"))


@query("t3_rolling_folds", """
    WITH w AS (SELECT seq, date_diff('day', DATE '2024-01-01', date) // 7 AS week FROM stops),
    b AS (SELECT greatest(1, (max(week) + 1) // 3) AS block FROM w)
    SELECT fold, role, count(*) AS n FROM (SELECT fold, CASE WHEN week < fold * block THEN 'train' WHEN week < (fold + 1) * block THEN 'val' END AS role
      FROM w, b, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS fold)) WHERE role IS NOT NULL GROUP BY ALL""")
def t3(t: Tables):
    return S.rolling_folds(t.stops, 2).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("t4_standard_scaler", """
    WITH s AS (SELECT avg(delay_minutes) AS m, stddev_pop(delay_minutes) AS d, avg(snow_depth) AS m2, stddev_pop(snow_depth) AS d2 FROM stops WHERE date <= DATE '2024-01-20')
    SELECT seq, round((delay_minutes - m) / d, 6) AS delay_minutes_scaled, round((snow_depth - m2) / d2, 6) AS snow_depth_scaled, 0.0::DOUBLE AS one_scaled FROM stops, s""")
def t4(t: Tables):
    names = ["delay_minutes", "snow_depth", "one"]
    df = t.stops.withColumn("one", F.lit(1.0))
    out = S.scale(df, S.scaler_statistics(df.where(F.col("date") <= EVENT_TRAIN_END), names), names)
    return out.select("seq", *[C.r6(f"{n}_scaled").alias(f"{n}_scaled") for n in names])


@query("t5_restandardise", """
    WITH s AS (SELECT avg(wind_speed) AS m, greatest(stddev_pop(wind_speed), 1e-6) AS d FROM stops WHERE date <= DATE '2024-01-20')
    SELECT seq, round((wind_speed - m) / d, 6) AS wind_speed_scaled, 0.0::DOUBLE AS one_scaled FROM stops, s""")
def t5(t: Tables):
    df = t.stops.withColumn("one", F.lit(1.0))
    stats = S.scaler_statistics(df.where(F.col("date") <= EVENT_TRAIN_END), ["wind_speed", "one"], floor=1e-6)
    out = S.scale(df, stats, ["wind_speed", "one"])
    return out.select("seq", C.r6("wind_speed_scaled").alias("wind_speed_scaled"), "one_scaled")


@query("t6_row_sample", "SELECT seq FROM stops ORDER BY md5(seq || '|42'), seq LIMIT 500")
def t6(t: Tables):
    return S.sample_rows(t.stops, 500, ["seq"]).select("seq")


@query("t7_bucket_sample", """
    SELECT seq, bucket FROM (SELECT seq, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(service_id || '|' || stop_order || '|42'), service_id, stop_order) AS rn
      FROM (SELECT *, CASE WHEN p_b <= 0.25 THEN 'low' WHEN p_b <= 0.5 THEN 'mid_low' WHEN p_b <= 0.75 THEN 'mid_high' ELSE 'high' END AS bucket FROM predictions))
    WHERE rn <= 200""", "predictions")
def t7(t: Tables):
    from stopflow.plans.dashboard import prediction_sample

    return prediction_sample(t.predictions, 200).select("seq", "bucket")


@query("t8_dense_index", "SELECT service_id, row_number() OVER (ORDER BY service_id) - 1 AS idx FROM services", "services")
def t8(t: Tables):
    return S.dense_index(t.services, "service_id", "idx")


@query("t9_class_weights", """
    SELECT country, n, round((SELECT count(*) FROM stops) / (3.0 * n), 6) AS weight FROM (SELECT country, count(*) AS n FROM stops GROUP BY 1)""")
def t9(t: Tables):
    return S.class_weights(t.stops, "country").withColumn("weight", C.r6("weight"))


@query("t9_positive_weight", "SELECT round(greatest(1.0, sum(1 - y_stop)::DOUBLE / greatest(sum(y_stop), 1)), 6) AS positive_weight FROM stops")
def t9_pos(t: Tables):
    return S.positive_weight(t.labelled, "y_stop").withColumn("positive_weight", C.r6("positive_weight"))


@query("t10_label_encoding", """
    SELECT fault_id, CAST(dense_rank() OVER (ORDER BY cause_group) - 1 AS INTEGER) AS y_cause FROM faults""", "faults")
def t10(t: Tables):
    return t.faults.join(S.label_index(t.faults, "cause_group", "y_cause"), "cause_group").select("fault_id", "y_cause")


@query("t11_first_wins", "SELECT station_id, seq, temperature FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY seq) AS rn FROM stops) WHERE rn = 1")
def t11(t: Tables):
    return S.first_wins(t.stops.select("station_id", "seq", "temperature"), ["station_id"], ["seq"])


@query("t12_country_sample", """
    SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY country ORDER BY md5(service_id || '|' || stop_order || '|42'), service_id, stop_order) AS rn
      FROM predictions WHERE y_stop = 1 AND split = 'test') WHERE rn <= 60""", "predictions")
def t12(t: Tables):
    from stopflow.plans.dashboard import cause_sample

    return cause_sample(t.predictions.where("y_stop = 1 AND split = 'test'"), 60).select("seq")


# -- sorts, limits, sets ------------------------------------------------------------------

@query("o1_stable_sort", "SELECT station_id, seq, row_number() OVER (PARTITION BY station_id ORDER BY date, delay_int, seq) AS place FROM stops")
def o1(t: Tables):
    from stopflow.operators.scan import keyed_scan, tag_slices

    order = ["date", "delay_int", "seq"]
    ranked = keyed_scan(tag_slices(t.stops, ["station_id"], order), order).plain
    return ranked.select("station_id", "seq", (F.col("_rn") + 1).alias("place"))


@query("o2_global_top_k", "SELECT seq, delay_minutes FROM stops ORDER BY delay_minutes DESC NULLS LAST, seq LIMIT 25")
def o2(t: Tables):
    return t.stops.orderBy(F.desc_nulls_last("delay_minutes"), "seq").limit(25).select("seq", "delay_minutes")


@query("o3_top_k_per_group", """
    SELECT station_id, seq FROM (SELECT station_id, seq, row_number() OVER (PARTITION BY station_id ORDER BY delay_minutes DESC NULLS LAST, seq) AS rn FROM stops) WHERE rn <= 3""")
def o3(t: Tables):
    return S.sample_per_group(t.stops, ["station_id"], 3, [F.desc_nulls_last("delay_minutes"), F.col("seq")]).select("station_id", "seq")


@query("o4_union_all", "SELECT seq, 'early' AS part FROM stops WHERE day(date) <= 15 UNION ALL SELECT seq, 'late' FROM stops WHERE day(date) >= 10")
def o4(t: Tables):
    early = t.stops.where(F.dayofmonth("date") <= 15).select("seq", F.lit("early").alias("part"))
    late = t.stops.where(F.dayofmonth("date") >= 10).select(F.lit("late").alias("part"), "seq")
    return early.unionByName(late)


@query("o5_union_distinct", "SELECT station_from AS station_id FROM edges WHERE distance_km < 3 UNION SELECT station_to FROM edges WHERE distance_km > 60", "edges")
def o5(t: Tables):
    return t.edges.where("distance_km < 3").select(F.col("station_from").alias("station_id")).union(
        t.edges.where("distance_km > 60").select("station_to")).distinct()


@query("o6_intersection", "SELECT user_id FROM positioned WHERE split = 'train' INTERSECT SELECT user_id FROM positioned WHERE split = 'test'", "positioned")
def o6(t: Tables):
    df = S.with_split(t.stops, splits=EVENT_SPLITS)
    return df.where("split = 'train'").select("user_id").intersect(df.where("split = 'test'").select("user_id"))


@query("o7_column_difference", """
    WITH p AS (SELECT *, lag(coalesce(delay_minutes, 0), 1, 0) OVER w AS prev_stop_actual_delay FROM positioned WINDOW w AS (PARTITION BY service_id ORDER BY scheduled_time, seq)),
    v AS (SELECT count(DISTINCT y_stop) AS y_stop, count(DISTINCT stop_order) AS stop_order, count(DISTINCT temperature) AS temperature, count(DISTINCT prev_stop_actual_delay) AS prev_stop_actual_delay FROM p),
    n AS (UNPIVOT v ON COLUMNS(*) INTO NAME "column" VALUE n_values)
    SELECT "column", "column" NOT IN ('y_stop', 'prev_stop_actual_delay') AS in_a, "column" <> 'y_stop' AS in_b, n_values FROM n""", "positioned")
def o7(t: Tables):
    from stopflow.operators.features import inflight

    return guards.column_report(inflight(t.positioned).select("y_stop", "stop_order", "temperature", "prev_stop_actual_delay"))


@query("o8_distinct_rows", "SELECT DISTINCT station_id, train_class_code FROM stops")
def o8(t: Tables):
    return t.stops.select("station_id", "train_class_code").distinct()
