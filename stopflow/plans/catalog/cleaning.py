"""Queries of projections, cleaning, parsing, imputation."""

from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators import builders as B
from stopflow.operators import features as feat
from stopflow.operators import guards, impute, parse
from stopflow.plans.adapter import EVENT_TRAIN_END, Tables
from stopflow.plans.registry import query


@query("p1_date_window", """
    SELECT count(*) AS rows_before, count(*) FILTER (WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24') AS rows_after,
           CAST(min(date) FILTER (WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24') AS VARCHAR) AS first_kept
    FROM stops""")
def p1(t: Tables):
    inside = F.col("date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-24").cast("date"))
    return t.stops.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(inside).alias("rows_after"),
                       F.min(F.when(inside, F.col("date"))).cast("string").alias("first_kept"))


@query("p2_delay_sentinels", """
    SELECT seq, CAST(TRY_CAST(trim(arrival_text) AS FLOAT) AS DOUBLE) AS arrival_delay,
           CAST(coalesce(trim(arrival_text) = 'S', false) AS INTEGER) AS arrival_cancelled FROM feed""", "feed")
def p2(t: Tables):
    return t.feed.select("seq", C.delay_value("arrival_text").alias("arrival_delay"),
                         C.delay_cancelled("arrival_text").cast("int").alias("arrival_cancelled"))


@query("p3_sentinel_classes", """
    SELECT 'arrival' AS source, count(*) FILTER (WHERE trim(arrival_text) = 'N') AS n_first, count(*) FILTER (WHERE trim(arrival_text) = 'S') AS n_cancelled,
           count(TRY_CAST(trim(arrival_text) AS FLOAT)) AS n_numeric FROM feed
    UNION ALL SELECT 'departure', count(*) FILTER (WHERE trim(departure_text) = 'N'), count(*) FILTER (WHERE trim(departure_text) = 'S'),
           count(TRY_CAST(trim(departure_text) AS FLOAT)) FROM feed""", "feed")
def p3(t: Tables):
    sides = F.explode(F.array(F.struct(F.lit("arrival").alias("source"), F.col("arrival_text").alias("x")),
                              F.struct(F.lit("departure").alias("source"), F.col("departure_text").alias("x"))))
    x = F.trim("x")
    return t.feed.select(sides.alias("s")).select("s.*").groupBy("source").agg(
        F.count_if(x == "N").alias("n_first"), F.count_if(x == "S").alias("n_cancelled"),
        F.count(C.delay_value("x")).alias("n_numeric"))


@query("p4_tolerant_bool", """
    SELECT seq, CAST(coalesce(lower(bool_text) IN ('true', '1'), false) AS INTEGER) AS with_digits,
           CAST(coalesce(lower(bool_text) = 'true', false) AS INTEGER) AS words_only FROM feed""", "feed")
def p4(t: Tables):
    return t.feed.select("seq", C.tolerant_bool("bool_text").cast("int").alias("with_digits"),
                         C.tolerant_bool("bool_text", accept_digits=False).cast("int").alias("words_only"))


def _nl(t: Tables):
    from stopflow.sources.readers import cancellation_sources

    df = t.feed.select("seq", F.col("arrival_text").alias("arrival_delay"), F.col("departure_text").alias("departure_delay"),
                       F.col("full_text").alias("fully_cancelled"), F.col("bool_text").alias("arrival_cancelled"),
                       F.when(F.col("seq") % 29 == 3, "True").when(F.col("seq") % 31 == 4, None).otherwise("no").alias("departure_cancelled"))
    flags = cancellation_sources(df)
    return df.withColumns(flags | {"cancelled": C.any_of(*flags.values())})


@query("p5_any_cancelled", """
    SELECT seq, CAST(coalesce(trim(arrival_text) = 'S', false) OR coalesce(trim(departure_text) = 'S', false) AS INTEGER) AS two_sources,
           CAST(coalesce(trim(arrival_text) = 'S', false) OR coalesce(trim(departure_text) = 'S', false) OR full_text = 'true' OR lower(bool_text) = 'true' OR seq % 29 = 3 AS INTEGER) AS all_sources
    FROM feed""", "feed")
def p5(t: Tables):
    two = C.any_of(F.col("s_arrival"), F.col("s_departure"))
    return _nl(t).select("seq", two.cast("int").alias("two_sources"), F.col("cancelled").cast("int").alias("all_sources"))


@query("p6_cancellation_breakdown", """
    SELECT 'fully_cancelled' AS source, count(*) FILTER (WHERE full_text = 'true') AS n_true FROM feed
    UNION ALL SELECT 'arrival_cancelled', count(*) FILTER (WHERE lower(bool_text) = 'true') FROM feed
    UNION ALL SELECT 's_arrival', count(*) FILTER (WHERE trim(arrival_text) = 'S') FROM feed
    UNION ALL SELECT 's_departure', count(*) FILTER (WHERE trim(departure_text) = 'S') FROM feed
    UNION ALL SELECT 'departure_cancelled', count(*) FILTER (WHERE seq % 29 = 3) FROM feed
    UNION ALL SELECT 'union', count(*) FILTER (WHERE coalesce(trim(arrival_text) = 'S', false) OR trim(departure_text) = 'S' OR full_text = 'true' OR lower(bool_text) = 'true' OR seq % 29 = 3) FROM feed""", "feed")
def p6(t: Tables):
    names = ["fully_cancelled", "arrival_cancelled", "departure_cancelled", "s_arrival", "s_departure"]
    one = _nl(t).agg(*[F.count_if(n).alias(n) for n in names], F.count_if("cancelled").alias("union"))
    return one.unpivot([], [*names, "union"], "source", "n_true")


@query("p7_header_names", """
    SELECT seq, service_id AS service_id_raw, type_text AS train_type, code_text AS station_code, arrival_text AS arrival_delay,
           coalesce(temperature, wind_speed) AS air_temp FROM feed""", "feed")
def p7(t: Tables):
    raw = t.feed.select("seq", F.col("service_id").alias("Service:RDT-ID"), F.col("type_text").alias("Service:Type"),
                        F.col("code_text").alias("Stop:Station code"), F.col("arrival_text").alias("Stop:Arrival delay"),
                        F.col("temperature").alias("airTemperature"), F.col("wind_speed").alias("Air temperature"))
    return parse.rename_known(raw, K.NL_HEADERS | K.FI_FIELDS)


@query("p8_train_class", """
    SELECT seq, CAST(coalesce(m.c, 6) AS INTEGER) AS train_class_code FROM feed LEFT JOIN (VALUES ('EC', 3), ('FR', 5), ('IC', 2), ('SPRINTER', 0),
      ('INTERCITY DIRECT', 4), ('P', 1), ('MUS', 6), ('REG', 0)) m(n, c) ON m.n = upper(trim(type_text))""", "feed")
def p8(t: Tables):
    return t.feed.select("seq", C.train_class("type_text").alias("train_class_code"))


@query("p9_weather_text", """
    SELECT seq, CAST(coalesce(m.c, 0) AS INTEGER) AS severity, CAST(m.c AS INTEGER) AS severity_or_null FROM feed LEFT JOIN (VALUES ('sunny', 0), ('partially cloudy', 0), ('cloudy', 0),
      ('light rain', 1), ('moderate rain', 2), ('heavy rain', 3), ('light snow', 2), ('moderate snow', 3), ('heavy snow', 4)) m(n, c)
      ON m.n = lower(trim(weather_text))""", "feed")
def p9(t: Tables):
    return t.feed.select("seq", C.weather_text_severity("weather_text").alias("severity"),
                         C.weather_text_severity("weather_text", unknown_to=None).alias("severity_or_null"))


@query("p9_unknown_weather", """
    SELECT lower(trim(weather_text)) AS label, count(*) AS n FROM feed WHERE weather_text = 'hail' GROUP BY 1""", "feed")
def p9_unknown(t: Tables):
    return t.feed.where(C.is_unknown_weather("weather_text")).groupBy(
        F.lower(F.trim("weather_text")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


SEVERITY_SQL = """greatest(CASE WHEN precipitation >= 5 THEN 3 WHEN precipitation >= 2 THEN 2 WHEN precipitation >= 0.5 THEN 1 ELSE 0 END,
      CASE WHEN snow_depth >= 40 THEN 4 WHEN snow_depth >= 15 THEN 3 WHEN snow_depth >= 5 THEN 2 ELSE 0 END{fog})"""


@query("p10_severity_with_visibility", f"""
    SELECT seq, CAST({SEVERITY_SQL.format(fog=', CASE WHEN visibility < 200 THEN 3 ELSE 0 END')} AS INTEGER) AS severity FROM feed""", "feed")
def p10(t: Tables):
    return t.feed.select("seq", C.weather_severity("precipitation", "snow_depth", "visibility").alias("severity"))


@query("p11_daily_severity", f"SELECT seq, CAST({SEVERITY_SQL.format(fog='')} AS INTEGER) AS severity FROM feed", "feed")
def p11(t: Tables):
    return t.feed.select("seq", C.weather_severity("precipitation", "snow_depth").alias("severity"))


def wide_matrix(t: Tables):
    """Wide distance matrix pivoted from the edges; the diagonal is marked."""
    e = t.edges.select("station_from", "station_to", F.round("distance_km", 0).cast("int").cast("string").alias("cell"))
    diagonal = t.stations.select(F.col("station_id").alias("station_from"), F.col("station_id").alias("station_to"), F.lit("XXX").alias("cell"))
    wide = e.unionByName(diagonal).groupBy("station_from").pivot("station_to").agg(F.max("cell"))
    return wide.withColumnRenamed("station_from", "Station")


def station_map(t: Tables):
    return t.stations.select(F.col("station_id").alias("station_code"), F.concat(F.lit("NL_"), "station_id").alias("station_id"))


@query("p12_unpivot_matrix", """
    SELECT 'NL_' || station_from AS station_from, 'NL_' || station_to AS station_to, round(round(distance_km, 0), 2) AS distance_km FROM edges""""", "edges")
def p12(t: Tables):
    return B.adjacency_from_matrix(wide_matrix(t), "Station", station_map(t))


@query("p13_matrix_statistics", """
    SELECT CAST((SELECT count(*) FROM stations) * (SELECT count(*) FROM stations) AS BIGINT) AS n_total, (SELECT count(*) FROM stations) AS n_xxx,
           (SELECT count(*) FROM stations) * (SELECT count(*) FROM stations) - (SELECT count(*) FROM edges) AS n_nan,
           (SELECT count(*) FROM edges) AS n_edges""",
       "edges stations")
def p13(t: Tables):
    return B.matrix_statistics(wide_matrix(t), "Station", station_map(t))


def trains(t: Tables):
    """Train rows with a serialised stop list, built from the stops."""
    s = F.col("seq")

    def stop(shift: int):
        # some names hold the feed's words for missing and true values, or a quote
        code = F.when((s + shift) % 71 == 0, "'None'").when((s + shift) % 73 == 0, '"K\'nan True"').when((s + shift) % 79 == 0, "'is True or None'") \
            .otherwise(F.concat(F.lit("'K"), ((F.col("k") + shift) % 100), F.lit("'")))
        delay = F.when((s + shift) % 5 == 0, F.lit("nan")).otherwise((F.col("delay_int") + shift).cast("string"))
        cancelled = F.when((s + shift) % 4 == 0, "True").otherwise("False")
        temp = F.when((s + shift) % 6 == 0, F.lit("None")).otherwise((s % 30).cast("string"))
        spelling = F.when(s % 2 == 0, "Air temperature").otherwise("airTemperature")
        return F.concat(F.lit("{'stationShortCode': "), code, F.lit(", 'differenceInMinutes': "), delay, F.lit(", 'cancelled': "), cancelled,
                        F.lit(", 'weather_observations': {'"), spelling, F.lit("': "), temp, F.lit(", 'Snow depth': "), (s % 60).cast("string"), F.lit("}}"))

    cell = (F.when(s % 53 == 0, "nan").when(s % 59 == 0, " ").when(s % 61 == 0, F.lit(None))
            .when(s % 67 == 0, F.concat(F.lit("[{'stationShortCode': "), F.col("k").cast("string")))
            .when(s % 3 == 0, stop(0))
            .otherwise(F.concat(F.lit("["), stop(0), F.lit(", "), stop(1), F.lit("]"))))
    return t.stops.select(s.alias("trainNumber"), F.concat(F.lit("f"), s % 4).alias("file"), F.lit("false").alias("cancelled"),
                          F.col("date").cast("string").alias("departureDate"), cell.alias("timeTableRows"))


NESTED_SQL = """
    tr AS (SELECT seq, k, delay_int, CASE WHEN seq % 53 = 0 OR seq % 59 = 0 OR seq % 61 = 0 THEN 'empty' WHEN seq % 67 = 0 THEN 'parse_error' ELSE 'success' END AS status,
           CASE WHEN seq % 53 = 0 OR seq % 59 = 0 OR seq % 61 = 0 OR seq % 67 = 0 THEN 0 WHEN seq % 3 = 0 THEN 1 ELSE 2 END AS n_stops FROM stops)"""


@query("p14_stop_list_status", f"WITH {NESTED_SQL} SELECT seq AS train_number, status AS parse_status, CAST(n_stops AS INTEGER) AS n_stops FROM tr")
def p14(t: Tables):
    return parse.with_stops(trains(t)).select(F.col("trainNumber").alias("train_number"), "parse_status",
                                              F.coalesce(F.size("_stops"), F.lit(0)).alias("n_stops"))


@query("p15_explode_stops", f"""
    WITH {NESTED_SQL},
    rows AS (SELECT seq, k, delay_int, n_stops, i FROM tr, (SELECT unnest([0, 1]) AS i) WHERE i < n_stops OR (n_stops = 0 AND i = 0))
    SELECT seq AS train_number, CASE WHEN n_stops = 0 THEN NULL WHEN (seq + i) % 71 = 0 THEN 'None' WHEN (seq + i) % 73 = 0 THEN 'K''nan True' WHEN (seq + i) % 79 = 0 THEN 'is True or None' ELSE 'K' || ((k + i) % 100) END AS station_code,
           CASE WHEN n_stops > 0 AND (seq + i) % 5 <> 0 THEN CAST(delay_int + i AS DOUBLE) END AS delay_minutes,
           CASE WHEN n_stops > 0 THEN CASE WHEN (seq + i) % 4 = 0 THEN 'true' ELSE 'false' END ELSE 'false' END AS cancelled,
           CASE WHEN n_stops > 0 AND (seq + i) % 6 <> 0 THEN CAST(seq % 30 AS DOUBLE) END AS air_temp,
           CASE WHEN n_stops > 0 THEN CAST(seq % 60 AS DOUBLE) END AS snow_depth FROM rows""")
def p15(t: Tables):
    rows = parse.explode_stops(parse.with_stops(trains(t)))
    return rows.select("train_number", "station_code", F.col("delay_minutes").try_cast("double").alias("delay_minutes"), "cancelled",
                       F.col("air_temp").try_cast("double").alias("air_temp"), F.col("snow_depth").try_cast("double").alias("snow_depth"))


@query("p16_parse_log", f"""
    WITH {NESTED_SQL} SELECT 'f' || (seq % 4) AS file, count(*) AS n_trains, CAST(sum(greatest(n_stops, 1)) AS BIGINT) AS n_stops,
      count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status = 'empty') AS n_empty,
      count(*) FILTER (WHERE status = 'parse_error') AS n_error FROM tr GROUP BY 1""")
def p16(t: Tables):
    return parse.parse_log(parse.with_stops(trains(t)), "file")


@query("p17_coercion", """
    SELECT seq, CAST(TRY_CAST(trim(arrival_text) AS FLOAT) AS DOUBLE) AS arrival_text, CAST(lower(bool_text) IN ('true', '1') AS INTEGER) AS bool_text FROM feed""", "feed")
def p17(t: Tables):
    return parse.coerce(t.feed, ["arrival_text"], ["bool_text"]).select("seq", "arrival_text", F.col("bool_text").cast("int").alias("bool_text"))


@query("p17_coercion_log", """
    SELECT 'arrival_text' AS "column", round(avg(CAST(TRY_CAST(trim(arrival_text) AS FLOAT) IS NULL AS INT)), 6) AS nan_rate, 1.0::DOUBLE AS nan_rate_before FROM feed
    UNION ALL SELECT 'visibility', round(avg(CAST(visibility IS NULL AS INT)), 6), round(avg(CAST(visibility IS NULL AS INT)), 6) FROM feed""", "feed")
def p17_log(t: Tables):
    out = parse.coercion_log(t.feed, ["arrival_text", "visibility"])
    return out.select("column", C.r6("nan_rate").alias("nan_rate"), C.r6("nan_rate_before").alias("nan_rate_before"))


@query("p18_normalise_codes", """
    SELECT seq, upper(trim(code_text)) AS station_code, 'OTHER' AS train_type, CAST(user_id AS DOUBLE) AS train_number FROM feed""", "feed")
def p18(t: Tables):
    raw = t.feed.select("seq", F.col("code_text").alias("stationShortCode"), F.col("user_id").cast("string").alias("train_number"))
    return parse.normalise_codes(raw).select("seq", "station_code", "train_type", "train_number")


@query("p19_decimal_comma", "SELECT seq, CAST(replace(distance_text, ',', '.') AS DOUBLE) AS km FROM feed", "feed")
def p19(t: Tables):
    return t.feed.select("seq", C.decimal_comma("distance_text").alias("km"))


@query("p20_duration_digits", "SELECT seq, CAST(regexp_replace(duration_text, '[^0-9]', '', 'g') AS DOUBLE) AS minutes FROM feed", "feed")
def p20(t: Tables):
    return t.feed.select("seq", C.digits_only("duration_text").alias("minutes"))


@query("p21_duration_first_number", "SELECT seq, k::DOUBLE AS minutes FROM feed", "feed")
def p21(t: Tables):
    return t.feed.select("seq", C.first_number("duration_text").alias("minutes"))


@query("p22_slash_date", "SELECT seq, CASE WHEN seq % 25 <> 0 THEN CAST(date AS VARCHAR) END AS day FROM feed", "feed")
def p22(t: Tables):
    return t.feed.select("seq", C.slash_date("slash_text").cast("string").alias("day"))


@query("p23_code_list", """
    SELECT seq, upper(trim(c)) AS station_code FROM (SELECT seq, unnest(string_split(codes_text, ',')) AS c FROM feed)""", "feed")
def p23(t: Tables):
    return B.explode_codes(t.feed.select("seq", "codes_text"), "codes_text").select("seq", "station_code")


@query("p24_fault_description", """
    SELECT seq, coalesce(weather_text, 'nan') || ' | ' || repeat(coalesce(type_text, 'nan'), 40) AS description FROM feed""", "feed")
def p24(t: Tables):
    return t.feed.select("seq", C.fault_description("weather_text", F.repeat("type_text", 40)).alias("description"))


@query("p25_cause_group", "SELECT fault_id, cause_group FROM faults WHERE cause_group <> ''", "faults")
def p25(t: Tables):
    out = t.faults.select("fault_id", C.cause_group("description").alias("cause_group"))
    return out.where("cause_group <> ''")


@query("p26_identifiers", """
    SELECT seq, 'IT_' || replace(upper(trim(code_text)), ' ', '_') AS station_id, 'FI_' || user_id || '_' || strftime(date, '%Y-%m-%d') AS service_id FROM feed""", "feed")
def p26(t: Tables):
    return t.feed.select("seq", C.prefixed_id("IT", C.code("code_text")).alias("station_id"), C.prefixed_id("FI", "user_id", "date").alias("service_id"))


@query("p27_country", "SELECT seq, country FROM stops")
def p27(t: Tables):
    return t.stops.select("seq", C.country_of("station_id").alias("country"))


@query("p28_train_key", "SELECT seq, country || '_' || user_id AS train_key FROM stops")
def p28(t: Tables):
    return t.stops.select("seq", C.train_key("service_id", "country").alias("train_key"))


@query("p29_stop_label", "SELECT seq, y_stop FROM stops")
def p29(t: Tables):
    return t.stops.select("seq", C.late("delay_minutes", "cancelled").alias("y_stop"))


@query("p30_feature_projection", """
    SELECT seq, stop_order, n_total_stops, weather_severity, train_class_code FROM positioned""", "positioned")
def p30(t: Tables):
    df = t.positioned.select("seq", "stop_order", "n_total_stops", "weather_severity", "train_class_code", "y_stop", "delay_min",
                             "delay_minutes", "cancelled", F.lit(0.0).alias("prev_stop_actual_delay"), F.lit(1).alias("_meta_run"))
    return df.select(*guards.legal_columns(df.columns, "A"))


P31_COLUMNS = ["station_id", "stop_order", "y_stop", "delay_min", "prev_stop_actual_delay"]


@query("p31_leakage_check", """
    WITH c AS (SELECT unnest(['station_id', 'stop_order', 'y_stop', 'delay_min', 'prev_stop_actual_delay']) AS "column"), s AS (SELECT unnest(['A', 'B']) AS scenario),
    v AS (SELECT count(DISTINCT station_id) AS station_id, count(DISTINCT stop_order) AS stop_order, count(DISTINCT y_stop) AS y_stop, count(DISTINCT delay_min) AS delay_min, count(DISTINCT prev) AS prev_stop_actual_delay
          FROM (SELECT *, lag(coalesce(delay_minutes, 0), 1, 0) OVER (PARTITION BY service_id ORDER BY scheduled_time, seq) AS prev FROM positioned)),
    n AS (UNPIVOT v ON COLUMNS(*) INTO NAME "column" VALUE n_values)
    SELECT scenario, "column", ("column" IN ('y_stop', 'delay_min') OR ("column" = 'prev_stop_actual_delay' AND scenario = 'A')) AS leaks, n_values FROM c CROSS JOIN s JOIN n USING ("column")""", "positioned")
def p31(t: Tables):
    return guards.leak_report(feat.inflight(t.positioned).select(*P31_COLUMNS), ("A", "B"))


@query("p32_numeric_columns", "SELECT seq, k, temperature, user_id FROM stops")
def p32(t: Tables):
    df = t.stops.select("seq", "service_id", "date", "k", "temperature", "user_id", "cancelled")
    return df.select(*guards.numeric_columns(df))


@query("p33_weather_defaults", """
    SELECT s.seq, coalesce(w.temperature, 10.0)::DOUBLE AS temperature, coalesce(w.wind_speed, 2.0)::DOUBLE AS wind_speed,
           coalesce(w.precipitation, 0.0)::DOUBLE AS precipitation, coalesce(w.snow_depth, 0.0)::DOUBLE AS snow_depth,
           CAST(w.day IS NOT NULL AS INTEGER) AS weather_observed FROM stops s
    LEFT JOIN (SELECT station_id AS st, date AS day, arg_min(temperature, seq) AS temperature, arg_min(wind_speed, seq) AS wind_speed,
                 arg_min(precipitation, seq) FILTER (precipitation IS NOT NULL OR true) AS p0, min_by(struct_pack(p := precipitation), seq).p AS precipitation,
                 min_by(struct_pack(p := snow_depth), seq).p AS snow_depth FROM stops GROUP BY 1, 2) w
      ON w.st = s.station_id AND w.day = s.date""")
def p33(t: Tables):
    rows = t.stops.withColumn("station_code", F.col("station_id"))
    weather = B.weather_by_station(rows)
    stops = t.stops.withColumn("station_code", F.col("station_id"))
    return B.join_weather(stops, weather).select("seq", "temperature", "wind_speed", "precipitation", "snow_depth", "weather_observed")


@query("p34_geo_filter", """
    SELECT station_id, round(lat, 4) AS lat, round(lon, 4) AS lon,
      CAST(CASE country WHEN 'IT' THEN round(lat, 4) BETWEEN 35.0 AND 47.5 AND round(lon, 4) BETWEEN 6.0 AND 19.0
           WHEN 'FI' THEN round(lat, 4) BETWEEN 59.5 AND 70.5 AND round(lon, 4) BETWEEN 19.0 AND 32.0
           ELSE round(lat, 4) BETWEEN 50.5 AND 53.7 AND round(lon, 4) BETWEEN 3.0 AND 7.5 END AS INTEGER) AS domestic
    FROM (SELECT station_id, country, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 0 WHEN k % 23 = 0 THEN 89 ELSE lat END AS lat,
                 CASE WHEN k % 19 = 0 THEN 0 ELSE lon END AS lon FROM stations)
    WHERE lat BETWEEN 30 AND 75 AND lon BETWEEN -15 AND 40 AND NOT (lat = 0 AND lon = 0)""", "stations")
def p34(t: Tables):
    from stopflow.plans.dashboard import stations_on_map

    k = F.col("k")
    odd = t.stations.withColumns({
        "lat": F.when(k % 17 == 0, None).when(k % 19 == 0, 0.0).when(k % 23 == 0, 89.0).otherwise(F.col("lat")),
        "lon": F.when(k % 19 == 0, 0.0).otherwise(F.col("lon"))})
    return stations_on_map(odd).select("station_id", "lat", "lon", "domestic")


@query("p35_dashboard_filter", """
    SELECT seq, CASE WHEN p_b < 0.25 THEN 'low' WHEN p_b < 0.5 THEN 'mid_low' WHEN p_b < 0.75 THEN 'mid_high' ELSE 'high' END AS band,
      CAST(y_stop = 1 AND yp_b = 1 AND p_b > 0.95 AS INTEGER) AS is_tp, CAST(y_stop = 0 AND yp_b = 1 AND p_b > 0.7 AS INTEGER) AS is_fp,
      CAST(y_stop = 1 AND yp_b = 0 AND coalesce(delay_min > 30, false) AS INTEGER) AS is_fn, CAST(abs(p_b - p_a) > 0.4 AS INTEGER) AS is_flip
    FROM predictions WHERE country = 'IT' AND contains(service_id, '1') AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""", "predictions")
def p35(t: Tables):
    from stopflow.plans.dashboard import case_flags, filter_predictions

    rows = filter_predictions(t.predictions, country="IT", service="1", first="2024-01-10", last="2024-01-20")
    return case_flags(rows).select("seq", "band", "is_tp", "is_fp", "is_fn", "is_flip")


@query("p36_position_category", """
    SELECT seq, CASE WHEN is_origin = 1 THEN 'origin' WHEN is_terminus = 1 THEN 'terminus' WHEN position_norm < 0.25 THEN 'early'
      WHEN position_norm < 0.75 THEN 'mid' ELSE 'late' END AS category FROM positioned""", "positioned")
def p36(t: Tables):
    return t.positioned.select("seq", C.position_category("is_origin", "is_terminus", "position_norm").alias("category"))


@query("p37_delay_delta", "SELECT seq, TRY_CAST(trim(departure_text) AS DOUBLE) - TRY_CAST(trim(arrival_text) AS DOUBLE) AS delta FROM feed", "feed")
def p37(t: Tables):
    return t.feed.select("seq", (C.delay_value("departure_text") - C.delay_value("arrival_text")).alias("delta"))


@query("p38_finite_values", """
    SELECT seq, CASE WHEN seq % 7 = 0 OR seq % 11 = 0 OR delay_minutes IS NULL THEN 0 ELSE delay_minutes END AS value FROM stops""")
def p38(t: Tables):
    s = F.col("seq")
    dirty = F.when(s % 7 == 0, F.lit(float("nan"))).when(s % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("delay_minutes"))
    return t.stops.select("seq", C.finite_or_zero(dirty).alias("value"))


@query("p39_name_lookup", """
    WITH wanted(name) AS (VALUES ('ST 7'), ('ST 7 NORD'), ('ST9'), ('9 X')),
    names AS (SELECT DISTINCT 'ST ' || k AS station_name, k::DOUBLE AS lat FROM stops)
    SELECT w.name, coalesce(e.station_name, (SELECT min(n.station_name) FROM names n WHERE contains(n.station_name, split_part(w.name, ' ', 1)))) AS station_name
    FROM wanted w LEFT JOIN names e ON e.station_name = w.name""")
def p39(t: Tables):
    from stopflow.operators.relate import lookup_name

    names = t.stops.select(F.concat(F.lit("ST "), "k").alias("station_name"), F.col("k").cast("double").alias("lat")).distinct()
    out = lookup_name(names, "station_name", ["ST 7", "ST 7 NORD", "ST9", "9 X"], ["lat"], key="name")
    return out.select("name", "station_name")


@query("p40_outcome_tag", """
    SELECT seq, CASE WHEN y_stop = yp_b THEN CASE WHEN y_stop = 1 THEN 'hit' ELSE 'quiet' END WHEN yp_b = 1 THEN 'false alarm' ELSE 'miss' END AS outcome,
      CAST(abs((p_b - p_a) * 100) > 30 AS INTEGER) AS shifted, CASE WHEN abs((p_b - p_a) * 100) > 30 THEN CASE WHEN p_b > p_a THEN 'up' ELSE 'down' END END AS direction
    FROM predictions""", "predictions")
def p40(t: Tables):
    from stopflow.plans.dashboard import outcome

    return outcome(t.predictions).select("seq", "outcome", "shifted", "direction")


# -- imputation -------------------------------------------------------------------

@query("i1_zero_fill", "SELECT seq, coalesce(precipitation, 0) AS precipitation, coalesce(snow_depth, 0) AS snow_depth FROM stops")
def i1(t: Tables):
    return impute.zero_fill(t.stops, ["precipitation", "snow_depth"]).select("seq", "precipitation", "snow_depth")


@query("i1_fill_log", """
    SELECT 'precipitation' AS "column", count(*) FILTER (WHERE precipitation IS NULL) AS n_imputed, 'zero_fill' AS strategy FROM stops
    UNION ALL SELECT 'snow_depth', count(*) FILTER (WHERE snow_depth IS NULL), 'zero_fill' FROM stops""")
def i1_log(t: Tables):
    return impute.missing_log(t.stops, ["precipitation", "snow_depth"], "zero_fill")


@query("i2_monthly_median", """
    WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 9 <> 0 AND month(o_orderdate) <> 11 THEN o_totalprice END AS price FROM orders),
    tr AS (SELECT * FROM o WHERE o_orderdate <= TIMESTAMP '1997-06-30'),
    m AS (SELECT month(o_orderdate) AS m, median(price) AS med FROM tr GROUP BY 1)
    SELECT o_orderkey, round(coalesce(price, m.med, (SELECT median(price) FROM tr)), 4) AS price FROM o LEFT JOIN m ON m.m = month(o.o_orderdate)""", "")
def i2(t: Tables):
    o = t.raw("orders").select("o_orderkey", "o_orderdate", F.when(
        (F.col("o_orderkey") % 9 != 0) & (F.month("o_orderdate") != 11), F.col("o_totalprice")).alias("price"))
    out = impute.monthly_median_fill(o, ["price"], "o_orderdate", train_end="1997-06-30")
    return out.select("o_orderkey", F.round("price", 4).alias("price"))


@query("i2_monthly_median_log", f"""
    SELECT 'precipitation' AS "column", count(*) FILTER (WHERE precipitation IS NULL) AS n_imputed, 'monthly_median_train_only' AS strategy,
      round(median(precipitation) FILTER (WHERE date <= DATE '{EVENT_TRAIN_END}'), 6) AS global_median_train FROM stops""")
def i2_log(t: Tables):
    out = impute.monthly_median_log(t.stops, ["precipitation"], "date", EVENT_TRAIN_END)
    return out.withColumn("global_median_train", C.r6("global_median_train"))


@query("i3_seasonal_median", """
    WITH o AS (SELECT o_orderkey, month(o_orderdate) AS m, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price FROM orders)
    SELECT o_orderkey, round(coalesce(price, median(price) OVER (PARTITION BY m)), 4) AS price FROM o""", "")
def i3(t: Tables):
    o = t.raw("orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"))
    return impute.monthly_median_fill(o, ["price"], "o_orderdate", train_end=None).select("o_orderkey", F.round("price", 4).alias("price"))


@query("i4_cross_fill", "SELECT seq, coalesce(snow_depth, temperature) AS snow_depth FROM stops")
def i4(t: Tables):
    return impute.cross_fill(t.stops, "snow_depth", "temperature").select("seq", "snow_depth")


@query("i5_global_median", "SELECT seq, round(coalesce(precipitation, (SELECT median(precipitation) FROM stops)), 6) AS precipitation FROM stops")
def i5(t: Tables):
    return impute.median_fill(t.stops, "precipitation").select("seq", C.r6("precipitation").alias("precipitation"))


@query("i6_drop_missing_target", "SELECT seq, delay_minutes FROM stops WHERE delay_minutes IS NOT NULL")
def i6(t: Tables):
    return impute.drop_missing(t.stops, ["delay_minutes"]).select("seq", "delay_minutes")


@query("i7_train_medians", f"""
    WITH m AS (SELECT median(delay_minutes) AS d, median(precipitation) AS p FROM stops WHERE date <= DATE '{EVENT_TRAIN_END}')
    SELECT seq, round(coalesce(delay_minutes, m.d), 6) AS delay_minutes, round(coalesce(precipitation, m.p), 6) AS precipitation,
           0.0::DOUBLE AS never_measured FROM stops, m""")
def i7(t: Tables):
    names = ["delay_minutes", "precipitation", "never_measured"]
    df = t.stops.withColumn("never_measured", F.lit(None).cast("double"))
    med = impute.train_medians(df.where(F.col("date") <= EVENT_TRAIN_END), names)
    out = impute.apply_medians(df, med, names)
    return out.select("seq", *[C.r6(n).alias(n) for n in names])


