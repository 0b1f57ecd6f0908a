"""Feature queries (position, calendar, network, history, inflight)."""

from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators import features as feat
from stopflow.operators import graph as G
from stopflow.plans.adapter import EVENT_SPLITS, Tables
from stopflow.plans.catalog.graph import betweenness_sql
from stopflow.plans.registry import query

W = "WINDOW w AS (PARTITION BY service_id ORDER BY scheduled_time, seq)"


def _r6(df, *names):
    return df.withColumns({n: C.r6(n) for n in names})


@query("f1_stop_position", f"""
    SELECT seq, CAST(row_number() OVER w - 1 AS INTEGER) AS stop_order,
           CAST(count(*) OVER p AS INTEGER) AS n_total_stops,
           round((row_number() OVER w - 1)::DOUBLE / greatest(count(*) OVER p - 1, 1), 6) AS position_norm,
           CAST(row_number() OVER w = 1 AS INTEGER) AS is_origin,
           CAST(row_number() OVER w = count(*) OVER p AS INTEGER) AS is_terminus,
           round(coalesce((epoch_us(scheduled_time) - epoch_us(min(scheduled_time) OVER p)) / 6e7, 0), 2) AS cum_scheduled_minutes
    FROM stops WINDOW w AS (PARTITION BY service_id ORDER BY scheduled_time, seq), p AS (PARTITION BY service_id)""")
def f1(t: Tables):
    out = feat.stop_position(t.labelled).select(
        "seq", "stop_order", "n_total_stops", "position_norm", "is_origin", "is_terminus", "cum_scheduled_minutes")
    return _r6(out, "position_norm").withColumn("cum_scheduled_minutes", F.round("cum_scheduled_minutes", 2))


@query("f2_stop_calendar", """
    SELECT seq, CAST(coalesce(hour(scheduled_time), 12) AS INTEGER) AS scheduled_arrival_hour,
           CAST(isodow(date) - 1 AS INTEGER) AS scheduled_arrival_dow, CAST(month(date) AS INTEGER) AS month,
           CAST(strftime(date, '%Y-%m-%d') IN ('2024-01-01', '2024-03-29', '2024-04-01', '2024-04-25', '2024-05-01',
                '2024-05-09', '2024-05-12', '2024-05-17', '2024-05-20', '2024-06-21') AS INTEGER) AS is_holiday,
           round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos
    FROM stops""")
def f2(t: Tables):
    out = feat.stop_time(t.stops).select(
        "seq", "scheduled_arrival_hour", "scheduled_arrival_dow", "month", "is_holiday", "month_sin", "month_cos")
    return _r6(out, "month_sin", "month_cos")


@query("f3_station_static", """
    SELECT s.seq, round(coalesce(n.lat, 0), 6) AS lat, round(coalesce(n.lon, 0), 6) AS lon,
           coalesce(n.degree, 0)::DOUBLE AS degree, round(coalesce(n.avg_historical_delay, 0), 6) AS avg_historical_delay
    FROM stops s LEFT JOIN (SELECT * FROM stations) n USING (station_id)""", "stops stations")
def f3(t: Tables):
    out = feat.station_static(t.stops, t.stations)
    return _r6(out.select("seq", "lat", "lon", "degree", "avg_historical_delay"), "lat", "lon", "avg_historical_delay")


ROUTE_SQL = """
    WITH hop AS (SELECT *, lag(station_id) OVER w AS prev_station FROM stops
                 WINDOW w AS (PARTITION BY service_id ORDER BY scheduled_time, seq)),
         seg AS (SELECT h.*, coalesce(e.distance_km, 0) AS km FROM hop h
                 LEFT JOIN edges e ON e.station_from = h.prev_station AND e.station_to = h.station_id)"""


@query("f4_service_identity", ROUTE_SQL + """
    SELECT seq, train_class_code, country, CAST(count(*) OVER p AS INTEGER) AS service_n_stops,
           round((epoch_us(max(scheduled_time) OVER p) - epoch_us(min(scheduled_time) OVER p)) / 6e7, 2) AS service_scheduled_duration_min,
           round(sum(km) OVER w, 6) AS cum_distance_km, round(sum(km) OVER p, 6) AS service_route_distance_km
    FROM seg WINDOW w AS (PARTITION BY service_id ORDER BY scheduled_time, seq), p AS (PARTITION BY service_id)""",
       "stops edges")
def f4(t: Tables):
    out = feat.service_identity(t.stops.drop("train_class_code"), t.services, t.edges)
    return _r6(out.select("seq", "train_class_code", "country", "service_n_stops", "service_scheduled_duration_min",
                          "cum_distance_km", "service_route_distance_km"),
               "cum_distance_km", "service_route_distance_km").withColumn(
        "service_scheduled_duration_min", F.round("service_scheduled_duration_min", 2))


@query("f5_weather_delta", f"""
    SELECT seq, coalesce(weather_severity - lag(weather_severity) OVER w, 0)::DOUBLE AS delta_severity_vs_prev_stop,
           coalesce(wind_speed - lag(wind_speed) OVER w, 0)::DOUBLE AS delta_wind_vs_prev_stop
    FROM stops {W}""")
def f5(t: Tables):
    return feat.weather_delta(t.stops).select("seq", "delta_severity_vs_prev_stop", "delta_wind_vs_prev_stop")


DAILY_SQL = """daily AS (SELECT station_id, date, avg(y_stop) AS rate, avg(delay_minutes) AS mean_delay FROM {src} GROUP BY ALL)"""
LAG_SQL = """lags AS (SELECT d.station_id, d.date,
             coalesce((SELECT avg(p.rate) FROM daily p WHERE p.station_id = d.station_id AND p.date = d.date - 1), 0) AS station_lag1_rate,
             coalesce((SELECT avg(p.rate) FROM daily p WHERE p.station_id = d.station_id AND p.date BETWEEN d.date - 7 AND d.date - 1), 0) AS station_lag7_rate,
             coalesce((SELECT avg(p.mean_delay) FROM daily p WHERE p.station_id = d.station_id AND p.date = d.date - 1), 0) AS station_lag1_avg_delay
             FROM daily d)"""


@query("f6_station_lag", f"""
    WITH {DAILY_SQL.format(src='stops')}, {LAG_SQL}
    SELECT s.seq, round(station_lag1_rate, 6) AS station_lag1_rate, round(station_lag7_rate, 6) AS station_lag7_rate,
           round(station_lag1_avg_delay, 6) AS station_lag1_avg_delay
    FROM stops s JOIN lags USING (station_id, date)""")
def f6(t: Tables):
    lags = feat.station_lag(feat.daily_rates(t.stops, ["station_id"]))
    out = feat.attach(t.stops.select("seq", "station_id", "date"), lags, ["station_id", "date"])
    names = ["station_lag1_rate", "station_lag7_rate", "station_lag1_avg_delay"]
    return _r6(out.select("seq", *names), *names)


@query("f6_station_lag_volume", f"""
    WITH daily AS (SELECT station_id, date, avg(y_stop) AS rate, avg(delay_minutes) AS mean_delay FROM li GROUP BY ALL),
    lags AS (SELECT station_id, date,
             coalesce(avg(rate) OVER (PARTITION BY station_id ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS l1,
             coalesce(avg(rate) OVER (PARTITION BY station_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS l7
             FROM daily)
    SELECT station_id, count(*) AS n_stops, round(avg(l1), 6) AS mean_lag1, round(avg(l7), 6) AS mean_lag7
    FROM li JOIN lags USING (station_id, date) GROUP BY station_id""", "li")
def f6_volume(t: Tables):
    stops = t.lineitem_stops
    lags = feat.station_lag(feat.daily_rates(stops, ["station_id"]))
    out = feat.attach(stops.select("station_id", "date"), lags, ["station_id", "date"])
    return out.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_stops"), C.r6(F.avg("station_lag1_rate")).alias("mean_lag1"),
        C.r6(F.avg("station_lag7_rate")).alias("mean_lag7"))


@query("f7_train_lag", """
    WITH s AS (SELECT *, country || '_' || regexp_replace(regexp_replace(service_id, '^[A-Z]{2}_', ''), '_\\d{4}-\\d{2}-\\d{2}$', '') AS train_key FROM stops),
    daily AS (SELECT train_key, date, avg(y_stop) AS rate FROM s GROUP BY ALL),
    lags AS (SELECT train_key, date,
             coalesce(avg(rate) OVER (PARTITION BY train_key ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS l1,
             coalesce(avg(rate) OVER (PARTITION BY train_key ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS l7
             FROM daily)
    SELECT seq, train_key, round(l1, 6) AS train_lag1_rate, round(l7, 6) AS train_lag7_rate FROM s JOIN lags USING (train_key, date)""")
def f7(t: Tables):
    stops = t.stops.withColumn("train_key", C.train_key("service_id", "country"))
    lags = feat.train_lag(feat.daily_rates(stops, ["train_key"]))
    out = feat.attach(stops.select("seq", "train_key", "date"), lags, ["train_key", "date"])
    return _r6(out.select("seq", "train_key", "train_lag1_rate", "train_lag7_rate"), "train_lag1_rate", "train_lag7_rate")


@query("f8_train_station_lag", """
    WITH s AS (SELECT *, country || '_' || user_id AS train_key FROM stops),
    daily AS (SELECT train_key, station_id, date, avg(y_stop) AS rate FROM s GROUP BY ALL),
    lags AS (SELECT train_key, station_id, date,
             coalesce(avg(rate) OVER (PARTITION BY train_key, station_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS l7 FROM daily)
    SELECT seq, round(l7, 6) AS train_station_lag7_rate FROM s JOIN lags USING (train_key, station_id, date)""")
def f8(t: Tables):
    keys = ["train_key", "station_id"]
    stops = t.stops.withColumn("train_key", C.train_key("service_id", "country"))
    lags = feat.train_station_lag(feat.daily_rates(stops, keys))
    out = feat.attach(stops.select("seq", *keys, "date"), lags, [*keys, "date"])
    return _r6(out.select("seq", "train_station_lag7_rate"), "train_station_lag7_rate")


@query("f9_neighbour_signal", f"""
    WITH {DAILY_SQL.format(src='stops')}, {LAG_SQL},
    nbr AS (SELECT e.station_from AS station_id, l.date, avg(l.station_lag1_rate) AS v
            FROM edges e JOIN lags l ON l.station_id = e.station_to GROUP BY ALL)
    SELECT seq, round(coalesce(v, 0) + 1e-9, 6) AS nbr_lag1_rate FROM stops LEFT JOIN nbr USING (station_id, date)""", "stops edges")
def f9(t: Tables):
    lags = feat.station_lag(feat.daily_rates(t.stops, ["station_id"]))
    out = feat.attach(t.stops.select("seq", "station_id", "date"), feat.neighbour_lag(lags, t.edges), ["station_id", "date"])
    return out.select("seq", C.r6(F.col("nbr_lag1_rate") + 1e-9).alias("nbr_lag1_rate"))


@query("f10_fault_context", """
    WITH per_day AS (SELECT station_id, date, count(*) AS n FROM faults GROUP BY ALL),
    days AS (SELECT DISTINCT station_id, date FROM stops),
    counted AS (SELECT d.station_id, d.date, coalesce(sum(p.n), 0)::DOUBLE AS v FROM days d
                LEFT JOIN per_day p ON p.station_id = d.station_id AND p.date BETWEEN d.date - 14 AND d.date - 1 GROUP BY ALL)
    SELECT seq, v AS station_n_active_faults_14d FROM stops JOIN counted USING (station_id, date)""", "stops faults")
def f10(t: Tables):
    days = feat.daily_rates(t.stops, ["station_id"])
    out = feat.attach(t.stops.select("seq", "station_id", "date"), feat.fault_count(days, t.faults), ["station_id", "date"])
    return out.select("seq", "station_n_active_faults_14d")


INFLIGHT_SQL = """
           round(coalesce(lag(d) OVER w, 0), 6) AS prev_stop_actual_delay,
           round(coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS cum_actual_delay_so_far,
           round(greatest(0, coalesce(max(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS max_actual_delay_so_far"""


@query("f11_inflight", f"""
    SELECT seq, {INFLIGHT_SQL} FROM (SELECT *, coalesce(delay_minutes, 0) AS d FROM stops) {W}""")
def f11(t: Tables):
    names = ["prev_stop_actual_delay", "cum_actual_delay_so_far", "max_actual_delay_so_far"]
    return _r6(feat.inflight(t.stops).select("seq", *names), *names)


@query("f11_inflight_volume", """
    SELECT service_id, round(sum(prev), 4) AS sum_prev, round(sum(cum), 4) AS sum_cum, round(max(peak), 4) AS top_peak FROM (
      SELECT service_id, coalesce(lag(delay_minutes) OVER w, 0) AS prev,
             coalesce(sum(delay_minutes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
             greatest(0, coalesce(max(delay_minutes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS peak
      FROM li WINDOW w AS (PARTITION BY service_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))
    GROUP BY service_id""", "li")
def f11_volume(t: Tables):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    out = feat.inflight(t.lineitem_stops, order=order)
    return out.groupBy("service_id").agg(
        F.round(F.sum("prev_stop_actual_delay"), 4).alias("sum_prev"),
        F.round(F.sum("cum_actual_delay_so_far"), 4).alias("sum_cum"),
        F.round(F.max("max_actual_delay_so_far"), 4).alias("top_peak"))


ASSEMBLED = ["y_stop", "weather_severity", "train_class_code", "service_n_stops", "service_route_distance_km",
             "service_scheduled_duration_min", "stop_order", "n_total_stops", "position_norm", "is_origin",
             "is_terminus", "cum_scheduled_minutes", "cum_distance_km", "scheduled_arrival_hour",
             "scheduled_arrival_dow", "month", "is_holiday", "lat", "lon", "degree", "avg_historical_delay",
             "delta_severity_vs_prev_stop", "delta_wind_vs_prev_stop", "station_lag1_rate", "station_lag7_rate",
             "station_lag1_avg_delay", "train_lag1_rate", "train_lag7_rate", "train_station_lag7_rate",
             "nbr_lag1_rate", "station_n_active_faults_14d", "prev_stop_actual_delay", "cum_actual_delay_so_far",
             "max_actual_delay_so_far", "temperature", "wind_speed", "precipitation", "snow_depth", "month_sin", "month_cos", "betweenness_centrality"]


def feature_store(t: Tables):
    """All features, from standard tables that are written first."""
    t = t.landed()
    return feat.assemble(t.labelled, t.services, t.stations, t.edges, t.faults, G.betweenness(t.edges, t.stations))


@query("f12_feature_assembly", ROUTE_SQL + """,
    s AS (SELECT *, country || '_' || user_id AS train_key, coalesce(delay_minutes, 0) AS d FROM seg),
    sd AS (SELECT station_id, date, avg(y_stop) AS rate, avg(delay_minutes) AS md FROM stops GROUP BY ALL),
    sl AS (SELECT station_id, date, coalesce(avg(rate) OVER a, 0) AS l1, coalesce(avg(rate) OVER b, 0) AS l7, coalesce(avg(md) OVER a, 0) AS ld
           FROM sd WINDOW a AS (PARTITION BY station_id ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
                          b AS (PARTITION BY station_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
    td AS (SELECT train_key, date, avg(y_stop) AS rate FROM s GROUP BY ALL),
    tl AS (SELECT train_key, date, coalesce(avg(rate) OVER a, 0) AS l1, coalesce(avg(rate) OVER b, 0) AS l7
           FROM td WINDOW a AS (PARTITION BY train_key ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
                          b AS (PARTITION BY train_key ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
    xd AS (SELECT train_key, station_id, date, avg(y_stop) AS rate FROM s GROUP BY ALL),
    xl AS (SELECT train_key, station_id, date, coalesce(avg(rate) OVER (PARTITION BY train_key, station_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS l7 FROM xd),
    nb AS (SELECT e.station_from AS station_id, sl.date, avg(sl.l1) AS v FROM edges e JOIN sl ON sl.station_id = e.station_to GROUP BY ALL),
    bt AS MATERIALIZED (""" + betweenness_sql() + """),
    fd AS (SELECT station_id, date, count(*) AS n FROM faults GROUP BY ALL),
    fc AS (SELECT sd.station_id, sd.date, coalesce(sum(fd.n), 0) AS n FROM sd LEFT JOIN fd ON fd.station_id = sd.station_id AND fd.date BETWEEN sd.date - 14 AND sd.date - 1 GROUP BY ALL)
    SELECT s.seq, s.y_stop, s.weather_severity, s.train_class_code, count(*) OVER p::DOUBLE AS service_n_stops,
      round(sum(km) OVER p, 6) AS service_route_distance_km,
      round((epoch_us(max(scheduled_time) OVER p) - epoch_us(min(scheduled_time) OVER p)) / 6e7, 2) AS service_scheduled_duration_min,
      CAST(row_number() OVER w - 1 AS INTEGER) AS stop_order, CAST(count(*) OVER p AS INTEGER) AS n_total_stops,
      round((row_number() OVER w - 1)::DOUBLE / greatest(count(*) OVER p - 1, 1), 6) AS position_norm,
      CAST(row_number() OVER w = 1 AS INTEGER) AS is_origin, CAST(row_number() OVER w = count(*) OVER p AS INTEGER) AS is_terminus,
      round((epoch_us(scheduled_time) - epoch_us(min(scheduled_time) OVER p)) / 6e7, 2) AS cum_scheduled_minutes,
      round(sum(km) OVER w, 6) AS cum_distance_km,
      CAST(hour(scheduled_time) AS INTEGER) AS scheduled_arrival_hour, CAST(isodow(s.date) - 1 AS INTEGER) AS scheduled_arrival_dow,
      CAST(month(s.date) AS INTEGER) AS month, CAST(s.date = DATE '2024-01-01' AS INTEGER) AS is_holiday,
      round(n.lat, 6) AS lat, round(n.lon, 6) AS lon, n.degree::DOUBLE AS degree, round(n.avg_historical_delay, 6) AS avg_historical_delay,
      coalesce(weather_severity - lag(weather_severity) OVER w, 0)::DOUBLE AS delta_severity_vs_prev_stop,
      coalesce(wind_speed - lag(wind_speed) OVER w, 0)::DOUBLE AS delta_wind_vs_prev_stop,
      round(sl.l1, 6) AS station_lag1_rate, round(sl.l7, 6) AS station_lag7_rate, round(sl.ld, 6) AS station_lag1_avg_delay,
      round(tl.l1, 6) AS train_lag1_rate, round(tl.l7, 6) AS train_lag7_rate, round(xl.l7, 6) AS train_station_lag7_rate,
      round(coalesce(nb.v, 0) + 1e-9, 6) AS nbr_lag1_rate, fc.n::DOUBLE AS station_n_active_faults_14d, temperature::DOUBLE AS temperature, wind_speed::DOUBLE AS wind_speed,
      round(precipitation, 6) AS precipitation, snow_depth::DOUBLE AS snow_depth,
      round(bt.betweenness_centrality, 6) AS betweenness_centrality, round(sin(2 * pi() * month(s.date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(s.date) / 12), 6) AS month_cos, """ + INFLIGHT_SQL + """
    FROM s JOIN stations n ON n.station_id = s.station_id JOIN bt ON bt.station_id = s.station_id JOIN sl ON sl.station_id = s.station_id AND sl.date = s.date
      JOIN tl ON tl.train_key = s.train_key AND tl.date = s.date
      JOIN xl ON xl.train_key = s.train_key AND xl.station_id = s.station_id AND xl.date = s.date
      LEFT JOIN nb ON nb.station_id = s.station_id AND nb.date = s.date JOIN fc ON fc.station_id = s.station_id AND fc.date = s.date
    WINDOW w AS (PARTITION BY service_id ORDER BY scheduled_time, seq), p AS (PARTITION BY service_id)""",
       "stops edges stations faults")
def f12(t: Tables):
    out = feature_store(t)
    doubles = {f.name for f in out.schema if f.dataType.simpleString() == "double"}
    out = out.withColumn("nbr_lag1_rate", F.col("nbr_lag1_rate") + 1e-9)
    return out.select("seq", *[F.round(c, 2 if "minute" in c or "duration" in c else 6).alias(c) if c in doubles else F.col(c)
                               for c in ASSEMBLED])


@query("f13_cause_features", """
    SELECT seq, CAST(h BETWEEN 6 AND 9 AS INTEGER) AS is_peak_morning, CAST(h BETWEEN 16 AND 19 AS INTEGER) AS is_peak_evening,
      CAST(h >= 22 OR h <= 4 AS INTEGER) AS is_off_peak, CAST(w >= 5 AS INTEGER) AS is_weekend, CAST(w = 0 AS INTEGER) AS is_monday,
      CAST(w = 4 AS INTEGER) AS is_friday, CAST(m = 12 OR m <= 2 AS INTEGER) AS is_winter, CAST(m BETWEEN 3 AND 5 AS INTEGER) AS is_spring,
      CAST(m BETWEEN 6 AND 8 AS INTEGER) AS is_summer, round(ln(1 + greatest(d, 0)), 6) AS delay_log, CAST(d > 30 AS INTEGER) AS delay_severe,
      CAST(d > 60 AS INTEGER) AS delay_extreme, CAST(p > 10 AS INTEGER) AS cascade_strong, CAST(p > 30 AS INTEGER) AS cascade_severe,
      round(ln(1 + greatest(c, 0)), 6) AS cum_delay_log, CAST(weather_severity >= 3 AS INTEGER) AS weather_severe,
      CAST(weather_severity = 4 AS INTEGER) AS weather_extreme, CAST(coalesce(snow_depth, 0) >= 15 AS INTEGER) AS heavy_snow,
      CAST((m = 12 OR m <= 2) AND weather_severity >= 3 AS INTEGER) AS winter_x_severe_weather,
      round(ln(1 + greatest(d, 0)) * pos, 6) AS delay_x_position, CAST(train_class_code = 0 AS INTEGER) AS is_local,
      CAST(train_class_code >= 4 AS INTEGER) AS is_highspeed, round(ln(1 + degree), 6) AS degree_log
    FROM (SELECT s.*, n.degree, hour(scheduled_time) AS h, isodow(date) - 1 AS w, month(date) AS m, coalesce(delay_minutes, 0) AS d,
            coalesce(lag(delay_minutes) OVER w1, 0) AS p,
            coalesce(sum(coalesce(delay_minutes, 0)) OVER (w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
            (row_number() OVER w1 - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY service_id) - 1, 1) AS pos
          FROM stops s JOIN stations n USING (station_id) WINDOW w1 AS (PARTITION BY service_id ORDER BY scheduled_time, seq))""",
       "stops stations")
def f13(t: Tables):
    base = feat.inflight(feat.stop_position(t.labelled))
    base = feat.stop_time(feat.station_static(base, t.stations))
    out = feat.cause_features(base)
    names = ["is_peak_morning", "is_peak_evening", "is_off_peak", "is_weekend", "is_monday", "is_friday", "is_winter",
             "is_spring", "is_summer", "delay_log", "delay_severe", "delay_extreme", "cascade_strong", "cascade_severe",
             "cum_delay_log", "weather_severe", "weather_extreme", "heavy_snow", "winter_x_severe_weather",
             "delay_x_position", "is_local", "is_highspeed", "degree_log"]
    return _r6(out.select("seq", *names), "delay_log", "cum_delay_log", "delay_x_position", "degree_log")


@query("f14_rolling_faults", """
    WITH d AS (SELECT date, count(*) AS n, sum(duration_minutes) AS total, count(DISTINCT station_id) AS lines
               FROM faults GROUP BY date),
    cal AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM d)::TIMESTAMP, (SELECT max(date) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT CAST(cal.date AS VARCHAR) AS date, coalesce(n, 0) AS fault_count, coalesce(total, 0) AS total_downtime,
           coalesce(lines, 0) AS lines_affected,
           round(avg(coalesce(n, 0)) OVER (ORDER BY cal.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling_mean
    FROM cal LEFT JOIN d USING (date)""", "faults")
def f14(t: Tables):
    out = feat.rolling_daily(t.faults, "date", "station_id", "duration_minutes")
    return _r6(out.withColumn("date", F.col("date").cast("string")), "rolling_mean")


@query("f15_previous_label", """
    SELECT seq, y_stop, prev_y FROM (SELECT seq, y_stop, lag(y_stop) OVER (PARTITION BY service_id ORDER BY stop_order) AS prev_y
    FROM positioned) WHERE prev_y IS NOT NULL""", "positioned")
def f15(t: Tables):
    return feat.previous_label(t.positioned).select("seq", "y_stop", "prev_y")


@query("f16_running_counts", """
    SELECT CAST(date AS VARCHAR) AS date, n, CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS cum_n
    FROM (SELECT date, count(*) AS n FROM stops GROUP BY date)""")
def f16(t: Tables):
    from pyspark.sql import Window

    # One row per day before the global window.
    daily = t.stops.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return daily.select(F.col("date").cast("string").alias("date"), "n",
                        F.sum("n").over(Window.orderBy("date")).alias("cum_n"))


@query("f17_sequence_packing", """
    SELECT service_id, stop_order // 3 AS page, CAST(count(*) AS INTEGER) AS n_steps, string_agg(stop_order || ':' || y_stop, ',' ORDER BY stop_order) AS steps
    FROM positioned GROUP BY ALL""", "positioned")
def f17(t: Tables):
    packed = feat.pack_sequences(t.positioned, ["y_stop"], max_stops=3)
    text = F.array_join(F.transform("steps", lambda s: F.concat(s["stop_order"], F.lit(":"), s["y_stop"])), ",")
    return packed.select("service_id", "page", "n_steps", text.alias("steps"))


@query("f17_sequence_unpacking", """
    SELECT seq, stop_order, p_a AS sequence_score FROM predictions""", "predictions")
def f17_back(t: Tables):
    p = t.predictions
    packed = feat.pack_sequences(p, ["p_a"], max_stops=3)
    return feat.unpack_scores(packed, p, "p_a").select("seq", "stop_order", "sequence_score")


@query("f18_calendar_grid", """
    WITH cal AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date),
    d AS (SELECT station_id, date, count(*) AS n, avg(delay_minutes) AS v FROM stops GROUP BY ALL)
    SELECT s.station_id, CAST(cal.date AS VARCHAR) AS date, coalesce(d.n, 0) AS n, round(d.v, 6) AS mean_delay
    FROM (SELECT DISTINCT station_id FROM stops) s CROSS JOIN cal LEFT JOIN d ON d.station_id = s.station_id AND d.date = cal.date""")
def f18(t: Tables):
    grid = feat.calendar(t.stops.select("station_id").distinct(), EVENT_SPLITS["train"][0], EVENT_SPLITS["test"][1])
    daily = t.stops.groupBy("station_id", "date").agg(F.count(F.lit(1)).alias("n"), C.r6(F.avg("delay_minutes")).alias("mean_delay"))
    return grid.join(daily, ["station_id", "date"], "left").select(
        "station_id", F.col("date").cast("string").alias("date"), F.coalesce("n", F.lit(0)).alias("n"), "mean_delay")
