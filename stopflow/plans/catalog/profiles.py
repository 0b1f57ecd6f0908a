"""Queries of profiling and aggregation."""

from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators import profiling as P
from stopflow.plans import dashboard
from stopflow.plans.adapter import Tables
from stopflow.plans.catalog.tables import CAUSE_SQL
from stopflow.plans.registry import query


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("a1_missing_summary", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing_count, count({c}) AS present_count,
      round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS missing_pct, '{d}' AS dtype FROM stops"""
    for c, d in (("delay_minutes", "double"), ("precipitation", "double"), ("snow_depth", "double"), ("station_id", "string"))))
def a1(t: Tables):
    return P.missing_summary(t.stops, ["delay_minutes", "precipitation", "snow_depth", "station_id"])


@query("a2_completeness", """
    SELECT 'precipitation' AS "column", round(1 - avg(CAST(precipitation IS NULL AS INT)), 6) AS completeness FROM stops
    UNION ALL SELECT 'temperature', 1.0 FROM (SELECT count(*) FROM stops)""")
def a2(t: Tables):
    return _round(P.completeness(t.stops, ["precipitation", "temperature"]), "completeness")


@query("a3_describe", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, {qs} FROM stops"""
    for c in ("delay_minutes", "wind_speed", "precipitation")
    for qs in [", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}" for n, q in P.EXTREMES.items())]))
def a3(t: Tables):
    return _round(P.describe(t.stops, ["delay_minutes", "wind_speed", "precipitation"]), "mean", "std", "min", "max", *P.EXTREMES)


@query("a4_delay_statistics", """
    WITH q AS (SELECT quantile_cont(delay_minutes, 0.05) AS lo, quantile_cont(delay_minutes, 0.95) AS hi FROM stops)
    SELECT count(delay_minutes) AS n, round(avg(delay_minutes), 6) AS mean, round(median(delay_minutes), 6) AS median, round(stddev_samp(delay_minutes), 6) AS std,
      round(min(delay_minutes), 6) AS min, round(max(delay_minutes), 6) AS max, round(max(hi), 6) AS p95,
      round(100.0 * avg(CAST(delay_minutes > 3 AS INT)), 6) AS pct_late, count(*) FILTER (WHERE delay_minutes BETWEEN lo AND hi) AS n_clipped FROM stops, q""")
def a4(t: Tables):
    return _round(P.delay_statistics(t.stops, "delay_minutes"), "mean", "median", "std", "min", "max", "p95", "pct_late")


HIST_SQL = """b AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
    SELECT CAST(greatest(0, least({n} - 1, floor((v - lo) / ((hi - lo) / {n}.0::DOUBLE)))) AS INTEGER) AS bin, round(lo + (hi - lo) / {n} * greatest(0, least({n} - 1, floor((v - lo) / ((hi - lo) / {n}.0::DOUBLE)))), 6) AS bin_from,
      count(*) AS n FROM x, b GROUP BY ALL"""


@query("a5_histogram", "WITH x AS (SELECT l_extendedprice AS v FROM lineitem), " + HIST_SQL.format(n=50), "")
def a5(t: Tables):
    return _round(P.histogram(t.raw("lineitem"), "l_extendedprice", 50), "bin_from")


@query("a5_clipped_histogram", "WITH x AS (SELECT least(90, greatest(-10, delay_minutes))::DOUBLE AS v FROM stops WHERE delay_minutes IS NOT NULL), " + HIST_SQL.format(n=80))
def a5_clipped(t: Tables):
    return _round(P.histogram(t.stops, "delay_minutes", 80, -10, 90), "bin_from")


@query("a6_delay_by_type", """
    SELECT train_class_code, round(avg(delay_minutes), 6) AS mean_delay, round(stddev_samp(delay_minutes), 6) AS std_delay, count(*) AS n_stops,
      round(100.0 * avg(CAST(delay_minutes > 3 AS INT)), 6) AS pct_late, round(median(delay_minutes), 6) AS median_delay
    FROM stops WHERE delay_minutes IS NOT NULL GROUP BY 1 HAVING count(*) >= 500""")
def a6(t: Tables):
    return _round(P.group_delays(t.stops, "train_class_code", "delay_minutes", 500), "mean_delay", "std_delay", "pct_late", "median_delay")


@query("a6_delay_by_supplier_volume", """
    SELECT station_id, round(avg(delay_minutes), 6) AS mean_delay, round(stddev_samp(delay_minutes), 6) AS std_delay, count(*) AS n_stops,
      round(100.0 * avg(CAST(delay_minutes > 3 AS INT)), 6) AS pct_late, round(median(delay_minutes), 6) AS median_delay FROM li GROUP BY 1 HAVING count(*) >= 500""", "li")
def a6_volume(t: Tables):
    return _round(P.group_delays(t.lineitem_stops, "station_id", "delay_minutes", 500), "mean_delay", "std_delay", "pct_late", "median_delay")


@query("a7_delay_by_class", """
    WITH o(c, r) AS (VALUES ('FR', 0), ('IC', 1), ('REG', 2), ('P', 3)), x AS (SELECT upper(trim(type_text)) AS c, delay_minutes AS d FROM feed WHERE NOT cancelled AND delay_minutes IS NOT NULL)
    SELECT c AS train_class, CAST(r AS INTEGER) AS place, round(avg(d), 6) AS mean_delay, round(median(d), 6) AS median_delay, round(stddev_samp(d), 6) AS std_delay, count(*) AS n_stops,
      round(100.0 * avg(CAST(d > 3 AS INT)), 6) AS pct_late FROM x JOIN o USING (c) GROUP BY ALL""", "feed")
def a7(t: Tables):
    order = F.array(*[F.lit(c) for c in ("FR", "IC", "REG", "P")])
    rows = t.feed.where(~F.col("cancelled")).withColumn("train_class", C.code("type_text"))
    out = P.group_delays(rows, "train_class", "delay_minutes", 1)
    out = out.withColumn("place", (F.array_position(order, F.col("train_class")) - 1).cast("int")).where("place >= 0")
    return _round(out, "mean_delay", "median_delay", "std_delay", "pct_late")


BINNED_SQL = """b AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
    g AS (SELECT CAST(greatest(0, least({n} - 1, ceil((v - lo) / ((hi - lo) / {n}.0::DOUBLE)) - 1)) AS INTEGER) AS bin, lo, hi, count(*) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS sem FROM x, b GROUP BY ALL)
    SELECT bin, round(lo + (hi - lo) / {n} * (bin + 0.5), 6) AS mid, n, round(mean, 6) AS mean, round(sem, 6) AS sem, round(mean - 1.96 * sem, 6) AS low,
      round(mean + 1.96 * sem, 6) AS high, CAST(mean = max(mean) OVER () AS INTEGER) AS worst FROM g"""


@query("a8_binned_mean", "WITH x AS (SELECT snow_depth AS v, delay_minutes AS d FROM stops WHERE NOT cancelled AND snow_depth IS NOT NULL AND delay_minutes IS NOT NULL), " + BINNED_SQL.format(n=14))
def a8(t: Tables):
    out = P.binned_mean(t.stops.where(~F.col("cancelled")), "snow_depth", "delay_minutes", 14)
    return _round(out, "mid", "mean", "sem", "low", "high")


@query("a9_delay_by_weather", """
    SELECT lower(trim(weather_text)) AS weather, round(avg(delay_minutes) FILTER (WHERE NOT cancelled), 6) AS mean_delay,
      round(stddev_samp(delay_minutes) FILTER (WHERE NOT cancelled) / sqrt(count(delay_minutes) FILTER (WHERE NOT cancelled)), 6) AS sem_delay,
      round(100.0 * avg(CAST(cancelled AS INT)), 6) AS cancellation_rate, count(delay_minutes) AS n_stops FROM feed WHERE weather_text IS NOT NULL GROUP BY 1""", "feed")
def a9(t: Tables):
    rows = t.feed.withColumn("weather", F.lower(F.trim("weather_text")))
    return _round(P.conditional_delays(rows, "weather", "delay_minutes").drop("pct_late"), "mean_delay", "sem_delay", "cancellation_rate")


@query("a10_monthly_trend", """
    SELECT strftime(o_orderdate, '%Y-%m') AS period, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem, round(median(o_totalprice), 4) AS median
    FROM orders GROUP BY 1""", "")
def a10(t: Tables):
    return _round(P.trend(t.raw("orders"), F.date_format("o_orderdate", "yyyy-MM"), "o_totalprice"), "mean", "sem", "median", digits=4)


@query("a11_weekday_mean", "SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, round(avg(delay_minutes), 6) AS mean_delay FROM stops WHERE NOT cancelled GROUP BY 1")
def a11(t: Tables):
    return t.stops.where(~F.col("cancelled")).groupBy(F.weekday("date").alias("dow")).agg(C.r6(F.avg("delay_minutes")).alias("mean_delay"))


@query("a12_rates_by_dimension", """
    SELECT 'train_class_code' AS dimension, CAST(train_class_code AS VARCHAR) AS value, round(avg(is_disrupted), 6) AS rate, count(*) AS n FROM services GROUP BY ALL
    UNION ALL SELECT 'month', CAST(month(date) AS VARCHAR), round(avg(is_disrupted), 6), count(*) FROM services GROUP BY ALL
    UNION ALL SELECT 'dow', CAST(isodow(date) - 1 AS VARCHAR), round(avg(is_disrupted), 6), count(*) FROM services GROUP BY ALL""", "services")
def a12(t: Tables):
    df = t.services.withColumns({"month": F.month("date"), "dow": F.weekday("date")})
    return _round(P.rates_by(df, "is_disrupted", ["train_class_code", "month", "dow"]), "rate")


@query("a13_rate_by_severity", "SELECT weather_severity, count(*) AS n, round(avg(y_stop), 6) AS rate FROM stops GROUP BY 1")
def a13(t: Tables):
    return t.labelled.groupBy("weather_severity").agg(F.count(F.lit(1)).alias("n"), C.r6(F.avg("y_stop")).alias("rate"))


RANK_SQL = """r AS (SELECT station_id, avg(delay_minutes) FILTER (WHERE NOT cancelled) AS m, 100.0 * avg(CAST(cancelled AS INT)) AS c, count(delay_minutes) AS n_stops
      FROM stops GROUP BY 1 HAVING count(delay_minutes) >= 60)"""


@query("a14_station_ranking", f"""
    WITH {RANK_SQL} SELECT * FROM (SELECT 'delay' AS metric, station_id, round(m, 6) AS value, n_stops FROM r ORDER BY m DESC, station_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'cancellation', station_id, round(c, 6), n_stops FROM r ORDER BY c DESC, station_id LIMIT 10)""")
def a14(t: Tables):
    stats = P.conditional_delays(t.stops, "station_id", "delay_minutes", min_rows=60)
    parts = [stats.orderBy(F.desc(c), "station_id").limit(10).select(F.lit(n).alias("metric"), "station_id", C.r6(c).alias("value"), "n_stops")
             for n, c in (("delay", "mean_delay"), ("cancellation", "cancellation_rate"))]
    return parts[0].unionByName(parts[1])


@query("a15_correlations", """
    SELECT 'delay_minutes' AS a, 'snow_depth' AS b, round(corr(delay_minutes, snow_depth), 6) AS r FROM stops
    UNION ALL SELECT 'delay_minutes', 'wind_speed', round(corr(delay_minutes, wind_speed), 6) FROM stops
    UNION ALL SELECT 'snow_depth', 'wind_speed', round(corr(snow_depth, wind_speed), 6) FROM stops""")
def a15(t: Tables):
    return _round(P.correlations(t.stops, ["delay_minutes", "snow_depth", "wind_speed"]), "r")


@query("a15_correlates_of_target", """
    SELECT "column", round(v, 6) AS abs_r, CAST(row_number() OVER (ORDER BY v DESC) AS INTEGER) AS rank FROM (
      SELECT 'snow_depth' AS "column", abs(corr(delay_minutes, snow_depth)) AS v FROM stops UNION ALL SELECT 'wind_speed', abs(corr(delay_minutes, wind_speed)) FROM stops
      UNION ALL SELECT 'k', abs(corr(delay_minutes, k)) FROM stops)""")
def a15_target(t: Tables):
    return _round(P.correlates_of(P.correlations(t.stops, ["delay_minutes", "snow_depth", "wind_speed", "k"]), "delay_minutes"), "abs_r")


@query("a16_top_causes", """
    SELECT cause_en, count(*) AS n_events, sum(duration_minutes) AS total, round(avg(duration_minutes), 6) AS mean FROM faults GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "faults")
def a16(t: Tables):
    return _round(P.top_totals(t.faults, "cause_en", "duration_minutes", "n_events"), "mean")


@query("a17_stations_by_disruptions", """
    SELECT upper(trim(c)) AS station_code, count(*) AS n FROM (SELECT unnest(string_split(codes_text, ',')) AS c FROM feed WHERE event_type = 'error') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "feed")
def a17(t: Tables):
    from stopflow.operators.builders import explode_codes

    rows = explode_codes(t.feed.where("event_type = 'error'").select("seq", "codes_text"), "codes_text")
    return P.top_counts(rows, "station_code", 10).drop("share")


@query("a18_lines_by_downtime", """
    SELECT station_id, count(*) AS n_events, sum(duration_minutes) AS total, round(avg(duration_minutes), 6) AS mean FROM faults GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""", "faults")
def a18(t: Tables):
    return _round(P.top_totals(t.faults, "station_id", "duration_minutes", "total"), "mean")


@query("a19_connection_counts", """
    SELECT station_id, count(*) AS connections FROM (SELECT station_from AS station_id FROM edges WHERE station_from < station_to UNION ALL SELECT station_to FROM edges WHERE station_from < station_to)
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""", "edges")
def a19(t: Tables):
    return P.connection_counts(P.undirected(t.edges))


@query("a20_mean_distance_ends", """
    WITH p AS (SELECT station_from, avg(distance_km) AS m FROM edges GROUP BY 1)
    SELECT * FROM (SELECT station_from, round(m, 6) AS mean_km, 'remote' AS side FROM p ORDER BY m DESC, station_from LIMIT 5)
    UNION ALL SELECT * FROM (SELECT station_from, round(m, 6), 'central' FROM p ORDER BY m, station_from LIMIT 5)""", "edges")
def a20(t: Tables):
    return _round(P.mean_distance_ends(t.edges), "mean_km")


@query("a21_route_length_ccdf", """
    WITH l AS (SELECT service_id, max(stop_order) AS length FROM positioned GROUP BY 1)
    SELECT length, count(*) AS n, round(1.0 - sum(count(*)) OVER (ORDER BY length) / sum(count(*)) OVER (), 6) AS share_longer FROM l GROUP BY length""", "positioned")
def a21(t: Tables):
    return _round(P.ccdf(t.positioned, "service_id", "stop_order"), "share_longer")


@query("a22_degree_distribution", "SELECT least(c, 20) AS degree, count(*) AS n_keys FROM (SELECT station_from, count(*) AS c FROM edges GROUP BY 1) GROUP BY 1", "edges")
def a22(t: Tables):
    return P.size_distribution(t.edges, ["station_from"], 20, "degree").withColumn("degree", F.col("degree").cast("long"))


@query("a23_stops_per_train", "SELECT least(c, 60) AS size, count(*) AS n_keys FROM (SELECT service_id, count(*) AS c FROM stops GROUP BY 1) GROUP BY 1")
def a23(t: Tables):
    return P.size_distribution(t.stops, ["service_id"], 60).withColumn("size", F.col("size").cast("long"))


@query("a24_contingency", """
    SELECT y_stop, count(*) FILTER (WHERE weather_severity = 0) AS "0", count(*) FILTER (WHERE weather_severity = 1) AS "1", count(*) FILTER (WHERE weather_severity = 2) AS "2",
      count(*) FILTER (WHERE weather_severity = 3) AS "3", count(*) FILTER (WHERE weather_severity = 4) AS "4" FROM stops GROUP BY 1""")
def a24(t: Tables):
    return P.contingency(t.labelled, "y_stop", "weather_severity", [0, 1, 2, 3, 4])


@query("a25_keywords", """
    SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ù]{4,}')) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""", "")
def a25(t: Tables):
    return P.keywords(t.raw("documents"), "text")


@query("a26_daily_counts", "SELECT CAST(date AS VARCHAR) AS date, count(*) AS n FROM faults GROUP BY 1", "faults")
def a26(t: Tables):
    return t.faults.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("a27_value_shares", "SELECT station_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM stops), 6) AS share FROM stops GROUP BY 1")
def a27(t: Tables):
    return _round(P.value_counts(t.stops, "station_id"), "share")


@query("a28_frequent_means", "SELECT weather_text, round(avg(delay_minutes), 6) AS mean, count(*) AS n FROM feed WHERE weather_text IS NOT NULL GROUP BY 1 HAVING count(*) > 900", "feed")
def a28(t: Tables):
    return _round(P.frequent_means(t.feed, "weather_text", "delay_minutes", 900), "mean")


@query("a29_route_totals", "SELECT service_id, country, CAST(sum(k) AS BIGINT) AS total FROM stops GROUP BY ALL ORDER BY total DESC, service_id, country LIMIT 10")
def a29(t: Tables):
    return t.stops.groupBy("service_id", "country").agg(F.sum("k").alias("total")).orderBy(F.desc("total"), "service_id", "country").limit(10)


@query("a29_holiday_means", """
    SELECT CAST(date = DATE '2024-01-01' AS INTEGER) AS holiday, round(avg(delay_minutes), 6) AS mean_delay FROM stops GROUP BY 1""")
def a29_holiday(t: Tables):
    from stopflow.operators.features import stop_time

    return stop_time(t.stops).groupBy(F.col("is_holiday").alias("holiday")).agg(C.r6(F.avg("delay_minutes")).alias("mean_delay"))


@query("a30_threshold_counts", """
    SELECT 'delay_minutes' AS "column", count(*) FILTER (WHERE delay_minutes < 0) AS n_negative, count(*) FILTER (WHERE delay_minutes = 0) AS n_zero,
      count(*) FILTER (WHERE delay_minutes > 30) AS n_above_30, count(*) FILTER (WHERE delay_minutes > 120) AS n_above_120 FROM stops
    UNION ALL SELECT 'temperature', count(*) FILTER (WHERE temperature < 0), count(*) FILTER (WHERE temperature = 0), count(*) FILTER (WHERE temperature > 30), count(*) FILTER (WHERE temperature > 120) FROM stops""")
def a30(t: Tables):
    return P.threshold_counts(t.stops, ["delay_minutes", "temperature"])


@query("a31_extreme_rows", "SELECT seq, delay_minutes, delay_minutes - temperature AS delta FROM stops ORDER BY delay_minutes DESC NULLS LAST, seq LIMIT 20")
def a31(t: Tables):
    return t.stops.select("seq", "delay_minutes", (F.col("delay_minutes") - F.col("temperature")).alias("delta")).orderBy(
        F.desc_nulls_last("delay_minutes"), "seq").limit(20)


@query("a32_dataset_summary", """
    SELECT count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(DISTINCT station_id) AS n_station_id,
      count(DISTINCT service_id) AS n_service_id, count(*) FILTER (WHERE cancelled) AS n_cancelled, round(avg(delay_minutes) FILTER (WHERE NOT cancelled), 6) AS mean_delay,
      round(100.0 * avg(CAST(delay_minutes > 3 AS INT)) FILTER (WHERE NOT cancelled), 6) AS pct_late FROM stops""")
def a32(t: Tables):
    return _round(P.dataset_summary(t.stops, ["station_id", "service_id"], "date", "delay_minutes"), "mean_delay", "pct_late")


@query("a32_rows_per_month", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1", "")
def a32_months(t: Tables):
    return t.raw("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("a33_snow_quartiles", """
    SELECT CAST(month(date) AS INTEGER) AS month, round(quantile_cont(snow_depth, 0.25), 6) AS q25, round(quantile_cont(snow_depth, 0.5), 6) AS q50,
      round(quantile_cont(snow_depth, 0.75), 6) AS q75 FROM stops GROUP BY 1""")
def a33(t: Tables):
    from stopflow.operators.quantiles import quantiles

    return _round(quantiles(t.stops.withColumn("month", F.month("date")), ["month"], "snow_depth", P.QUARTILES).drop("n_values"), *P.QUARTILES)


@query("a33_max_snow_per_station", "SELECT station_id, max(snow_depth) AS snow_max, arg_min(temperature, seq) AS first_temperature FROM stops GROUP BY 1")
def a33_max(t: Tables):
    return t.stops.groupBy("station_id").agg(F.max("snow_depth").alias("snow_max"), F.min_by("temperature", "seq").alias("first_temperature"))


@query("a34_imputation_histograms", """
    WITH m AS (SELECT median(snow_depth) AS med FROM stops), y AS (SELECT 'before' AS stage, snow_depth AS v FROM stops WHERE snow_depth IS NOT NULL UNION ALL SELECT 'after', coalesce(snow_depth, med) FROM stops, m),
    x AS (SELECT * FROM y), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
    SELECT stage, CAST(greatest(0, least(19, floor((v - lo) / ((hi - lo) / 20.0::DOUBLE)))) AS INTEGER) AS bin, count(*) AS n FROM x, b GROUP BY ALL""")
def a34(t: Tables):
    from stopflow.operators.impute import median_fill

    both = t.stops.select(F.lit("before").alias("stage"), "snow_depth").unionByName(
        median_fill(t.stops, "snow_depth").select(F.lit("after").alias("stage"), "snow_depth"))
    return P.histogram(both, "snow_depth", 20, groups=["stage"]).drop("bin_from")


@query("a35_mode_per_key", f"WITH {CAUSE_SQL} SELECT station_id, CAST(date AS VARCHAR) AS date, cause_group FROM cause", "faults")
def a35(t: Tables):
    return P.mode_per_key(t.faults, ["station_id", "date"], "cause_group").withColumn("date", F.col("date").cast("string"))


@query("a36_station_coverage", """
    WITH s AS (SELECT country, CASE WHEN k % 17 <> 0 THEN lat END AS lat, lon FROM stations), r AS (SELECT country, round(lat, 4) AS lat, round(lon, 4) AS lon FROM s),
    d AS (SELECT *, CASE country WHEN 'IT' THEN lat BETWEEN 35.0 AND 47.5 AND lon BETWEEN 6.0 AND 19.0 WHEN 'FI' THEN lat BETWEEN 59.5 AND 70.5 AND lon BETWEEN 19.0 AND 32.0
      ELSE lat BETWEEN 50.5 AND 53.7 AND lon BETWEEN 3.0 AND 7.5 END AS home FROM r)
    SELECT country, count(*) FILTER (WHERE lat IS NOT NULL AND home) AS n_domestic, count(*) FILTER (WHERE lat IS NOT NULL AND NOT home) AS n_international,
      count(*) FILTER (WHERE lat IS NULL) AS n_missing FROM d GROUP BY 1""", "stations")
def a36(t: Tables):
    return dashboard.coverage_by_country(t.stations.withColumn("lat", F.when(F.col("k") % 17 != 0, F.col("lat"))))


@query("a37_filtered_causes", f"""
    WITH {CAUSE_SQL}, x AS (SELECT cause_group FROM positioned JOIN cause USING (station_id, date) WHERE y_stop = 1 AND weather_severity = 3 AND is_origin = 1)
    SELECT cause_group, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS share FROM x GROUP BY 1""", "positioned faults")
def a37(t: Tables):
    rows = t.predictions.where("y_stop = 1").join(P.mode_per_key(t.faults, ["station_id", "date"], "cause_group"), ["station_id", "date"])
    return _round(dashboard.cause_distribution(rows, "cause_group", weather=3, position="origin"), "share")


@query("a38_display_scores", """
    SELECT seq, round((temperature - avg(temperature) OVER ()) / stddev_pop(temperature) OVER (), 6) AS temperature_z, round((snow_depth - avg(snow_depth) OVER ()) / stddev_pop(snow_depth) OVER (), 6) AS snow_depth_z FROM stops""")
def a38(t: Tables):
    out = dashboard.display_scores(t.stops, ["temperature", "snow_depth"])
    return _round(out.select("seq", "temperature_z", "snow_depth_z"), "temperature_z", "snow_depth_z")


@query("a39_bounding_boxes", """
    SELECT country, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon FROM stations GROUP BY 1""", "stations")
def a39(t: Tables):
    return _round(P.bounding_boxes(t.stations), "min_lat", "max_lat", "min_lon", "max_lon")


@query("a41_label_coverage", f"""
    WITH {CAUSE_SQL} SELECT count(*) AS n_disrupted, count(cause_group) AS n_labelled, round(avg(CAST(cause_group IS NOT NULL AS INT)), 6) AS coverage
    FROM stops LEFT JOIN cause USING (station_id, date) WHERE y_stop = 1""", "stops faults")
def a41(t: Tables):
    from stopflow.plans.causes import label_coverage

    return _round(label_coverage(t.labelled, t.faults), "coverage")
