"""Maps the shared test tables onto the standard stop-level tables.

`Tables` only builds plans (nothing runs until a query is acted on), and each
frame is built once per object.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators import features as feat
from stopflow.session import configure, written

# The mapped events cover January 2024 only, so its splits are shorter.
EVENT_SPLITS = {
    "train": ("2024-01-01", "2024-01-20"),
    "val": ("2024-01-21", "2024-01-25"),
    "test": ("2024-01-26", "2024-01-31"),
}
EVENT_TRAIN_END = "2024-01-20"
EVENT_REF_END = "2024-01-10"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def landed(self) -> Tables:
        """The same tables with stops, stations and edges written first, for plans
        that read them many times."""
        out = Tables(self.spark, self.sf_dir)
        for name in ("stops", "stations", "edges"):
            out.__dict__[name] = written(getattr(out, name), name)
        return out

    @cached_property
    def stops(self) -> DataFrame:
        """One row per scheduled stop."""
        e = self.raw("events").withColumn(
            "k", F.get_json_object("props", "$.k").cast("int"))
        eid = F.col("event_id")
        country = F.when(F.col("k") % 3 == 0, "IT").when(F.col("k") % 3 == 1, "FI").otherwise("NL")
        day = F.col("ts").cast("date")
        no_measure = eid % 13 == 0
        return e.select(
            eid.alias("seq"),
            F.concat(F.lit("SV_"), F.col("user_id"), F.lit("_"), day).alias("service_id"),
            F.concat(country, F.lit("_"), F.col("k")).alias("station_id"),
            country.alias("country"),
            day.alias("date"),
            F.col("ts").alias("scheduled_time"),
            F.when((F.col("event_type") == "view") & (eid % 7 == 0), None)
            .otherwise(F.col("value") - 110).alias("delay_minutes"),
            ((F.col("event_type") == "error") & (eid % 10 == 0)).alias("cancelled"),
            (eid % 5).cast("int").alias("weather_severity"),
            (eid % 41 - 10).cast("double").alias("temperature"),
            ((eid % 23) * 0.5).alias("wind_speed"),
            F.when(~no_measure, (eid % 11) * 0.6).alias("precipitation"),
            F.when(~no_measure, (eid % 60).cast("double")).alias("snow_depth"),
            (F.col("user_id") % 7).cast("int").alias("train_class_code"),
            "k", "user_id", "event_type", (F.floor("value").cast("int") - 110).alias("delay_int"),
        )

    @cached_property
    def feed(self) -> DataFrame:
        """The same stops with the raw text columns of the country feeds."""
        s, k = F.col("seq"), F.col("k")

        def pick(n: int, *texts):
            return F.get(F.array(*[F.lit(x) for x in texts]), (s % n).cast("int"))

        return self.stops.select(
            "*",
            F.when(s % 17 == 0, "N").when(s % 19 == 0, "S").when(s % 23 == 0, "abc").when(s % 29 == 0, None)
            .when(s % 31 == 0, " 7 ").otherwise(F.col("delay_int").cast("string")).alias("arrival_text"),
            F.when(s % 37 == 0, "N").when(s % 41 == 0, "S").otherwise((F.col("delay_int") + 1).cast("string")).alias("departure_text"),
            pick(10, " ec ", "FR", "ic", "Sprinter", "Intercity direct", "P", "mus", "XYZ", "", "REG").alias("type_text"),
            pick(11, "Sunny", "cloudy", " light rain ", "moderate rain", "HEAVY RAIN", "light snow", "moderate snow",
                 "heavy snow", "hail", "partially cloudy", None).alias("weather_text"),
            pick(6, "true", "False", "TRUE", "1", "0", "maybe").alias("bool_text"),
            F.when(s % 43 == 0, "true").otherwise("false").alias("full_text"),
            F.concat(k, F.lit(","), s % 10).alias("distance_text"),
            F.when(s % 3 == 0, F.concat(k, F.lit("min"))).when(s % 3 == 1, F.concat(F.lit("ca "), k, F.lit(" min")))
            .otherwise(F.concat(k, F.lit(" of 60 min"))).alias("duration_text"),
            F.when(s % 25 == 0, "2024/13/40").otherwise(F.concat_ws(
                "/", F.year("date"), F.month("date"), F.dayofmonth("date"))).alias("slash_text"),
            F.concat(F.lit(" st "), k).alias("code_text"),
            F.concat(k, F.lit(", "), (k + 1) % 100, F.lit(",zz")).alias("codes_text"),
            F.when(s % 47 == 0, F.lit(None).cast("double")).otherwise((s % 900).cast("double")).alias("visibility"),
        )

    @cached_property
    def services(self) -> DataFrame:
        return self.stops.groupBy("service_id", "date", "train_class_code").agg(
            F.max(C.late("delay_minutes", "cancelled")).alias("is_disrupted"))

    @cached_property
    def labelled(self) -> DataFrame:
        """Stops with the label, as the stop grain delivers them."""
        return self.stops.withColumn("y_stop", C.late("delay_minutes", "cancelled")).withColumn(
            "delay_min", F.col("delay_minutes"))

    @cached_property
    def edges(self) -> DataFrame:
        """Consecutive stations of a service, both directions, with |k1 - k2| km."""
        from stopflow.operators.builders import adjacency_from_order

        stops = self.stops.withColumn("km", F.col("k").cast("double"))
        return adjacency_from_order(stops, ["service_id"], ["scheduled_time", "seq"],
                                    "station_id", distance="km")

    @cached_property
    def stations(self) -> DataFrame:
        hist = (F.col("date") <= EVENT_REF_END) & ~F.col("cancelled")
        return self.stops.groupBy("station_id", "country", "k").agg(
            F.coalesce(F.avg(F.when(hist, F.col("delay_minutes"))), F.lit(0.0)).alias("avg_historical_delay"),
            F.countDistinct("service_id").cast("int").alias("degree"),
        ).select(
            "station_id", "country",
            (F.col("k") / 10.0 + 45.0).cast("double").alias("lat"),
            (F.col("k") / 10.0 + 9.0).cast("double").alias("lon"),
            "avg_historical_delay", "degree", "k")

    @cached_property
    def faults(self) -> DataFrame:
        groups = F.array(*[F.lit(g) for g in K.CAUSE_GROUPS])
        index = (F.col("seq") % 9).cast("int")
        return self.stops.where(F.col("event_type") == "error").select(
            F.concat(F.col("country"), F.lit("_FAULT_"), F.col("seq")).alias("fault_id"),
            "date", "station_id",
            F.concat(F.lit("cause "), index, F.lit(" | "), F.get(groups, index)).alias("description"),
            F.concat(F.lit("cause "), index).alias("cause_en"),
            F.get(groups, index).alias("cause_group"),
            F.col("k").cast("double").alias("duration_minutes"), "seq")

    @cached_property
    def positioned(self) -> DataFrame:
        """Labelled stops with their position in the service."""
        return feat.stop_position(self.labelled)

    @cached_property
    def predictions(self) -> DataFrame:
        """Both scenarios side by side; probabilities follow a fixed formula."""
        base = self.positioned.withColumn("split", split_column())
        p_a = ((F.col("seq") * 7919) % 1000) / 1000.0
        out = base.withColumn("p_a", p_a).withColumn(
            "p_b", F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.lit(0.7) * F.col("y_stop") + F.lit(0.3) * p_a)))
        return out.withColumn("yp_a", (F.col("p_a") >= 0.5).cast("int")).withColumn(
            "yp_b", (F.col("p_b") >= 0.5).cast("int")).select(
            "seq", "service_id", "station_id", "country", "date", "train_class_code", "stop_order",
            "n_total_stops", "position_norm", "is_origin", "is_terminus", "y_stop", "delay_min",
            "weather_severity", "snow_depth", "temperature", "wind_speed", "split",
            "p_a", "yp_a", "p_b", "yp_b")

    @cached_property
    def runs(self) -> DataFrame:
        """Predictions in long form: one row per (model, scenario, stop)."""
        both = F.explode(F.array(
            F.struct(F.lit("A").alias("scenario"), F.col("p_a").alias("p_disrupted"), F.col("yp_a").alias("y_pred")),
            F.struct(F.lit("B").alias("scenario"), F.col("p_b").alias("p_disrupted"), F.col("yp_b").alias("y_pred"))))
        p = self.predictions
        return p.select("*", both.alias("r")).select(
            *[c for c in p.columns if c not in ("p_a", "p_b", "yp_a", "yp_b")],
            F.lit("gbt").alias("model"), "r.scenario", "r.p_disrupted", "r.y_pred")

    @cached_property
    def lineitem_stops(self) -> DataFrame:
        """Volume adapter: lineitem as stops of an order."""
        li, o = self.raw("lineitem"), self.raw("orders")
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        return j.select(
            F.col("l_orderkey").cast("string").alias("service_id"),
            F.col("l_suppkey").cast("string").alias("station_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
            (F.col("l_quantity") - 40).alias("delay_minutes"),
            F.lit(False).alias("cancelled"))


def split_column(date: str = "date", splits: dict | None = None):
    out = None
    for name, (start, end) in (splits or EVENT_SPLITS).items():
        inside = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


# ---------------------------------------------------------------------------
# The same tables in DuckDB SQL, as common table expressions.

_CTE = {
    "stops": ("", """
        SELECT event_id AS seq, 'SV_' || user_id || '_' || strftime(ts, '%Y-%m-%d') AS service_id,
               (CASE k % 3 WHEN 0 THEN 'IT' WHEN 1 THEN 'FI' ELSE 'NL' END) || '_' || k AS station_id,
               CASE k % 3 WHEN 0 THEN 'IT' WHEN 1 THEN 'FI' ELSE 'NL' END AS country,
               CAST(ts AS DATE) AS date, ts AS scheduled_time,
               CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN NULL ELSE value - 110 END AS delay_minutes,
               (event_type = 'error' AND event_id % 10 = 0) AS cancelled,
               CAST(event_id % 5 AS INTEGER) AS weather_severity,
               CAST(event_id % 41 - 10 AS DOUBLE) AS temperature,
               CAST(event_id % 23 AS DOUBLE) * 0.5::DOUBLE AS wind_speed,
               CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 11 AS DOUBLE) * 0.6::DOUBLE END AS precipitation,
               CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 60 AS DOUBLE) END AS snow_depth,
               CAST(user_id % 7 AS INTEGER) AS train_class_code, k, user_id, event_type,
               CAST(floor(value) AS INTEGER) - 110 AS delay_int,
               CAST(COALESCE(CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN NULL ELSE value - 110 END > 5, false)
                    OR (event_type = 'error' AND event_id % 10 = 0) AS INTEGER) AS y_stop
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""),
    "feed": ("stops", """
        SELECT *, CASE WHEN seq % 17 = 0 THEN 'N' WHEN seq % 19 = 0 THEN 'S' WHEN seq % 23 = 0 THEN 'abc' WHEN seq % 29 = 0 THEN NULL
                    WHEN seq % 31 = 0 THEN ' 7 ' ELSE CAST(delay_int AS VARCHAR) END AS arrival_text,
               CASE WHEN seq % 37 = 0 THEN 'N' WHEN seq % 41 = 0 THEN 'S' ELSE CAST(delay_int + 1 AS VARCHAR) END AS departure_text,
               [' ec ', 'FR', 'ic', 'Sprinter', 'Intercity direct', 'P', 'mus', 'XYZ', '', 'REG'][seq % 10 + 1] AS type_text,
               ['Sunny', 'cloudy', ' light rain ', 'moderate rain', 'HEAVY RAIN', 'light snow', 'moderate snow', 'heavy snow',
                'hail', 'partially cloudy', NULL][seq % 11 + 1] AS weather_text,
               ['true', 'False', 'TRUE', '1', '0', 'maybe'][seq % 6 + 1] AS bool_text,
               CASE WHEN seq % 43 = 0 THEN 'true' ELSE 'false' END AS full_text,
               k || ',' || (seq % 10) AS distance_text,
               CASE seq % 3 WHEN 0 THEN k || 'min' WHEN 1 THEN 'ca ' || k || ' min' ELSE k || ' of 60 min' END AS duration_text,
               CASE WHEN seq % 25 = 0 THEN '2024/13/40' ELSE year(date) || '/' || month(date) || '/' || day(date) END AS slash_text,
               ' st ' || k AS code_text, k || ', ' || ((k + 1) % 100) || ',zz' AS codes_text,
               CASE WHEN seq % 47 <> 0 THEN CAST(seq % 900 AS DOUBLE) END AS visibility
        FROM stops"""),
    "services": ("stops", """
        SELECT service_id, date, train_class_code, max(y_stop) AS is_disrupted FROM stops GROUP BY ALL"""),
    "hops": ("stops", """
        SELECT station_id AS a, lead(station_id) OVER w AS b, abs(lead(k) OVER w - k)::DOUBLE AS d
        FROM stops WINDOW w AS (PARTITION BY service_id ORDER BY scheduled_time, seq)"""),
    "edges": ("hops", """
        SELECT station_from, station_to, round(avg(d), 2) AS distance_km FROM (
          SELECT a AS station_from, b AS station_to, d FROM hops WHERE b IS NOT NULL AND a <> b
          UNION ALL SELECT b, a, d FROM hops WHERE b IS NOT NULL AND a <> b)
        GROUP BY ALL"""),
    "stations": ("stops", """
        SELECT station_id, country, 45.0::DOUBLE + k / 10.0::DOUBLE AS lat, 9.0::DOUBLE + k / 10.0::DOUBLE AS lon,
               coalesce(avg(delay_minutes) FILTER (WHERE date <= DATE '2024-01-10' AND NOT cancelled), 0) AS avg_historical_delay,
               CAST(count(DISTINCT service_id) AS INTEGER) AS degree, k
        FROM stops GROUP BY station_id, country, k"""),
    "faults": ("stops", """
        SELECT country || '_FAULT_' || seq AS fault_id, date, station_id,
               'cause ' || (seq % 9) || ' | ' || g[seq % 9 + 1] AS description,
               'cause ' || (seq % 9) AS cause_en, g[seq % 9 + 1] AS cause_group,
               k::DOUBLE AS duration_minutes, seq
        FROM stops, (SELECT ['rolling stock', 'infrastructure', 'external', 'accidents', 'logistical',
                             'engineering work', 'staff', 'weather', 'unknown'] AS g)
        WHERE event_type = 'error'"""),
    "positioned": ("stops", """
        SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS stop_order,
               CAST(count(*) OVER (PARTITION BY service_id) AS INTEGER) AS n_total_stops,
               (row_number() OVER w - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY service_id) - 1, 1) AS position_norm,
               CAST(row_number() OVER w = 1 AS INTEGER) AS is_origin,
               CAST(row_number() OVER w = count(*) OVER (PARTITION BY service_id) AS INTEGER) AS is_terminus,
               delay_minutes AS delay_min,
               CASE WHEN date <= DATE '2024-01-20' THEN 'train' WHEN date <= DATE '2024-01-25' THEN 'val' ELSE 'test' END AS split
        FROM stops WINDOW w AS (PARTITION BY service_id ORDER BY scheduled_time, seq)"""),
    "predictions": ("positioned", """
        SELECT *, CAST(p_a >= 0.5 AS INTEGER) AS yp_a, CAST(p_b >= 0.5 AS INTEGER) AS yp_b FROM (
          SELECT *, least(0.999::DOUBLE, greatest(0.001::DOUBLE, 0.7::DOUBLE * y_stop + 0.3::DOUBLE * p_a)) AS p_b FROM (
            SELECT *, ((seq * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE AS p_a FROM positioned))"""),
    "runs": ("predictions", """
        SELECT * EXCLUDE (p_a, yp_a, p_b, yp_b), 'gbt' AS model, 'A' AS scenario, p_a AS p_disrupted, yp_a AS y_pred FROM predictions
        UNION ALL
        SELECT * EXCLUDE (p_a, yp_a, p_b, yp_b), 'gbt', 'B', p_b, yp_b FROM predictions"""),
    "li": ("", """
        SELECT CAST(l_orderkey AS VARCHAR) AS service_id, CAST(l_suppkey AS VARCHAR) AS station_id,
               CAST(o_orderdate AS DATE) AS date, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
               l_quantity - 40 AS delay_minutes, CAST(l_quantity - 40 > 5 AS INTEGER) AS y_stop
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
}


def with_tables(sql: str, *needs: str) -> str:
    """Prefix a statement with the mapped tables it uses."""
    ordered: list[str] = []

    def add(name: str) -> None:
        parent = _CTE[name][0]
        if parent:
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        add(n)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({_CTE[n][1]})" if n in ("stops", "positioned")
                     else f"{n} AS ({_CTE[n][1]})" for n in ordered)
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes}, {sql[5:]}"
    return f"WITH {ctes} {sql}"
