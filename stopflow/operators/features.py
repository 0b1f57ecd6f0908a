"""Per-stop features.

Within a service everything comes from one ordered scan; across days everything
comes from daily aggregates (one row per key and day), so no window ever sees
more than a key's days. Every history feature reads strictly earlier days of
the same key; the first day of a key gets 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators.scan import Sliced, keyed_scan, tag_slices

SERVICE = ["service_id"]
ORDER = ["scheduled_time", "seq"]


def _zero(c: str | Column) -> Column:
    return F.coalesce(C.col(c), F.lit(0.0))


def _minutes(start: str, end: str) -> Column:
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in (start, end)]
    return (micros[1] - micros[0]) / F.lit(6e7)


# -- inside a service ----------------------------------------------------------

def _position_columns(time: str | None) -> dict[str, Column]:
    n = F.col("_n")
    out = {
        # stops of a service, not rows of a table
        "stop_order": F.col("_rn").cast("int"),
        "n_total_stops": n.cast("int"),
        "position_norm": F.col("_rn") / F.greatest(n - 1, F.lit(1)),
        "is_origin": (F.col("_rn") == 0).cast("int"),
        "is_terminus": (F.col("_rn") == n - 1).cast("int"),
    }
    if time:
        out["cum_scheduled_minutes"] = _zero(_minutes(f"low_{time}", time))
    return out


def stop_position(df: DataFrame, key: Sequence[str] = SERVICE, order: Sequence[str] = ORDER,
                  time: str | None = "scheduled_time") -> DataFrame:
    """Order, count, normalised position, first/last flags, minutes since the first stop."""
    scanned = keyed_scan(tag_slices(df, key, order), order, lows=[time] if time else []).plain
    return scanned.withColumns(_position_columns(time)).drop(f"low_{time}", "_rn", "_n")


def stop_time(df: DataFrame, time: str = "scheduled_time", date: str = "date") -> DataFrame:
    """UTC hour (12 when unknown), weekday Monday=0, month, holiday, month on the circle."""
    angle = F.col("month") * F.lit(2 * math.pi / 12)
    holidays = [F.lit(h).cast("date") for h in K.HOLIDAYS]
    return df.withColumns({
        "scheduled_arrival_hour": F.coalesce(F.hour(time), F.lit(12)),
        "scheduled_arrival_dow": F.weekday(date),
        "month": F.month(date),
        "is_holiday": C.flag(F.col(date).isin(holidays)),
    }).withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)})


STATION_STATIC = ["lat", "lon", "degree", "avg_historical_delay"]


def station_static(df: DataFrame, stations: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """Attributes of the station; an unknown station gets zeros."""
    have = [c for c in STATION_STATIC if c in stations.columns]
    dim = stations.select("station_id", *have)
    if betweenness is not None:
        dim = dim.join(betweenness.select("station_id", "betweenness_centrality"), "station_id", "left")
    else:
        dim = dim.withColumn("betweenness_centrality", F.lit(0.0))
    out = df.drop(*STATION_STATIC, "betweenness_centrality").join(dim, "station_id", "left")
    for c in STATION_STATIC:
        if c not in have:
            out = out.withColumn(c, F.lit(0.0))
    return out.withColumns({c: _zero(F.col(c).cast("double")) for c in [*STATION_STATIC, "betweenness_centrality"]})


def with_segment_km(df: DataFrame, edges: DataFrame, prev: str = "prev_station_id") -> DataFrame:
    """Distance from the previous station, 0 when there is none. The edge list is
    reduced to one row per pair first, so stops never multiply."""
    pairs = edges.where(F.col("station_from").isNotNull() & F.col("station_to").isNotNull()).groupBy(
        F.col("station_from").alias(prev), F.col("station_to").alias("station_id")).agg(
        F.avg("distance_km").alias("_km"))
    return df.join(pairs, [prev, "station_id"], "left").withColumn("seg_km", _zero("_km")).drop("_km")


def service_identity(df: DataFrame, services: DataFrame, edges: DataFrame,
                     key: Sequence[str] = SERVICE, order: Sequence[str] = ORDER,
                     time: str = "scheduled_time") -> DataFrame:
    """Class, country, stop count, route duration and distance, running distance."""
    scanned = keyed_scan(tag_slices(df, key, order), order, prev=["station_id"], lows=[time], tops=[time])
    duration = _zero(_minutes(f"low_{time}", f"top_{time}"))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"service_n_stops": F.col("_n"), "service_scheduled_duration_min": duration})
        return with_segment_km(rows.drop("_rn", "_n", f"low_{time}", f"top_{time}"), edges)

    dim = services.groupBy("service_id").agg(F.min("train_class_code").alias("_class"))
    out = _route(scanned.map(placed), order).join(dim, "service_id", "left")
    return out.withColumns({
        "train_class_code": F.coalesce("_class", F.lit(K.OTHER_CLASS)),
        "country": C.country_of("station_id"),
    }).drop("_class", "prev_station_id", "seg_km")


def _route(sliced: Sliced, order: Sequence[str]) -> DataFrame:
    return keyed_scan(sliced, order, sums=["seg_km"]).plain.withColumns({
        "cum_distance_km": F.col("before_seg_km") + F.col("seg_km"),
        "service_route_distance_km": F.col("total_seg_km"),
    }).drop("before_seg_km", "total_seg_km", "_rn", "_n")


def _delta(c: str) -> Column:
    return _zero(F.col(c).cast("double") - F.col(f"prev_{c}").cast("double"))


def weather_delta(df: DataFrame, key: Sequence[str] = SERVICE, order: Sequence[str] = ORDER,
                  time: str = "scheduled_time") -> DataFrame:
    """Change of severity and wind against the previous stop of the service."""
    scanned = keyed_scan(tag_slices(df, key, order), order, prev=["weather_severity", "wind_speed"]).plain
    return scanned.withColumns({
        "delta_severity_vs_prev_stop": _delta("weather_severity"),
        "delta_wind_vs_prev_stop": _delta("wind_speed"),
    }).drop("prev_weather_severity", "prev_wind_speed", "_rn", "_n")


_INFLIGHT_COLUMNS = {
    "prev_stop_actual_delay": lambda: _zero("prev__d"),
    "cum_actual_delay_so_far": lambda: _zero("before__d"),
    "max_actual_delay_so_far": lambda: F.greatest(F.lit(0.0), _zero("peak__d")),
}


def inflight(df: DataFrame, key: Sequence[str] = SERVICE, order: Sequence[str] = ORDER,
             time: str = "scheduled_time") -> DataFrame:
    """Delay at the previous stop, running sum and running maximum over earlier
    stops. A missing delay counts as 0; the maximum never falls below 0."""
    base = df.withColumn("_d", _zero("delay_minutes"))
    scanned = keyed_scan(tag_slices(base, key, order), order, prev=["_d"], sums=["_d"], peaks=["_d"]).plain
    out = scanned.withColumns({k: v() for k, v in _INFLIGHT_COLUMNS.items()})
    return out.drop("_d", "prev__d", "before__d", "total__d", "peak__d", "_rn", "_n")


def previous_label(df: DataFrame, label: str = "y_stop", key: Sequence[str] = SERVICE,
                   order: Sequence[str] = ("stop_order",)) -> DataFrame:
    """Label of the previous stop; the first stop of a service is dropped."""
    scanned = keyed_scan(tag_slices(df, key, order), order, prev=[label]).plain
    return scanned.where(F.col("_rn") > 0).withColumnRenamed(f"prev_{label}", "prev_y").drop("_rn", "_n")


# -- across days ----------------------------------------------------------------

def day_no(date: str = "date") -> Column:
    return F.unix_date(F.col(date))


def days_before(keys: Sequence[str], first: int, last: int = 1, date: str = "date"):
    """Window over the days [d-first, d-last] of the same key."""
    return Window.partitionBy(*keys).orderBy(day_no(date)).rangeBetween(-first, -last)


def daily_rates(df: DataFrame, keys: Sequence[str], cancelled: str | None = "cancelled") -> DataFrame:
    """One row per key and day: share of late stops, mean delay, number of stops."""
    y = C.late("delay_minutes", cancelled if cancelled in df.columns else None)
    return df.groupBy(*keys, "date").agg(
        F.avg(y).alias("daily_rate"), F.avg("delay_minutes").alias("daily_avg_delay"),
        F.count(F.lit(1)).alias("n_stops"))


def station_lag(daily: DataFrame) -> DataFrame:
    keys = ["station_id"]
    return daily.select(
        "station_id", "date",
        _zero(F.avg("daily_rate").over(days_before(keys, 1))).alias("station_lag1_rate"),
        _zero(F.avg("daily_rate").over(days_before(keys, 7))).alias("station_lag7_rate"),
        _zero(F.avg("daily_avg_delay").over(days_before(keys, 1))).alias("station_lag1_avg_delay"))


def train_lag(daily: DataFrame, key: str = "train_key") -> DataFrame:
    return daily.select(
        key, "date",
        _zero(F.avg("daily_rate").over(days_before([key], 1))).alias("train_lag1_rate"),
        _zero(F.avg("daily_rate").over(days_before([key], 7))).alias("train_lag7_rate"))


def train_station_lag(daily: DataFrame, keys: Sequence[str] = ("train_key", "station_id")) -> DataFrame:
    """Mean over the previous seven *observed* days (rows, not calendar days)."""
    w = Window.partitionBy(*keys).orderBy(day_no()).rowsBetween(-7, -1)
    return daily.select(*keys, "date", _zero(F.avg("daily_rate").over(w)).alias("train_station_lag7_rate"))


def neighbour_lag(lags: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean of the neighbours' lag-1 rate on the same day; a neighbour without
    stops on that day does not count."""
    links = edges.where(F.col("station_from").isNotNull()).select(
        F.col("station_from"), F.col("station_to").alias("station_id"))
    return links.join(lags.select("station_id", "date", "station_lag1_rate"), "station_id").groupBy(
        F.col("station_from").alias("station_id"), "date").agg(
        F.avg("station_lag1_rate").alias("nbr_lag1_rate"))


def fault_count(days: DataFrame, faults: DataFrame, first: int = 14, last: int = 1,
                name: str = "station_n_active_faults_14d",
                calendar: tuple | None = None) -> DataFrame:
    """Faults at the station in [d-first, d-last] for every (station, day) of `days`.

    Faults are counted per day first and meet the stop days in one window, so no
    stop is ever paired with single faults. With a calendar, faults outside it do
    not count and days outside it get 0.
    """
    f = faults.where(F.col("station_id").isNotNull() & F.col("date").isNotNull())
    known = F.lit(True) if calendar is None else F.col("date").between(F.lit(calendar[0]), F.lit(calendar[1]))
    f = f.where(known)
    both = f.select("station_id", "date", F.lit(1).alias("_f"), F.lit(0).alias("_day")).unionByName(
        days.select("station_id", "date", F.lit(0).alias("_f"), F.lit(1).alias("_day")))
    merged = both.groupBy("station_id", "date").agg(F.sum("_f").alias("_f"), F.max("_day").alias("_day"))
    window = F.sum("_f").over(days_before(["station_id"], first, last))
    counted = merged.withColumn(name, F.when(known, F.coalesce(window, F.lit(0))).otherwise(0).cast("double"))
    return counted.where("_day = 1").select("station_id", "date", name)


def attach(df: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of features at (key, date) grain; a missing match means 0."""
    names = [c for c in features.columns if c not in keys]
    return df.join(features, list(keys), "left").withColumns({c: _zero(c) for c in names})


# -- assembly --------------------------------------------------------------------

def assemble(stops: DataFrame, services: DataFrame, stations: DataFrame, edges: DataFrame,
             faults: DataFrame | None = None, betweenness: DataFrame | None = None,
             key: Sequence[str] = SERVICE, order: Sequence[str] = ORDER,
             time: str = "scheduled_time") -> DataFrame:
    """All features from labelled stops. One ordered scan per service serves
    position, weather deltas and inflight features; one join per history grain."""
    base = stops.withColumn("_d", _zero("delay_minutes")).drop("train_class_code", "country")
    scanned = keyed_scan(
        tag_slices(base, key, order), order,
        prev=["station_id", "weather_severity", "wind_speed", "_d"],
        sums=["_d"], peaks=["_d"], lows=[time], tops=[time])
    duration = _zero(_minutes(f"low_{time}", f"top_{time}"))
    derived = {
        **_position_columns(time),
        **{k: v() for k, v in _INFLIGHT_COLUMNS.items()},
        "delta_severity_vs_prev_stop": _delta("weather_severity"),
        "delta_wind_vs_prev_stop": _delta("wind_speed"),
        "service_n_stops": F.col("_n").cast("double"),
        "service_scheduled_duration_min": duration,
    }
    spent = ["_rn", "_n", "_d", "prev__d", "before__d", "total__d", "peak__d", f"low_{time}", f"top_{time}",
             "prev_weather_severity", "prev_wind_speed"]
    placed = scanned.map(lambda rows: with_segment_km(rows.withColumns(derived).drop(*spent), edges))
    routed = _route(placed, order).drop("prev_station_id", "seg_km")

    classes = services.groupBy("service_id").agg(F.min("train_class_code").alias("_class"))
    out = routed.join(classes, "service_id", "left").withColumns({
        "train_class_code": F.coalesce("_class", F.lit(K.OTHER_CLASS)),
        "country": C.country_of("station_id"),
    }).drop("_class")
    out = stop_time(station_static(out, stations, betweenness), time)
    out = out.withColumn("train_key", C.train_key("service_id", "country"))

    keyed = stops.select("service_id", "station_id", "date", "delay_minutes", *[c for c in ("cancelled",) if c in stops.columns],
                         C.train_key("service_id", C.country_of("station_id")).alias("train_key"))
    daily_station = daily_rates(keyed, ["station_id"])
    lags = station_lag(daily_station)
    station_day = lags.join(neighbour_lag(lags, edges), ["station_id", "date"], "left")
    if faults is not None:
        station_day = station_day.join(fault_count(daily_station, faults), ["station_id", "date"], "left")
    else:
        station_day = station_day.withColumn("station_n_active_faults_14d", F.lit(0.0))
    out = attach(out, station_day, ["station_id", "date"])
    # Both train histories meet at their own narrow grain, so that the wide stop
    # rows are shuffled once for them.
    trains = train_station_lag(daily_rates(keyed, ["train_key", "station_id"])).join(
        train_lag(daily_rates(keyed, ["train_key"])), ["train_key", "date"], "left")
    return attach(out, trains, ["train_key", "station_id", "date"]).drop("train_key")


# -- causes ------------------------------------------------------------------------

def cause_features(df: DataFrame) -> DataFrame:
    """Flags, logarithms and interactions for cause prediction."""
    hour, dow, month = (F.col(c) for c in ("scheduled_arrival_hour", "scheduled_arrival_dow", "month"))
    delay = F.greatest(_zero("delay_min"), F.lit(0.0))
    previous = _zero("prev_stop_actual_delay")
    severity = F.coalesce("weather_severity", F.lit(0))
    cls = F.col("train_class_code")
    first = {
        "is_peak_morning": C.flag(hour.between(6, 9)),
        "is_peak_evening": C.flag(hour.between(16, 19)),
        "is_off_peak": C.flag((hour >= 22) | (hour <= 4)),
        "is_weekend": C.flag(dow >= 5),
        "is_monday": C.flag(dow == 0),
        "is_friday": C.flag(dow == 4),
        "is_winter": C.flag((month == 12) | (month <= 2)),
        "is_spring": C.flag(month.between(3, 5)),
        "is_summer": C.flag(month.between(6, 8)),
        "delay_log": F.log1p(delay),
        "delay_severe": C.flag(F.col("delay_min") > 30),
        "delay_extreme": C.flag(F.col("delay_min") > 60),
        "cascade_strong": C.flag(previous > 10),
        "cascade_severe": C.flag(previous > 30),
        "cum_delay_log": F.log1p(F.greatest(_zero("cum_actual_delay_so_far"), F.lit(0.0))),
        "weather_severe": C.flag(severity >= 3),
        "weather_extreme": C.flag(severity == 4),
        "heavy_snow": C.flag(F.col("snow_depth") >= 15),
        "is_local": C.flag(cls == 0),
        "is_highspeed": C.flag(cls >= 4),
        "degree_log": F.log1p(_zero(F.col("degree").cast("double"))),
    }
    return df.withColumns(first).withColumns({
        "winter_x_severe_weather": F.col("is_winter") * F.col("weather_severe"),
        "delay_x_position": F.col("delay_log") * F.col("position_norm"),
    })


# -- calendars and sequences --------------------------------------------------------

def calendar(keys: DataFrame, start, end, name: str = "date") -> DataFrame:
    """Dense key x day grid: every key row repeated for each day of [start, end]."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return keys.select("*", F.explode(days).alias(name))


def rolling_daily(events: DataFrame, date: str, line: str, minutes: str, days: int = 7) -> DataFrame:
    """Daily counts, sums and distinct lines on a gap-free calendar, with a
    trailing mean over `days` days (zero days count)."""
    per_day = events.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("date")).agg(
        F.count(F.lit(1)).alias("fault_count"), F.coalesce(F.sum(minutes), F.lit(0.0)).alias("total_downtime"),
        F.countDistinct(line).alias("lines_affected"))
    span = per_day.agg(F.explode(F.sequence(F.min("date"), F.max("date"), F.expr("interval 1 day"))).alias("date"))
    filled = span.join(per_day, "date", "left").na.fill(0)
    # One row per calendar day: the window is bounded by the length of the log.
    w = Window.orderBy("date").rowsBetween(-(days - 1), 0)
    return filled.withColumn("rolling_mean", F.avg("fault_count").over(w))


def pack_sequences(df: DataFrame, columns: Sequence[str], max_stops: int = 80,
                   key: str = "service_id", order: str = "stop_order") -> DataFrame:
    """Rows of at most `max_stops` ordered steps and their number; a longer
    service goes on on its next page."""
    page = F.floor(F.col(order) / max_stops).cast("long")
    packed = df.groupBy(key, page.alias("page")).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("steps"))
    return packed.withColumn("n_steps", F.size("steps"))


def unpack_scores(packed: DataFrame, stops: DataFrame, score: str,
                  key: str = "service_id", order: str = "stop_order") -> DataFrame:
    """Scores back to stop rows; NULL for a stop that was never packed."""
    flat = packed.select(key, F.explode("steps").alias("s")).select(key, F.col(f"s.{order}").alias(order),
                                                                   F.col(f"s.{score}").alias("sequence_score"))
    return stops.join(flat, [key, order], "left")
