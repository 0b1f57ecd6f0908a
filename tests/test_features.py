import pytest
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators import features as feat


def column(df, name, order="seq"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_position(toy):
    df = feat.stop_position(toy["stops"])
    assert column(df, "stop_order") == [0, 1, 2, 0, 1]
    assert column(df, "position_norm") == [0, 0.5, 1, 0, 1]
    assert column(df, "is_origin") == [1, 0, 0, 1, 0]
    assert column(df, "is_terminus") == [0, 0, 1, 0, 1]
    assert column(df, "cum_scheduled_minutes") == [0, 60, 120, 0, 60]


def test_assembled_toy_values(toy):
    df = feat.assemble(toy["stops"].withColumn("y_stop", C.late("delay_minutes", "cancelled")).withColumns(
        {c: F.lit(None).cast("double") for c in ("temperature", "precipitation", "snow_depth")}),
        toy["services"], toy["stations"], toy["edges"], None, toy["betweenness"])
    assert df.count() == 5
    assert column(df, "cum_distance_km") == [0, 12, 24, 0, 12]
    assert column(df, "service_route_distance_km") == [24, 24, 24, 12, 12]
    assert column(df, "service_scheduled_duration_min") == [120, 120, 120, 60, 60]
    assert column(df, "delta_wind_vs_prev_stop") == [0, 1, 1, 0, 0.5]
    assert column(df, "delta_severity_vs_prev_stop") == [0, 1, -1, 0, 1]
    assert column(df, "prev_stop_actual_delay") == [0, 0, 7, 0, 0]
    assert column(df, "cum_actual_delay_so_far") == [0, 0, 7, 0, 0]
    assert column(df, "max_actual_delay_so_far") == [0, 0, 7, 0, 0]
    assert column(df, "station_lag1_rate") == [0, 0, 0, 0.5, 1.0]
    assert column(df, "nbr_lag1_rate") == [0, 0, 0, 1.0, 0.5]
    assert column(df, "betweenness_centrality") == [0.4, 0.1, 0.4, 0.4, 0.1]
    assert column(df, "train_class_code") == [2] * 5
    assert column(df, "country") == ["IT"] * 5


def lag_rows(spark, rows):
    return spark.createDataFrame(rows, "station_id string, date string, delay_minutes double").withColumn("date", F.to_date("date"))


def test_lag_is_strictly_before_the_day(spark):
    rows = [("ST_X", f"2024-02-0{d}", 30.0 if i < late else 0.0) for d, late in ((1, 4), (2, 0), (3, 2)) for i in range(4)]
    lags = feat.station_lag(feat.daily_rates(lag_rows(spark, rows), ["station_id"]))
    assert column(lags, "station_lag1_rate", "date") == [0, 1.0, 0.0]
    assert column(lags, "station_lag7_rate", "date") == [0, 1.0, 0.5]


def test_changing_a_day_leaves_its_own_lags_alone(spark):
    rows = [("ST_X", f"2024-02-0{d}", float(d)) for d in range(1, 6)]
    changed = [(s, d, 99.0 if d.endswith("03") else v) for s, d, v in rows]
    a, b = ({r["date"]: r for r in feat.station_lag(feat.daily_rates(lag_rows(spark, x), ["station_id"])).collect()} for x in (rows, changed))
    for day in a:
        if day.day <= 3:
            assert a[day] == b[day]
    assert a != b


def test_first_day_of_a_key_does_not_take_over_another_key(spark):
    rows = [("A", "2024-02-01", 30.0), ("A", "2024-02-02", 30.0), ("B", "2024-02-01", 30.0), ("B", "2024-02-02", 0.0)]
    daily = feat.daily_rates(lag_rows(spark, rows), ["station_id"])
    lags = {(r["station_id"], r["date"].day): r["station_lag7_rate"] for r in feat.station_lag(daily).collect()}
    assert lags[("A", 1)] == 0 and lags[("B", 1)] == 0
    by_row = feat.train_station_lag(daily.withColumn("train_key", F.lit("t")))
    first = {(r["station_id"], r["date"].day): r["train_station_lag7_rate"] for r in by_row.collect()}
    assert first[("B", 1)] == 0 and first[("B", 2)] == 1.0


def test_gaps_skip_days_but_observed_days_do_not(spark):
    rows = [("A", "2024-02-01", 30.0), ("A", "2024-02-20", 0.0)]
    daily = feat.daily_rates(lag_rows(spark, rows), ["station_id"])
    assert column(feat.station_lag(daily), "station_lag7_rate", "date") == [0, 0]
    assert column(feat.train_station_lag(daily.withColumn("train_key", F.lit("t"))), "train_station_lag7_rate", "date") == [0, 1.0]


def test_running_maximum_never_falls_below_zero(spark):
    df = spark.sql("SELECT * FROM VALUES ('s', 0, -4D), ('s', 1, -2D), ('s', 2, null), ('s', 3, 3D) AS t(service_id, seq, delay_minutes)")
    out = feat.inflight(df, order=["seq"])
    assert column(out, "max_actual_delay_so_far") == [0, 0, 0, 0]
    assert column(out, "cum_actual_delay_so_far") == [0, -4, -6, -6]
    assert column(out, "prev_stop_actual_delay") == [0, -4, -2, 0]


def test_inflight_toy(spark):
    df = spark.sql("SELECT * FROM VALUES ('s', 0, 3D), ('s', 1, 7D), ('s', 2, 12D) AS t(service_id, seq, delay_minutes)")
    out = feat.inflight(df, order=["seq"])
    assert column(out, "prev_stop_actual_delay") == [0, 3, 7]


@pytest.mark.parametrize("last, expected", [(1, 2), (0, 3)])
def test_fault_windows(spark, last, expected):
    days = spark.sql("SELECT 'A' AS station_id, DATE'2024-03-20' AS date")
    faults = spark.sql("""SELECT * FROM VALUES ('A', DATE'2024-03-20'), ('A', DATE'2024-03-19'), ('A', DATE'2024-03-06'), ('A', DATE'2024-03-05'),
                          ('B', DATE'2024-03-19'), (null, DATE'2024-03-19') AS t(station_id, date)""")
    assert feat.fault_count(days, faults, 14, last, "n").first()["n"] == expected


def test_unknown_hour_is_noon(spark):
    df = spark.sql("SELECT CAST(null AS TIMESTAMP_NTZ) AS scheduled_time, DATE'2024-05-01' AS date")
    row = feat.stop_time(df).first()
    assert (row["scheduled_arrival_hour"], row["is_holiday"], row["scheduled_arrival_dow"]) == (12, 1, 2)


def test_pack_and_unpack(spark):
    df = spark.range(5).selectExpr("'s' AS service_id", "CAST(id AS INT) AS stop_order", "id / 10.0D AS p")
    packed = feat.pack_sequences(df, ["p"], max_stops=3)
    assert column(packed, "n_steps", "page") == [3, 2]
    back = feat.unpack_scores(packed, df, "p")
    assert column(back, "sequence_score", "stop_order") == [0.0, 0.1, 0.2, 0.3, 0.4]
