"""Leakage rules, splits, parsing, sources: contracts and small frames."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators import builders as B
from stopflow.operators import guards, impute, parse
from stopflow.operators import splits as S
from stopflow.sources import readers, schemas


def test_scenario_a_bans_more_than_b():
    assert guards.banned("B") < guards.banned("A")
    assert set(K.COLUMN_FAMILY["inflight"]) == guards.banned("A") - guards.banned("B")
    with pytest.raises(ValueError):
        guards.banned("C")


@pytest.mark.parametrize("name", ["y_stop", "delay_minutes", "cancelled", "final_delay"])
def test_outcomes_are_banned_everywhere(name):
    for scenario in "AB":
        with pytest.raises(ValueError, match="Leakage"):
            guards.check_no_leak(["stop_order", name], scenario)


def test_inflight_is_legal_in_b_only():
    columns = ["stop_order", *K.COLUMN_FAMILY["inflight"], "_meta_run", "y_stop"]
    assert guards.legal_columns(columns, "A") == ["stop_order"]
    assert guards.legal_columns(columns, "B") == ["stop_order", *K.COLUMN_FAMILY["inflight"]]


def test_history_columns():
    assert [c for c in ("station_lag7_rate", "nbr_lag1_rate", "stop_order", "prev_stop_actual_delay", "degree") if guards.is_history_column(c)] == [
        "station_lag7_rate", "nbr_lag1_rate", "prev_stop_actual_delay"]


def split_rows(spark, extra=()):
    rows = [(f"S_{m}_{i}", date(2024, m, d)) for m, d in ((2, 15), (5, 10), (6, 15)) for i in range(2)]
    return spark.createDataFrame([*rows, *extra], "service_id string, date date")


def test_splits_are_complete_and_disjoint(spark):
    df = S.with_split(split_rows(spark, [("late", date(2024, 7, 1))]))
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 2, "val": 2, "test": 2}
    guards.check_disjoint(df)


def test_service_in_two_splits_raises(spark):
    with pytest.raises(AssertionError):
        guards.check_disjoint(S.with_split(split_rows(spark, [("S_2_0", date(2024, 5, 1))])))


def test_rolling_folds_train_before_val(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-04-28', interval 1 day)) AS date")
    folds = S.rolling_folds(df, 4).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("t"), F.min(F.when(F.col("role") == "val", F.col("date"))).alias("v"))
    rows = folds.orderBy("fold").collect()
    assert len(rows) == 4 and all((r["v"] - r["t"]).days == 1 for r in rows)


def test_scaler_ignores_missing_and_constant(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 5D), (3D, 5D), (null, 5D) AS t(a, b)")
    out = S.scale(df, S.scaler_statistics(df, ["a", "b"]), ["a", "b"])
    assert sorted((r["a_scaled"], r["b_scaled"]) for r in out.where("a IS NOT NULL").collect()) == [(-1, 0), (1, 0)]
    assert out.where("a IS NULL").first()["a_scaled"] is None


def test_dense_index_is_sorted_and_dense(spark):
    df = spark.range(1000).selectExpr("concat('IT_', id % 300) AS s")
    rows = S.dense_index(df, "s", "i").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(300)) and [r["s"] for r in rows] == sorted(r["s"] for r in rows)


def test_delay_sentinels(spark):
    df = spark.createDataFrame([("N",), ("S",), (" 7 ",), ("3.5",), ("abc",), (None,)], "x string")
    got = df.select(C.delay_value("x").alias("v"), C.delay_cancelled("x").alias("c")).collect()
    assert [(r["v"], r["c"]) for r in got] == [(None, False), (None, True), (7.0, False), (3.5, False), (None, False), (None, False)]


def test_severity_cuts(spark):
    df = spark.sql("""SELECT * FROM VALUES (0.4D, 0D, 500D), (0.5D, 0D, 500D), (2D, 0D, 500D), (5D, 0D, 500D), (0D, 5D, 500D), (0D, 15D, 500D), (0D, 40D, 500D),
                      (0D, 0D, 199D), (null, null, null), (5D, 5D, 500D) AS t(p, s, v)""")
    got = [r[0] for r in df.select(C.weather_severity("p", "s", "v")).collect()]
    assert got == [0, 1, 2, 3, 2, 3, 4, 3, 0, 3]


def test_position_cut_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5, 0.75, 1.0)], "x double")
    assert [r[0] for r in df.select(C.position_bucket("x")).collect()] == ["0-25", "0-25", "25-50", "50-75", "75-100"]


def test_nested_stop_lists(spark):
    cells = [
        ("ok", "[{'stationShortCode': 'HKI', 'differenceInMinutes': nan, 'cancelled': True, 'weather_observations': {'Air temperature': -3.5, 'Snow depth': None}}, {'stationShortCode': 'PSL', 'differenceInMinutes': 4}]"),
        ("single", "{'stationShortCode': 'TPE', 'differenceInMinutes': 1}"),
        ("broken", "[{'stationShortCode': 'X'"), ("blank", "  "), ("nan", "nan"), ("null", None)]
    df = spark.createDataFrame(cells, "trainNumber string, timeTableRows string").withColumn("cancelled", F.lit("false"))
    parsed = parse.with_stops(df)
    assert {r["trainNumber"]: r["parse_status"] for r in parsed.collect()} == {
        "ok": "success", "single": "success", "broken": "parse_error", "blank": "empty", "nan": "empty", "null": "empty"}
    rows = {(r["train_number"], r["station_code"]): r for r in parse.explode_stops(parsed).collect()}
    assert len(rows) == 7
    first = rows[("ok", "HKI")]
    assert (first["delay_minutes"], first["cancelled"], first["air_temp"], first["snow_depth"]) == (None, "true", "-3.5", None)
    assert rows[("broken", None)]["cancelled"] == "false"


def test_weather_default_marks_missing(spark):
    stops = spark.sql("SELECT 'A' AS station_code, DATE'2024-01-01' AS date UNION ALL SELECT 'B', DATE'2024-01-01'")
    weather = spark.sql("SELECT 'a' AS station_code, '2024-01-01' AS date, '1.5' AS temperature, '2' AS wind_speed, 'x' AS precipitation, '50' AS snow_depth, 1 AS seq")
    rows = {r["station_code"]: r for r in B.join_weather(stops, B.weather_by_station(weather)).collect()}
    assert (rows["A"]["temperature"], rows["A"]["weather_severity"], rows["A"]["weather_observed"]) == (1.5, 4, 1)
    assert (rows["B"]["temperature"], rows["B"]["weather_severity"], rows["B"]["weather_observed"]) == (10.0, 0, 0)


def test_month_without_train_rows_takes_overall_median(spark):
    df = spark.sql("""SELECT * FROM VALUES (DATE'2024-01-01', 1D), (DATE'2024-01-02', 3D), (DATE'2024-02-01', 10D), (DATE'2024-05-01', null), (DATE'2024-01-09', null) AS t(d, x)""")
    got = {r["d"]: r["x"] for r in impute.monthly_median_fill(df, ["x"], "d").collect()}
    assert got[date(2024, 5, 1)] == 3.0 and got[date(2024, 1, 9)] == 2.0


def test_standard_schemas(spark):
    empty = schemas.empty_faults(spark)
    assert empty.columns == K.STANDARD_TABLES["nodes_fault"]
    assert schemas.missing_columns(empty.drop("description"), "nodes_fault") == ["description"]
    with pytest.raises(ValueError):
        schemas.validate(empty.drop("date"), "nodes_fault", strict=True)


def test_four_tables_are_required(spark, tmp_path):
    spark.sql("SELECT 'A' AS station_id, 1.0D AS lat, 1.0D AS lon, 0.0D AS avg_historical_delay, 1 AS degree").write.parquet(str(tmp_path / "IT/nodes_station"))
    with pytest.raises(FileNotFoundError):
        readers.load_countries(spark, [str(tmp_path / "IT")])


def test_declared_types_follow_names_not_positions(spark, tmp_path):
    spark.sql("SELECT 'x' AS extra, '7' AS train_number, '2024-01-02' AS date").write.option("header", True).csv(str(tmp_path / "ops"))
    row = readers.csv(spark, str(tmp_path / "ops"), schemas.OPERATIONS).first()
    assert (row["extra"], row["train_number"], row["date"]) == ("x", 7, date(2024, 1, 2))


def test_partition_sizing():
    from stopflow.session import options_for

    small, large = options_for(10_000_000, 8), options_for(100 * 10**12, 8000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(large["spark.sql.shuffle.partitions"]) * 256 * 1024**2 >= 100 * 10**12


def test_bucketed_stops_need_no_shuffle(spark, toy, tmp_path):
    from stopflow.operators import features as feat
    from stopflow.sources.sinks import save_bucketed

    save_bucketed(toy["stops"], "stops_by_service", str(tmp_path / "b"), "service_id", 4, ["service_id", "scheduled_time", "seq"])
    plan = feat.inflight(spark.table("stops_by_service"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    spark.sql("DROP TABLE stops_by_service")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from datetime import date as day

    from stopflow.sources import readers as r

    path = str(tmp_path / "stops")
    spark.range(10).selectExpr("id AS seq", "DATE'2024-01-05' AS date", "1.0D AS a", "2.0D AS b").write.parquet(path)
    plan = r.columns(spark, path, ["seq", "date"]).where(r.in_window("date", day(2024, 1, 1), day(2024, 1, 31)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "ReadSchema: struct<seq:bigint,date:date>" in plan


def test_landed_files_against_a_manifest(spark, tmp_path):
    for folder in ("sent", "landed"):
        (tmp_path / folder).mkdir()
    for name, text in {"a.csv": "1,2\n3,4\n", "b.csv": "5,6\n", "c.csv": "", "gone.csv": "x\n"}.items():
        (tmp_path / "sent" / name).write_text(text)
    for name, text in {"a.csv": "1,2\n3,4\n", "b.csv": "5,7\n", "c.csv": "more\n"}.items():
        (tmp_path / "landed" / name).write_text(text)
    manifest = readers.fingerprints(spark, str(tmp_path / "sent"))
    rows = {r["file"]: (r["size_ok"], r["content_ok"]) for r in readers.verify_files(spark, str(tmp_path / "landed"), manifest).collect()}
    assert rows == {"a.csv": (1, 1), "b.csv": (1, 0), "gone.csv": (0, 0)}


def test_stream_log_holds_every_batch(spark, tmp_path):
    from stopflow.streaming.ingest import load, operations_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        (folder / f"f{i}.csv").write_text(f"seq,date\n{i},2024-01-0{i + 1}\n{i},2023-01-01\n")
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("date", T.DateType())])
        stream = operations_stream(spark, str(folder), schema, files_per_batch=1)
        log = load(stream, str(tmp_path / "out"), str(tmp_path / "offsets")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
    assert [(r["raw_rows"], r["kept_rows"]) for r in sorted(log, key=lambda r: r["batch"])] == [(2, 1)] * 6
    assert max(r["cum_kept"] for r in log) == 6 == spark.read.parquet(str(tmp_path / "out")).count()


def test_words_inside_strings_stay(spark):
    from stopflow.operators import parse

    cells = [
        ("[{'stationShortCode': 'None', 'type': 'is True or None', 'differenceInMinutes': nan, 'cancelled': True}]", ("None", "is True or None", None, "true")),
        ("""{'stationShortCode': "K'nan", 'type': "False", 'differenceInMinutes': None, 'cancelled': False}""", ("K'nan", "False", None, "false")),
        (r"""{'stationShortCode': 'it\'s None', 'type': 'a "nan" b', 'differenceInMinutes': 3}""", ("it's None", 'a "nan" b', "3", None)),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cells] + [("[{'stationShortCode': 'x', 'type': None",)], "timeTableRows string")
    rows = parse.with_stops(df).collect()
    for row, (_, want) in zip(rows, cells):
        s = row["_stops"][0]
        assert (s["stationShortCode"], s["type"], s["differenceInMinutes"], s["cancelled"]) == want
    assert [r["parse_status"] for r in rows] == ["success"] * 3 + ["parse_error"]


@pytest.mark.parametrize("n", [1, 7, 500, 5000])
def test_sample_is_the_smallest_hashes(spark, n):
    from hashlib import md5

    df = spark.range(3000).selectExpr("id AS seq", "id % 7 AS v").repartition(6)
    want = sorted(range(3000), key=lambda i: (md5(f"{i}|42".encode()).hexdigest(), i))[:n]
    assert sorted(r["seq"] for r in S.sample_rows(df, n, ["seq"]).collect()) == sorted(want)
