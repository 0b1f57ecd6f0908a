"""Raw files of three countries to standard tables, store, models and reports."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stopflow.functions import constants as K
from stopflow.operators import guards
from stopflow.plans import country, store, training
from stopflow.sources import readers, sinks

DAYS = [date(2024, 1, 1) + timedelta(days=n) for n in range(0, 180, 3)]


def write(folder, name, header, rows, sep=","):
    folder.mkdir(parents=True, exist_ok=True)
    text = "\n".join(sep.join(f'"{c}"' if isinstance(c, str) and sep in c else str(c) for c in r) for r in [header, *rows])
    (folder / name).write_text(text + "\n")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    raw, rng = tmp_path_factory.mktemp("raw"), random.Random(1)
    delay = lambda: rng.choice([0, 1, 2, 8, 20])
    ops = [(f"T{t}", t, rng.choice(["REG", "FR"]), d, s, n + 1, "N" if n == 0 else "S" if rng.random() < 0.03 else delay(), delay(), "light rain", 3.0)
           for d in DAYS for t in range(2) for n, s in enumerate(("roma ", "Firenze", "BOLOGNA"))]
    write(raw / "it", "ops.csv", ["train_id", "train_number", "train_class", "date", "station_name", "station_order", "arrival_delay", "departure_delay", "weather", "wind_speed"], ops)
    write(raw / "it", "master.csv", ["name", "lat", "lon"], [("Roma", 41.9, 12.5), ("Firenze", 43.7, 11.2)])
    write(raw / "it", "mileage.csv", ["train_id", "station_name", "station_order", "distance"], [("T0", "Roma", 1, "0,0"), ("T0", "Firenze", 2, "250,5"), ("T0", "Bologna", 3, "340,5")])
    trains = []
    for d in DAYS:
        stops = [{"stationShortCode": s, "scheduledTime": f"{d}T0{8 + n}:00:00Z" if n < 2 else f"{d}T10:00:00Z", "differenceInMinutes": delay(), "cancelled": False,
                  "weather_observations": {"Air temperature": float("nan") if rng.random() < 0.2 else 1.5, "Snow depth": rng.choice([0, 20, None])}} for n, s in enumerate(("HKI", "PSL", "TPE"))]
        trains.append((7, d, "IC", "False", str(stops).replace(", ", "; ").replace("; ", ", ")))
    write(raw / "fi", "matched_data_2024_01.csv", ["trainNumber", "departureDate", "trainType", "cancelled", "timeTableRows"], trains)
    nl = [(f"{d:%m%d}{n % 2}", d, "Sprinter", "false", f"{d:%m%d}{n}", s, f"{d}T0{7 + n}:00:00+00:00", delay(), 0, "false", "false", 0) for d in DAYS for n, s in enumerate(("ut", "asd", "ut", "rtd"))]
    header = ["Service:RDT-ID", "Service:Date", "Service:Type", "Service:Completely cancelled", "Stop:RDT-ID", "Stop:Station code", "Stop:Arrival time", "Stop:Arrival delay",
              "Stop:Departure delay", "Stop:Arrival cancelled", "Stop:Departure cancelled", "Service:Maximum delay"]
    write(raw / "nl", "services-2024-01.csv", header, nl)
    write(raw / "nl", "stations.csv", ["code", "geo_lat", "geo_lng"], [("UT", 52.1, 5.1), ("ASD", 52.4, 4.9), ("RTD", 51.9, 4.5)])
    write(raw / "nl", "disruptions.csv", ["rdt_id", "start_time", "cause_en", "cause_group", "rdt_station_codes"],
          [(n, f"{d} 06:00:00", "signal failure", rng.choice(["infrastructure", "staff"]), "UT, ASD") for n, d in enumerate(DAYS)])
    write(raw / "nl", "distances.csv", ["Station", "UT", "ASD", "RTD"], [("UT", "XXX", 40, 57), ("ASD", 40, "XXX", 70), ("RTD", 57, 70, "XXX")])
    csv = lambda p: readers.csv(spark, str(raw / p))
    it = country.italy(readers.operations(spark, str(raw / "it/ops.csv")), csv("it/master.csv"), csv("it/mileage.csv"))
    fi = country.finland(readers.finland(spark, str(raw / "fi")))
    nl = country.netherlands(readers.netherlands_services(spark, str(raw / "nl")), csv("nl/stations.csv"), csv("nl/disruptions.csv"), csv("nl/distances.csv"))
    stored = []
    for name, tables in (("IT", it), ("FI", fi), ("NL", nl)):
        for table, df in tables.items():
            sinks.save_standard(df, str(raw / "tables" / name / table), table)
        stored.append(str(raw / "tables" / name))
    return readers.load_countries(spark, stored)


def test_standard_tables(tables):
    for name, names in K.STANDARD_TABLES.items():
        assert set(names) <= set(tables[name].columns), name
    n = len(DAYS)
    assert tables["edges_stops_at"].count() == n * (6 + 3 + 4)
    assert {r["station_id"] for r in tables["nodes_station"].collect()} == {
        "IT_ROMA", "IT_FIRENZE", "IT_BOLOGNA", "FI_HKI", "FI_PSL", "FI_TPE", "NL_UT", "NL_ASD", "NL_RTD"}
    km = {(r["station_from"], r["station_to"]): r["distance_km"] for r in tables["edges_adjacent"].collect()}
    assert km[("IT_FIRENZE", "IT_ROMA")] == 250.5 and km[("FI_HKI", "FI_PSL")] == 0.0 and km[("NL_RTD", "NL_ASD")] == 70.0
    assert ("FI_HKI", "FI_TPE") not in km
    assert tables["nodes_fault"].where("station_id IS NULL").count() == 0 and tables["nodes_fault"].count() == 2 * n


def test_store_models_and_reports(spark, tables, tmp_path):
    built = store.build(tables, str(tmp_path / "store"))
    assert len(built.columns["A"]) == 37 and len(built.columns["B"]) == 40
    assert set(built.columns["B"]) - set(built.columns["A"]) == set(K.COLUMN_FAMILY["inflight"])
    assert built.rows.count() == len(DAYS) * 13
    means = built.scaled().where("split = 'train'").agg(F.avg("wind_speed_scaled"), F.stddev_pop("cum_distance_km_scaled")).first()
    assert abs(means[0]) < 1e-9 and means[1] == pytest.approx(1.0)
    guards.check_disjoint(built.rows)
    metrics = training.run_matrix(built.rows, str(tmp_path / "runs"), names=("logreg",), rounds=5)
    assert {(r["model"], r["scenario"]) for r in metrics.collect()} == {("logreg", "A"), ("logreg", "B")}
    report = store.evaluation_report(readers.predictions(spark, str(tmp_path / "runs"), "test")).collect()
    assert len(report) == 2 and all(0 <= r["test"]["pr_auc"] <= 1 and len(r["by_country"]) == 3 for r in report)
    tables_out = store.explanation_report(built.rows.where("split = 'test'"), {"wind_speed": 0.1, "stop_order": -0.2}, ["_meta_seq"], ["country"])
    assert tables_out["global"].count() == 2 and tables_out["by_country"].count() == 6
