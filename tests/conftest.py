import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from stopflow.session import local_session

    return local_session(8, "stopflow-tests")


@pytest.fixture
def toy(spark):
    """Two services on two days between two stations."""
    stops = spark.sql("""
        SELECT * FROM VALUES
          ('IT_S1', 'IT_AAA', DATE'2024-02-15',  0D, 1, 5.0D, false, TIMESTAMP_NTZ'2024-02-15 08:00:00', 1),
          ('IT_S1', 'IT_BBB', DATE'2024-02-15',  7D, 2, 6.0D, false, TIMESTAMP_NTZ'2024-02-15 09:00:00', 2),
          ('IT_S1', 'IT_AAA', DATE'2024-02-15', 12D, 1, 7.0D, false, TIMESTAMP_NTZ'2024-02-15 10:00:00', 3),
          ('IT_S2', 'IT_AAA', DATE'2024-02-16',  0D, 0, 4.5D, false, TIMESTAMP_NTZ'2024-02-16 08:00:00', 4),
          ('IT_S2', 'IT_BBB', DATE'2024-02-16',  0D, 1, 5.0D, false, TIMESTAMP_NTZ'2024-02-16 09:00:00', 5)
        AS t(service_id, station_id, date, delay_minutes, weather_severity, wind_speed, cancelled, scheduled_time, seq)""")
    return {
        "stops": stops,
        "stations": spark.sql("SELECT * FROM VALUES ('IT_AAA', 45.0D, 9.0D, 2.0D, 4), ('IT_BBB', 45.5D, 9.2D, 3.0D, 2) AS t(station_id, lat, lon, avg_historical_delay, degree)"),
        "edges": spark.sql("SELECT * FROM VALUES ('IT_AAA', 'IT_BBB', 12.0D), ('IT_BBB', 'IT_AAA', 12.0D) AS t(station_from, station_to, distance_km)"),
        "services": spark.sql("SELECT * FROM VALUES ('IT_S1', 2, DATE'2024-02-15', 1), ('IT_S2', 2, DATE'2024-02-16', 0) AS t(service_id, train_class_code, date, is_disrupted)"),
        "betweenness": spark.sql("SELECT * FROM VALUES ('IT_AAA', 0.4D), ('IT_BBB', 0.1D) AS t(station_id, betweenness_centrality)"),
    }
