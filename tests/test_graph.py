import itertools
import random

import pytest

from stopflow.operators import graph as G


def brute_force(nodes, edges):
    """All simple shortest paths by enumeration over a small graph."""
    out = dict.fromkeys(nodes, 0.0)
    adj = {}
    for (u, v), w in edges.items():
        adj.setdefault(u, []).append((v, w))
    for s, t in itertools.permutations(nodes, 2):
        best, paths = float("inf"), []
        stack = [(s, [s], 0.0)]
        while stack:
            u, path, d = stack.pop()
            if d > best:
                continue
            if u == t:
                if d < best:
                    best, paths = d, []
                paths.append(path)
                continue
            stack += [(v, [*path, v], d + w) for v, w in adj.get(u, ()) if v not in path]
        for path in paths:
            for v in path[1:-1]:
                out[v] += 1 / len(paths)
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(8)]
    edges = {(u, v): float(rng.randint(1, 3)) for u, v in itertools.permutations(nodes, 2) if rng.random() < 0.3}
    e = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "station_from string, station_to string, distance_km double")
    n = spark.createDataFrame([(x,) for x in nodes], "station_id string")
    norm = (len(nodes) - 1) * (len(nodes) - 2)
    return e, n, {k: v / norm for k, v in brute_force(nodes, edges).items()}


@pytest.mark.parametrize("hops", [1, 3, 8])
def test_betweenness_by_joins(case, monkeypatch, hops):
    e, n, want = case
    monkeypatch.setattr(G, "HOPS", hops)
    got = {r["station_id"]: r["betweenness_centrality"] for r in G.betweenness(e, n, most_edges=0).collect()}
    assert got == pytest.approx(want)


def test_betweenness(case):
    e, n, want = case
    got = {r["station_id"]: r["betweenness_centrality"] for r in G.betweenness(e, n).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("most_edges", [0, G.EDGES])
def test_betweenness_of_a_long_line(spark, most_edges):
    """No limit on the number of hops: a line of 30 stations, one way."""
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(29)], "station_from string, station_to string, distance_km double")
    n = spark.createDataFrame([(f"n{i:02d}",) for i in range(30)], "station_id string")
    got = {r["station_id"]: r["betweenness_centrality"] for r in G.betweenness(e, n, most_edges).collect()}
    assert got == pytest.approx({f"n{i:02d}": i * (29 - i) / (29 * 28) for i in range(30)})


def test_unreachable_and_isolated_stations(spark):
    e = spark.sql("SELECT * FROM VALUES ('a', 'b', 1D), ('b', 'c', 1D), ('x', 'y', 1D), ('c', 'c', 3D), ('out', 'b', 1D), (null, 'a', 1D) AS t(station_from, station_to, distance_km)")
    n = spark.createDataFrame([(x,) for x in ("a", "b", "c", "alone", "x", "y", "y", "out")], "station_id string")
    for most_edges in (0, G.EDGES):
        got = {r["station_id"]: r["betweenness_centrality"] for r in G.betweenness(e, n, most_edges).collect()}
        assert got == pytest.approx({"a": 0, "b": 2 / 30, "c": 0, "alone": 0, "x": 0, "y": 0, "out": 0})
    empty = G.betweenness(e.limit(0), n).collect()
    assert {r["betweenness_centrality"] for r in empty} == {0.0}


def test_zero_distance_counts_as_one(spark):
    e = spark.sql("SELECT * FROM VALUES ('a', 'b', 0D), ('b', 'c', 0D), ('a', 'c', 5D) AS t(station_from, station_to, distance_km)")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "station_id string")
    got = {r["station_id"]: r["betweenness_centrality"] for r in G.betweenness(e, n).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_lookup_reads_one_bucket_of_each_table(spark, toy, tmp_path):
    from stopflow.operators import kg

    faults = spark.sql("SELECT * FROM VALUES ('f1', DATE'2024-02-15', 'IT_AAA', 'x'), ('f2', DATE'2024-02-02', 'IT_AAA', 'y'), ('f3', DATE'2024-02-01', 'IT_AAA', 'z'), ('f4', DATE'2024-02-16', 'IT_AAA', 'z'), ('f5', null, 'IT_AAA', 'z') AS t(fault_id, date, station_id, description)")
    stops = toy["stops"].selectExpr("*", "1.0D AS temperature", "0.0D AS precipitation", "0.0D AS snow_depth")
    graph = kg.build(toy["stations"], toy["services"], stops, toy["edges"], faults)
    index = kg.index_stations(graph, faults, "lookup_test", str(tmp_path / "index"), buckets=4)
    try:
        found = kg.lookup(spark, index, "IT_AAA", "2024-02-16")
        row = found.first()
        assert (row["recent_faults"], row["n_neighbours"], row["sample_neighbours"], row["degree"]) == (3, 1, ["IT_BBB"], 4)
        assert kg.lookup(spark, index, "IT_AAA", "2024-02-14").first()["recent_faults"] == 2
        assert kg.lookup(spark, index, "IT_BBB", "2024-02-16").first()["recent_faults"] == 0
        assert kg.lookup(spark, index, "nowhere", "2024-02-16").collect() == []
        # the planner may read a pruned bucket as plain files; then its plan does not say which
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        found = kg.lookup(spark, index, "IT_AAA", "2024-02-16")
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert plan.count("SelectedBucketsCount: 1 out of 4") == 3
        assert "hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        for name in (index.stations, index.neighbours, index.faults):
            spark.sql(f"DROP TABLE {name}")


def test_functions_go_to_workers_by_value(tmp_path):
    """A worker has no copy of the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from stopflow.operators import calibration

    for k, thing in enumerate((G.Network, calibration.pool, calibration._pooled)):
        (tmp_path / f"{k}").write_bytes(cloudpickle.dumps(thing))
        code = f"from pyspark import cloudpickle; print(cloudpickle.loads(open({str(tmp_path / str(k))!r}, 'rb').read()).__name__)"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
        assert out.stdout.strip() == thing.__name__
