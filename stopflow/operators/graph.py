"""Station graph: index and attributes, betweenness, neighbour aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.session import written


def edge_index(edges: DataFrame, index: DataFrame, key: str = "station_id", number: str = "idx") -> DataFrame:
    """Edges between indexed stations; distance relative to the longest one."""
    src = index.select(F.col(key).alias("station_from"), F.col(number).alias("src"))
    dst = index.select(F.col(key).alias("station_to"), F.col(number).alias("dst"))
    known = edges.join(src, "station_from").join(dst, "station_to").withColumn("km", F.coalesce("distance_km", F.lit(0.0)))
    longest = known.agg(F.max("km")).scalar()
    return known.select("src", "dst", (F.col("km") / F.when(longest > 0, longest).otherwise(F.lit(1.0))).alias("attr"))


def _weighted(edges: DataFrame) -> DataFrame:
    """One weight per directed pair; a missing or zero distance counts as 1."""
    w = F.when(F.coalesce(F.col("distance_km"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("distance_km"))
    return edges.where("station_from IS NOT NULL AND station_to IS NOT NULL AND station_from <> station_to").groupBy(
        F.col("station_from").alias("u"), F.col("station_to").alias("v")).agg(F.min(w).alias("w"))


# Pairs of stations with an edge that every task may hold, at 20 bytes each.
EDGES = 1_000_000
# Sources that a task follows together.
SOURCES = 32


def betweenness(edges: DataFrame, stations: DataFrame, most_edges: int = EDGES) -> DataFrame:
    """Weighted directed betweenness, normalised by (n-1)(n-2).

    Paths of any number of hops count, sources are independent of each other. A
    network of at most `most_edges` edges goes to every task, which then follows
    its sources to the end without a shuffle; a larger one is followed by joins.
    """
    weighted = written(_weighted(edges), "edges")
    n = stations.select("station_id").distinct().count()
    raw = _spread_sources(weighted, stations) if weighted.count() <= most_edges else _dependencies(weighted, stations)
    norm = (n - 1) * (n - 2) if n > 2 else 1
    return stations.select("station_id").distinct().join(raw, "station_id", "left").select(
        "station_id", (F.coalesce("score", F.lit(0.0)) / F.lit(float(norm))).alias("betweenness_centrality"))


class Network:
    """A weighted directed graph as arrays, its edges sorted by head and by tail."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int):
        self.n = n
        order = np.argsort(v, kind="stable")
        self.u, self.v, self.w = u[order], v[order], w[order]
        self.heads, self.first = np.unique(self.v, return_index=True)
        self.by_tail = np.argsort(self.u, kind="stable")
        self.tails, self.first_out = np.unique(self.u[self.by_tail], return_index=True)

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """Of every node from each source. Only edges of nodes that came nearer in
        the last round are followed in the next."""
        d = np.full((len(sources), self.n), np.inf)
        d[np.arange(len(sources)), sources] = 0.0
        moved = np.zeros(self.n, bool)
        moved[sources] = True
        while moved.any():
            some = np.flatnonzero(moved[self.u])
            moved[:] = False
            if not len(some):
                break
            heads, first = np.unique(self.v[some], return_index=True)
            near = np.minimum.reduceat(d[:, self.u[some]] + self.w[some], first, axis=1)
            moved[heads] = (near < d[:, heads]).any(0)
            d[:, heads] = np.minimum(d[:, heads], near)
        return d

    def dependencies(self, sources: np.ndarray) -> np.ndarray:
        """Sum over the sources of each node's share of the shortest paths from
        them to all other nodes, ends not counted."""
        d = self.distances(sources)
        on = (d[:, self.u] + self.w == d[:, self.v]) & np.isfinite(d[:, self.v])
        # walks along the edges of shortest paths: hop by hop until none is open
        paths = np.zeros_like(d)
        paths[np.arange(len(sources)), sources] = 1.0
        step = paths.copy()
        while True:
            after = np.zeros_like(d)
            after[:, self.heads] = np.add.reduceat(np.where(on, step[:, self.u], 0.0), self.first, axis=1)
            if not after.any():
                break
            paths += after
            step = after
        share = np.where(on, paths[:, self.u] / np.where(on, paths[:, self.v], 1.0), 0.0)[:, self.by_tail]
        back = self.v[self.by_tail]
        step = np.isfinite(d).astype(float)
        total = np.zeros_like(d)
        while True:
            after = np.zeros_like(d)
            after[:, self.tails] = np.add.reduceat(share * step[:, back], self.first_out, axis=1)
            if not after.any():
                break
            total += after
            step = after
        total[np.arange(len(sources)), sources] = 0.0
        return total.sum(0)


def _spread_sources(weighted: DataFrame, stations: DataFrame, together: int = SOURCES) -> DataFrame:
    """Sum over all sources of a node's dependency, the sources dealt out to tasks
    and the edges, whose number the caller has checked, sent to each of them."""
    spark = stations.sparkSession
    edges = weighted.select("u", "v", "w").toArrow()
    # nodes by name; an isolated station is on no path
    names = np.unique(np.concatenate((edges["u"].to_numpy(), edges["v"].to_numpy()))) if len(edges) else np.zeros(0, object)
    shipped = spark.sparkContext.broadcast((names, np.searchsorted(names, edges["u"].to_numpy()), np.searchsorted(names, edges["v"].to_numpy()), edges["w"].to_numpy()))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, u, v, w = shipped.value
        network, total = Network(u, v, w, len(names)), np.zeros(len(names))
        for batch in batches:
            sources = batch.column("station_id").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(names, sources), len(names) - 1)
            at = at[names[at] == sources]
            for k in range(0, len(at), together):
                total += network.dependencies(at[k:k + together])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.string()), pa.array(total[some])], ["station_id", "score"])

    if not len(names):
        return spark.createDataFrame([], "station_id string, score double")
    sources = stations.where("station_id IS NOT NULL").select(F.col("station_id").cast("string").alias("station_id")).distinct()
    tasks = min(-(-len(names) // together) * 4, 4096)
    return sources.repartition(tasks, "station_id").mapInArrow(follow, "station_id string, score double").groupBy("station_id").agg(F.sum("score").alias("score"))


# Hops that one job follows before it writes its state.
HOPS = 16


def _dependencies(weighted: DataFrame, stations: DataFrame) -> DataFrame:
    """Sum over all sources of a node's dependency, by joins: distances by
    relaxation, then path counts and dependencies over the shortest-path edges,
    HOPS at a time until nothing moves. Positive weights end every loop. State
    is one row per (source, node), partitioned by source; where Spark finds the
    written edges small enough to send them round, hops need no shuffle.
    """
    nodes = stations.select(F.col("station_id").alias("s")).distinct()
    # an edge from each node to itself keeps what is known already
    stay = nodes.select(F.col("s").alias("u"), F.col("s").alias("v"), F.lit(0.0).alias("w"))
    ends = weighted.select("v").distinct().select(F.col("v").alias("u"), "v", F.lit(0.0).alias("w"))
    steps = written(weighted.unionByName(stay.union(ends).distinct()), "steps")
    dist = written(nodes.select("s", F.col("s").alias("u"), F.lit(0.0).alias("d")), "distances")
    moved = True
    while moved:
        after = dist.repartition("s")
        for _ in range(HOPS):
            after = after.join(steps, "u").groupBy("s", F.col("v").alias("u")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        after = written(after, "distances")
        moved = not after.join(dist.withColumnRenamed("d", "_old"), ["s", "u"], "left").where("_old IS NULL OR d < _old").isEmpty()
        dist = after
    head = dist.select("s", F.col("u").alias("v"), F.col("d").alias("dv"))
    dag = written(dist.join(weighted, "u").join(head, ["s", "v"]).where("d + w = dv").select("s", "u", "v"), "dag")

    pairs = dist.select("s", "u")

    def follow(start: DataFrame, edges: DataFrame) -> DataFrame:
        """Sum per (s, u) of x over all walks along the edges, those of no step
        included. `open` rows go on, and every one leaves a copy behind."""
        kinds = [pairs.select("s", "u", F.col("u").alias("v"), F.lit(1.0).alias("r"), F.lit(was).alias("open"), F.lit(False).alias("after")) for was in (True, False)]
        moves = written(edges.select("s", "u", "v", "r", F.lit(True).alias("open"), F.lit(True).alias("after")).union(kinds[0]).union(kinds[1]), "moves")
        state = start.withColumn("open", F.lit(True))
        while True:
            state = state.repartition("s")
            for _ in range(HOPS):
                state = state.join(moves, ["s", "u", "open"]).groupBy("s", F.col("v").alias("u"), F.col("after").alias("open")).agg(F.sum(F.col("x") * F.col("r")).alias("x"))
            state = written(state, "state")
            if state.where("open").isEmpty():
                return state.select("s", "u", "x")

    begin = nodes.select("s", F.col("s").alias("u"), F.lit(1.0).alias("x"))
    counts = written(follow(begin, dag.withColumn("r", F.lit(1.0))).withColumnRenamed("x", "c"), "counts")
    into = counts.select("s", F.col("u").alias("v"), F.col("c").alias("cv"))
    # from a node back to the one before it, with its share of the paths
    back = dag.join(counts, ["s", "u"]).join(into, ["s", "v"]).select("s", F.col("v").alias("u"), F.col("u").alias("v"), (F.col("c") / F.col("cv")).alias("r"))
    shares = follow(counts.select("s", "u", F.lit(1.0).alias("x")), back)
    return shares.where("s <> u").groupBy(F.col("u").alias("station_id")).agg(F.sum(F.col("x") - 1).alias("score"))


def neighbour_means(nodes: DataFrame, edges: DataFrame, columns: Sequence[str], layers: int = 2,
                    key: str = "station_id") -> DataFrame:
    """Mean of the neighbours' features, layer upon layer: `h0_*` are the node's
    own values, `h1_*` the neighbours' means, `h2_*` the means of those."""
    out = nodes.select(key, *[F.col(c).cast("double").alias(f"h0_{c}") for c in columns])
    links = edges.select(F.col("station_from").alias(key), F.col("station_to").alias("_to")).distinct()
    layer = out
    for n in range(1, layers + 1):
        source = layer.select(F.col(key).alias("_to"), *[F.col(f"h{n - 1}_{c}") for c in columns])
        layer = links.join(source, "_to").groupBy(key).agg(
            *[F.avg(f"h{n - 1}_{c}").alias(f"h{n}_{c}") for c in columns])
        layer = out.select(key).join(layer, key, "left").na.fill(0.0)
        out = out.join(layer, key)
    return out
