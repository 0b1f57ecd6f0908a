"""Embedding near-duplicates: an exact metric range join over cells of pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.frames import components, stored

COSINE = 0.9
# Numbers of pivots to choose from, and the vectors on which the choice is made.
PIVOTS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
SAMPLE = 2048
# Vectors of one side of a task's block.
BLOCK = 8192
# Single-precision products are this close to the true ones; nearer ones are computed again.
CLOSE = 1e-4


def usable(vec: str = "embedding") -> F.Column:
    """Neither null nor zero, and all components finite."""
    c = F.col(vec)
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(c, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no
    square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def reach(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector, and the cells that a ball of this radius
    around it can touch.

    A point of cell j is at least as near to pivot j as to the own pivot i, so by
    the triangle inequality a vector whose distance from the plane between them
    is above the radius has no partner there. That distance is (d_j^2 - d_i^2)
    / (2 d_ij)."""
    d2 = np.maximum(0, 2 - 2 * units @ pivots.T)
    own = d2.argmin(1)
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[own]
    far = d2 - d2[np.arange(len(units)), own][:, None] > 2 * (radius + 1e-6) * between
    return own, ~far


def choose(sample: np.ndarray, vectors: int, radius: float, cost_of_copy: float = 2000.0) -> np.ndarray:
    """Pivots for a join of so many vectors: as many of the sample as make the
    products plus the copies cheapest. A copy to another cell is taken to cost
    as much as so many products; each vector is multiplied with what its cell
    holds, as measured on the sample."""
    best, best_cost = sample[:1], math.inf
    half = len(sample) // 2
    for n in PIVOTS:
        if n > max(1, half):
            break
        own, touches = reach(sample[half:], sample[:n], radius)
        cells = np.bincount(own, minlength=n) / len(own)
        held = touches.mean(0)
        cost = vectors * (cells * held).sum() + cost_of_copy * touches.sum(1).mean()
        if cost < best_cost:
            best, best_cost = sample[:n], cost
    return best


def _forest(rows: np.ndarray, cols: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that tie together what the pairs left[rows], right[cols] tie,
    at most one per vector."""
    ids, both = np.unique(np.concatenate((left[rows], right[cols])), return_inverse=True)
    a, b = both[:len(rows)], both[len(rows):]
    parent = np.arange(len(ids))
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            break
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    moved = parent != np.arange(len(ids))
    return ids[parent[moved]], ids[moved]


def compare(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y (unit length, double precision) have at least this
    cosine: single-precision products, computed again in double precision where
    they are close to the bound."""
    dots = x.astype(np.float32) @ y.astype(np.float32).T
    hit = dots >= cosine
    if float(dots.max(initial=-2)) >= cosine - CLOSE:
        i, j = np.nonzero(np.abs(dots - np.float32(cosine)) <= CLOSE)
        for k in range(0, len(i), 100_000):
            a, b = i[k:k + 100_000], j[k:k + 100_000]
            hit[a, b] = (x[a] * y[b]).sum(1) >= cosine
    return hit


def link(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vec: str = "embedding", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: other vectors with a
    cosine of at least `cosine`, and the smallest id that links reach.

    Vectors that are null, empty, zero or not finite, and rows without an id,
    are linked with nothing; vectors of different lengths neither. Every row is
    a vector of its own and gives one row, also if it shares its id with others:
    links count rows, and an id reaches what any of its rows reaches only if a
    link does. Equal vectors are one class and compared once. A class lies in
    the cell of its nearest pivot and is copied to every cell of a smaller
    number that the radius can touch; a cell compares its own classes with each
    other and with the copies, so each pair meets once. Cells are cut into
    blocks of at most `block` rows a side, as many as its rows need, so one cell
    may hold any share of the rows. A block hands on counts and a forest of its
    links, never the pairs.

    Pivots come from `sample` vectors with the smallest hash, the only thing
    taken from a part of the data; the result does not depend on them.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    radius = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    # a row finds its class by 128 bits of its vector; ids may repeat
    digest = [F.xxhash64("v").alias("d1"), F.xxhash64(F.lit(1), F.col("v")).alias("d2")]
    good = F.col("vec_id").isNotNull() & usable("v")
    classes = rows.where(good).groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # numbered when they are written, once
    groups = stored(classes.select(F.monotonically_increasing_id().alias("id"), "v", "least", "n", *digest), "classes")
    heads = groups.orderBy("d1", "d2").limit(sample).select("v").toArrow().column("v").combine_chunks()
    by_length: dict[int, list] = {}
    for v in heads.to_pylist():
        by_length.setdefault(len(v), []).append(v)
    total = groups.count()
    pivots = {n: choose(_unit(np.asarray(v)), total, radius) for n, v in by_length.items()}
    shipped = vectors.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(v) for v in b.column("v")], np.int64)
            for length in np.unique(lengths):
                part = b.take(pa.array(np.flatnonzero(lengths == length)))
                p = shipped.value.get(int(length))
                if p is None:
                    own, touches = np.zeros(len(part), np.int64), np.ones((len(part), 1), bool)
                else:
                    own, touches = reach(_unit(_matrix(part.column("v"))), p, radius)
                touches &= np.arange(touches.shape[1]) <= own[:, None]
                i, cell = np.nonzero(touches)
                some = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), length), pa.int64()), pa.array(cell, pa.int64()), pa.array(own[i] == cell), *[some.column(c) for c in ("id", "n", "v")]], ["length", "cell", "own", "id", "n", "v"])

    dealt = groups.mapInArrow(deal, f"length long, cell long, own boolean, id long, n long, v {kind}")
    # sizes of the cells: at most as many rows as pivots
    sizes = stored(dealt.groupBy("length", "cell").agg(F.sum(F.col("own").cast("long")).alias("owned"), F.count("*").alias("held")), "cells")
    cut = sizes.select("length", "cell", F.ceil(F.col("owned") / block).alias("p"), F.ceil(F.col("held") / block).alias("q")).where("p > 0")
    placed = dealt.join(F.broadcast(cut), ["length", "cell"]).withColumn("h", F.xxhash64("id"))
    # own classes of part i meet all parts j >= i of the own ones and all parts of the copies
    i, j = F.expr("cast(pmod(h, p) as int)"), F.expr("cast(pmod(h, q) as int)")
    left = placed.where("own").withColumn("side", F.lit(0)).withColumn("i", i).withColumn("j", F.explode(F.expr("sequence(0, cast(q as int) - 1)")))
    right = placed.withColumn("side", F.lit(1)).withColumn("j", j).withColumn("i", F.explode(F.expr("sequence(0, cast(p as int) - 1)")))
    columns = ["length", "cell", "i", "j", "side", "own", "id", "n", "v"]

    def join(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        v = _unit(_matrix(table.column("v").combine_chunks()))
        ids, n, own = (table.column(c).to_numpy() for c in ("id", "n", "own"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        count = np.zeros(len(side), np.int64)
        ends_a, ends_b = [], []
        for s in range(0, len(a), 1024):
            for t in range(0, len(b), 2048):
                x, y = a[s:s + 1024], b[t:t + 2048]
                hit = compare(v[x], v[y], cosine)
                if not hit.any():
                    continue
                # two own classes meet twice, once on either side: the smaller id counts
                r, c = np.nonzero(hit)
                keep = ~own[y][c] | (ids[x][r] < ids[y][c])
                r, c = r[keep], c[keep]
                if len(r):
                    count[x] += np.bincount(r, weights=n[y][c], minlength=len(x)).astype(np.int64)
                    count[y] += np.bincount(c, weights=n[x][r], minlength=len(y)).astype(np.int64)
                    e = _forest(r, c, ids[x], ids[y])
                    ends_a.append(e[0])
                    ends_b.append(e[1])
        some = np.flatnonzero(count)
        none = np.zeros(0, np.int64)
        e_a, e_b = np.concatenate([none, *ends_a]), np.concatenate([none, *ends_b])
        return pa.table({"a": np.concatenate((ids[some], e_a)), "b": pa.array([None] * len(some) + e_b.tolist(), pa.int64()), "links": np.concatenate((count[some], np.zeros(len(e_a), np.int64)))})

    met = stored(left.select(*columns).union(right.select(*columns)).groupBy("length", "cell", "i", "j").applyInArrow(join, "a long, b long, links long"), "met")
    counts = met.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    linked = stored(components(met.where("b IS NOT NULL").select("a", "b")), "components")
    reached = groups.select("id", "least").join(linked, "id").groupBy("component_id").agg(F.min("least").alias("reached"))
    named = groups.join(counts, "id", "left").join(linked.join(reached, "component_id"), "id", "left")
    named = named.select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("reached", "least").alias("component_id"))
    keyed = rows.select("vec_id", *[F.when(good, d).alias(f"r{i}") for i, d in enumerate((F.xxhash64("v"), F.xxhash64(F.lit(1), F.col("v"))))])
    out = keyed.join(named, (F.col("r0") == F.col("d1")) & (F.col("r1") == F.col("d2")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
