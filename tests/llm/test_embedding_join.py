"""Range join of vectors against all pairs."""

import numpy as np
import pytest

from stopflow.llm import embedding_join as E


def brute(rows, cosine=0.9):
    ok = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.asarray(v, float) / max(abs(x) for x in v)
            ok[i] = scaled / np.linalg.norm(scaled)
    near = {i: {j for j, w in ok.items() if j != i and len(w) == len(v) and v @ w >= cosine} for i, v in ok.items()}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen), min(seen) == i)
    return out


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def vectors(n=400, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    x = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.25, 0.6], (n, 1))
    x[50:70] = x[50]
    return [(int(i), [float(a) for a in v]) for i, v in zip(rng.permutation(n) * 2, x.astype(np.float32))]


@pytest.mark.parametrize("block", [8192, 16])
def test_all_links(spark, block):
    rows = vectors()
    got = result(E.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block))
    assert got == brute(rows)
    assert max(n for n, _, _ in got.values()) >= 19


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert result(E.link(df)) == brute([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e-30, 0.0]), (10, [-1.0, 0.0]), (11, []), (12, [1e200, 0.0])]
    df = spark.createDataFrame([("x", v, i, True) for i, v in rows], "label string, embedding array<double>, vec_id long, kept boolean")
    assert result(E.link(df)) == brute(rows)
    assert E.link(df.limit(0)).collect() == []


def test_plane_bound_keeps_every_partner():
    rng = np.random.default_rng(8)
    x = E._unit(rng.normal(size=(600, 6)))
    pivots, radius = x[:20], (2 - 2 * 0.9) ** 0.5
    own, touches = E.reach(x, pivots, radius)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert touches[i, own[j]].all()


def test_one_row_in_one_row_out(spark):
    """Ids may repeat, with equal and with other vectors: every row is a vector."""
    rng = np.random.default_rng(5)
    base = [[float(a) for a in v] for v in rng.normal(size=(12, 4))]
    rows = [(int(rng.integers(0, 8)), base[int(rng.integers(0, 12))]) for _ in range(60)] + [(3, None), (3, [0.0] * 4), (None, base[0]), (5, [1.0, -0.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0, -0.0])]
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and any(v)]
    unit = {i: np.asarray(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    near = {i: {j for j in good if j != i and unit[i] @ unit[j] >= 0.9 - 1e-12} for i in good}
    want = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want.append((k, len(near.get(i, ())), least, k == least))
    got = E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
