import os
import random

import numpy as np
import pyarrow as pa
import pytest

from stopflow.llm import quality_attention as Q
from stopflow.llm.arrays import slices
from stopflow.llm.frames import fold_of


def corpus(n=300, seed=3):
    """Prose, and prose of which one stretch is noise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) for _ in range(rng.randrange(3, 400))]
        bad = i % 3 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = ["x%%%"] * 40
        rows.append((i, " ".join(words), 0 if bad else 1))
    return rows


def test_gradient():
    rng = np.random.default_rng(0)
    x, begins, y = rng.normal(size=(20, Q.FEATURES)), np.array([0, 1, 5, 6, 13, 20]), np.array([1.0, 0, 1, 1, 0])
    m = Q.train(x, begins, y)._replace(mean=np.zeros(Q.FEATURES), scale=np.ones(Q.FEATURES))

    def loss(m):
        s = Q._attend(m, x, begins)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, g in Q._gradient(m, x, begins, y).items():
        flat = getattr(m, name).ravel()
        for k in rng.integers(0, len(flat), 4):
            up, down = flat.copy(), flat.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            shape = getattr(m, name).shape
            slope = (loss(m._replace(**{name: up.reshape(shape)})) - loss(m._replace(**{name: down.reshape(shape)}))) / 2e-5
            assert abs(slope - g.ravel()[k]) < 1e-4, name


def test_features_do_not_depend_on_the_batch():
    texts = [t for _, t, _ in corpus(20)] + ["", "a", None, "é ü", "the the the"]
    whole = next(slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])))
    x, begins = Q.passages(*whole[1:])
    for i, t in enumerate(texts):
        one = next(slices(iter([pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"])])))
        assert np.allclose(Q.passages(*one[1:])[0], x[begins[i]:begins[i + 1]], atol=1e-6)
    assert begins[-1] - begins[-2] == 1


def test_bad_stretches_are_found(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 4] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    held = [(i, q) for i, _, q in rows if i % 4 == 0]
    assert sum(got[i] == q for i, q in held) >= 0.95 * len(held)


def test_test_table_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("test tables not present")
    from stopflow.llm.queries import QUERIES

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op8_quality_attention"](spark, sf_dir).join(labels, "doc_id").where(fold_of() == 0).collect()
    assert all(r["held_out"] for r in rows) and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert min(np.mean(good), 1) > np.mean(bad) + 0.5


def test_odd_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (2, "", 3), (None, "a b", 3), (4, "x " * 50_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(docs, none) == 0.5
    assert Q.fit(docs, spark.createDataFrame([(2, 1)], "doc_id long, quality int")) == 1.0
    out = Q.score(docs, Q.fit(docs, spark.createDataFrame([(2, 1), (4, 0), (2, 0)], "doc_id long, quality int")), keep=["doc_id", "y"]).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["y"] == 3 for r in out)
    assert Q.score(docs.limit(0), 0.5).collect() == []
    with pytest.raises(ValueError):
        Q.score(docs.withColumnRenamed("y", "score"), 0.5, keep=["score"])


def plain_passages(text):
    """Features of a text's passages, byte by byte and word by word."""
    raw = (text or "").encode()
    gap = {32, *range(9, 14)}
    words, i = [], 0
    while i < len(raw):
        if raw[i] in gap:
            i += 1
            continue
        j = i
        while j < len(raw) and raw[j] not in gap:
            j += 1
        words.append((i, j, bytes(b + 32 if 65 <= b <= 90 else b for b in raw[i:j])))
        i = j
    out = []
    for k in range(0, max(1, len(words)), Q.PASSAGE):
        part = words[k:k + Q.PASSAGE]
        x = np.zeros(Q.FEATURES)
        if part:
            end = words[k + Q.PASSAGE][0] if k + Q.PASSAGE < len(words) else len(raw)
            kinds = [int(Q._CLASS[b]) for b in raw[part[0][0]:end]]
            pairs = np.zeros(Q._N * Q._N)
            for a, b in zip(kinds, kinds[1:]):
                pairs[a * Q._N + b] += 1
            x[:Q._N * Q._N] = np.sqrt(pairs / max(1, pairs.sum()))
            seen, n = [w for _, _, w in part], len(part)
            x[-5] = (n - len(set(seen))) / n
            x[-4] = sum(a == b for a, b in zip(seen, seen[1:])) / n
            x[-3] = sum(k + i >= Q.PASSAGE and words[k + i - Q.PASSAGE][2] == w for i, w in enumerate(seen)) / n
            x[-2] = sum(j - i for i, j, _ in part) / n / 10
            x[-1] = np.log1p(n) / 5
        out.append(x)
    return out


def plain_score(m, bag):
    """Gated attention over a bag, one passage after another."""
    states, gates = [], []
    for x in bag:
        h = [max(0.0, sum((x[i] - m.mean[i]) / m.scale[i] * m.w[i, j] for i in range(Q.FEATURES)) + m.b[j]) for j in range(Q.HIDDEN)]
        e = 0.0
        for k in range(Q.GATE):
            t = np.tanh(sum(h[j] * m.v[j, k] for j in range(Q.HIDDEN)))
            g = 1 / (1 + np.exp(-sum(h[j] * m.u[j, k] for j in range(Q.HIDDEN))))
            e += t * g * m.a[k]
        states.append(h)
        gates.append(np.exp(e))
    z = [sum(g * h[j] for g, h in zip(gates, states)) / sum(gates) for j in range(Q.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(z[j] * m.c[j] for j in range(Q.HIDDEN)) + m.d[0])))


def test_against_brute_force(spark):
    rows = corpus(30, seed=8)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(90, None), (91, ""), (92, "é Ü x\ty\n\nz"), (92, "again")], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    got = sorted((r["doc_id"], round(r["score"], 5)) for r in Q.score(docs, model).collect())
    want = sorted((r["doc_id"], round(float(plain_score(model, plain_passages(r["text"]))), 5)) for r in docs.collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-4)


def test_bags_are_bounded(spark, monkeypatch):
    """Long texts and repeated rows of an id give a bounded number of passages."""
    assert Q.some_of(5, 9, 32).tolist() == [5, 6, 7, 8] and Q.some_of(0, 100, 4).tolist() == [0, 25, 50, 75]
    seen = []
    monkeypatch.setattr(Q, "train", lambda x, begins, y: seen.append((len(x), len(y))) or 0.5)
    docs = spark.createDataFrame([(1, "word " * 64 * 50), (1, "word " * 64 * 50), (1, "other"), (2, "short text")], "doc_id long, text string")
    Q.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), bag=8)
    assert len(seen) == 1 and seen[0][1] == 2 and seen[0][0] <= 9
