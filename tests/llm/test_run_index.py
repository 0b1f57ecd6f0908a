import hashlib
import random

import numpy as np
import pytest

from stopflow.llm import run_index as R

SCHEMA = "spans int, text string, doc_id long, k1 int, marks string"


def brute_force(rows, length):
    """(doc_id, n_bytes, n_removed, spans, kept) of (doc_id, text) rows."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            p = (key(d), i)
            first[b[i:i + length]] = min(first.get(b[i:i + length], p), p)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < (key(d), i):
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        spans = [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2])]
        out.append((d, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=str)


def corpus(seed, n=40, letters="abcd ö"):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))), "ab" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([i, i, i * 3, None]), "".join(parts)))
    return [*rows, rows[0], rows[1], (7, None), (8, ""), (9, "x" * 3000), (10, "x" * 700 + passages[0])]


@pytest.mark.parametrize("seed, length, gram, most", [(1, 20, 6, 4096), (2, 20, 6, 2), (3, 9, 3, 1), (4, 30, 1, 3)])
def test_against_brute_force(spark, seed, length, gram, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(1, t, d, 2, "m") for d, t in rows], SCHEMA).repartition(5)
    got = R.remove(df, length, gram=gram, most=most, bucket_bytes=2000)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    assert result(got) == brute_force(rows, length)


def test_hundred_bytes(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(80)) + (passage[i:] if i % 3 else passage[:110 - i]) + " ".join(word() for _ in range(40))) for i in range(30)]
    rows += [(100 + i, rows[5][1]) for i in range(20)]
    df = spark.createDataFrame([(t, d) for d, t in rows], "text string, doc_id long").repartition(3)
    got = result(R.remove(df))
    assert got == brute_force(rows, 100)
    assert hashlib.sha256(got[0][4]).hexdigest() and all(r[2] == r[1] for r in got if r[0] >= 100)


def test_texts_under_one_id(spark):
    a, b = "the same beginning of two texts, and one end", "the same beginning of two texts, another end"
    rows = [(5, a), (5, b), (5, a), (6, b), (4, "beginning of two texts")]
    df = spark.createDataFrame([(t, d) for d, t in rows], "text string, doc_id long")
    assert result(R.remove(df, 12, gram=4)) == brute_force(rows, 12)


def test_empty_table(spark):
    assert R.remove(spark.createDataFrame([], SCHEMA)).collect() == []


def test_few_notes_for_a_hot_anchor(spark):
    """A passage of all documents adds at most two rows a task to its anchors."""
    passage = "abcdefghijklmnopqrstuvwxyz" * 3
    df = spark.range(400).selectExpr("id", "0 AS base", "0L AS k1", "0L AS k2", f"concat(id, '{passage}') AS data").coalesce(4)
    occ = R.occurrences(df, 10, 40)
    assert occ.count() >= 400
    whole = {(r["id"], r["a"]) for r in occ.collect()}
    assert len(whole) == occ.count()


def texts_of(rng):
    sig = rng.integers(1, 4)
    return [bytes(rng.integers(97, 97 + sig, rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]


def test_runs_hold_the_whole_text():
    rng = np.random.default_rng(0)
    for _ in range(100):
        texts = texts_of(rng)
        index = R.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        assert index.restore().tobytes() == b"".join(t + b"\xff" for t in texts) + b"\xfe"
        assert (index.heads[1:] != index.heads[:-1]).all() and index.lengths.sum() == index.size


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(100):
        texts = texts_of(rng)
        index = R.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        t = index.restore().tobytes()
        order = sorted(range(len(t)), key=lambda i: t[i:])
        shared, other = index.statistics(np.arange(len(t)))
        for before, here in zip(order, order[1:]):
            common = next(k for k in range(len(t)) if t[before + k] != t[here + k])
            assert (shared[here], other[here]) == (common, before) or common == shared[here] == 0


def test_repetitive_texts_have_few_runs():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 2000).astype(np.uint8))
    one = R.RunIndex(np.frombuffer(text, np.uint8), np.array([0, 2000]))
    many = R.RunIndex(np.frombuffer(text * 50, np.uint8), np.arange(51) * 2000)
    assert len(many.heads) < 1.2 * len(one.heads)
