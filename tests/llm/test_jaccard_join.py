"""N-gram Jaccard join against brute force."""

import os
import random
import re

import numpy as np
import pytest

from stopflow.llm import jaccard_join as J

SF_DIR = "/root/testdata/sf0.001"


def shingles_of(text, size=5):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(rows, percent=80):
    sets = {d: shingles_of(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        k = rng.randrange(3)
        i = rng.randrange(len(out))
        if k == 0:
            out[i] = f"x{rng.random()}"
        elif k == 1:
            out.insert(i, f"y{rng.random()}")
        elif len(out) > 1:
            del out[i]
    return out


def groups(seed=1):
    """Texts of many lengths with copies at, above and below the bound, sharing a passage."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200, 420):
        for _ in range(4):
            base = [f"w{rng.randrange(400)}" for _ in range(n)]
            if n > 40:
                base[10:10] = passage
            rows.append(" ".join(base))
            rows += [" ".join(edited(rng, base, c)) for c in (0, 1, 1, 2, max(1, n // 50), max(1, n // 45), max(1, n // 40), max(1, n // 20))]
            rows.append(" ".join(base).upper())
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("forced", [None, "double", "spare"])
def test_groups_as_by_brute_force(spark, monkeypatch, forced):
    rows = groups()
    if forced:
        def allocate(low, high, size, sets, percent=80):
            h = J.most_different(high, percent)
            double, spare = ((h + 1) // 2, 0) if forced == "double" else (0, h // 2 + 1)
            return J.Band(low, high, h, double, h + 1 + spare - 2 * double, spare)

        monkeypatch.setattr(J, "allocate", allocate)
    got = result(J.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute(rows)


@pytest.mark.parametrize("percent", [50, 70])
def test_lower_percentages_as_by_brute_force(spark, percent):
    """Sets up to the bound apart, each with one that holds it whole."""
    rows = []
    for n in (*range(6, 40), 60, 90):
        words = [f"w{n}.{i}" for i in range((n * 100) // percent + 4)]
        rows += [(2 * n, " ".join(words[:n + 4])), (2 * n + 1, " ".join(words))]
    want = brute(rows, percent)
    assert len({c for _, c in want.values()}) == len(rows) // 2
    assert result(J.link(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)) == want


def test_documents_as_by_brute_force(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(J.link(docs)) == want
    assert any(c != d for d, (_, c) in want.items())


def test_star_of_dissimilar_members(spark):
    """The smallest document of a signature is linked with nothing, others are."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"z{i}.{k}" for k in range(30)])) for i in range(4)]
    other = [f"v{i}" for i in range(300)]
    rows += [(10 + i, " ".join(edited(rng, other, 4))) for i in range(30)]
    assert result(J.link(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "é" * 3), (9, "x " * 30000)]
    df = spark.createDataFrame([(t, d, "clash") for d, t in rows], "text string, doc_id long, component_id string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in J.link(df).collect())
    assert got == [(-1, 2, -1), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 2, 6), (7, 2, 6), (8, 1, 8), (9, 1, 9)]
    assert J.link(df.limit(0)).collect() == []


def test_linked_sets_share_a_signature():
    """For every allocation, sets at the bound meet in one of the bands."""
    rng = np.random.default_rng(3)
    for trial in range(400):
        n = int(rng.integers(4, 300))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        drop = int(rng.integers(0, n // 5 + 1))
        add = int(rng.integers(0, n // 4 + 1))
        y = np.concatenate((x[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
        if 100 * (n - drop) < 80 * (n + add):
            continue
        low = J.bounds(max(len(x), len(y)))
        bands = []
        for k in range(len(low) - 1):
            h = J.most_different(low[k + 1] - 1, 80)
            double, spare = int(rng.integers(0, (h + 1) // 2 + 1)), int(rng.integers(0, h + 2))
            single = h + 1 + spare - 2 * double
            if single < spare:
                spare, single = 0, h + 1 - 2 * double
            bands.append(J.Band(low[k], low[k + 1] - 1, h, double, single, spare))
        lows = np.array([b.low for b in bands])
        sx, sy = np.sort(x), np.sort(y)
        if len(sx) == len(sy) and (sx == sy).all():
            continue
        both = [{s for k in J._bands_of(len(s_), bands, lows, 80) for s in J.signatures(s_, bands[k], k).tolist()} for s_ in (sx, sy)]
        assert both[0] & both[1], (n, drop, add, trial)
