import hashlib
import random
import zlib

import pytest

from stopflow.llm import merkle

SCHEMA = "leaf int, source string, doc_id long, tree string, lang string, n_chars long, text string, rank int, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*[field(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def climb(level, fanout):
    """Root, and for each leaf its steps (left siblings, right siblings) up to it."""
    paths, owners = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        up, own = [], []
        for i in range(0, len(level), fanout):
            run = level[i:i + fanout]
            for j in range(len(run)):
                for leaf in owners[i + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h(*run))
            own.append([x for o in owners[i:i + fanout] for x in o])
        level, owners = up, own
    return level[0], paths


def brute_force(rows, fanout):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append((leaf_of(r, r["text"]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    grown = {s: climb([d for d, _ in trees[s]], fanout) for s in order}
    root, tops = climb([grown[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        for (d, r), path in zip(trees[s], grown[s][1]):
            steps = path + top
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(r, text)
            for left, right in steps:
                folded = h(left, folded, right)
            out.append((r["doc_id"], s, d, grown[s][0], root, h(*[x for p in steps for x in p]), folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, sources, seed):
    rng = random.Random(seed)
    texts = [None, "", "plain lower", "Some UPPER Ä", "naïve ÀB", "x" * 20_000 + "Z", "-"]
    out = []
    for i in range(n):
        out.append({"leaf": i, "source": rng.choice(sources), "doc_id": rng.choice([i, i, i, i * 7 + 1, 3, None]), "tree": "t", "lang": rng.choice(["en", None, ""]), "n_chars": rng.choice([None, 0, 17]),
                    "text": rng.choice(texts), "rank": 0, "path": "p"})
    return out + out[:3]


@pytest.mark.parametrize("n, sources, fanout", [(70, ["a", "b", None, ""], 2), (60, ["one"], 3), (400, ["hot"] * 5 + [f"s{i}" for i in range(20)] + ["é", None], 16), (1, ["a"], 16), (18, ["a"], 16)])
def test_against_brute_force(spark, n, sources, fanout):
    rows = rows_of(n, sources, n)
    if n == 1:
        rows = rows[:1]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    got = merkle.manifest(df, fanout)
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows, fanout)


def test_tampering_is_found_and_nothing_else(spark):
    rows = rows_of(120, ["a", "b"], 4)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    out = merkle.manifest(df).collect()
    by_leaf = {leaf_of(r, r["text"]): r for r in rows}
    for r in out:
        row = by_leaf[r["leaf"]]
        changed = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in row["text"] or "")
        assert r["verified"] is (not changed)
    assert {r["verified"] for r in out} == {True, False}


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranks_of_a_tree_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).selectExpr("IF(id % 10 = 0, 'b', 'a') AS tree", "1000 - id AS doc_id")
        got = merkle.ranked(df, ["doc_id"], "ranks").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for t in "ab":
        ids = sorted((r["rank"], r["doc_id"]) for r in got if r["tree"] == t)
        assert [k for k, _ in ids] == list(range(len(ids))) and [d for _, d in ids] == sorted(d for _, d in ids)
