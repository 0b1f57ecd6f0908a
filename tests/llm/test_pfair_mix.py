from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stopflow.llm import pfair_mix as P


def simulate(shares):
    """Earliest deadline first, slot by slot."""
    frame, done, out = sum(shares), [0] * len(shares), []
    for t in range(frame):
        ready = [(-(-(done[s] + 1) * frame // n), s) for s, n in enumerate(shares) if done[s] < n and done[s] * frame // n <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


@pytest.fixture
def corpus(spark):
    sizes = {"a": 700, "b": 90, "c": 33, "d": 5, None: 12}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, "text", "clash", -1))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string, slot string, supply long")


def test_frame_is_the_simulated_one(corpus):
    plan = {r["_source"]: r.asDict() for r in P.schedule(corpus, {"a": 5, "b": 3, "c": 1.5, None: 0.5}, block=4, frame=200).collect()}
    names = sorted((n for n in plan if plan[n]["share"]), key=lambda n: n or "")
    want = simulate([plan[n]["share"] for n in names])
    assert plan["d"]["share"] == 0
    for k, n in enumerate(names):
        assert plan[n]["slots"] == [t for t, s in enumerate(want) if s == k]


@pytest.mark.parametrize("weights", [None, {"a": 0.2, "b": 0.45, "c": 0.25, "d": 0.05, None: 0.05}])
def test_deviation_is_below_one_block(corpus, weights):
    rows = P.mix(corpus, weights, block=4, frame=300).collect()
    plan = {r["_source"]: Fraction(r["share"], r["frame"]) for r in P.schedule(corpus, weights, block=4, frame=300).collect()}
    assert len(rows) == 840 and len({r["doc_id"] for r in rows}) == 840
    slots, blocks = defaultdict(set), defaultdict(list)
    for r in rows:
        slots[r["slot"]].add((r["source"], r["block_no"]))
        blocks[r["source"], r["block_no"]].append(r["place"])
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(len(s) == 1 for s in slots.values())
    assert all(sorted(p) == list(range(len(p))) and len(p) <= 4 for p in blocks.values())
    # until its last block each source has had its weight, less than a block off
    sizes = defaultdict(int)
    for s, k in blocks:
        sizes[s] = max(sizes[s], k + 1)
    order = sorted((slot, s) for slot, x in slots.items() for s, _ in x)
    for source, w in plan.items():
        had = 0
        for slot, s in order:
            if had == sizes[source]:
                break
            assert abs(had - slot * w) < 1
            had += s == source
    favoured = {r["_source"] for r in P.schedule(corpus, weights, block=4, frame=300).collect() if r["favoured"]}
    assert favoured and all(r["scheduled"] for r in rows if r["source"] in favoured)


@pytest.mark.parametrize("n", [1_000, 40_000])
@pytest.mark.parametrize("rare", [0, 1])
def test_mixture_does_not_depend_on_size_or_rare_sources(spark, n, rare):
    """A source of one document neither delays the end nor lets the ceiling lapse."""
    docs = spark.range(n).selectExpr("id AS doc_id", "if(id % 10 < 6, 'hot', concat('s', id % 10)) AS source")
    if rare:
        docs = docs.union(spark.createDataFrame([(n, "rare")], "doc_id long, source string"))
    taken = {r["source"]: r["n"] for r in P.mix(docs).where("scheduled").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert taken == {"hot": -(-(n + rare) // 4), **{f"s{k}": n // 10 for k in range(6, 10)}, **({"rare": 1} if rare else {})}


def test_weights_below_a_slot_of_the_frame(spark):
    """A weight of 1.49 slots is not rounded to one slot of the mixture."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id < 149, 'rare', if(id < 6000, 'b', 'hot')) AS source")
    weights = {"rare": 0.0149, "b": 0.7151, "hot": 0.27}
    taken = {r["source"]: r["n"] for r in P.mix(docs, weights, frame=100).where("scheduled").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert taken == {"rare": 149, "b": 5851, "hot": 2700}


def test_hot_source_is_numbered_in_parts(corpus, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED_TOGETHER", 50)
    rows = [r for r in P.mix(corpus, block=4, frame=300).collect() if r["source"] == "a"]
    assert sorted((r["block_no"], r["place"]) for r in rows) == [(i // 4, i % 4) for i in range(700)]


def test_odd_tables(spark, corpus):
    assert P.mix(corpus.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, source string")
    assert sorted(r["place"] for r in P.mix(twice).collect()) == [0, 1, 2]
    none = P.mix(twice, {"b": 1.0}).collect()
    assert len(none) == 3 and not any(r["scheduled"] for r in none) and all(r["slot"] is None for r in none)
    with pytest.raises(Exception, match="raise frame"):
        P.schedule(spark.createDataFrame([(i, str(i)) for i in range(9)], "doc_id long, source string"), frame=4)


def test_no_python_on_the_executors(corpus):
    plan = P.mix(corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
