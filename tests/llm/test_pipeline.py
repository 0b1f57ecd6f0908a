"""The stages against plain versions of themselves, each on its own input."""

import os
from collections import Counter

import pytest
from test_jaccard_join import brute

import corpus_pipeline as P
from stopflow.llm import pfair_mix
from stopflow.llm.frames import stored

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def stages(spark):
    """Input and result of every stage."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = stored(stage(spark, docs, SF_DIR), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, stages):
    columns = stages[0][1].columns
    for name, before, after in stages[:-1]:
        assert after.columns == columns, name
        assert Counter(after.collect()) <= Counter(before.collect()), name
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in stages[0][1].collect()} - {r["doc_id"] for r in stages[0][2].collect()}
    known = [labels[d] for d in gone if d in labels]
    assert known and known.count(0) >= 0.9 * len(known)
    groups = brute([(r["doc_id"], r["text"]) for r in stages[2][1].collect()])
    assert {r["doc_id"] for r in stages[2][2].collect()} == {d for d, (_, c) in groups.items() if d == c}
    mixed = {r["doc_id"] for r in pfair_mix.mix(stages[3][1]).collect() if r["scheduled"]}
    assert {r["doc_id"] for r in stages[3][2].collect()} == mixed
    packed = stages[4][2].collect()
    assert {r["doc_id"] for r in packed} == mixed


def test_one_row_of_a_repeated_or_null_id_stays(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (2, text, "a"), (2, text, "a"), (3, other, None), (3, other, "z"), (None, text, "a"), (None, "alone", "b"), (None, "alone", "a"), (4, None, "a"), (5, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(1, text, "a"), (3, other, None), (4, None, "a"), (5, None, "a"), (None, "alone", "a")]
    assert Counter(tuple(r) for r in P.deduplicate(spark, docs, SF_DIR).collect()) == Counter(want)
    same = docs.where("doc_id > 3")
    assert Counter(P.deduplicate(spark, same, SF_DIR).collect()) == Counter(same.collect())


def test_mixing_keeps_a_source_above_the_ceiling(spark):
    """Sixty per cent of the documents come from one source."""
    docs = spark.range(10_000).selectExpr("id AS doc_id", "'x' AS text", "if(id % 10 < 6, 'hot', concat('s', id % 10)) AS source")
    mixed = P.mix(spark, docs, SF_DIR)
    assert mixed.columns == docs.columns
    assert sorted(mixed.collect()) == sorted(docs.collect())
    assert not all(r["scheduled"] for r in pfair_mix.mix(docs).collect())


def test_run_gives_the_last_stage(spark, stages):
    assert Counter(P.run(spark, SF_DIR).collect()) == Counter(stages[-1][2].collect())


def test_empty_documents(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), "stage")
        assert docs.count() == 0


def test_clashing_columns_come_out_as_they_went_in(spark):
    """Columns that operators make themselves, and nulls, empty texts and repeated rows."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    names = ("score", "predicted", "kept", "failed_rules", "_q_n_words", "slot", "place", "scheduled", "component_id", "count", "_row", "n")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (-1, None, None, None, None), (-1, None, None, None, None)], docs.schema)
    docs = docs.union(odd).selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in names])
    for name, stage in P.STAGES[:-1]:
        after = stored(stage(spark, docs, SF_DIR), "stage")
        assert after.columns == docs.columns, name
        assert Counter(after.collect()) <= Counter(docs.collect()), name
        docs = after
    packed = stored(P.STAGES[-1][1](spark, docs, SF_DIR), "stage")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_the_mixture_orders_the_sequences(spark):
    """Texts of half a sequence: two by two, in the order in which the mixture wrote them."""
    text = " ".join(["word"] * 1500)
    docs = stored(spark.range(400).selectExpr("id AS doc_id", f"'{text}' AS text", "if(id < 240, 'hot', concat('s', id % 4)) AS source"), "docs")
    mixed = stored(P.mix(spark, docs, SF_DIR), "mixed")
    want = [r["doc_id"] for r in P.placed(mixed).orderBy("_at").collect()]
    by_slot = [r["doc_id"] for r in pfair_mix.mix(docs).orderBy("slot", "place").collect()]
    assert want == by_slot != sorted(want)
    packed = P.pack(spark, mixed, SF_DIR).collect()
    heads = {r["sequence_id"]: min(want.index(x["doc_id"]) for x in packed if x["sequence_id"] == r["sequence_id"]) for r in packed}
    order = [r["sequence_id"] for r in sorted(packed, key=lambda r: r["first_place"])]
    assert [heads[s] for s in order] == sorted(heads.values()) and len(packed) == 400
