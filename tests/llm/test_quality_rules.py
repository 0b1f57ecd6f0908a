import os

import pytest

from stopflow.llm import quality_rules as Q

CLEAN = "the cat and the dog went to a house that is in the town of hats, with one more line here"


def judged(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, kept string, _q_n_words double")
    return {r["doc_id"]: r.asDict() for r in Q.judge(df).collect()}


def repeated_words(words):
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})


def test_each_rule(spark):
    texts = [CLEAN, "short text", "ab " * 30, "### $$$ " + CLEAN + " *** &&& ||| <<< >>>", CLEAN.upper(), "\n".join([CLEAN] * 2 + ["x the y"] * 5), "pneumonoultramicroscopic-words " * 3 + " ".join("verylongwordverylongword%d" % i for i in range(20)), None, "", " \n\t"]
    got = judged(spark, texts)
    assert got[0]["kept"] and got[0]["failed_rules"] == []
    assert got[1]["failed_rules"] == ["long_enough", "stop_words"] and got[1]["base_failed"]
    assert "few_repeats" in got[2]["failed_rules"] and got[2]["base_failed"]
    assert got[3]["failed_rules"] == ["few_symbols"] and not got[3]["base_failed"]
    assert got[4]["failed_rules"] == ["stop_words"]
    assert "few_repeated_lines" in got[5]["failed_rules"]
    assert {"word_length", "stop_words"} <= set(got[6]["failed_rules"])
    assert all(got[i]["base_failed"] and not got[i]["kept"] and got[i]["_q_n_words"] == 0 for i in (7, 8, 9))


def test_repeats_as_by_brute_force(spark):
    texts = ["a b c d e f a b c d e", "a a a a a a a", "a b c d e a b c d e a b c d e", "x y z w v u t s r q", "a b c d e x a b c d e y a b c d", " ".join(str(i % 7) for i in range(3000)), "a\x0bb\x0cc d\re a b c d e"]
    got = judged(spark, texts)
    for i, t in enumerate(texts):
        assert got[i]["_q_n_repeat_words"] == repeated_words(t.split()), t[:40]


def test_counts(spark):
    got = judged(spark, ["añ\t#b $🙂\n\n a \nx\n a \nx\n \n"])[0]
    assert (got["_q_n_words"], got["_q_word_chars"], got["_q_n_symbols"], got["_q_n_dup_lines"], got["_q_n_lines"]) == (7, 10, 2, 2, 5)


def test_filtering_measures_once(spark):
    df = spark.createDataFrame([(1, CLEAN)], "doc_id long, text string")
    kept = Q.judge(df).where("kept").select("doc_id", "text")
    assert kept.count() == 1
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1


def test_empty_table(spark):
    assert judged(spark, []) == {}


@pytest.mark.parametrize("name", ["op4_host_reputation", "op7_quality_rules"])
def test_sql_twins(spark, name):
    from oracle import compare, connect

    from stopflow.llm.queries import QUERIES, SQL

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("test tables not present")
    assert compare(spark, connect(sf_dir), name, QUERIES[name], SQL[name], sf_dir) is None
