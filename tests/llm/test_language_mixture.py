import math
import os
import random
from collections import Counter

import pytest

from stopflow.llm import language_mixture as L
from stopflow.llm.frames import fold_of

WORDS = {"aa": ["kala", "maka", "taka", "lakka"], "bb": ["sisi", "mini", "tisin", "vini"], "cc": ["böro", "tördo", "möno"]}


def text(rng, *langs, n=60):
    return " ".join(rng.choice(WORDS[langs[i * len(langs) // n]]) for i in range(n))


@pytest.fixture
def model(spark):
    rng = random.Random(1)
    rows = [(text(rng, lang), lang) for lang in WORDS for _ in range(20)] + [(None, "aa"), ("kala", None)]
    return L.fit(spark.createDataFrame(rows, "text string, lang string"))


def predicted(spark, model, texts):
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return [(r["lang_pred"], r["score"], dict(zip(r["languages"], r["proportions"]))) for r in sorted(L.predict(df, model).collect(), key=lambda r: r["doc_id"])]


def test_mixtures(spark, model):
    rng = random.Random(2)
    got = predicted(spark, model, [text(rng, "aa"), text(rng, "bb", "cc"), text(rng, "aa", "bb", "cc", n=90), "möno", "K"])
    assert got[0][0] == "aa" and set(got[0][2]) == {"aa"} and got[0][1] == 1.0
    assert set(got[1][2]) == {"bb", "cc"} and all(0.35 < w < 0.65 for w in got[1][2].values())
    assert set(got[2][2]) == {"aa", "bb", "cc"}
    assert got[3][0] == "cc" and got[4][0] in WORDS
    assert all(abs(sum(w.values()) - 1) < 1e-6 for _, _, w in got)


def test_odd_rows(spark, model):
    got = predicted(spark, model, [None, "", "123 ...", " ", "kala " * 40_000, "\u00bd \u00bd", "\u2167 \u3007", "\u0661\u0662", "\u00bd k"])
    assert [g[:2] for g in got[:4]] == [("und", 0.0)] * 4 and got[4][0] == "aa"
    # characters that are numbers are no letters
    assert [g[:2] for g in got[5:8]] == [("und", 0.0)] * 3 and got[8][0] in WORDS
    assert predicted(spark, model, []) == []
    empty = L.fit(spark.createDataFrame([], "text string, lang string"))
    assert predicted(spark, empty, ["kala"]) == [("und", 0.0, {})]
    with pytest.raises(ValueError):
        L.predict(spark.createDataFrame([("a", 1.0)], "text string, score double"), model, keep=("score",))


def test_test_table_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("test tables not present")
    from stopflow.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op1_language_mixture"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where(fold_of() == 0).collect()
    assert all(r["held_out"] for r in rows) and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def trigrams(text):
    """Classes of the trigrams around letter bytes, one by one."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    data = [32, *map(fold, (text or "").encode()), 32]
    return [((data[i - 1] << 16 | data[i] << 8 | data[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(1, len(data) - 1) if data[i] != 32]


def brute_force(rows, texts):
    """Counts, mixtures and the penalised choice of languages in plain loops."""
    langs = sorted({x for t, x in rows if t is not None and x is not None})
    counts = {x: Counter() for x in langs}
    for t, x in rows:
        if t is not None and x is not None:
            counts[x].update(trigrams(t))
    like = {x: (lambda c, n=counts[x], s=sum(counts[x].values()): (n[c] + L.SMOOTHING) / (s + L.SMOOTHING * L.CLASSES)) for x in langs}

    def mixture(names, seen):
        w, total = {x: 1 / len(names) for x in names}, sum(seen.values())
        for _ in range(L.ROUNDS if len(names) > 1 else 0):
            step = dict.fromkeys(names, 0.0)
            for c, n in seen.items():
                whole = sum(w[x] * like[x](c) for x in names)
                for x in names:
                    step[x] += n * w[x] * like[x](c) / whole / total
            moved = max(abs(step[x] - w[x]) for x in names)
            w = step
            if moved < 1e-3:
                break
        return w, sum(n * math.log(sum(w[x] * like[x](c) for x in names)) for c, n in seen.items())

    out = []
    for t in texts:
        seen = Counter(trigrams(t))
        first = mixture(langs, seen)[0]
        order = sorted(langs, key=lambda x: -first[x])
        best = (None, -math.inf)
        for k in range(1, len(order) + 1):
            w, value = mixture(order[:k], seen)
            value = value / L.OVERLAP - (k - 1) * 0.5 * math.log(sum(seen.values()))
            if value <= best[1]:
                break
            best = (w, value)
        out.append(best[0])
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(text(rng, lang, n=25), lang) for lang in WORDS for _ in range(6)] + [(text(rng, "aa", "cc"), "cc"), (None, "aa"), ("kala", None), ("", "bb")]
    texts = [text(rng, "aa", n=8), text(rng, "bb", "cc", n=40), text(rng, "aa", "bb", "cc", n=60), "möno", "Kala SISI", "x", "tisin 12 böro! kala", text(rng, "cc", "aa", n=11)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    for got, want in zip(predicted(spark, model, texts), brute_force(rows, texts), strict=True):
        assert got[2] == pytest.approx(want, abs=1e-9)
        assert got[0] == max(want, key=want.get) and got[1] == pytest.approx(max(want.values()))


def test_number_of_languages_is_checked(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        L.fit(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "text string, lang string"))
