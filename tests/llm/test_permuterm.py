import random
import re
import zlib
from collections import Counter

import pytest

from stopflow.llm import permuterm as P


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_force(words):
    forms, out = {}, []
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        form = others[0][1] if others and -others[0][0] >= 2 * n else None
        forms[w] = form
        out.append((w, n, len(others), form, words[form] if form else None))
    rows = []
    for w, n, c, form, form_n in out:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, n, c, form, form_n, root))
    return sorted(rows)


def result(df):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("abÿéÀ") for _ in range(rng.randint(1, 7)))
        words[w] = rng.choice([3, 3, 4, 8, 20, 50, 100])
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            v = rng.choice([w[:i] + rng.choice("abÿ") + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice("abÀ") + w[i + 1:]])
            if v:
                words[v] = rng.choice([3, 6, 12, 25])
    df = spark.createDataFrame([(n, w, "x") for w, n in words.items()], "n long, word string, prefix string").repartition(4)
    assert result(P.group(df)) == brute_force(words)


def test_runs_of_equal_letters_count_once(spark):
    words = {"aaaa": 10, "aaa": 3, "aab": 5, "aaab": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(P.group(df)) == brute_force(words)


def test_a_long_chain_ends_at_its_root(spark):
    words = {"abcdefgh"[:i] + "x" * (8 - i): 3 * 2 ** i for i in range(9)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = result(P.group(df))
    assert got == brute_force(words) and {r[5] for r in got} == {"abcdefgh"}


def test_vocabulary(spark):
    texts = ["Straße straße STRASSE naïve, Naïve NAÏVE", None, "", "word's words Words WORDS tiny tiny tiny", "übung Übung", "a " * 5000 + "longer", " ".join(f"Longest{'' if i % 2 else 'er'}" for i in range(600))]
    rows = [(t, i, "w") for i, t in enumerate(texts)] + [("nameless nameless nameless", None, "w"), (texts[0], 0, "w")]
    count = Counter()
    for text, i, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 3 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    df = spark.createDataFrame(rows, "text string, doc_id long, word string")
    want = {w: n for w, n in count.items() if len(w) >= 5 and n >= 2}
    assert {r["word"]: r["n"] for r in P.vocabulary(df, least_n=2, plant=3).collect()} == want
    plain = {r["word"]: r["n"] for r in P.vocabulary(df, plant=None).collect()}
    assert plain == {"straße": 4, "words": 3, "longest": 300, "longester": 300, "nameless": 3, "naïve": 4}


def test_no_words(spark):
    df = spark.createDataFrame([(None, 1), ("1 2 3", 2)], "text string, doc_id long")
    assert P.group(P.vocabulary(df)).collect() == []
    assert P.group(spark.createDataFrame([(None, 5)], "word string, n long")).collect() == []
    with pytest.raises(ValueError, match="2 or more"):
        P.group(spark.createDataFrame([], "word string, n long"), ratio=1)
