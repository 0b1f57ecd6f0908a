import random
import zlib

import numpy as np
import pytest

from stopflow.llm import best_fit as B
from stopflow.llm.tokens import Encoder

TEXTS = ["", " ", "a  b", "a \n b", "\n\n", "don't 's 's", "é̀ x", "a　 b", "a<|endoftext|> b <|startoftext|>", "x\ty z\r\nq", "🙂 🙂🙂 a", "a\x1c b", "a \x85b", "12 34\n56", "_ _a ' 's", "\x01 a \x01b", "One two.\nThree, four\nfive"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_words_give_the_ids_of_whole_texts(name):
    enc = Encoder(name, remembered=12)
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["the", "The", "ünd", "x,", "'s", "a\nb", "ing."]) for _ in range(30)) for _ in range(20)]
    want = [np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want
    assert [enc.encode([t])[0] for t in texts] == want


def one_by_one(sizes, length):
    """Best fit decreasing, a bin at a time."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(length - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(6)
    for trial in range(150):
        length = rng.choice([7, 16, 50, 64])
        sizes = [rng.randint(1, length) if rng.random() < 0.5 else rng.randint(1, 1 + length // 5) for _ in range(rng.randint(1, 120))]
        counts = {n: sizes.count(n) for n in set(sizes)}
        used, ranks = {}, {n: [] for n in counts}
        for n, rank, m, first, offset in B.plan(counts, length):
            for k in range(m):
                used.setdefault(first + k, []).append((offset, n))
                ranks[n].append(rank + k)
        assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
        rooms = []
        for places in used.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= length
            rooms.append(length - at)
        assert sorted(rooms) == one_by_one(sizes, length)


def test_packing_of_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "der"]) for _ in range(rng.choice([0, 1, 3, 8, 60])))) for i in range(150)] + [(150, None), (151, ""), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(t, i, 9) for i, t in rows], "text string, doc_id long, length int")
    packed = B.pack(df, length=32, keep_ids=True)
    got = packed.collect()
    tok = Encoder("byte_bpe_50k.json").tokenizer
    texts = dict(rows)
    pieces = {}
    for r in got:
        assert len(r["ids"]) == r["length"] <= 32 and zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        if r["doc_id"] != 7:
            pieces.setdefault(r["doc_id"], []).append(r)
    assert sum(r["doc_id"] == 7 for r in got) >= 2
    for d, p in pieces.items():
        p.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in p] == list(range(len(p))) and all(r["length"] == 32 for r in p[1:])
        assert sum((r["ids"] for r in p), []) == tok.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        assert [r["start"] for r in p] == [sum(q["length"] for q in p[:k]) for k in range(len(p))]
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 32
    assert len(bins) == len(one_by_one([r["length"] for r in got], 32))
    assert {r["sequence_id"]: len(r["ids"]) for r in B.sequences(packed).collect()} == {k: sum(n for _, n in p) for k, p in bins.items()}


def test_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(B, "NUMBERED_TOGETHER", 10)
    got = B.pack(spark.createDataFrame([(i, "a b") for i in range(100)], "doc_id long, text string"), length=6).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 100 and len({r["sequence_id"] for r in got}) == 50


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert B.pack(df.limit(0)).collect() == []
    assert [(r["length"], r["offset"]) for r in B.pack(df).collect()] == [(1, 0)]
    assert B.pack(df, end_id=None).collect() == []
    long = B.pack(spark.createDataFrame([(1, "word " * 50_000)], "doc_id long, text string"), length=2048).collect()
    assert sum(r["length"] for r in long) > 50_000 and max(r["length"] for r in long) == 2048
