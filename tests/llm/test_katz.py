import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stopflow.llm import katz as K

END, START = object(), object()


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]


def brute(rows):
    """The same model with dictionaries, a token at a time."""
    uni, bi, ctx = Counter(), Counter(), Counter()
    for _, t, held in rows:
        if not held:
            prev = START
            for w in tokens_of(t):
                uni[w] += 1
                bi[prev, w] += 1
                ctx[prev] += 1
                prev = w
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (K.discounts(np.array([sum(x == r for x in c.values()) for r in range(1, K.K + 2)])) for c in (uni, bi))
    left = sum(c * (1 - d1[c]) for c in uni.values() if c <= K.K) / n if n else 1
    scale, unseen = (1, left) if left > 0 else (n / (n + 1), 1 / (n + 1))
    cut = lambda c, d: c * d[c] if c <= K.K else c

    def low(w):
        return cut(uni[w], d1) / n * scale if uni[w] else unseen

    def prob(prev, w):
        if not ctx[prev]:
            return low(w)
        followers = [x for (p, x) in bi if p == prev]
        kept = sum(cut(bi[prev, x], d2) for x in followers)
        total = ctx[prev] + (kept >= ctx[prev] - 1e-9)
        if bi[prev, w]:
            return cut(bi[prev, w], d2) / total
        return (1 - kept / total) / (1 - sum(low(x) for x in followers)) * low(w)

    out = {}
    for d, t, held in rows:
        ws = tokens_of(t)
        out[d] = (bool(held), len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), sum(math.log10(prob(p, w)) for p, w in zip([START, *ws], ws)))
    return out, prob, list(uni), list(ctx)


def rows_of(n=160, seed=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)] + ["The", "ünd"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(0, 60))), i % 5 == 1) for i in range(n)]
    return rows + [(n, None, False), (n + 1, "", True), (n + 2, "never seen words", True), (n + 3, "w1 " * 3000, False), (n + 4, "w1 w2", None)]


@pytest.mark.parametrize("chunk, per_bucket", [(4_000_000, 1_500_000), (300, 500)])
def test_scores_as_by_brute_force(spark, monkeypatch, chunk, per_bucket):
    monkeypatch.setattr(K, "CHUNK", chunk)
    monkeypatch.setattr(K, "PER_BUCKET", per_bucket)
    rows = rows_of()
    df = spark.createDataFrame([(h, t, d, 1) for d, t, h in rows], "held_out boolean, text string, doc_id long, score int").repartition(3)
    got = {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in K.score(df).collect()}
    want = brute(rows)[0]
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert got[d][4:] == pytest.approx(want[d][4:], rel=1e-9), d
    held = [d for d in want if want[d][0]]
    assert sum(got[d][5] for d in held) > sum(got[d][4] for d in held)


def test_probabilities_add_up_to_one():
    """The weights are exact: over all tokens and one unseen one, after any context."""
    _, prob, vocab, contexts = brute(rows_of(60))
    for c in [*contexts[:40], "unknown"]:
        assert sum(prob(c, w) for w in vocab) + prob(c, "unseen") == pytest.approx(1, abs=1e-9)


def test_backoff_of_a_context_without_rare_pairs():
    weight, total = K.backoff(np.zeros((1, K.K), int), np.array([12]), np.array([0.25]), np.array([12.0]), np.ones(K.K + 1))
    assert total[0] == 13 and weight[0] == pytest.approx((1 / 13) / 0.75)


def test_discounts():
    d = K.discounts(np.array([100, 40, 20, 12, 8, 6]))
    assert d[0] == 1 and d[1:] == pytest.approx([0.6875, 0.609375, 0.6875, 0.73958333, 0.84375])
    assert K.discounts(np.zeros(6))[1] == 0.5


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", True), (1, "a b", True)], "doc_id long, text string, held_out boolean")
    assert K.score(df.limit(0)).collect() == []
    rows = K.score(df).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(3, 0, 0, 0.0, 0.0)] * 2
