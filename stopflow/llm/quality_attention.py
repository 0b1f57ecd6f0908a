"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.arrays import slices, words

# Words of one passage.
PASSAGE = 64
# The fit uses the labels of this many documents at most, those with the smallest hash of their id.
SAMPLE = 6_000
# Passages of a document that the model learns from.
BAG = 32
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 25, 128, 4e-3, 1e-4
ACCEPT = 0.3

# Classes of bytes (space, line end, lower, upper, digit, comma and
# stop, loud marks, symbols, bar, other ASCII, non-ASCII).
_CLASS = np.full(256, 9, np.uint8)
_CLASS[[32, 9]] = 0
_CLASS[[10, 11, 12, 13]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[44, 46, 58, 59]] = 5
_CLASS[[33, 63]] = 6
_CLASS[[ord(c) for c in "#*$%&<>=+^~\\{}[]@"]] = 7
_CLASS[124] = 8
_CLASS[128:] = 10
_N = 11
FEATURES = _N * _N + 5


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # encoder
    b: np.ndarray
    v: np.ndarray  # attention: tanh branch, gate, and the weights of both
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray  # classifier
    d: np.ndarray


def passages(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of some texts, and where each text's begin.

    A passage is PASSAGE words in a row (the last of a text: what is left), with
    the characters up to the next one. Features: shares of all pairs of
    neighbouring byte classes; share of words that occur again in the passage,
    that repeat the word before, that occurred in the passage before; mean word
    length; logarithm of the number of words. A text without words has one
    passage of zeros."""
    h, starts, ends, firsts = words(raw, places)
    n_words = np.diff(firsts)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    begins = np.concatenate(([0], np.cumsum(n_passages)))
    total = int(begins[-1])
    owner = np.repeat(np.arange(len(n_words)), n_words)
    within = np.arange(len(h)) - firsts[:-1][owner]
    of_word = begins[:-1][owner] + within // PASSAGE
    out = np.zeros((total, FEATURES), np.float32)
    if not len(h):
        return out, begins
    # a byte belongs to the passage of the last word that began before it
    lead = np.flatnonzero(within % PASSAGE == 0)
    mark = np.zeros(len(raw) + 1, np.int32)
    np.add.at(mark, starts[lead], 1)
    seq = np.cumsum(mark[:-1]) - 1
    ids = of_word[lead]
    inside = seq >= 0
    kind = _CLASS[raw].astype(np.int32)
    pair = kind[:-1] * _N + kind[1:]
    ok = inside[:-1] & (seq[:-1] == seq[1:])
    flat = np.bincount(seq[:-1][ok].astype(np.int64) * (_N * _N) + pair[ok], minlength=len(ids) * _N * _N)[:len(ids) * _N * _N]
    shares = flat.reshape(len(ids), _N * _N).astype(np.float32)
    shares /= np.maximum(1, shares.sum(1, keepdims=True))
    out[ids, :_N * _N] = np.sqrt(shares)
    count = np.bincount(of_word, minlength=total).astype(np.float32)
    some = np.maximum(1, count)
    # words again in the same passage, and in the passage before
    key = np.lexsort((h, of_word))
    same = np.zeros(len(h), bool)
    same[1:] = (h[key][1:] == h[key][:-1]) & (of_word[key][1:] == of_word[key][:-1])
    out[:, -5] = np.bincount(of_word[key], weights=same, minlength=total) / some
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    out[:, -4] = np.bincount(of_word, weights=again, minlength=total) / some
    far = np.zeros(len(h), bool)
    far[PASSAGE:] = (h[PASSAGE:] == h[:-PASSAGE]) & (owner[PASSAGE:] == owner[:-PASSAGE])
    out[:, -3] = np.bincount(of_word, weights=far, minlength=total) / some
    out[:, -2] = np.bincount(of_word, weights=(ends - starts).astype(float), minlength=total) / some / 10
    out[:, -1] = np.log1p(count) / 5
    return out, begins


def _attend(m: Model, x: np.ndarray, begins: np.ndarray):
    """Everything of a forward pass over bags of passages."""
    at = begins[:-1]
    bag = np.repeat(np.arange(len(at)), np.diff(begins))
    h = np.maximum(0, (x - m.mean) / m.scale @ m.w + m.b)
    t, g = np.tanh(h @ m.v), 1 / (1 + np.exp(-(h @ m.u)))
    e = (t * g) @ m.a
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    weight = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(h * weight[:, None], at, axis=0)
    score = 1 / (1 + np.exp(-(z @ m.c + m.d[0])))
    return bag, h, t, g, weight, z, score


def _gradient(m: Model, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of the bags."""
    bag, h, t, g, weight, z, score = _attend(m, x, begins)
    out = (score - y) / len(y)
    dz = out[:, None] * m.c
    # softmax over the passages of a bag
    de = weight * ((h * dz[bag]).sum(1) - (z * dz).sum(1)[bag])
    dt, dg = de[:, None] * m.a * g * (1 - t * t), de[:, None] * m.a * t * g * (1 - g)
    dh = (weight[:, None] * dz[bag] + dt @ m.v.T + dg @ m.u.T) * (h > 0)
    xs = (x - m.mean) / m.scale
    return {"w": xs.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True)}


def train(x: np.ndarray, begins: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adam over mini-batches of bags, in a fixed order."""
    rng = np.random.default_rng(seed)
    scale = x.std(0) + 1e-2
    m = Model(x.mean(0), scale, rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
              rng.normal(0, GATE ** -0.5, GATE), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))]))
    first, second, step = {}, {}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            part = order[i:i + BATCH]
            rows = np.concatenate([np.arange(begins[k], begins[k + 1]) for k in part])
            sizes = np.concatenate(([0], np.cumsum([begins[k + 1] - begins[k] for k in part])))
            step += 1
            moved = {}
            for name, g in _gradient(m, x[rows], sizes, y[part]).items():
                old = getattr(m, name)
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                moved[name] = old - RATE * (first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8) + DECAY * old)
            m = m._replace(**moved)
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bag: int = BAG, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Model | float:
    """Model from the labelled documents: at most `sample` of them, and of each at
    most `bag` passages, spread evenly over its text. Both bound what the driver
    holds, with FEATURES numbers a passage; scoring knows no such bounds.

    `labels` has (doc_id, quality 0/1); null labels and ids are left out, and of
    several labels of an id the largest counts. Of several rows of an id one
    text is learnt from, the first by its hash. Without both kinds of labels
    the result is their share of 1 (0.5 without any): a constant score.
    """
    marked = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(quality).cast("double").alias("y"))
    some = docs.select(F.col(doc_id).alias("_id")).distinct().join(marked, "_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(some), "_id")
    rows = rows.groupBy("_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, places in slices(batches):
            x, begins = passages(raw, places)
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), batch.column("y"), pa.array([x[some_of(a, b, bag)].tobytes() for a, b in zip(begins[:-1], begins[1:])], pa.binary())], ["id", "y", "x"])

    found = rows.mapInArrow(encode, "id long, y double, x binary").toPandas().sort_values("id", kind="stable")
    y = found["y"].to_numpy(float)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["x"]]
    return train(np.concatenate(bags).astype(float), np.concatenate(([0], np.cumsum([len(b) for b in bags]))), y)


def some_of(first: int, end: int, most: int) -> np.ndarray:
    """All numbers from first to end, or `most` of them at even distances."""
    n = end - first
    return np.arange(first, end) if n <= most else first + np.arange(most) * n // most


def score(docs: DataFrame, model: Model | float, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: the id), score and predicted (1 from `accept` on)
    of every row. A null or empty text is one passage without words; all
    passages of a text of any length count. Rows with equal ids are scored each
    by its own text."""
    keep = [doc_id] if keep is None else keep
    if {"score", "predicted"} & set(keep):
        raise ValueError("columns score and predicted are made here")
    shipped = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, float) else tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value if isinstance(shipped.value, float) else Model(*shipped.value)
        for batch, raw, places in slices(batches, "_mil_text"):
            if isinstance(m, float):
                s = np.full(len(places) - 1, m)
            else:
                x, begins = passages(raw, places)
                s = _attend(m, x, begins)[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(s, pa.float64()), pa.array((s >= accept).astype(np.int32))], [*keep, "score", "predicted"])

    rows = docs.select(*keep, F.col(text).alias("_mil_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")
