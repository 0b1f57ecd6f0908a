"""Language identification: the languages of a text as a mixture, by expectation-maximisation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.frames import stored
from stopflow.llm.tokens import batches_of_text

# Classes that byte trigrams are hashed into.
CLASSES = 1 << 16
SMOOTHING = 0.1
# Neighbouring trigrams share two of three bytes; their evidence counts once.
OVERLAP = 3.0
ROUNDS = 40
UNKNOWN = "und"
# Languages that a model may have; their likelihoods are held by the driver and every task.
MOST_LANGUAGES = 400

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    likelihood: np.ndarray  # (CLASSES, languages)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class of the trigram around every letter byte, and where each text begins.
    All other ASCII characters count as spaces."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = _FOLD[np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8)]
    at = np.flatnonzero(data != 32)
    a, b, c = (data[at + k].astype(np.uint32) for k in (-1, 0, 1))
    code = (a << 16 | b << 8 | c) * np.uint32(2654435761)
    begins = np.cumsum([0] + [len(r) + 2 for r in raw])
    return (code >> np.uint32(16)).astype(np.uint16), np.searchsorted(at, begins)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram likelihoods of every language that occurs, counted over all rows
    whose text and language are not null. Each task adds up its rows before the
    shuffle; the model has CLASSES numbers per language, whatever the input. More
    than MOST_LANGUAGES languages are an error. Repeated rows count each; a text
    of any length is one row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in batches_of_text(batches):
            names = batch.column("lang").to_pylist()
            codes, begins = _trigrams(texts)
            for name in set(names):
                own = np.concatenate([codes[begins[i]:begins[i + 1]] for i, x in enumerate(names) if x == name])
                sums[name] = sums.get(name, 0) + np.bincount(own, minlength=CLASSES)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "class", "n"])

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = stored(known.mapInArrow(count, "lang string, class int, n long").groupBy("lang", "class").agg(F.sum("n").alias("n")), "trigrams")
    if counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = counts.toPandas()
    languages = sorted(set(rows["lang"]))
    n = np.zeros((CLASSES, len(languages)))
    n[rows["class"].to_numpy(int), [languages.index(x) for x in rows["lang"]]] = rows["n"]
    return Model(languages, (n + SMOOTHING) / (n.sum(0) + SMOOTHING * CLASSES))


def _mixture(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p that maximise sum n log(p @ w), and that sum."""
    total = n.sum()
    w = np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] == 1:
        return w, float(n @ np.log(p[:, 0]))
    for _ in range(rounds):
        step = w * (p.T @ (n / (p @ w))) / total
        moved = np.abs(step - w).max()
        w = step
        if moved < 1e-3:
            break
    return w, float(n @ np.log(p @ w))


def infer(model: Model, codes: np.ndarray, rounds: int = ROUNDS) -> tuple[list[int], np.ndarray]:
    """Languages of one text and their proportions, largest first.

    All languages are mixed first; then the sets of the one, two, ... largest
    are fitted anew while log-likelihood / OVERLAP minus half the logarithm of
    the number of trigrams per further language still rises."""
    code, n = np.unique(codes, return_counts=True)
    p = model.likelihood[code]
    n = n.astype(float)
    order = np.argsort(-_mixture(p, n, rounds)[0], kind="stable") if p.shape[1] > 1 else np.zeros(1, int)
    best, best_value = None, -math.inf
    for k in range(1, len(order) + 1):
        w, value = _mixture(p[:, order[:k]], n, rounds)
        value = value / OVERLAP - (k - 1) * 0.5 * math.log(n.sum())
        if value <= best_value:
            break
        best, best_value = (order[:k], w), value
    by_size = np.argsort(-best[1], kind="stable")
    return best[0][by_size].tolist(), best[1][by_size]


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred, score (its proportion), languages, proportions.

    A text that is null or has no letter, and every text when the model knows no
    language, is `und` with score 0 and empty lists; letters are characters of
    Unicode category L, so numbers written as one character are none. Ties go to
    the language that comes first by name. Rows are judged each by itself, texts
    as a whole, however long.
    """
    clash = {"lang_pred", "score", "languages", "proportions", "text"} & set(keep)
    if clash:
        raise ValueError(f"columns that are made here: {sorted(clash)}")
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shipped.value)
        for batch, texts in batches_of_text(batches):
            codes, begins = _trigrams(texts)
            names, scores, lists, shares = [], [], [], []
            for i, t in enumerate(texts):
                if not m.languages or not _LETTER.search(t):
                    langs, w = [], np.zeros(0)
                else:
                    langs, w = infer(m, codes[begins[i]:begins[i + 1]])
                lists.append([m.languages[k] for k in langs])
                shares.append(w.tolist())
                names.append(lists[-1][0] if langs else UNKNOWN)
                scores.append(min(1.0, float(w[0])) if langs else 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lists, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                                             [*keep, "lang_pred", "score", "languages", "proportions"])

    rows = docs.select(*keep, F.col(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, languages array<string>, proportions array<double>")
