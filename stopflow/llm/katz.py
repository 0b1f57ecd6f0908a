"""Language-model scoring: a Katz backoff bigram model with Good-Turing discounts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.arrays import mix, slices, words
from stopflow.llm.frames import stored
from stopflow.llm.packed import bucket_of, cuts, pack, pack_sorted, unpack, unpack_sorted

# Counts up to this one are discounted.
K = 5
# Tokens of one chunk of documents, and entries per bucket of a count table.
CHUNK = 1_500_000
PER_BUCKET = 500_000
# A context with more than 1 / HOT of a bucket's tokens is spread over all buckets.
HOT = 4

_END = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


class Totals(NamedTuple):
    """Of the training tokens: their number, the distinct ones, and what the unigram
    level makes of each count."""

    tokens: int
    distinct: int
    discount: np.ndarray  # of counts 0..K
    scale: float  # of all probabilities of seen tokens
    unseen: float  # log10 probability of an unseen token


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of the counts 0..K from the numbers of n-grams that
    were seen 1..K+1 times, normalised so that counts above K keep all their
    mass. Where these numbers do not fall as they should, absolute discounting
    takes over: (r - D) / r with D = n1 / (n1 + 2 n2), 0.5 if there are none."""
    n = np.concatenate(([0.0], of_counts.astype(float)))
    d = np.ones(K + 1)
    if (n[1:K + 2] > 0).all():
        over = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        d[1:] = ((r + 1) * n[2:K + 2] / (r * n[1:K + 1]) - over) / (1 - over) if over < 1 else -1
    if not ((d > 0) & (d <= 1)).all() or not (n[1:K + 2] > 0).all():
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
        d[1:] = 1 - cut / np.arange(1, K + 1)
    return d


def _discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after discounting; those above K stay."""
    return np.where(count > K, count, count * d[np.minimum(count, K)])


def unigrams(count: np.ndarray, t: Totals) -> np.ndarray:
    """Probability of tokens with these counts; 0 gives that of all unseen ones."""
    p = _discounted(count, t.discount) / max(t.tokens, 1) * t.scale
    return np.where(count > 0, p, 10.0 ** t.unseen)


def _pack32(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack32(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def _of_counts(count: np.ndarray) -> list[int]:
    return np.bincount(count[count <= K + 1], minlength=K + 2)[1:].tolist() if len(count) else [0] * (K + 1)


def encode(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, text, held_out) as numbers, stored: the hashes
    of a chunk's distinct tokens in ascending order, frequent ones first in the
    numbering of the token stream, which ends each document with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, docs_, lengths = 0, [], [], []

        def flush() -> pa.RecordBatch:
            h = np.concatenate(parts)
            vocab, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            cols = [[uuid.uuid4().int >> 65], [[d for d, _ in docs_]], [[o for _, o in docs_]], [np.concatenate(lengths).astype(np.int32).tolist()], [pack_sorted(vocab)], [_pack32(order)], [_pack32(rank[inverse])], [len(h)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["chunk", "doc_id", "held_out", "lengths", "vocab", "ranked", "tokens", "n"])

        for batch, raw, places in slices(batches):
            h, _, _, firsts = words(raw, places)
            parts.append(np.insert(h, firsts[1:], _END))
            lengths.append(np.diff(firsts) + 1)
            docs_ += list(zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()))
            held += len(parts[-1])
            if held >= CHUNK:
                yield flush()
                held, parts, docs_, lengths = 0, [], [], []
        if held:
            yield flush()

    return stored(docs.mapInArrow(run, "chunk long, doc_id array<long>, held_out array<boolean>, lengths array<int>, vocab binary, ranked binary, tokens binary, n long"), "encoded")


def _tokens(row: dict, v: int) -> np.ndarray:
    """Local numbers, by hash, of a chunk's tokens."""
    return _unpack32(row["ranked"], v)[_unpack32(row["tokens"], row["n"])]


def count_unigrams(encoded: DataFrame, buckets: int) -> DataFrame:
    """Rows (chunk, bucket, ids, counts): for the tokens of each chunk that fall into
    a bucket, their places among all tokens of it and their training counts; and
    per bucket a row of chunk -1 with the table itself and its sums, stored."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                vocab = unpack_sorted(row["vocab"])
                lengths, held = np.asarray(row["lengths"], np.int64), np.asarray(row["held_out"], bool)
                n = np.bincount(_tokens(row, len(vocab)), weights=np.repeat(~held, lengths), minlength=len(vocab)).astype(np.int64)
                at = cuts(vocab, buckets)
                some = [k for k in range(buckets) if at[k + 1] > at[k]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()), pa.array([pack_sorted(vocab[at[k]:at[k + 1]]) for k in some], pa.binary()), pa.array([pack(n[at[k]:at[k + 1]]) for k in some], pa.binary())],
                                                 ["bucket", "chunk", "keys", "n"])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, n = [unpack_sorted(r["keys"]) for r in rows], [unpack(r["n"], np.int64) for r in rows]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(n), minlength=len(every)).astype(np.int64)
        seen = total[total > 0]
        out = [(r["chunk"], rows[0]["bucket"], pack_sorted(i.astype(np.uint64)), pack(total[i]), None) for r, i in zip(rows, np.split(inverse, np.cumsum([len(k) for k in keys])[:-1]))]
        out.append((-1, rows[0]["bucket"], pack_sorted(every), pack(total), [len(every), int(seen.sum()), len(seen), *_of_counts(seen)]))
        return _table(out, ["chunk", "bucket", "ids", "counts", "sums"])

    asked = encoded.select("chunk", "held_out", "lengths", "vocab", "ranked", "tokens", "n").mapInArrow(ask, "bucket int, chunk long, keys binary, n binary")
    return stored(asked.groupBy("bucket").applyInArrow(merge, "chunk long, bucket int, ids binary, counts binary, sums array<long>"), "unigrams")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"chunk": pa.int64(), "bucket": pa.int32(), "sums": pa.list_(pa.int64())}
    cols = list(zip(*rows))
    return pa.table({n: pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, cols)})


def totals(sums: np.ndarray) -> Totals:
    """From tokens, distinct tokens and the counts of counts."""
    tokens, distinct = int(sums[0]), int(sums[1])
    d = discounts(sums[2:])
    if not tokens:
        return Totals(0, 0, d, 1.0, 0.0)
    r = np.arange(1, K + 1)
    left = float((r * sums[2:2 + K] * (1 - d[1:])).sum()) / tokens
    # without rare tokens one count is set aside for the unseen ones
    scale = 1.0 if left > 0 else tokens / (tokens + 1)
    return Totals(tokens, distinct, d, scale, float(np.log10(left if left > 0 else 1 / (tokens + 1))))


class _Pairs(NamedTuple):
    """Distinct pairs of neighbouring tokens of a chunk, in order of bucket,
    context and token."""

    of_token: np.ndarray
    context: np.ndarray
    token: np.ndarray
    at: np.ndarray


def _pairs(tokens: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray, start_id: int, starts: int, buckets: int, hot: float) -> _Pairs:
    """The context of a document's first token is a start mark, local number len(ids)."""
    v = len(ids)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = v
    pairs, of_token = np.unique(before.astype(np.uint64) * np.uint64(v + 1) + tokens.astype(np.uint64), return_inverse=True)
    context, token = (pairs // np.uint64(v + 1)).astype(np.int64), (pairs % np.uint64(v + 1)).astype(np.int64)
    own = np.append(ids, start_id)[context].astype(np.uint64)
    spread = np.append(counts, starts)[context] > hot
    key = mix(own * _PAIR + np.where(spread, ids[token].astype(np.uint64) + np.uint64(1), np.uint64(0)))
    bucket = bucket_of(key, buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return _Pairs(place[of_token], context[order], token[order], np.searchsorted(bucket[order], np.arange(buckets + 1)))


def _vocabulary(row: dict, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Global ids and training counts of a chunk's tokens, from all buckets."""
    parts = sorted(row["unigrams"], key=lambda r: r["bucket"])
    return np.concatenate([unpack_sorted(r["ids"]).astype(np.int64) + offsets[r["bucket"]] for r in parts]), np.concatenate([unpack(r["counts"], np.int64) for r in parts])


def count_bigrams(chunks: DataFrame, t: Totals, starts: int, offsets: np.ndarray, buckets: int, hot: float) -> DataFrame:
    """For each chunk and bucket the training counts of the chunk's pairs, with the
    sums of contexts that need their backoff weight; per bucket (chunk -1) the
    table of counts with its counts of counts; and (chunk -2) the sums of
    contexts that are spread over the buckets. Stored."""
    start_id = int(offsets[-1])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids, counts = _vocabulary(row, offsets)
                lengths, held = np.asarray(row["lengths"], np.int64), np.asarray(row["held_out"], bool)
                tokens = _tokens(row, len(ids))
                p = _pairs(tokens, lengths, ids, counts, start_id, starts, buckets, hot)
                n = np.bincount(p.of_token, weights=np.repeat(~held, lengths), minlength=len(p.token)).astype(np.int64)
                own, spread = np.append(ids, start_id), np.append(counts, starts) > hot
                some = [k for k in range(buckets) if p.at[k + 1] > p.at[k]]
                cols: list[list[bytes]] = [[], [], [], [], []]
                for k in some:
                    c, w = p.context[p.at[k]:p.at[k + 1]], p.token[p.at[k]:p.at[k + 1]]
                    for col, x in zip(cols, (pack_sorted(own[c].astype(np.uint64)), pack(ids[w]), pack(n[p.at[k]:p.at[k + 1]]), pack(counts[w]), np.packbits(spread[c]).tobytes())):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", "chunk", "context", "token", "n", "count", "spread"])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        context = [unpack_sorted(r["context"]).astype(np.int64) for r in rows]
        token, n, count = ([unpack(r[c], np.int64) for r in rows] for c in ("token", "n", "count"))
        spread = [np.unpackbits(np.frombuffer(r["spread"], np.uint8), count=len(x)).astype(bool) for r, x in zip(rows, context)]
        sizes = np.cumsum([len(x) for x in context])[:-1]
        context, token, n, count, spread = (np.concatenate(x) for x in (context, token, n, count, spread))
        order = np.lexsort((token, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (token[order][1:] != token[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=n).astype(np.int64)
        first = order[new]
        # sums per context: followers seen 1..K times, the mass of all others, unigram mass of the seen
        by = np.cumsum(np.append(True, context[first][1:] != context[first][:-1])) - 1
        contexts = by[-1] + 1
        name, is_spread = context[first][np.searchsorted(by, np.arange(contexts))], spread[first][np.searchsorted(by, np.arange(contexts))]
        low = np.minimum(total, K + 1)
        met = np.bincount(by * (K + 2) + low, minlength=contexts * (K + 2)).reshape(contexts, K + 2)[:, 1:K + 1].astype(np.int64)
        big = np.bincount(by, weights=np.where(total > K, total, 0), minlength=contexts).astype(np.int64)
        below = np.bincount(by, weights=np.where(total > 0, unigrams(count[first], t), 0), minlength=contexts)
        out = []
        bucket = rows[0]["bucket"]
        for r, g in zip(rows, np.split(group, sizes)):
            c = by[g]
            want = np.unique(c[(total[g] == 0) | (met[c].sum(1) == 0)])
            want = want[~is_spread[want]]
            out.append((r["chunk"], bucket, pack(total[g]), pack_sorted(name[want].astype(np.uint64)), pack(met[want].ravel()), pack(big[want]), pack(below[want].view(np.int64)), None))
        s = np.flatnonzero(is_spread)
        out.append((-2, bucket, pack(np.zeros(0, np.int64)), pack_sorted(name[s].astype(np.uint64)), pack(met[s].ravel()), pack(big[s]), pack(below[s].view(np.int64)), None))
        seen = total > 0
        out.append((-1, bucket, pack(total[seen]), pack_sorted(context[first][seen].astype(np.uint64)), pack(token[first][seen]), b"", b"", _of_counts(total[seen])))
        return _table(out, ["chunk", "bucket", "counts", "context", "met", "big", "below", "sums"])

    asked = chunks.mapInArrow(ask, "bucket int, chunk long, context binary, token binary, n binary, count binary, spread binary")
    return stored(asked.groupBy("bucket").applyInArrow(merge, "chunk long, bucket int, counts binary, context binary, met binary, big binary, below binary, sums array<long>"), "bigrams")


def backoff(met: np.ndarray, big: np.ndarray, below: np.ndarray, count: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the lower level after a context, and the context's total. The
    weight makes the probabilities of all tokens add up to one; a context that
    leaves no mass gets one more in its total."""
    kept = (met * (np.arange(1, K + 1) * d[1:])).sum(1) + big
    total = count + (kept >= count - 1e-9)
    return (1 - kept / np.maximum(total, 1)) / (1 - below), total


def _spread_sums(bigrams: DataFrame) -> DataFrame:
    """Sums of the contexts that are spread over the buckets: at most HOT times as
    many rows as there are buckets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                met = unpack(r["met"], np.int64).reshape(-1, K)
                yield pa.RecordBatch.from_arrays([pa.array(unpack_sorted(r["context"]).astype(np.int64)), *[pa.array(met[:, k]) for k in range(K)], pa.array(unpack(r["big"], np.int64)), pa.array(unpack(r["below"], np.float64))], ["context", *[f"m{k}" for k in range(K)], "big", "below"])

    one = bigrams.where("chunk = -2").select("context", "met", "big", "below").mapInArrow(rows, "context long, " + ", ".join(f"m{k} long" for k in range(K)) + ", big long, below double")
    return one.groupBy("context").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(K)], F.sum("big").alias("big"), F.sum("below").alias("below")).select("context", F.array(*[f"m{k}" for k in range(K)]).alias("met"), "big", "below")


def score(docs: DataFrame, held_out: str = "held_out", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every
    document, from a model of those that are not held out.

    Tokens are words (A-Z lower-cased) and one end. A pair of tokens seen in
    training has its discounted relative frequency; else the token's unigram
    probability counts, times the backoff weight of the context; a context never
    seen weighs 1. Unseen tokens share what Good-Turing takes from the seen ones.
    base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))).

    A null text is an end only; a null held_out trains. Without training tokens
    every token has probability 1. Repeated rows and ids are scored each by
    itself, and empty tables give empty results.

    Counts lie in tables partitioned by hash ranges of tokens and contexts. A
    chunk of documents asks each part for the counts of its distinct tokens and
    pairs (summed within the chunk first) and gets them back in the same order,
    so the rows shuffled are the distinct pairs per chunk. Contexts with a large
    share of all tokens are spread over all parts, and their sums, at most HOT
    per part, meet in one broadcast table.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    encoded = encode(rows)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    n_all = encoded.agg(F.sum("n")).first()[0]
    if not n_all:
        return docs.sparkSession.createDataFrame([], schema)
    buckets = max(1, -(-n_all // PER_BUCKET))
    uni = count_unigrams(encoded, buckets)
    # one short row per bucket
    sums = {r["bucket"]: r["sums"] for r in uni.where("chunk = -1").select("bucket", "sums").collect()}
    offsets = np.cumsum([0] + [sums[k][0] if k in sums else 0 for k in range(buckets)])
    t = totals(np.sum([s[1:] for s in sums.values()], axis=0))
    starts = encoded.select(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0]
    hot = t.tokens / buckets / HOT
    answers = uni.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ids", "counts")).alias("unigrams"))
    chunks = encoded.drop("vocab").join(answers, "chunk")
    bi = count_bigrams(chunks.drop("doc_id"), t, starts, offsets, buckets, hot)
    d = discounts(np.sum([r["sums"] for r in bi.where("chunk = -1").select("sums").collect()], axis=0))
    wide = {r["context"]: (np.asarray(r["met"]), r["big"], r["below"]) for r in _spread_sums(bi).collect()}
    shipped = docs.sparkSession.sparkContext.broadcast((tuple(t), offsets, d, wide))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, offsets, d, wide = shipped.value
        t = Totals(*plain)
        start_id = int(offsets[-1])
        base = t.tokens + 0.5 * (t.distinct + 1)
        for batch in batches:
            for row in _rows(batch):
                ids, counts = _vocabulary(row, offsets)
                lengths = np.asarray(row["lengths"], np.int64)
                tokens = _tokens(row, len(ids))
                p = _pairs(tokens, lengths, ids, counts, start_id, starts, buckets, hot)
                pair = np.zeros(len(p.token), np.int64)
                parts = [[], [], [], []]
                for r in row["bigrams"]:
                    pair[p.at[r["bucket"]]:p.at[r["bucket"] + 1]] = unpack(r["counts"], np.int64)
                    for x, y in zip(parts, (unpack_sorted(r["context"]).astype(np.int64), unpack(r["met"], np.int64).reshape(-1, K), unpack(r["big"], np.int64), unpack(r["below"], np.float64))):
                        x.append(y)
                own, total = np.append(ids, start_id), np.append(counts, starts).astype(float)
                local = {c: i for i, c in enumerate(own.tolist()) if c in wide}
                name = np.concatenate([np.zeros(0, np.int64), *parts[0], np.array(list(local), np.int64)])
                met = np.concatenate([np.zeros((0, K), np.int64), *parts[1], np.array([wide[c][0] for c in local]).reshape(-1, K)])
                big = np.concatenate([np.zeros(0, np.int64), *parts[2], np.array([wide[c][1] for c in local], np.int64)])
                below = np.concatenate([np.zeros(0), *parts[3], np.array([wide[c][2] for c in local], float)])
                at = np.searchsorted(own, name)
                weight = np.ones(len(own))
                ctx = total[at]
                alpha, grown = backoff(met, big, below, ctx, d)
                weight[at] = np.where(ctx > 0, alpha, 1.0)
                total[at] = np.where(ctx > 0, grown, 1.0)
                uni_log = np.log10(unigrams(counts, t))
                with np.errstate(divide="ignore"):
                    seen = np.log10(_discounted(pair, d) / np.maximum(total[p.context], 1))
                    value = np.where(pair > 0, seen, np.log10(weight[p.context]) + uni_log[p.token])
                begins = np.cumsum(lengths) - lengths
                known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), begins)
                flat = np.add.reduceat(np.log10((counts + 0.5) / base)[tokens], begins)
                full = np.add.reduceat(value[p.of_token], begins)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), t.tokens)), pa.array(flat), pa.array(full)],
                                                 ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    replies = bi.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "context", "met", "big", "below")).alias("bigrams"))
    return chunks.join(replies, "chunk").mapInArrow(evaluate, schema)
