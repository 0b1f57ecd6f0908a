"""Long repeats cut out of a corpus: run-length compressed indexes over the strings around shared anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopflow.llm.arrays import _BYTE, _STEP, _powers, mix, slices
from stopflow.llm.frames import stored

# A string of so many bytes is removed where it also starts earlier.
LENGTH = 100
# Bytes of the grams whose least hash in a string of LENGTH is its anchor.
GRAM = 24
# Bytes of strings that are indexed together.
BUCKET_BYTES = 1 << 20
# Different strings around one anchor; an anchor with more gets finer ones.
MOST = 4096
# Places at which a task remembers anchors, to know them again without a shuffle.
SEEN = 1 << 21
# Bytes of text whose anchors are found together.
SLICE_BYTES = 1 << 18

_BYTE_D = np.random.default_rng(20240502).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Bytes that no UTF-8 text has: the end of a string, and of all strings.
_END, _LAST = 0xFF, 0xFE


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """The least or largest of every `width` consecutive numbers."""
    size = 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:size - width], x[width - size:]) if size < width else x


def _inside(places: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of the n places begin a string of `length` inside one text."""
    step = np.zeros(n + 1, np.int64)
    whole = np.diff(places) >= length
    np.add.at(step, places[:-1][whole], 1)
    np.add.at(step, places[1:][whole] - length + 1, -1)
    return np.cumsum(step[:n]) > 0


def anchors(raw: np.ndarray, places: np.ndarray, gram: int, length: int) -> dict[str, np.ndarray]:
    """Runs of places whose strings of `length` have the same anchor, the least hash
    of their grams: where a run starts, how many places it has, the anchor, a
    digest of the bytes that its strings cover, and whether its anchor occurs
    twice there. Equal strings have equal anchors."""
    n, w = len(raw), length - gram + 1
    none = {"start": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "h": np.zeros(0, np.uint64), "d": np.zeros(0, np.uint64), "twice": np.zeros(0, bool)}
    if n < length:
        return none
    forth, back = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * forth[:n], out=total[1:])
    g = mix((total[gram:] - total[:-gram]) * back[:n - gram + 1])
    m = _sliding(np.minimum, g, w)
    ok = _inside(places, len(m), length)
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (m[1:] != m[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return none
    stops = np.append(np.flatnonzero(first | ~ok), len(m))
    count = stops[np.searchsorted(stops, start, side="right")] - start
    # the same anchor again and again: pieces of w places
    pieces = -(-count // w)
    which = np.repeat(np.arange(len(start)), pieces)
    within = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, count = start[which] + w * within, np.minimum(w, count[which] - w * within)
    # grams that are the least of some string
    most = _sliding(np.maximum, np.concatenate((np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64))), w)
    least = np.flatnonzero(g == most)
    same = np.concatenate(([0], np.cumsum(g[least[1:]] == g[least[:-1]])))
    lo, hi = np.searchsorted(least, start), np.searchsorted(least, start + count + w - 1)
    twice = same[np.maximum(hi - 1, lo)] > same[lo]
    np.cumsum(_BYTE_D[raw] * forth[:n], out=total[1:])
    d = mix((total[start + count + length - 1] - total[start]) * back[start] + count.astype(np.uint64) * _STEP[63])
    return {"start": start, "n": count, "h": m[start], "d": d, "twice": twice}


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's suffixes in ascending order, and the first eight bytes
    of each suffix as a number. The last byte must be the only one of its kind."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | padded[k:n + k]
    sa = np.argsort(head)
    new = np.ones(n, bool)
    new[1:] = head[sa[1:]] != head[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    slot = np.flatnonzero(~alone)
    depth = 8
    # the slots of equal prefixes are sorted by the ranks of what follows
    while len(slot):
        at = sa[slot]
        behind = np.minimum(at + depth, n - 1)
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[behind].astype(np.uint64)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slot] = at
        new = np.ones(len(slot), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = slot[np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))]
        slot = slot[~(new & np.append(new[1:], True))]
        depth *= 2
    return sa, head


class RunIndex:
    """Index of many strings, compressed to the runs of their Burrows-Wheeler transform.

    `heads` and `lengths` are the runs. `samples` are the places of the suffixes
    at the starts of runs in the order of the text, `before` the place of the
    suffix at the end of the run before each, and `common` how many bytes the
    two share. All other suffixes follow from these: a suffix inside a run has
    the same byte before it as its neighbour in the order, so going on by one
    byte in both leaves neighbours that share one byte less.
    """

    def __init__(self, raw: np.ndarray, places: np.ndarray):
        lengths = np.diff(places)
        n = len(raw) + len(lengths) + 1
        t = np.full(n, _END, np.uint8)
        self.starts = places[:-1] + np.arange(len(lengths))
        t[np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths)] = raw
        t[-1] = _LAST
        self.size = n
        sa, head = suffix_array(t)
        bwt = t[sa - 1]
        edge = np.ones(n, bool)
        edge[1:] = bwt[1:] != bwt[:-1]
        rows = np.flatnonzero(edge)
        self.heads, self.lengths = bwt[rows], np.diff(np.append(rows, n))
        samples, before = sa[rows], sa[rows - 1]
        order = np.argsort(samples)
        self.samples, self.before = samples[order], before[order]
        self.common = self._common(head, t, self.samples, self.before)
        self.common[self.samples == sa[0]] = 0

    @staticmethod
    def _common(head: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shared bytes of suffixes, eight at a time; different suffixes part before the end."""
        out = np.zeros(len(a), np.int64)
        some = np.flatnonzero(a != b)
        n = len(t)
        while len(some):
            x, y = a[some] + out[some], b[some] + out[some]
            inside = (x < n) & (y < n)
            some, x, y = some[inside], x[inside], y[inside]
            same = head[x] == head[y]
            part = some[~same]
            if len(part):
                u = (head[x[~same]] ^ head[y[~same]]).astype(">u8").view(np.uint8).reshape(-1, 8)
                out[part] += (u != 0).argmax(1)
            some = some[same]
            out[some] += 8
        return out

    def statistics(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of places of the text, in ascending order: how many
        bytes from there are shared with the neighbour in the order of all
        suffixes, and where the neighbour is."""
        k = np.searchsorted(self.samples, at, side="right") - 1
        on = at - self.samples[k]
        return np.maximum(self.common[k] - on, 0), np.minimum(self.before[k] + on, self.size - 1)

    def restore(self) -> np.ndarray:
        """The indexed bytes from the runs alone, by steps from the last place to the first."""
        bwt = np.repeat(self.heads, self.lengths)
        back = np.empty(self.size, np.int64)
        back[np.argsort(bwt, kind="stable")] = np.arange(self.size)
        out, row = np.empty(self.size, np.uint8), int(np.flatnonzero(bwt == _LAST)[0])
        # the row of the whole text has the last byte before it
        for i in range(self.size - 1, -1, -1):
            out[i] = bwt[row]
            row = int(back[row])
        return out


def later(raw: np.ndarray, places: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (string, from, to) of the places of strings at which `length` bytes
    begin that also begin at a smaller position; `position` is that of each
    string's first byte."""
    index = RunIndex(raw, places)
    valid = np.zeros(index.size, bool)
    count = np.maximum(np.diff(places) - length + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    rel = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = index.starts[owner] + rel
    valid[at] = True
    shared, other = index.statistics(at)
    place = np.cumsum(valid) - 1
    link = (shared >= length) & valid[other]
    root = np.where(link, place[other], np.arange(len(at)))
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    pos = position[owner] + rel
    least = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(least, root, pos)
    hit = pos > least[root]
    begin = hit.copy()
    begin[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    end = hit.copy()
    end[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    return owner[b], rel[b], rel[e] + 1


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _whole(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(memoryview(data)[8:], n, codec="zstd", asbytes=True) if n else b""


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))


_KEY = ["id", "base", "k1", "k2"]


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equal in all columns, null ids too."""
    on = F.lit(True)
    for c in columns:
        on = on & (a[c].eqNullSafe(b[c]) if c == "id" else a[c] == b[c])
    return on


def occurrences(rows: DataFrame, gram: int, length: int, seen: int = SEEN) -> DataFrame:
    """(h, d, id, base, k1, k2, a, n, twice) of the runs of all rows whose anchor
    occurs more than once in the corpus.

    All runs of an anchor would meet at its hash; a task that knows an anchor
    from an earlier run deals further ones out by their own hash and leaves a
    note at the anchor's, so that a task adds few rows to an anchor, whatever its
    share of the corpus. `seen` is a power of two.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last anchor met at each place; one that gave way is simply met anew
        known, noted = np.zeros(seen, np.uint64), np.zeros(seen, np.uint64)
        for part, raw, places in slices(batches, "data", SLICE_BYTES):
            r = anchors(raw, places, gram, length)
            if not len(r["h"]):
                continue
            u, first, back, count = np.unique(r["h"], return_index=True, return_inverse=True, return_counts=True)
            place = u & np.uint64(seen - 1)
            old = known[place] == u
            again = np.ones(len(back), bool)
            again[first[~old]] = False
            again_u = old | (count > 1)
            again_u[back[r["twice"]]] = True
            note = u[again_u & (noted[place] != u)]
            known[place] = u
            noted[note & np.uint64(seen - 1)] = note
            row = np.searchsorted(places, r["start"], side="right") - 1
            a = r["start"] - places[row]
            salt = np.where(again, 1 + (mix(r["d"] + a.astype(np.uint64)) >> np.uint64(52)), 0).astype(np.int32)
            take = pa.array(np.concatenate((row, np.zeros(len(note), np.int64))))
            last = np.zeros(len(note), np.int64)
            yield pa.RecordBatch.from_arrays(
                [_long(np.concatenate((r["h"], note))), pa.array(np.concatenate((salt, last)).astype(np.int32)), _long(np.concatenate((r["d"], last.view(np.uint64)))),
                 *[part.column(c).take(take) for c in _KEY], pa.array(np.concatenate((a, last - 1)).astype(np.int32)), pa.array((np.concatenate((2 * r["n"] + r["twice"], last))).astype(np.int32))],
                ["h", "salt", "d", *_KEY, "a", "n"])

    runs = rows.select(*_KEY, "data").mapInArrow(scan, "h long, salt int, d long, id long, base int, k1 long, k2 long, a int, n int")
    met = runs.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("h", "salt")))
    kept = met.where("a >= 0 AND (salt > 0 OR met > 1)")
    return stored(kept.select("h", "d", *_KEY, "a", F.expr("n div 2").cast("int").alias("n"), (F.col("n") % 2).alias("twice")), "runs")


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, most: int = MOST, unique: bool = False) -> DataFrame:
    """(id, base, k1, k2, marks) of the rows (id, base, k1, k2, data) with places at
    which `length` bytes begin that also begin at a smaller (id, base + place);
    marks are arrays of (from, to). `k1` and `k2` tell apart rows that share an
    id and a base; equal rows must be equal in these. `unique` says that there
    are no equal rows.

    Equal strings have the same anchor. Runs of strings around anchors that
    occur once are dropped, and equal runs of bytes are one, standing for the
    first; further copies are repeats throughout. What is left of an anchor,
    different runs that may share strings, is indexed in buckets of anchors. An
    anchor with more than `most` different runs does not go to a bucket: its
    runs are dealt anew, in the same way, by longer grams. At last a gram is a
    whole string, and then all runs of an anchor are one.
    """
    occ = occurrences(rows, gram, length)
    first = F.min(F.struct("id", (F.col("base") + F.col("a")).alias("at"), "base", "k1", "k2", "a")).alias("f")
    groups = stored(occ.groupBy("h", "d").agg(first, F.max("n").alias("n"), F.count("*").alias("c"), F.max("twice").alias("twice")), "strings")
    kinds = groups.groupBy("h").agg(F.count("*").alias("k"), F.max("twice").alias("t")).where("k > 1 OR t > 0")
    need = groups.join(kinds, "h").select(*[F.col(f"f.{c}").alias(c) for c in _KEY], F.struct("h", "d", "f.a", "n", "k").alias("cut")).groupBy(*_KEY).agg(F.collect_list("cut").alias("cuts"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _KEY], pa.array([_squeezed(x) for x in b.column("data").cast(pa.large_binary()).to_pylist()], pa.binary())], [*_KEY, "z"])

    kind = "id long, base int, k1 long, k2 long"
    texts = rows.select(*_KEY, "data").mapInArrow(squeeze, f"{kind}, z binary").withColumnsRenamed({c: f"r_{c}" for c in _KEY})
    on = F.lit(True)
    for c in _KEY:
        on = on & (need[c].eqNullSafe(texts[f"r_{c}"]) if c == "id" else need[c] == texts[f"r_{c}"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                cuts = part.column("cuts").flatten()
                row = np.repeat(np.arange(len(part)), pa.compute.list_value_length(part.column("cuts")).to_numpy())
                starts, ends = cuts.field("a").to_numpy(), cuts.field("a").to_numpy() + cuts.field("n").to_numpy() + length - 1
                texts = [_whole(z) for z in part.column("z").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [cuts.field("h"), cuts.field("d"), cuts.field("k"), part.column("id").take(pa.array(row)), pa.array((part.column("base").to_numpy()[row] + starts).astype(np.int32)),
                     pa.array([texts[r][s:e] for r, s, e in zip(row.tolist(), starts.tolist(), ends.tolist())], pa.binary())], ["h", "d", "k", "id", "at", "data"])

    asked = need.join(texts, on).select(*_KEY, "cuts", "z")
    if not unique:
        # repeated rows: one of them
        asked = asked.dropDuplicates(_KEY)
    strings = stored(asked.mapInArrow(cut, "h long, d long, k long, id long, at int, data binary"), "cuts")

    def find(table: pa.Table) -> pa.Table:
        data = table.column("data").cast(pa.large_binary()).combine_chunks()
        sizes = np.array([len(x) for x in data.to_pylist()], np.int64)
        places = np.concatenate(([0], np.cumsum(sizes)))
        raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        ids = table.column("id").to_pandas().rank(method="dense", na_option="top").to_numpy().astype(np.int64)
        owner, lo, hi = later(raw, places, (ids << 32) + table.column("at").to_numpy(), length)
        return pa.table({"h": table.column("h").take(pa.array(owner)), "d": table.column("d").take(pa.array(owner)), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})

    small = strings.where(F.col("k") <= most)
    buckets = max(1, -(-(strings.agg(F.sum(F.length("data"))).first()[0] or 0) // bucket_bytes))
    found = small.withColumn("bucket", F.expr(f"pmod(xxhash64(h), {buckets})")).groupBy("bucket").applyInArrow(find, "h long, d long, lo int, hi int")
    ranges = found.groupBy("h", "d").agg(F.collect_list(F.struct(F.col("lo").alias("from"), F.col("hi").alias("to"))).alias("ranges"))
    hot = strings.where(F.col("k") > most)
    if gram < length and not hot.isEmpty():
        finer = length - (length - gram) // 2
        inner = repeats(hot.select("id", F.col("at").alias("base"), F.col("h").alias("k1"), F.col("d").alias("k2"), "data"), length, finer, bucket_bytes, most, True)
        ranges = ranges.union(inner.select(F.col("k1").alias("h"), F.col("k2").alias("d"), F.col("marks").alias("ranges")))
    verdicts = stored(groups.join(ranges, ["h", "d"], "left").where("c > 1 OR ranges IS NOT NULL").select("h", "d", F.col("f.id").alias("f_id"), F.col("f.at").alias("f_at"), "ranges"), "verdicts")
    is_first = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("base") + F.col("a") == F.col("f_at"))
    shifted = F.transform("ranges", lambda r: F.struct((r["from"] + F.col("a")).alias("from"), (r["to"] + F.col("a")).alias("to")))
    marks = F.when(is_first, shifted).otherwise(F.array(F.struct(F.col("a").alias("from"), (F.col("a") + F.col("n")).alias("to"))))
    hits = occ.join(verdicts, ["h", "d"]).withColumn("marks", marks).where("marks IS NOT NULL")
    return hits.groupBy(*_KEY).agg(F.flatten(F.collect_list("marks")).alias("marks"))


def remove(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every document: a byte goes if it
    is covered by `length` bytes that also start earlier, in a document with a
    smaller id or before that in the same one. `spans` are the maximal runs
    [start, end) of bytes that go, `kept` the others, which may cut a character.

    Strings are judged on the texts as given, as UTF-8 bytes, and never reach
    over the end of a text; a null text is empty. A null id is smaller than all
    others. Rows with equal ids are one document in this respect: strings at the
    same place in them are not earlier than each other, so repeated rows have
    the same result. Other columns are ignored, whatever their names; a text of
    any length is one row. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.lit(0).alias("base"), F.coalesce(F.col(text), F.lit("")).alias("data"))
    # texts under one id are told apart by a hash, where there are several
    tags = rows.groupBy("id").agg(F.count("*").alias("rows"), F.min(F.xxhash64("data")).alias("lo"), F.max(F.xxhash64("data")).alias("hi"))
    several = stored(tags.where("rows > 1").select(F.col("id").alias("of"), (F.col("lo") != F.col("hi")).alias("many")), "several")
    unique = several.isEmpty()
    if unique:
        rows = rows.withColumn("k1", F.lit(0).cast("long"))
    else:
        rows = rows.join(several, F.col("id").eqNullSafe(F.col("of")), "left").withColumn("k1", F.when(F.col("many"), F.xxhash64("data")).otherwise(F.lit(0).cast("long"))).drop("of", "many")
    rows = rows.withColumn("k2", F.lit(0).cast("long")).select(*_KEY, "data")
    marks = repeats(rows, length, unique=unique, **sizes).select(F.col("id").alias("m_id"), F.col("k1").alias("m_k1"), "marks")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k1"), pa.array([_squeezed(x) for x in b.column("data").cast(pa.large_binary()).to_pylist()], pa.binary())], ["id", "k1", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (key, z) in enumerate(zip(b.column("id").to_pylist(), b.column("z").to_pylist())):
                data = _whole(z)
                spans: list[tuple[int, int]] = []
                if b.column("marks")[i].is_valid:
                    m = b.column("marks").slice(i, 1).flatten()
                    lo, hi = m.field("from").to_numpy().astype(np.int64), m.field("to").to_numpy().astype(np.int64) + length - 1
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.append(True, lo[1:] > hi[:-1])
                    spans = list(zip(lo[new].tolist(), hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)].tolist()))
                edges = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                out.append((key, len(data), len(data) - len(kept), [{"start": s, "end": e} for s, e in spans], kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()))],
                                             ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    texts = rows.select("id", "k1", "data").mapInArrow(squeeze, "id long, k1 long, z binary")
    joined = texts.join(marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("k1") == F.col("m_k1")), "left").select("id", "z", "marks")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
