"""N-gram Jaccard join by universe partition, for exact near-duplicate groups of texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.arrays import mix, shingles, slices, words
from stopflow.llm.frames import components, stored
from stopflow.llm.packed import cuts, pack, pack_sorted, unpack, unpack_sorted

WORDS = 5
PERCENT = 80
# Growth of the size bands, at least.
GROWTH = 1.25
# Signatures that a task holds before it hands them on, and per bucket.
TOGETHER = 1_000_000
PER_BUCKET = 1_000_000

# 64-bit words of the parity bits that tell sets apart without their texts.
PARITY = 16

_SALT = np.random.default_rng(20240502).integers(0, 1 << 63, 4, dtype=np.uint64)


class Band(NamedTuple):
    """Sizes low..high. Any two linked sets of which the smaller lies in the band
    differ by at most `differ` shingles. `double` segments are matched up to one
    shingle, `single` ones exactly, and `spare` single ones may be left out."""

    low: int
    high: int
    differ: int
    double: int
    single: int
    spare: int


def bounds(largest: int, growth: float = GROWTH) -> list[int]:
    """First size of each band, up to one above `largest`."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return out


def most_different(low_size: int, percent: int) -> int:
    """Largest difference of two linked sets, the smaller having this size."""
    return (low_size + low_size * 100 // percent) * (100 - percent) // (100 + percent)


def allocate(low: int, high: int, size: float, sets: int, percent: int = PERCENT) -> Band:
    """Cheapest allocation for a band.

    Segments weigh 1 (single) or 2 (double). With weights adding up to differ +
    1 + spare, linked sets match in segments of weight spare + 1 at least, since
    a segment that does not match holds as many differences as it weighs. Each
    set leaves out its `spare` single segments with the fewest shingles. Two
    linked sets that match in a double segment meet there; else they match in
    spare + 1 single ones, which both sets order alike, and the last of these is
    left out by neither.

    The cost of a set is its number of signatures plus the sets it meets by
    chance: segments are about Poisson distributed, and empty ones (for double
    ones: those with at most one shingle) are alike in all sets.
    """
    differ = most_different(high, percent)
    best, best_cost = Band(low, high, differ, 0, differ + 1, 0), math.inf
    spares = sorted({0, 1, 2, 4, 8, *(int((differ + 1) * f) for f in (0.05, 0.1, 0.2, 0.3, 0.5))})
    for spare in spares:
        for double in sorted({0, *(int((differ + 1) * f) for f in (0.1, 0.25, 0.5))}):
            single = differ + 1 + spare - 2 * double
            if single < spare:
                continue
            mean = size / (single + double)
            empty = math.exp(-mean)
            signatures = double * (1 + mean) + single - spare
            met = max(0.0, single * empty - spare + math.sqrt(single * empty)) * sets * empty + double * (empty * (1 + mean)) ** 2 * sets
            if signatures + met < best_cost:
                best, best_cost = Band(low, high, differ, double, single, spare), signatures + met
    return best


def signatures(s: np.ndarray, band: Band, number: int) -> np.ndarray:
    """Signatures of a set (ascending shingles) in a band."""
    m = band.double + band.single
    segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    at = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    one = mix(s ^ _SALT[0])
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(one, out=total[1:])
    sums = total[at[1:]] - total[at[:-1]]
    salt = (np.arange(m, dtype=np.uint64) + np.uint64(number << 40)) * _SALT[1] * np.uint64(2)
    order = np.argsort(np.diff(at)[band.double:], kind="stable")[band.spare:] + band.double
    out = [mix(sums[order] + salt[order])]
    if band.double:
        d = band.double
        out.append(mix(sums[:d] + salt[:d] + np.uint64(1)))
        near = segment[:at[d]].astype(np.int64)
        out.append(mix(sums[near] - one[:at[d]] + salt[near] + np.uint64(1)))
    return np.concatenate(out)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, and nothing about its order."""
    return int(mix(s ^ _SALT[2]).sum(dtype=np.uint64).astype(np.int64)), int(mix(s + _SALT[3]).sum(dtype=np.uint64).astype(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of 64 PARITY parts is odd. Two sets
    differ by at least as many shingles as these bits do."""
    odd = np.bincount((s >> np.uint64(32)) * np.uint64(64 * PARITY) >> np.uint64(32), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_linked(percent: int, left: str = "x", right: str = "y") -> F.Column:
    """False only for sets (columns <side>.n, <side>.bits) whose sizes or parity
    bits rule a link out."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    apart = sum((F.bit_count(F.get(F.col(f"{left}.bits"), F.lit(k)).bitwiseXOR(F.get(F.col(f"{right}.bits"), F.lit(k)))) for k in range(PARITY)), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _sets(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch, raw, places in slices(batches, column):
        h, _, _, firsts = words(raw, places)
        yield batch, list(shingles(h, firsts, size))


def classes(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, bits, class_id) of rows (doc_id, text): the smallest id
    with an equal set; documents without shingles are classes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, size):
            d = [digest(s) for s in sets]
            bits = pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), bits], ["doc_id", "n_shingles", "d1", "d2", "bits"])

    sets = stored(docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bits array<long>"), "sets")
    copies = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    out = sets.join(copies, ["d1", "d2"], "left")
    return stored(out.select("doc_id", "n_shingles", "bits", F.when((F.col("n_shingles") > 0) & F.col("first").isNotNull() & F.col("doc_id").isNotNull(), F.col("first")).otherwise(F.col("doc_id")).alias("class_id")), "classes")


def plan(known: DataFrame, percent: int = PERCENT) -> tuple[list[Band], int]:
    """Bands with their allocations from the counts of sizes, and the expected
    number of signatures. Sizes are counted per band, so the driver gets one
    short row for each."""
    largest = known.agg(F.max("n_shingles")).first()[0] or 0
    # a set and those linked with it lie in the same band or in neighbouring ones
    low = bounds(largest, max(GROWTH, 100 / percent))
    edges = F.array(*[F.lit(x) for x in low])
    rows = known.where("n_shingles > 0").groupBy("n_shingles").count().withColumn("band", F.size(F.filter(edges, lambda e: e <= F.col("n_shingles"))) - 1)
    stats = {r["band"]: (r["n"], r["total"]) for r in rows.groupBy("band").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("n_shingles")).alias("total")).collect()}
    out, expected = [], 0.0
    for k in range(len(low) - 1):
        n, total = stats.get(k, (0, 0))
        n2, total2 = stats.get(k + 1, (0, 0))
        band = allocate(low[k], low[k + 1] - 1, (total + total2) / (n + n2) if n + n2 else low[k], n + n2, percent)
        out.append(band)
        expected += (n + n2) * (band.double * (1 + band.high / (band.single + band.double)) + band.single - band.spare)
    return out, int(expected)


def _bands_of(n: int, bands: list[Band], lows: np.ndarray, percent: int) -> list[int]:
    """Bands in which a set of n shingles takes part: its own, and the one below
    if a smaller set there can be linked with it. In bands without differences
    only equal sets are linked, and those are one class already."""
    k = int(np.searchsorted(lows, n, side="right")) - 1
    out = [k] if bands[k].differ else []
    if k and bands[k - 1].differ and n <= bands[k - 1].high * 100 // percent:
        out.append(k - 1)
    return out


def candidates(docs: DataFrame, bands: list[Band], buckets: int, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (sig, a, b): documents that share a signature, each with the smallest
    one (a) of its task, and those with the smallest of all tasks.

    A task ties documents with equal signatures to the smallest of them before
    anything is shuffled, so any number of copies of a text costs one row per
    task. Texts whose set a task has just met give no signatures at all.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.array([b.low for b in bands])
        sigs, owners, held, seen = [], [], 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            sig = np.concatenate(sigs)
            doc = np.repeat(np.array([o for o, _ in owners], np.int64), [n for _, n in owners])
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            new = np.concatenate(([True], sig[1:] != sig[:-1]))
            hub = doc[new][np.cumsum(new) - 1]
            tied = ~new & (hub != doc)
            rows = []
            if tied.any():
                rows.append((int(mix(hub[tied][:1].astype(np.uint64))[0] % np.uint64(buckets)), 1, pack(sig[tied]), pack(hub[tied]), pack(doc[tied])))
            sig, doc = sig[new], doc[new]
            at = cuts(sig, buckets)
            rows += [(k, 0, pack_sorted(sig[a:b]), pack(doc[a:b]), b"") for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], ["bucket", "kind", "sig", "a", "b"])

        for batch, sets in _sets(batches, size):
            for doc, s in zip(batch.column("doc_id").to_pylist(), sets):
                if doc is None or not len(s):
                    continue
                key = digest(s)
                if seen.get(key, doc + 1) <= doc:
                    continue
                seen[key] = doc
                for k in _bands_of(len(s), bands, lows, percent):
                    x = signatures(s, bands[k], k)
                    sigs.append(x)
                    owners.append((doc, len(x)))
                    held += len(x)
                if held >= TOGETHER:
                    yield from flush()
                    sigs, owners, held, seen = [], [], 0, {}
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(unpack(r["sig"]), unpack(r["a"], np.int64), unpack(r["b"], np.int64)) for r in rows if r["kind"] == 1]
        runs = [(unpack_sorted(r["sig"]), unpack(r["a"], np.int64)) for r in rows if r["kind"] == 0]
        if runs:
            sig, doc = np.concatenate([x[0] for x in runs]), np.concatenate([x[1] for x in runs])
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            new = np.concatenate(([True], sig[1:] != sig[:-1]))
            hub = doc[new][np.cumsum(new) - 1]
            tied = ~new & (hub != doc)
            out.append((sig[tied], hub[tied], doc[tied]))
        return pa.table({"sig": np.concatenate([x[0] for x in out]).view(np.int64), "a": np.concatenate([x[1] for x in out]), "b": np.concatenate([x[2] for x in out])})

    packed = docs.mapInArrow(emit, "bucket int, kind int, sig binary, a binary, b binary")
    return packed.groupBy("bucket").applyInArrow(meet, "sig long, a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked) of pairs (a, b): the sets of both texts compared. Only texts
    that occur in pairs go to the joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, np.ndarray] = (object(), np.zeros(0, np.uint64))
        for batch, sets in _sets(batches, size, "text_b"):
            a, linked = batch.column("a").to_pylist(), []
            for i, s in enumerate(sets):
                if held[0] != a[i]:
                    one = pa.RecordBatch.from_arrays([batch.column("text_a").slice(i, 1)], ["text"])
                    held = (a[i], next(_sets(iter([one]), size))[1][0])
                x, y = (s, held[1]) if len(s) <= len(held[1]) else (held[1], s)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = stored(docs.join(ids, "doc_id", "left_semi"), "texts")
    b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(run, "a long, b long, linked boolean"), "verified")


def _across(met: DataFrame, failed: DataFrame, copies: DataFrame, groups: DataFrame, sketch: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a signature at which some pair failed, are in
    different groups so far, may be linked and have not been compared."""
    sigs = met.join(failed, ["a", "b"], "left_semi").select("sig").distinct()
    members = met.join(sigs, "sig", "left_semi").select("sig", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    members = members.join(copies, "doc_id", "left").select("sig", F.coalesce("class_id", "doc_id").alias("id"))
    members = members.join(groups, "id", "left").select("sig", "id", F.coalesce("component_id", "id").alias("g")).distinct()
    mixed = members.groupBy("sig").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("sig")
    members = stored(members.join(mixed, "sig", "left_semi").join(sketch, "id"), "mixed")
    pairs = members.alias("x").join(members.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.g") < F.col("y.g")) & may_be_linked(percent))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return stored(pairs.join(done, ["a", "b"], "left_anti"), "across")


def link(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents are linked when their sets of shingles of `size` words
    (lower-cased A-Z; a shorter text is one shingle) have at least `percent` %
    of their union in common; component_id is the smallest id that links reach.
    Documents without words are linked with nothing, and so are rows without an
    id. Rows with equal ids are treated alike in their group.

    Equal sets are one class. Classes that share a signature are compared with
    the smallest one that has it; at signatures where such a comparison failed,
    all classes of different groups are compared. So no link between groups is
    missed, and within a group pairs need not be formed. Pairs whose sizes or
    parity bits exclude a link are not compared. Shingles are compared
    as 64-bit hashes of hashed words.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = classes(rows, size)
    bands, expected = plan(known, percent)
    if not bands or not expected:
        return known.select("doc_id", "n_shingles", F.col("class_id").alias("component_id"))
    met = candidates(rows, bands, max(1, -(-expected // PER_BUCKET)), size, percent)
    met = stored(met, "met")
    copies = stored(known.where("class_id <> doc_id").select("doc_id", "class_id").distinct(), "copies")
    # the pairs that met, and the classes of both ends
    named = met.select("a", "b").distinct()
    for c in ("a", "b"):
        named = named.join(copies.select(F.col("doc_id").alias(c), F.col("class_id").alias("_c")), c, "left").withColumn(f"c{c}", F.coalesce("_c", c)).drop("_c")
    named = stored(named.where("ca <> cb").select("a", "b", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")), "named")
    sketch = known.where("class_id = doc_id").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bits").dropDuplicates(["id"])
    pairs = named.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    pairs = pairs.join(sketch.select(F.col("id").alias("a"), F.struct("n", "bits").alias("x")), "a").join(sketch.select(F.col("id").alias("b"), F.struct("n", "bits").alias("y")), "b")
    pairs = stored(pairs.select("a", "b", may_be_linked(percent).alias("likely")), "pairs")
    checked = verify(pairs.where("likely").select("a", "b"), rows, size, percent)
    groups = stored(components(checked.where("linked")), "groups")
    linked = checked.where("linked").select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    failed = named.join(linked, ["ca", "cb"], "left_anti").select("a", "b")
    more = _across(met, failed, copies, groups, sketch, pairs.select("a", "b"), percent)
    if not more.isEmpty():
        checked = checked.union(verify(more, rows, size, percent))
        groups = stored(components(checked.where("linked")), "groups")
    out = known.join(groups.select(F.col("id").alias("class_id"), F.col("component_id").alias("_g")), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_g", "class_id").alias("component_id"))
