"""Best-fit packing of whole documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopflow.llm.frames import stored
from stopflow.llm.tokens import batches_of_text, encoder

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
END_ID = 0
# Rows of one part that a window numbers in one task.
NUMBERED_TOGETHER = 20_000
def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32[, ids]) per document of at
    most `length` ids, several where a document is longer: full pieces, after a
    first one that takes what is over. `end_id` is appended to each document. A
    null text is empty; without `end_id` a document without ids has no piece."""
    ended = np.asarray([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch, texts in batches_of_text(batches):
            names = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for name, ids in zip(names, enc.encode(texts)):
                ids += ended
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    end = at + (length if at else (n - 1) % length + 1)
                    raw = ids[4 * at:4 * end]
                    rows.append((name, k, at, end - at, zlib.crc32(raw), np.frombuffer(raw, "<i4") if keep_ids else None))
                    at, k = end, k + 1
            cols = list(zip(*rows)) or [()] * 6
            data = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
            yield pa.RecordBatch.from_arrays(data + ([pa.array(cols[5], pa.list_(pa.int32()))] if keep_ids else []),
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 if keep_ids else 5])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


class _Tightest:
    """Segment tree over remaining capacities: which of them open bins have."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def at_least(self, capacity: int) -> int | None:
        """Smallest remaining capacity of an open bin that is not below `capacity`."""
        i = capacity + self.size
        if self.count[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for any number of pieces of each length.

    Returns runs (length, first rank, ranks, first bin, offset): the pieces of
    that length with these ranks go to as many consecutive bins, at the offset.
    Lengths go in decreasing order, each piece into the open bin with the least
    capacity left that still fits, else into a new one. Pieces of equal length
    are placed together: bins of equal capacity are kept as ranges of numbers,
    so the work depends on the number of lengths, not of pieces.
    """
    tree, runs, bins = _Tightest(length), [], 0
    open_bins: dict[int, list[tuple[int, int]]] = {}
    for size in sorted((n for n in counts if n > 0), reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.at_least(size)
            if room is None:
                room = length
                first, n = bins, -(-left // (length // size))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            # a bin that got a piece is now the tightest one: fill it before the next
            fit = room // size
            full, over = divmod(left, fit)
            if full >= n:
                full, over = n, 0
            for layer in range(fit):
                m = full + (layer < over)
                if m:
                    runs.append((size, rank, m, first, length - room + layer * size))
                    rank, left = rank + m, left - m
            used = full + (over > 0)
            for space, at, m in ((room - fit * size, first, full), (room - over * size, first + full, used - full), (room, first + used, n - used)):
                if m and space:
                    open_bins.setdefault(space, []).append((at, m))
                    tree.add(space, m)
    return runs


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with `sequence_id` and `offset`.

    The counts of lengths, at most `length` numbers, decide everything: the
    driver plans runs of equal pieces (`plan`), and pieces look up their run by
    their rank within their length. A length is cut into parts of about
    NUMBERED_TOGETHER pieces, and ranks come from the counts of the parts, so a
    length that a third of all pieces have is not gathered anywhere, and the
    table of parts has a row per NUMBERED_TOGETHER pieces and one per length.
    Runs are at most about the square of the number of lengths, whatever the
    input, and go to the tasks as one broadcast table. Repeated rows and ids are
    packed each by itself, and pieces without an id fall into parts at random;
    an empty table gives an empty result.
    """
    # what a piece's part hangs on is written with it
    chance = F.when(F.col("doc_id").isNull(), (F.rand() * (1 << 31)).cast("long")).otherwise(F.xxhash64("doc_id", "piece", "ids_crc32"))
    cut = stored(pieces(docs, tokenizer, length, end_id, doc_id, text, keep_ids).withColumn("_chance", chance), "pieces")
    sizes = stored(cut.groupBy("length").agg(F.count("*").alias("n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.collect()}
    n_parts = sizes.select("length", F.ceil(F.col("n") / NUMBERED_TOGETHER).cast("long").alias("_parts"))
    rows = cut.join(F.broadcast(n_parts), "length").withColumn("_part", F.pmod("_chance", "_parts")).drop("_parts", "_chance")
    parts = stored(rows.groupBy("length", "_part").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = parts.select("length", "_part", (F.sum("n").over(before) - F.col("n")).alias("_ahead"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece"))).join(ahead, ["length", "_part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("_ahead") + F.col("_n") - 1).alias("_rank"))
    # runs by (length, first rank), looked up by a binary search
    runs = np.asarray(sorted(plan(counts, length)) or np.zeros((0, 5)), np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        # one number that orders (length, rank)
        key = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(key, (size << 48) + rank, side="right") - 1
            names = [c for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], [*names, "sequence_id", "offset"])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return ranked.mapInArrow(place, kinds + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of every sequence, from pieces packed with their ids: at most
    `length` ids meet in one row."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))
