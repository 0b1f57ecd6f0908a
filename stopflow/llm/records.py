"""Length-delimited binary records of token ids, with a separate offset index."""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopflow.llm.frames import stored
from stopflow.llm.tokens import batches_of_text, encoder

TOKENIZER = "word_bpe_49k.json"
# Tasks that read; beyond it a task reads several files.
MOST_TASKS = 100_000
END_ID = 1
# Of a record's payload: document id, its being null, bytes per id.
_HEAD = "<q?B"
# Of an index entry: document id, its being null, offset and bytes of the frame, ids.
_ENTRY = np.dtype([("doc_id", "<i8"), ("nil", "?"), ("offset", "<u8"), ("bytes", "<u8"), ("n_tokens", "<u8")])


def masked(data: bytes) -> bytes:
    """CRC-32 (IEEE), rotated and shifted by a constant: checksums of data that
    hold checksums stay independent."""
    c = zlib.crc32(data)
    return struct.pack("<I", ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    """Length (8 bytes), its checksum, payload, its checksum."""
    n = struct.pack("<Q", len(payload))
    return b"".join((n, masked(n), payload, masked(payload)))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at this place, and where the next one begins."""
    head = bytes(data[at:at + 8])
    if len(head) < 8 or bytes(data[at + 8:at + 12]) != masked(head):
        raise ValueError(f"damaged record length at {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12:end])
    if bytes(data[end:end + 4]) != masked(payload):
        raise ValueError(f"damaged record at {at}")
    return payload, end + 4


def payload_of(doc_id: int | None, ids: bytes) -> bytes:
    """A document's record: ids go as 16 bits where all of them fit."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    return struct.pack(_HEAD, doc_id or 0, doc_id is None, 2 if narrow else 4) + (wide.astype("<u2").tobytes() if narrow else ids)


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, nil, width = struct.unpack_from(_HEAD, payload)
    return None if nil else doc_id, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_HEAD)).astype("<u4")


def _uri(path: str) -> str:
    """Spark's names of S3 (s3a, s3n) are the same store under another scheme."""
    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            return "s3://" + path[len(scheme):]
    return path


def _store(path: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path))


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all documents in ascending order of their ids (null
    first; equal ids by a hash of the text) and returns the manifest: one row
    (file_no, file, index, records, tokens, bytes, start) per file, start being
    the ids in all files before.

    `path` is a URI that all executors can write to. A file's name holds a number
    of its own for each attempt, and only the files of attempts that succeeded
    are in the manifest, so lost executors leave nothing wrong behind. A null
    text is empty; empty tables give an empty manifest.
    """
    ended = np.asarray([] if end_id is None else [end_id], "<u4").tobytes()
    base = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, entries, at, tokens = encoder(tokenizer), None, [], 0, 0
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        store, folder = _store(base)
        for batch, texts in batches_of_text(batches):
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}.rec", buffer_size=1 << 20)
            for key, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                ids += ended
                data = frame(payload_of(key, ids))
                out.write(data)
                entries.append((key or 0, key is None, at, len(data), len(ids) // 4))
                at, tokens = at + len(data), tokens + len(ids) // 4
        if out is not None:
            out.close()
            with store.open_output_stream(f"{folder}/{name}.idx") as index:
                index.write(frame(np.asarray(entries, _ENTRY).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{base}/{name}.rec"]), pa.array([f"{base}/{name}.idx"]), pa.array([len(entries)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([at], pa.int64())],
                                             ["file_no", "file", "index", "records", "tokens", "bytes"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    files = stored(dealt.mapInArrow(run, "file_no int, file string, index string, records long, tokens long, bytes long"), "manifest")
    # one row per file of some hundred MB
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("start", F.sum("tokens").over(before) - F.col("tokens"))


def dealt(manifest: DataFrame) -> DataFrame:
    """The files, one to a task. A given number of partitions is kept as it is,
    however small they are."""
    files = manifest.select("file_no", "file", "index", "start")
    return files.repartitionByRange(max(1, min(files.count(), MOST_TASKS)), "file_no")


def read(manifest: DataFrame, keep_ids: bool = True, shuffle_seed: int | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of all records, their
    checksums verified. With a seed each file's records are fetched through its
    index in an order shuffled by the seed, else one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = _store(row["file"])
                with store.open_input_file(_store(row["index"])[1]) as f:
                    entries = np.frombuffer(unframe(f.read())[0], _ENTRY)
                starts = row["start"] + np.cumsum(entries["n_tokens"].astype(np.int64)) - entries["n_tokens"].astype(np.int64)
                order = list(range(len(entries)))
                if shuffle_seed is not None:
                    random.Random(f"{shuffle_seed}/{row['file_no']}").shuffle(order)
                rows: list[tuple] = []
                with store.open_input_file(name) as f:
                    for i in order:
                        f.seek(int(entries["offset"][i]))
                        key, ids = ids_of(unframe(f.read(int(entries["bytes"][i])))[0])
                        if len(ids) != entries["n_tokens"][i] or (key or 0) != entries["doc_id"][i]:
                            raise ValueError(f"{row['file']}: record {i} is not what the index says")
                        rows.append((key, int(starts[i]), len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if keep_ids else None))
                        if len(rows) == 2000:
                            yield _batch(rows, keep_ids)
                            rows = []
                if rows:
                    yield _batch(rows, keep_ids)

    return dealt(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    data = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.list_(pa.int32()))] if keep_ids else [])
    return pa.RecordBatch.from_arrays(data, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(data)])
