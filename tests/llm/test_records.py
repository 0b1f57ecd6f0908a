import zlib
from urllib.parse import urlparse

import numpy as np
import pytest

from stopflow.llm import records as R
from stopflow.llm.tokens import Encoder
from stopflow.session import scratch_path

ROWS = [(5, "Five words are in here"), (3, None), (9, ""), (1, "ünïcode 🙂 text\nwith lines"), (4, "again again"), (7, "x " * 5000), (4, "again again"), (None, "no id")]


def test_round_trip(spark):
    df = spark.createDataFrame([(t, d, 1) for d, t in ROWS], "text string, doc_id long, start int").repartition(4)
    manifest = R.write(df, scratch_path(spark, "records"))
    tok = Encoder("word_bpe_49k.json").tokenizer
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for d, t in order:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sorted((tuple(r) for r in R.read(manifest).collect()), key=lambda r: r[1])
    assert got == want
    shuffled = R.read(manifest, shuffle_seed=11).collect()
    assert sorted((tuple(r) for r in shuffled), key=lambda r: r[1]) == want
    assert [r["start"] for r in shuffled] == [r["start"] for r in R.read(manifest, shuffle_seed=11).collect()]
    assert manifest.agg({"tokens": "sum"}).first()[0] == at


def test_files_are_in_ascending_order(spark):
    df = spark.range(500).selectExpr("500 - id AS doc_id", "repeat('a ', 5) AS text").repartition(7)
    files = R.write(df, scratch_path(spark, "records")).orderBy("file_no").collect()
    last = -1
    for f in files:
        with open(urlparse(f["file"]).path, "rb") as rec:
            data = rec.read()
        pos = 0
        while pos < len(data):
            payload, pos = R.unframe(data, pos)
            key = R.ids_of(payload)[0]
            assert key > last
            last = key
    assert last == 500 and sum(f["records"] for f in files) == 500


def test_damage_is_found():
    data = bytearray(R.frame(R.payload_of(7, np.arange(20, dtype="<u4").tobytes())))
    assert R.ids_of(R.unframe(bytes(data))[0])[1].tolist() == list(range(20))
    for at in (0, 9, 15, len(data) - 1):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            R.unframe(bytes(broken))
    wide = np.array([1, 70_000], "<u4")
    assert R.ids_of(R.payload_of(None, wide.tobytes()))[1].tolist() == [1, 70_000] and R.ids_of(R.payload_of(None, wide.tobytes()))[0] is None


def test_empty_table(spark):
    manifest = R.write(spark.createDataFrame([], "doc_id long, text string"), scratch_path(spark, "records"))
    assert manifest.collect() == [] and R.read(manifest).collect() == []


def test_a_task_per_file(spark):
    """Also where adaptive execution would put a small manifest into one task."""
    manifest = spark.createDataFrame([(i, f"f{i}", f"x{i}", i) for i in range(64)], "file_no int, file string, index string, start long")
    dealt = R.dealt(manifest)
    sizes = dealt.mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]] for b in batches), "n long").collect()
    assert dealt.rdd.getNumPartitions() == 64 and [r["n"] for r in sizes] == [1] * 64


def test_schemes_of_the_same_store():
    assert R._uri("s3a://bucket/folder/x") == R._uri("s3n://bucket/folder/x") == "s3://bucket/folder/x" and R._uri("file:///tmp/x") == "file:///tmp/x"
