import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specgraph.llm import _util, records

PATH = P.path("word_bpe_49k.json")
TEXTS = ["Hello, World! it's", None, "", "ÉTÉ naïve  double\n\nspace", "x" * 5000, "don't <|endoftext|> stop.", "J̌ İstanbul Ḳ", "a a a", "a a a", "word " * 3000]


def slow_crc32c(blob):
    c = 0xFFFFFFFF
    for x in blob:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert [int(x) for x in records.crc32c([b"123456789", b"", b"a"])] == [0xE3069283, 0, 0xC1D04330]
    blobs = [os.urandom(n) for n in (4, 5, 255, 256, 257, 512, 1000, 3, 2100)]
    assert [slow_crc32c(b) for b in blobs] == records.crc32c(blobs).tolist()


def test_pieces_equal_whole_texts():
    lib, own = Tokenizer.from_file(PATH), records.PieceTokenizer(PATH)
    for t in filter(None, TEXTS):
        assert np.frombuffer(own.encode([t])[0], dtype=f"<u{own.width}").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_round_trip(spark):
    rows = [(i * 3 % 10 - 2, t, 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    to = _util.new_path(spark, "records-test")
    shards = records.write(docs, PATH, 2, to, shards=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.crc) for r in records.read_back(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()}
    lib, start = Tokenizer.from_file(PATH), 0
    for doc_id, t, _ in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    first = shards.orderBy("shard").first()
    reader = records.ShardReader(first.path)
    every = [b for group in reader for b in group]
    assert [reader.get(k) for k in range(len(every))] == every and len(reader.index()) == first.n_records
    fs, name = records.opened(first.path)
    with fs.open_input_file(name) as f:
        raw = bytearray(f.read())
    raw[20] ^= 1
    with fs.open_output_stream(name) as f:
        f.write(bytes(raw))
    with pytest.raises(ValueError, match="checksum"):
        list(records.ShardReader(first.path))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    shards = records.write(docs, PATH, 2, _util.new_path(spark, "records-none"))
    assert shards.count() == 0 and records.read_back(shards).count() == 0


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (0, "b c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start) for r in records.read_back(records.write(docs, PATH, 2, _util.new_path(spark, "records-two"))).collect())
    assert got == [(0, 0), (1, 3), (1, 5)]


def test_null_ids_ties_and_names(spark):
    """Null ids come first and stay null beside -1; rows that repeat an id have one order; other columns may have any name."""
    rows = [(None, "no id"), (-1, "minus one"), (5, "b"), (5, "a a"), (5, None), (None, ""), (5, "b"), (6, "c")]
    seen = set()
    for shards in (1, 3):
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame([(*r, 1, 2) for r in order], "doc_id long, text string, ids int, width int")
            back = records.read_back(records.write(docs, PATH, 2, _util.new_path(spark, "records-ties"), shards=shards)).collect()
            seen.add(tuple(sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in back)))
    assert len(seen) == 1
    ids = [r[1] for r in seen.pop()]
    assert ids == [None, None, -1, 5, 5, 5, 5, 6]


def test_other_vocabularies_go_whole(tmp_path):
    import json

    about = json.loads(Tokenizer.from_file(PATH).to_str())
    about["normalizer"] = {"type": "Replace", "pattern": {"String": "a b"}, "content": "ab"}
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(about, f)
    own = records.PieceTokenizer(path)
    assert not own.apart and records.PieceTokenizer(PATH).apart
    assert np.frombuffer(own.encode(["a b c"])[0], dtype=f"<u{own.width}").tolist() == Tokenizer.from_file(path).encode("a b c", add_special_tokens=False).ids
