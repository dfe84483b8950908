import hashlib
import io

import pytest
from pyspark.sql import functions as F

from specgraph.llm import _util, warc

BIG = "<p>é</p>" * 900
ROWS = [(1, "http://a/1", BIG), (7, "http://a/7", BIG), (3, "http://a/3", BIG), (4, None, "short"), (5, "x\r\ny", "short"), (6, "http://a/6", None), (8, "http://a/8", ""), (9, "u", "z" * 3_000_000), (None, "u", BIG), (7, "http://a/7", BIG), (10, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 100)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    archives = warc.write(pages, _util.new_path(spark, "warc-test"))
    table = warc.read(archives, chunk=1 << 16).cache()
    whole = table.groupBy("record_id", "record_type", "refers_to").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "data", "bytes_so_far", "digest_so_far", "last"))).alias("c")).collect()
    want = {i: (t or "").encode() for i, _, t in ROWS}
    for r in whole:
        if r.record_type == "response" and r.record_id != "<urn:x-page:7>":
            data = b"".join(bytes(c.data) for c in r.c)
            assert data == want[warc.page_of(r.record_id)]
            sha, n = hashlib.sha1(), 0
            for c in r.c:
                sha.update(c.data)
                n += len(c.data)
                assert (c.digest_so_far, c.bytes_so_far) == (sha.hexdigest(), n) and len(c.data) <= 1 << 16
            assert [c.last for c in r.c] == [False] * (len(r.c) - 1) + [True]
    kinds = sorted(((warc.page_of(r.record_id), r.record_type, warc.page_of(r.refers_to)) for r in table.filter("last").collect()), key=str)
    assert kinds == sorted([(1, "revisit", 7), (3, "revisit", 7), (None, "revisit", 7), (7, "response", None), (7, "response", None), *[(i, "response", None) for i in (4, 5, 6, 8, 9, 10)]], key=str)


def test_empty_table(spark):
    archives = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), _util.new_path(spark, "warc-none"))
    assert warc.read(archives).count() == 0


def test_damage_is_noticed():
    raw = b"".join(bytes(p) for p in warc.record(1, "u", b"x" * 2000, None, False, "1970-01-01T00:00:00Z"))
    assert len(list(warc.chunks_of(warc.Stream(io.BytesIO(raw)), 512))) == 4
    with pytest.raises(ValueError, match="digest"):
        list(warc.chunks_of(warc.Stream(io.BytesIO(raw.replace(b"xxx", b"xyx", 1))), 512))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.chunks_of(warc.Stream(io.BytesIO(raw[:-900])), 512))


def test_query_with_several_chunks(spark, tmp_path, monkeypatch):
    """The query's columns, with payloads over several chunks and a filter so full that every long payload is checked exactly."""
    rows = [*ROWS[:10], (11, "u", "z" * 3_000_000), (12, None, "é" * 499), (13, None, "é" * 499), (14, None, "é" * 500), (15, None, "é" * 500), *[(100 + i, "u", "hot" * 400) for i in range(60)], *[(200 + i, "u", f"{i} own " * 300) for i in range(60)]]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    data = [(i, (t or "").encode()) for i, _, t in rows]
    best = {}
    for i, d in data:
        if len(d) >= 1000 and i is not None:
            best[d] = max(best.get(d, i), i)
    want = sorted(((i, len(d), hashlib.sha1(d).hexdigest(), "revisit" if best.get(d, i) != i else "response", best[d] if best.get(d, i) != i else None) for i, d in data), key=str)
    for most in (28, 10):
        monkeypatch.setattr(_util, "MOST_BITS", most)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.query(spark, str(tmp_path)).collect()), key=str)
        assert got == want
    assert sum(r[3] == "revisit" for r in want) > 60
