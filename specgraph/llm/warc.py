"""WARC archives: deduplicated writing, and reading as a chunked record table.

Archives are ``.warc.gz`` files with one gzip member per record (WARC 1.1). A response record holds the HTTP
response; a revisit record (identical-payload-digest profile) only its headers. The reader streams:
a payload of any size becomes rows of (record, chunk number, bytes), each with the number and the SHA-1
digest of all payload bytes up to it, so that no record is ever held as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util
from .records import opened

#: Payload bytes in a row of the record table, compressed bytes read at once, and bytes of rows sent in one batch.
CHUNK, READ, BATCH = 1 << 20, 1 << 16, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2] if uri else ""
    return int(tail) if tail else None


def _line(value: str | None) -> str:
    return " ".join((value or "about:blank").split()) or "about:blank"


def record(page_id: int | None, url: str | None, payload, refers_to: int | None, revisit: bool, date: str, size: int | None = None, digest: str | None = None) -> Iterator[bytes]:
    """One record in pieces: WARC headers, block, and the blank lines after it.

    ``payload`` is any buffer; it is cut, never copied whole. A revisit needs none where its size and hex SHA-1 are given.
    """
    view = memoryview(payload if payload is not None else b"")
    size = len(view) if size is None else size
    sha1 = bytes.fromhex(digest) if digest else hashlib.sha1(view).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    length = len(head) + (0 if revisit else size)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    yield ("\r\n".join(lines) + "\r\n\r\n").encode() + head
    if not revisit:
        for k in range(0, size, CHUNK):
            yield view[k : k + CHUNK]
    yield b"\r\n\r\n"


class Stream:
    """Decompressed bytes of a file of gzip members (or of a plain file), read piece by piece."""

    def __init__(self, source):
        self.source, self.buffer, self.plain = source, bytearray(), None
        self.inflate = zlib.decompressobj(31)
        self.rest = b""

    def _more(self) -> bool:
        raw = self.rest or self.source.read(READ)
        self.rest = b""
        if not raw:
            if self.plain is False and not self.inflate.eof and self.begun:
                raise ValueError("the archive ends within a record")
            return False
        if self.plain is None:
            self.plain = raw[:2] != b"\x1f\x8b"
        if self.plain:
            self.buffer += raw
            return True
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.begun = True
        self.buffer += self.inflate.decompress(raw, CHUNK)
        self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
        return True

    begun = False

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        at = 0
        while (end := self.buffer.find(b"\n", at)) < 0:
            at = len(self.buffer)
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends within a line")
                return None
        out = bytes(self.buffer[:end]).rstrip(b"\r")
        del self.buffer[: end + 1]
        return out

    def take(self, most: int) -> bytes:
        """Between 1 and ``most`` bytes."""
        while not self.buffer:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:most])
        del self.buffer[:most]
        return out


def _headers(stream: Stream) -> tuple[dict[str, str], int]:
    """Named fields up to the blank line, and the bytes that they take."""
    out, size = {}, 0
    while line := stream.line():
        size += len(line) + 2
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out, size + 2


def _hex(digest: str | None) -> str | None:
    """Bare lower-case hex of a sha1: field in base 32 or hex; null for other algorithms."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def chunks_of(stream: Stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of the record table; every record has at least one (an empty payload an empty chunk), the last is marked."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record begins here")
        warc, _ = _headers(stream)
        left = int(warc["content-length"])
        status = stream.line()
        http, size = _headers(stream)
        left -= len(status) + 2 + size
        stated = int(http.get("content-length", left))
        about = {"record_id": warc.get("warc-record-id"), "record_type": warc.get("warc-type"), "target_uri": warc.get("warc-target-uri"), "refers_to": warc.get("warc-refers-to"), "stated_digest": _hex(warc.get("warc-payload-digest")), "stated_bytes": stated}
        sha, done, held, number = hashlib.sha1(), 0, bytearray(), 0
        while True:
            while left and len(held) < chunk:
                part = stream.take(min(left, chunk - len(held)))
                left -= len(part)
                held += part
            sha.update(held)
            done += len(held)
            yield about | {"chunk_no": number, "data": bytes(held), "bytes_so_far": done, "digest_so_far": sha.copy().hexdigest(), "last": not left}
            held.clear()
            number += 1
            if not left:
                break
        if about["record_type"] == "response" and about["stated_digest"] not in (None, sha.hexdigest()):
            raise ValueError(f"the payload of {about['record_id']} does not match its digest")


def planned(pages: DataFrame, least: int = 1000) -> tuple[DataFrame, list[DataFrame]]:
    """(page_id, url, payload, size, digest, refers_to, revisit): what each page's record is to be; and the tables written on the way, to drop.

    Of equal payloads of ``least`` bytes or more the one with the largest page_id is the response. Null html is an empty payload;
    rows with a null page_id give records too, and rows that repeat the largest page_id are responses all; so are all where no copy has an id.

    Payloads stay where they are read. Digests alone are grouped and joined; a revisit has no payload, short payloads are in no
    join, and of the others only those that a filter by hash of the revisits cannot tell from one are checked against these with their payloads.
    """
    spark = pages.sparkSession
    rows = _util.only(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").alias("size")).withColumn("digest", F.when(F.col("size") >= least, F.sha1("payload")))
    heads = _util.cut(rows.filter("digest is not null").select("page_id", "url", "size", "digest"), "heads")
    best = heads.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).filter("copies > 1 and best is not null").select("digest", "best")
    revisits = _util.cut(heads.join(best, "digest").filter(~F.col("best").eqNullSafe(F.col("page_id"))).select("page_id", "url", "size", "digest", F.col("best").alias("refers_to")), "revisits")
    key = F.xxhash64("digest", "page_id")
    seen, one = _util.among(revisits, key)
    again = revisits.select(F.col("digest").alias("d"), F.col("page_id").alias("p"))
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p"))
    doubtful = _util.cut(heads.filter(seen).join(again, same, "left_anti"), "doubtful")  # responses that the filter takes for revisits
    doubt, two = _util.among(doubtful, key)
    sure = rows.filter(F.col("digest").isNull() | ~seen)
    checked = rows.filter(F.col("digest").isNotNull() & seen & doubt).join(again, same, "left_anti")
    answers = sure.unionByName(checked).withColumns({"refers_to": F.lit(None).cast("bigint"), "revisit": F.lit(False)})
    others = revisits.withColumns({"payload": F.lit(None).cast("binary"), "revisit": F.lit(True)})
    names = ["page_id", "url", "payload", "size", "digest", "refers_to", "revisit"]
    plan = answers.select(*names).unionByName(others.select(*names))
    _util.forget(spark, one, two)
    return plan, [heads, revisits, doubtful]


def write(pages: DataFrame, to: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write a record per page to archives under ``to``; returns their table (path, n_records). Runs when called.

    Each task writes a file of its own name and reports it when whole; files of lost tasks are in no table.
    """
    _util.tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for b in batches:
            if out is None and b.num_rows:
                fs, folder = opened(to)
                fs.create_dir(folder, recursive=True)
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{folder}/{name}")
            payloads = b.column("payload")
            about = [b.column(c).to_pylist() for c in ("page_id", "url", "size", "digest", "refers_to", "revisit")]
            for k, (page_id, url, size, digest, refers_to, revisit) in enumerate(zip(*about)):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                for piece in record(page_id, url, payloads[k].as_buffer(), refers_to, revisit, date, size, digest):
                    out.write(z.compress(piece))
                out.write(z.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{to}/{name}", "n_records": n}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    plan, steps = planned(pages, least)
    archives = _util.cut(plan.mapInArrow(run, "path string, n_records bigint"), "archives")
    _util.drop(*steps)
    return archives


def read(archives: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of archives (column path).

    path, record_id, record_type, target_uri, refers_to, stated_digest, stated_bytes, chunk_no, data (null if not wanted),
    bytes_so_far, digest_so_far (lower-case hex SHA-1), last.
    """
    spark = archives.sparkSession
    _util.tune(spark)
    kept = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = opened(path)
                rows, size = [], 0
                with fs.open_input_stream(name) as source:
                    for row in chunks_of(Stream(source), chunk):
                        size += 500 + (len(row["data"]) if data else 0)
                        rows.append(row | {"path": path} | ({} if data else {"data": None}))
                        if size >= BATCH or len(rows) >= _util.ARROW_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=kept)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kept)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "path string, record_id string, record_type string, target_uri string, refers_to string, stated_digest string, stated_bytes bigint, chunk_no bigint, data binary, bytes_so_far bigint, digest_so_far string, last boolean"
    return archives.select("path").repartition(n, "path").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(_util.read(spark, sf_dir, "pages"), _util.new_path(spark, "warc"))
    records = read(archives, data=False).filter("last")
    number = F.nullif(F.regexp_extract("record_id", r":(-?\d+)>$", 1), F.lit("")).cast("long")
    target = F.nullif(F.regexp_extract(F.coalesce("refers_to", F.lit("")), r":(-?\d+)>$", 1), F.lit("")).cast("long")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number.alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type", target.alias("refers_to"),
    )


#: The same by plain SQL.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND best <> page_id THEN best END AS refers_to FROM p LEFT JOIN m ON m.d = p.d
"""
