"""Token-id output as length-delimited binary records with a separate offset index.

A shard is a sequence of frames in the TFRecord layout: length (u64), masked CRC-32C of the
length (u32), payload, masked CRC-32C of the payload (u32), all little-endian. A payload is the document id
(i64), the number of ids (u32), the bytes per id (u32: 2 or 4; 256 more where the document has no id) and the ids. Beside every shard
``X.rec`` lies ``X.idx``: one (offset u64, length u64) per record, so that a reader
can fetch records in any order. Shards cover ascending ranges of document ids and
records ascend within a shard. A shard is written under another name and renamed when whole, so that
a task that runs again, or twice, leaves one good copy.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util

#: Bytes per lane of the vectorised checksum, and of text that are tokenised or framed together.
LANE = 256
GROUP_CHARS = 2_000_000
#: Whitespace-delimited pieces whose ids a worker remembers.
KEPT_PIECES = 550_000
_HEAD, _HEAD_BYTES, _NO_ID = "<qII", 16, 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32C tables: four bytes at a time, and appending LANE zero bytes."""
    base = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        base = np.where(base & 1, (base >> 1) ^ np.uint32(0x82F63B78), base >> 1)
    step = [base]
    for _ in range(3):
        step.append((step[-1] >> 8) ^ base[step[-1] & 255])
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(LANE):
        basis = (basis >> 8) ^ base[basis & 255]
    lane = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for bit in range(8):
            lane[k, np.arange(256) >> bit & 1 == 1] ^= basis[8 * k + bit]
    return np.stack(step), lane


_STEP, _SHIFT = _tables()


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of every blob: lanes of all blobs advance together, then each blob's lanes are combined."""
    out = np.zeros(len(blobs), dtype=np.uint32)
    long = [i for i, b in enumerate(blobs) if len(b) >= 4]
    for i, b in enumerate(blobs):
        if len(b) < 4:
            crc = np.uint32(0xFFFFFFFF)
            for x in b:
                crc = (crc >> np.uint32(8)) ^ _STEP[0][(int(crc) ^ x) & 255]
            out[i] = ~crc
    if not long:
        return out
    sizes = np.array([len(blobs[i]) for i in long], dtype=np.int64)
    lanes = -(-sizes // LANE)
    data = np.zeros(int(lanes.sum()) * LANE, dtype=np.uint8)
    begin = np.cumsum(lanes) - lanes
    for i, n, at in zip(long, sizes, begin + lanes):
        data[at * LANE - n : at * LANE] = np.frombuffer(blobs[i], dtype=np.uint8)  # leading zeros don't change a CRC that starts at 0
    head = ((begin + lanes) * LANE - sizes)[:, None] + np.arange(4)
    data[head] ^= 255  # starting at all ones
    words = np.ascontiguousarray(data.view("<u4").reshape(-1, LANE // 4).T)
    crc = np.zeros(words.shape[1], dtype=np.uint32)
    for w in words:
        x = crc ^ w
        crc = _STEP[3][x & 255] ^ _STEP[2][x >> 8 & 255] ^ _STEP[1][x >> 16 & 255] ^ _STEP[0][x >> 24]
    order = np.argsort(-lanes, kind="stable")
    total, counts = np.zeros(len(long), dtype=np.uint32), lanes[order]
    for k in range(int(lanes.max())):
        n = int(np.searchsorted(-counts, -k, side="left"))  # blobs that have a lane k
        who = order[:n]
        x = total[who]
        total[who] = _SHIFT[0][x & 255] ^ _SHIFT[1][x >> 8 & 255] ^ _SHIFT[2][x >> 16 & 255] ^ _SHIFT[3][x >> 24] ^ crc[begin[who] + k]
    out[long] = ~total
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> Iterator[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    for head, h, p, c in zip(heads, masked(crc32c(heads)), payloads, masked(crc32c(payloads))):
        yield b"".join((head, int(h).to_bytes(4, "little"), p, int(c).to_bytes(4, "little")))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack(_HEAD, doc_id or 0, len(ids) // width, width | (_NO_ID if doc_id is None else 0)) + ids


def parse(blob: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, kind = struct.unpack_from(_HEAD, blob)
    return None if kind & _NO_ID else doc_id, np.frombuffer(blob, dtype=f"<u{kind & 255}", count=n, offset=_HEAD_BYTES)


class ShardReader:
    """Records of one shard, in order or, through its index, in any order; checksums are verified."""

    def __init__(self, path: str):
        self.fs, self.path = opened(path)

    def index(self) -> np.ndarray:
        with self.fs.open_input_stream(self.path.removesuffix(".rec") + ".idx") as f:
            return np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)

    def __iter__(self) -> Iterator[list[bytes]]:
        """Groups of payloads."""
        with self.fs.open_input_stream(self.path, buffer_size=1 << 20) as f:
            held: list[tuple[bytes, bytes, bytes]] = []
            size = 0
            while head := f.read(12):
                body = f.read(int.from_bytes(head[:8], "little") + 4)
                held.append((head, body[:-4], body[-4:]))
                size += len(body)
                if size >= GROUP_CHARS:
                    yield self._checked(held)
                    held, size = [], 0
            if held:
                yield self._checked(held)

    def get(self, k: int, index: np.ndarray | None = None) -> bytes:
        offset, length = map(int, (self.index() if index is None else index)[k])
        with self.fs.open_input_file(self.path) as f:
            f.seek(offset)
            raw = f.read(length)
        return self._checked([(raw[:12], raw[12:-4], raw[-4:])])[0]

    def _checked(self, held: list[tuple[bytes, bytes, bytes]]) -> list[bytes]:
        for blobs, crcs in (([h[:8] for h, _, _ in held], [h[8:] for h, _, _ in held]), ([b for _, b, _ in held], [c for _, _, c in held])):
            if (masked(crc32c(blobs)) != np.array([int.from_bytes(c, "little") for c in crcs], dtype=np.uint32)).any():
                raise ValueError(f"a checksum does not match in {self.path}")
        return [b for _, b, _ in held]


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class _Known(dict):
    """Piece to the bytes of its ids, which ``encode`` makes on first sight."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class PieceTokenizer:
    """Whole texts to ids with the tokenizers library, which gets each piece between white space once.

    Neither the vocabulary's normaliser nor its pre-tokeniser looks past white space, so that the ids of a text
    are those of its pieces in a row. A word of letters is a single pre-token: after the library's normaliser
    it goes straight to the library's model, and so do a word and a mark after it, which the pre-tokeniser parts.
    Any other piece goes through the library as a whole.
    """

    def __init__(self, path: str, width: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.width = width or (2 if self.lib.get_vocab_size() <= 1 << 16 else 4)
        self.letters = _byte_letters()
        about = json.loads(self.lib.to_str())
        #: Whether pieces may be encoded apart, and words and marks within them; other vocabularies' texts go through the library whole.
        self.apart = {k: about[k] for k in ("normalizer", "pre_tokenizer")} == _KNOWN_STEPS and not any(a["normalized"] or " " in a["content"] for a in about["added_tokens"])
        if self.apart:
            self.normalise, self.model = self.lib.normalizer.normalize_str, self.lib.model.tokenize
        self.known = _Known(self._piece)

    def _piece(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[-1] in ".,!?;:" and piece[:-1].isalpha():
            return self.known[piece[:-1]] + self.known[piece[-1]]
        if piece.isalpha():
            word = piece.lower() if piece.isascii() else self.normalise(piece)
            if word != piece:
                if word.isalpha():
                    return self.known[word]
            elif word.isalpha():
                ids = [t.id for t in self.model(word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode())))]
                return np.array(ids, dtype=f"<u{self.width}").tobytes()
        return np.array(self.lib.encode(piece, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [np.array(self.lib.encode(x, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes() for x in texts]
        if len(self.known) > KEPT_PIECES:
            self.known = _Known(self._piece)
        get = self.known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


#: Steps before the model for which a text's ids are those of its pieces between spaces in a row. Fixed values.
_KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, width, ids): the ids of every whole text and the end id, as little-endian bytes. Null texts are empty."""
    _util.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = int(end_id).to_bytes(tok.width, "little")
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            out, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size >= GROUP_CHARS:
                    out += tok.encode(held)
                    held, size = [], 0
            out += tok.encode(held)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([tok.width] * len(out), pa.int32()), pa.array([x + end for x in out], pa.binary())], names=["doc_id", "width", "ids"])

    return _util.only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, width int, ids binary")


def write(docs: DataFrame, path: str, end_id: int, to: str, shards: int | None = None) -> DataFrame:
    """Write the ids of every document to record shards under ``to``; returns a small table of the shards.

    Shards are ranges of ``doc_id`` (null ids first), so that reading them by name gives ascending ids; rows that repeat an id
    are written each, in the order of their texts' hashes and then of the texts, so that one id may fill several shards. Columns of the result: shard, path, n_records, n_tokens. Runs when
    called. An empty table gives no shards.
    """
    spark = docs.sparkSession
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Dealt out before tokenising: to find the ranges, Spark runs what stands before twice.
    order = "doc_id", F.xxhash64("text"), "text"
    ranges = _util.only(docs, "doc_id", "text").repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    dealt = tokenised(ranges, path, end_id).withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        offset = records = tokens = 0
        lowest = None
        for b in batches:
            if not b.num_rows:
                continue
            if fs is None:
                shard, lowest = b.column("shard")[0].as_py(), b.column("doc_id")[0].as_py()
                fs, folder = opened(to)
                fs.create_dir(folder, recursive=True)
                name, own = f"{folder}/shard-{shard:06d}", uuid.uuid4().hex
                rec, idx = fs.open_output_stream(f"{name}.{own}.rec.part"), fs.open_output_stream(f"{name}.{own}.idx.part")
            width = b.column("width")[0].as_py()
            blobs = [payload(d, x, width) for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist())]
            tokens += sum((len(x) - _HEAD_BYTES) // width for x in blobs)
            for f in frames(blobs):
                rec.write(f)
                idx.write(struct.pack("<QQ", offset, len(f)))
                offset += len(f)
                records += 1
        if fs is not None:
            rec.close(), idx.close()
            for kind in ("idx", "rec"):
                fs.move(f"{name}.{own}.{kind}.part", f"{name}.{kind}")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{to}/shard-{shard:06d}.rec", "lowest": lowest, "n_records": records, "n_tokens": tokens}], schema=kept)

    kept = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("lowest", pa.int64()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])
    return _util.cut(dealt.mapInArrow(run, "shard int, path string, lowest bigint, n_records bigint, n_tokens bigint"), "shards")


def read_back(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record, streamed from the shards; ids as little-endian u32 bytes.

    ``start`` counts the ids in all records before. Only one row a shard reaches the driver, to sum up the shards' sizes.
    """
    spark = shards.sparkSession
    start, rows = 0, []
    for r in shards.orderBy("shard").collect():
        rows.append((r.shard, r.path, start))
        start += r.n_tokens
    todo = spark.createDataFrame(rows, "shard int, path string, base bigint").repartition(max(1, len(rows)), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                for blobs in ShardReader(path):
                    ids, begin, count, data = [], [], [], []
                    for blob in blobs:
                        doc_id, x = parse(blob)
                        ids.append(doc_id)
                        begin.append(at)
                        count.append(len(x))
                        data.append(x.astype("<u4").tobytes())
                        at += len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(count, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return todo.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = _util.new_path(spark, "records")
    shards = write(_util.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, to)
    back = read_back(shards)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
