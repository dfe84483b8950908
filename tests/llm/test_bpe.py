import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from specgraph.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
random.seed(5)
TEXTS = ["", "a", "a" * 3000, "ab" * 700, "  x \n\n y\t", "don't won't I'll", "日本語 テキスト 🎉🎉", "1234567890" * 30, "".join(chr(random.randrange(1, 0x3000)) for _ in range(2000)), "Straße ÉÈÊ ñandú"]


@pytest.fixture(scope="module")
def lib():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(PATH)) if t}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library(lib):
    enc = bpe.Encoder(bpe.load_ranks(PATH), P.PATTERN)
    for texts in (TEXTS[:5], TEXTS):  # the second time with known pieces
        flat, sizes = enc.encode(texts)
        at = 0
        for t, n in zip(texts, sizes):
            assert flat[at : at + n].tolist() == lib.encode_ordinary(t)
            at += n


def test_forgets_and_goes_on(lib, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    enc = bpe.Encoder(bpe.load_ranks(PATH), P.PATTERN)
    for t in TEXTS:
        assert enc.encode([t])[0].tolist() == lib.encode_ordinary(t)


def test_digests(spark, lib):
    rows = [(i, t, "x", "y") for i, t in enumerate([*TEXTS, None, "a", "a"])] + [(None, "null id", "x", "y"), (0, "again", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    want = set()
    for i, t, _, _ in rows:
        ids = lib.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_decode_rejects_unknown_ids(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([99999999],)], "ids array<int>"), PATH).collect()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
