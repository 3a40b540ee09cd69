"""BPE and packing against the tokenizers library on whole tables, and the cases of their docstrings."""

import hashlib
import random
import struct
import zlib

import pytest

from palimpsest.llm import packing, tokens
from palimpsest.llm.common import read
from palimpsest.llm.queries import op5_bpe, op9_packing, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def odd(spark):
    pick = random.Random(1)
    texts = ["", None, " ", "aaaaaaa aaaa", "<|startoftext|>x<|endoftext|> y", "a\x1cb c", "ßÄ İ Σας ΟΔΟΣ", "banana bananana nnnnnn", "don't I'LL we've", "١٢٣ ½ ²", "日本語 😀😀", "wort " * 30_000, "x" * 100_000]
    texts += ["".join(pick.choices("aabbnl'ß İΣ😀1 .-\n\x1cé", k=pick.randrange(40))) for _ in range(500)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def test_encoding_of_every_row(spark, library):
    texts = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    rows = op5_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = expected(library, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(struct.pack(f"<{len(ids)}I", *ids)) and r.decoded_sha256 == digest(decoded.encode())


def test_encoding_of_odd_texts(odd, library):
    texts = {r.doc_id: r.text for r in odd.collect()}
    digests = {r.doc_id: r for r in tokens.encode_digests(odd, vocabulary()).collect()}
    for r in tokens.encode_documents(odd, vocabulary()).collect():
        ids, decoded = expected(library, texts[r.doc_id])
        assert r.ids == ids and r.decoded == decoded, texts[r.doc_id]
        assert digests[r.doc_id].ids_sha256 == digest(struct.pack(f"<{len(ids)}I", *ids)) and digests[r.doc_id].decoded_sha256 == digest(decoded.encode())


def plain_pieces(ids, max_len):
    """(start, length, crc) by plain halving."""
    out, at = [], 0
    while at < len(ids):
        n = max_len
        while n > len(ids) - at:
            n //= 2
        out.append((at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])), len(ids)))
        at += n
    return out


def test_packing_of_every_row(spark, library):
    texts = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    found = {}
    rows = op9_packing(spark, SF).collect()
    for r in rows:
        assert r.offset == 0 and 1 << r.bucket == r.length
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert {k: sorted(v) for k, v in found.items()} == {k: plain_pieces([*expected(library, t)[0], 2], 4096) for k, t in texts.items()}


def test_packing_of_odd_texts_and_buckets(odd, library, tmp_path, spark):
    packing.write_buckets(packing.pack_documents(odd, vocabulary(), max_len=64), str(tmp_path / "pieces"))
    rows = spark.read.parquet(str(tmp_path / "pieces")).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length == 1 << r.bucket and r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
    assert got == {k: [*expected(library, t)[0], 2] for k, t in texts.items()}


def test_repeats_clashing_columns_and_empty_tables(spark, odd):
    rows = odd.selectExpr("doc_id", "text", "1 AS start", "'x' AS ids", "2 AS n_tokens", "3 AS bucket").where("doc_id < 9")
    twice = rows.unionAll(rows)
    assert packing.pack_documents(twice, vocabulary()).count() == 2 * packing.pack_documents(rows, vocabulary()).count()
    assert tokens.encode_digests(twice, vocabulary()).count() == 18 and tokens.encode_documents(twice, vocabulary()).count() == 18
    assert packing.pack_documents(rows.limit(0), vocabulary()).count() == tokens.encode_digests(rows.limit(0), vocabulary()).count() == tokens.encode_documents(rows.limit(0), vocabulary()).count() == 0
