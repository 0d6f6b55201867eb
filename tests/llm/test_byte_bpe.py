"""Byte-level BPE against the vocabulary's own library, plain merging and round trips."""

import hashlib
import random

import pytest

from drivespark.llm import byte_bpe, common
from drivespark.llm.queries_bpe import VOCABULARY, op13_byte_bpe

tiktoken = pytest.importorskip("tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return byte_bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(2)
    letters = "abcXYZ 0123 '\"\n\t\x00\xa0é漢ñß🙂‍s't'll.,!? <|endoftext|>"
    return ["", " ", "\n\n  x", "don't we'll I'M", "<|endoftext|>", "  \t ", "a" * 5000, "x y " * 40_000, "漢字" * 900, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(400))]


def test_perfect_hash_is_minimal_and_never_takes_a_foreign_string(vocabulary, ranks):
    whole = vocabulary.whole
    keys = list(ranks)
    assert len(whole.key) == len(keys) and set(whole.key) == set(keys)
    assert whole.find(keys).tolist() == list(range(len(keys)))
    foreign = [b"", b"zzqx-not-in-it", *(k + b"\x00\x00q" for k in keys[:5000])]
    assert all((i < 0) == (x not in ranks) for i, x in zip(whole.find(foreign).tolist(), foreign, strict=True))
    assert byte_bpe.PerfectHash([]).find([b"a"]).tolist() == [-1]
    assert byte_bpe.PerfectHash([b"a"]).find([b"a", b"b"]).tolist() == [0, -1]


def test_heap_equals_plain_merging(vocabulary, ranks):
    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            rank, i = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if rank == 1 << 60:
                return [ranks[p] for p in parts]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    for _ in range(500):
        piece = bytes(rng.choice(b"aaabbtheoin \xe6\xbc\xa2s") for _ in range(rng.randint(1, 40)))
        assert vocabulary.merged(piece) == plain(piece)


def test_encoder_equals_the_library(vocabulary, library):
    encoder, forgetful = byte_bpe.Encoder(vocabulary), byte_bpe.Encoder(vocabulary, remembered=40)
    for text in odd_texts():
        want = library.encode_ordinary(text)
        assert encoder.encode(text).tolist() == want and forgetful.encode(text).tolist() == want


def test_stretches_change_nothing(vocabulary, library):
    text = " ".join(odd_texts())
    pieces = list(byte_bpe.stretches(text, 37))
    assert "".join(pieces) == text and len(pieces) > 100
    assert [i for p in pieces for i in byte_bpe.Encoder(vocabulary)._stretch(p).tolist()] == library.encode_ordinary(text)


def test_rows_nulls_repeats_and_clashing_columns(spark, ranks, library):
    texts = [None, *odd_texts()[:40], "same", "same"]
    rows = [(i if i else None, t, "x", 1.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded double").repartition(3)
    coded = byte_bpe.encode_texts(docs, ranks)
    assert coded.columns == ["doc_id", "text", "decoded", "ids"]
    both = byte_bpe.decode_ids(coded, ranks).collect()
    assert len(both) == len(texts)
    for r in both:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(docs.where("false"), ranks), ranks).count() == 0


def test_wrong_ids_and_vocabularies_are_errors(spark, ranks):
    for bad in ("array(50256)", "array(-1)", "array(1, null)"):
        with pytest.raises(Exception, match="id"):
            byte_bpe.decode_ids(spark.range(1).selectExpr(f"{bad} AS ids"), ranks).collect()
    assert [bytes(r.decoded) for r in byte_bpe.decode_ids(spark.range(1).selectExpr("CAST(NULL AS array<int>) AS ids"), ranks).collect()] == [b""]
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.Vocabulary({b"a": 0})


def test_query_on_the_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in common.read(spark, SF, "documents").collect()}
    rows = op13_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, raw = library.encode_ordinary(texts[r.doc_id]), texts[r.doc_id].encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
