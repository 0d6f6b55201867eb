"""The query of byte-level BPE (tested against the vocabulary's own library and by round trips; SQL can't express it)."""

from __future__ import annotations

from . import common
from .byte_bpe import PATTERN, decode_ids, digests, encode_texts, read_ranks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op13_byte_bpe(spark, sf_dir, vocabulary: str = VOCABULARY):
    ranks = read_ranks(vocabulary)
    ids = encode_texts(common.read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, PATTERN).drop("text")
    decoded = decode_ids(ids, ranks)
    return decoded.select("doc_id", *digests(decoded))
