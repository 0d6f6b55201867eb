"""Words are counted and made into subwords in one pass, which scoring reads; frequent words are looked up by slot."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from drivespark.llm import lm

ODD = ["", None, "  ", "a", "The the THE  end\n", "x \x1c\x85 AİZ\tb\x0bc\x0cd\re\n\n", " lead  trail ", "\x00 b\x00c", "ab" * 3_000, "a b a b"]


def test_one_pass_counts_words_and_makes_streams(spark):
    ranks = lm.read_ranks(spark)
    rows = [(i, i % 3 != 1, t) for i, t in enumerate(ODD * 4)]
    texts = spark.createDataFrame(rows, "doc_id long, learn boolean, text string").repartition(3)
    shared, encode = spark.sparkContext.broadcast(ranks), lm.load_encoder(ranks).encode_ordinary
    words = {i: [*(t or "").encode().translate(lm._LOWER).split(), b"\n"] for i, _, t in rows}
    subwords = lambda w: [lm.END] if w == b"\n" else encode(" " + w.decode())
    counts = Counter(w for i, learn, _ in rows if learn for w in words[i])
    key = lambda w: int(lm.word_keys(np.array(subwords(w)), np.array([0]), np.array([len(subwords(w))]))[0])
    by_id = Counter()
    for w, c in counts.items():
        for i in subwords(w):
            by_id[i] += c
    for block in (1, 1 << 20):  # a block for each text, and for all of a task
        both = lm.encoded(texts, shared, block)
        got = {r.doc_id: np.frombuffer(r.ids, np.uint16).tolist() for r in both.where("c IS NULL").collect()}
        assert got == {i: [x for w in ws for x in subwords(w)] for i, ws in words.items()}
        found = both.where("w IS NOT NULL").groupBy("w", "i").agg(F.sum("c").alias("c")).collect()
        assert {(r.w, r.i): r.c for r in found} == {(key(w), subwords(w)[0]): c for w, c in counts.items()}
        total = both.where("w IS NULL AND c IS NOT NULL").groupBy("i").agg(F.sum("c").alias("c")).collect()
        assert {r.i: r.c for r in total} == by_id


def test_slots_give_a_words_count_or_none():
    """Of words that share a slot the most frequent one is held; no word gets another's count."""
    rng = np.random.default_rng(3)
    keys, counts = rng.integers(-(2**63), 2**63, 3_000), rng.integers(1, 90, 3_000).astype(float)
    got = lm.Head(keys, counts, bits=10).of(keys)
    slot = keys.view(np.uint64) >> np.uint64(54)
    most = {s: counts[slot == s].max() for s in set(slot.tolist())}
    assert all(g in (0.0, c) for g, c in zip(got, counts, strict=True))
    assert sum(got > 0) == len(most) and all(c == most[s] for g, c, s in zip(got, counts, slot.tolist(), strict=True) if g)
    assert not lm.Head(keys, counts).of(rng.integers(-(2**63), 2**63, 3_000)).any()
