"""Lexical search: against brute force on many small shards, the query's SQL, and the bisection's cost."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from drivespark.llm import bisection, lexical
from drivespark.llm.queries_lexical import OP12_SQL, op12_lexical

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k):
    counts = [Counter(plain_terms(t)) for _, t in docs]
    big_n, big_l = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df, out = Counter(t for c in counts for t in c), []
    for item, text in items:
        scored = []
        for (i, _), c in zip(docs, counts, strict=True):
            m = 10 + 90 * sum(c.values()) * big_n // big_l if big_l else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [[f"w{lang}x{i}" for i in range(60)] for lang in range(4)]
    text = lambda n: " ".join(rng.choice(words[rng.randrange(4)] if rng.random() < 0.1 else words[n % 4]) for _ in range(rng.randint(1, 50)))
    docs = [(i, text(i)) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(150)]  # copies: all of equal score, ties to the smaller id
    docs += [(None, docs[5][1]), (7, docs[7][1]), (8, docs[7][1]), (2000, None), (2001, ""), (2002, " .,; "), (2003, "W0X1 É " * 3000), (2004, "漢字 É w0x1")]
    items = [(i, docs[rng.randrange(600)][1]) for i in range(25)] + [(90, docs[5][1]), (91, None), (92, ""), (93, "nowhere"), (94, "É"), (94, "é 漢字"), (None, "w1x1 w1x1 w2x2"), (95, "w0x1"), (95, "w0x1")]
    return docs, items


@pytest.mark.parametrize(("shard", "block_items", "block_terms"), [(40, 1000, 16384), (100_000, 17, 150)])
def test_equals_brute_force(spark, monkeypatch, shard, block_items, block_terms):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "VISITS", (1, 2))
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id long, text string, score long, item string, shard double").repartition(4)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, doc_id int").repartition(3)
    got = lexical.search(d, q, k=10, block_items=block_items, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, items, 10)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id string, text string")
    q = spark.createDataFrame([("i", "a"), ("j", None)], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.search(d, q).collect()] == [("i", 1, "1")]
    for a, b in ((d.where("false"), q), (d, q.where("false")), (d.where("text is null"), q)):
        assert lexical.search(a, b).count() == 0


def test_shards_are_bounded_and_bounds_hold(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 30)
    docs, items = corpus()
    block = next(lexical.item_blocks(spark.createDataFrame(items, "item_id int, text string"), "item_id", "text", 1000, 10_000))
    counted = lexical.staged(lexical.count_terms(spark.createDataFrame(docs, "doc_id long, text string"), block.vocabulary))
    n_docs, n_words = counted.selectExpr("count_if(n > 0)", "sum(n)").first()
    index = lexical.build_shards(counted, lexical.fit_order(counted, len(block.vocabulary), n_docs), n_docs, n_words)
    sizes = [r.n for r in index.selectExpr("size(docs) AS n").collect()]
    assert len(sizes) > 10 and max(sizes) < 90 and sum(sizes) == counted.where("size(terms) > 0").count()
    for r in index.collect():
        assert r.docs[: sum(x is not None for x in r.docs)] == sorted(x for x in r.docs if x is not None)
        for at, most in enumerate(r.most):
            assert most == max(r.impact[r.first[at] : r.first[at + 1]])


def test_bisection_puts_alike_documents_together():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 4, 800)
    pairs = np.unique(np.array([(d, kind[d] * 50 + t if rng.random() < 0.9 else rng.integers(200)) for d in range(800) for t in rng.integers(0, 50, 12)]), axis=0)
    tree = bisection.fit_tree(pairs[:, 0], pairs[:, 1], 800, 200, 3)
    leaf = tree.leaves(pairs[:, 0], pairs[:, 1], 800)
    assert tree.levels == 3 and set(leaf) <= set(range(8))
    pure = sum(np.bincount(kind[leaf == x]).max() for x in set(leaf)) / 800
    assert pure > 0.8  # 0.25 by chance
    assert bisection.fit_tree(pairs[:0, 0], pairs[:0, 1], 0, 200, 3).levels == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 10)
    for text in (b"", b"a" * 50, b"ab CD-ef  " * 30, b" " * 40):
        assert [w for ws in lexical.split_terms(text) for w in ws] == [w.encode() for w in plain_terms(text.decode())]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({OP12_SQL})").fetchall()
    assert Counter(tuple(r) for r in op12_lexical(spark, SF).collect()) == Counter(want) and want
