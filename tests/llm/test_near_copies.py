"""The pipeline's near-dedup stage against brute force, on chains of drifting copies and odd rows."""

import random

import numpy as np
import pytest

import corpus_pipeline
from drivespark.llm import near_copies
from drivespark.llm.components import components


def drifted():
    """Chains whose links are over 0.8 alike while their ends aren't; exact copies of every second text under other ids."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(4):
        text = [word() for _ in range(400)]
        for step in range(14):
            rows.append(" ".join(text))
            if step % 2:
                rows.append(" ".join(text))
            at = rng.randrange(0, 385)
            text[at : at + 8] = [word() for _ in range(8)]
    return [*rows, None, "", " \t", "one", "one", "ONE", "Éa 漢字 " * 3, "long " * 30_000]


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    prints = near_copies.word_prints([(t or "").encode() for t in texts])
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if (np.bitwise_count(prints[i] ^ prints[j]) <= near_copies.RADIUS).any():
                a, b = sorted((find(i), find(j)))
                root[b] = a
    sets, stay = [shingles(t) for t in texts], []
    for i in range(len(texts)):
        same = lambda j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        if not any(find(i) == find(j) and same(j) for j in stay):
            stay.append(i)
    return stay


@pytest.mark.parametrize("leaders", [8, 1])
def test_chains_equal_brute_force(spark, monkeypatch, leaders):
    monkeypatch.setattr(near_copies, "LEADERS", leaders)
    texts = drifted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in left) == brute(texts)
    assert len({r.text for r in left}) == len(left)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, 1000 - i % 3) for i in range(500, 900)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5), (6, None)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            root[find(a)] = find(b)
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        assert r.node not in got
        got[r.node] = r.label
    assert set(got) == set(root)
    assert len({(find(n), label) for n, label in got.items()}) == len({find(n) for n in got}) == len(set(got.values()))


def test_copies_unlike_the_first_of_their_group(spark):
    """A and B are linked but less than 0.8 alike; of three Bs one stays."""
    rng = random.Random(1)
    a = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100)]
    b = list(a)
    for i in (7, 23, 44, 61, 80):
        b[i] = b[i][::-1]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(b)), (4, " ".join(b)), (4, " ".join(b)), (None, " ".join(b)), (None, None)]
    table = spark.createDataFrame([(*r, 0, {"x": 1}) for r in rows], "doc_id long, text string, __key long, m map<string,int>").drop("m")
    left = near_copies.first_of_groups(table)
    assert left.columns == table.columns
    assert sorted(((r.doc_id or 0), (r.text or "")[:5]) for r in left.collect()) == sorted([(1, " ".join(a)[:5]), (0, " ".join(b)[:5]), (0, "")])
    assert near_copies.first_of_groups(table.where("false")).count() == 0
