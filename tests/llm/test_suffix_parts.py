"""Buckets of many classes are parted by more of their bytes; no row is made for each suffix."""

import random
from collections import Counter

from pyspark.sql import functions as F

from drivespark.llm import suffixes


def _texts() -> list[bytes]:
    """Many surroundings of one passage, some of them shared on one side or on both."""
    rng = random.Random(3)
    some = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    gram, lefts, rights = some(60), [some(230) for _ in range(12)], [some(230) for _ in range(12)]
    out = [some(230) + gram + some(230) for _ in range(60)]
    for i in range(90):
        left, right = lefts[rng.randrange(12)], rights[rng.randrange(12)]
        out.append(some(30) + left[rng.randrange(0, 200) :] + gram + right[: rng.randrange(0, 230)] + some(120))
    return out + out[-2:]


def _plain(texts: list[bytes], length: int) -> Counter:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out[len(t), len(gone), bytes(b for i, b in enumerate(t) if i not in gone)] += 1
    return out


def test_parted_buckets_equal_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    for in_task in (1, 12):
        got = Counter((r.n_units, r.n_removed, bytes(r.kept)) for r in suffixes.cut_repeated_bytes(docs, in_task=in_task).collect())
        assert got == _plain(texts, suffixes.LENGTH)


def test_a_class_of_a_large_bucket_costs_two_rows_at_most(spark, monkeypatch):
    made, halved = [], suffixes.halved
    monkeypatch.setattr(suffixes, "halved", lambda rows, length: (made.append((rows.count(), halved(rows, length).count())), halved(rows, length))[1])
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(_texts())], "doc_id long, text string")
    assert suffixes.cut_repeated_bytes(docs, in_task=12).agg(F.sum("n_removed")).first()[0] > 0
    assert made and all(0 < after <= 2 * before for before, after in made)
    assert sum(after for _, after in made) < 20 * len(_texts())
