"""Importance resampling: the CRC algebra against zlib, draws against plain Python and the query's SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from drivespark.llm import crc, resampling
from drivespark.llm.queries_resampling import OP11_SQL, op11_resample

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, rank double, n_words int, bucket long, weight string"


def test_crcs_of_joined_strings():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.randint(0, 60)), rng.randbytes(n)) for n in [0, 1, 2, 3, 255, 256, 70_000, 1_000_001, *(rng.randint(0, 40) for _ in range(500))]]
    a, b = (np.array([zlib.crc32(p[i]) for p in parts], np.uint32) for i in (0, 1))
    assert crc.joined(a, b, np.array([len(y) for _, y in parts])).tolist() == [zlib.crc32(x + y) for x, y in parts]
    assert len(crc.shift(np.zeros(0, np.uint32), np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("n_gram", [1, 2, 3, 4])
def test_features_are_the_crcs_of_all_runs(n_gram):
    texts = ["", "one", "A B c!d É漢 " * 9, "x", "x y", "no-end of Ünïcode 12", "w" * 3000 + " z"]
    words = resampling.WordCrcs(most=5)
    got = [(n, d, c) for n, (cs, ds) in enumerate(resampling.features([t.encode() for t in texts], words, n_gram)) for c, d in zip(cs.tolist(), ds.tolist(), strict=True)]
    want = []
    for d, t in enumerate(texts):
        ws = plain_words(t)
        want += [(n, d, zlib.crc32(" ".join(ws[i : i + n + 1]).encode())) for n in range(n_gram) for i in range(len(ws) - n)]
    assert Counter(got) == Counter(want)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, target, percent, least, buckets=10_000):
    def grams(t):
        ws = plain_words(t)
        return [zlib.crc32(g.encode()) % buckets for g in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]]

    s, t = Counter(g for _, x in docs for g in grams(x)), Counter(g for x in target for g in grams(x))
    big_s, big_t, rows = sum(s.values()), sum(t.values()), []
    for i, x in docs:
        g = grams(x)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in g]
        weight = sum(gain) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)) >= least))
    can = sorted((-r[3], r[0] is None, r[0] or 0) for r in rows if r[4])
    drawn = can[: percent * len(can) // 100]
    return rows, drawn


def corpus():
    rng = random.Random(5)
    some = [" ".join(rng.choice("alpha Beta gamma DELTA eps zeta-eta 42 é漢".split()) for _ in range(rng.randint(15, 60))) for _ in range(80)]
    return [(i, t) for i, t in enumerate([None, "", "  ", "one", "loop " * 900, *some])] + [(None, some[3]), (7, some[2]), (7, some[2]), (8, some[3])]


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_draws_equal_plain_python(spark, percent):
    docs, target = corpus(), ["alpha beta gamma", None, "", "gamma delta alpha " * 5]
    frame = spark.createDataFrame([(i, t, "x", 1.0, 3, 4, "y") for i, t in docs], SCHEMA).repartition(5)
    got = resampling.resample(frame, spark.createDataFrame([(t, 9) for t in target], "text string, n int"), percent=percent).collect()
    rows, drawn = plain(docs, target, percent, 20)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(r[:4] for r in rows)
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn


def test_empty_tables(spark):
    frame = spark.createDataFrame([(i, t, "x", 1.0, 3, 4, "y") for i, t in corpus()], SCHEMA)
    assert resampling.resample(frame.where("false"), frame).count() == 0
    rows = resampling.resample(frame, frame.where("false")).collect()
    assert len(rows) == len(corpus())
    assert sum(r.rank is not None for r in rows) == sum(len(plain_words(t)) >= 20 for _, t in corpus()) // 4


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({OP11_SQL})").fetchall()
    assert Counter(tuple(r) for r in op11_resample(spark, SF).select(*names).collect()) == Counter(want)
