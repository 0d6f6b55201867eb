"""The training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from drivespark.llm import lm, simhash
from drivespark.llm.decontaminate import find_contamination
from drivespark.llm.licenses import TEMPLATES, scan_licenses
from drivespark.llm.mixing import mix_sources
from drivespark.llm.neighbours import nearest
from drivespark.llm.quality import fit_quality, score_quality
from drivespark.llm.substrings import cut_repeated_words
from drivespark.llm.suffixes import cut_repeated_bytes
from drivespark.llm.toxicity import fit_toxicity, score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, score double, fp string, size string, h string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def texts():
    rng = random.Random(3)
    shared, item = words(rng, 60), words(rng, 30)
    base = words(rng, 120)
    some = [words(rng, rng.randint(1, 90)) for _ in range(12)]
    odd = [None, "", " \t\n ", "one", "Éa ñö 漢字 " * 60, "loop " * 700, words(rng, 4000), base, base, base + " more", base.replace(" ", "  ", 1)]
    return [*odd, *(f"{words(rng, 20)} {shared} {x}" for x in some[:4]), *some, f"{some[0]} {item} {some[1]}", item, "x " + TEMPLATES["MIT"] + "\n" + TEMPLATES["MIT"] + "\nprose"], item


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "c", "d"][i % 5], None, 1, 2.0, "x", "y", "z") for i, t in enumerate(texts()[0])]
    rows += [(None, "no id at all", None, None, None, 1, 2.0, "x", "y", "z"), rows[7], rows[7], rows[20]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, texts()[1], "x"), (2, None, "x"), (3, "", "x"), (4, "one", "x")], "item_id long, text string, doc_id string")


def test_licenses(spark, docs, empty):
    n, rows = len(texts()[0]) - 1, scan_licenses(docs).collect()
    assert {(r.doc_id, r.license, r.start, r.n_words, r.dice) for r in rows} == {(n, "MIT", 1, 5, 1.0)}
    assert scan_licenses(empty).count() == 0
    notice, prose = TEMPLATES["MIT-notice"].split(), "\n".join("def f(x): return x + 1" for _ in range(150))
    wrapped = "\n".join(" * " + " ".join(notice[i : i + 9]) for i in range(0, len(notice), 9))
    made = [("\n" * 100).join(TEMPLATES["MIT"].split()), f"{wrapped}\n{prose}", "see also: Released under the MIT License, as it were", "Released under the licence", TEMPLATES["ISC"] + " word" * 90_000]
    got = {(r.doc_id, r.license, r.dice) for r in scan_licenses(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert {(0, "MIT", 1.0), (1, "MIT-notice", 1.0), (2, "MIT", 1.0), (4, "ISC", 1.0)} <= got and all(i != 3 for i, _, _ in got)


def test_mixing(docs, empty):
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    total, share = sum(r["size"] for r in rows), sum(r[0].target for r in by.values())
    assert abs(total - share) < 1e-6 * total
    for own in by.values():
        assert own[0].source_size == sum(r["size"] for r in own)
        assert own[0].target <= 3 * own[0].source_size + 1e-9
        # The boundary is one document: no further off than the largest.
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(Counter(r.doc_id for r in own).values()) * max(r["size"] for r in own)
    assert mix_sources(empty).count() == 0


def brute_cut(all_texts, window, as_words):
    units = [(t or "").encode().split() if as_words else (t or "").encode() for t in all_texts]
    key = tuple if as_words else bytes
    seen = Counter(key(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[key(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g) if as_words else bytes(b for b, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("as_words", [False, True])
def test_repeats_equal_brute_force(docs, empty, as_words):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(brute_cut([r.text for r in rows], 35 if as_words else 200, as_words))
    run = cut_repeated_words if as_words else cut_repeated_bytes
    got = run(docs).select("n_units", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()
    assert sorted(tuple(r) for r in got) == want
    assert run(empty).count() == 0
    # Buckets of many classes go through joins: the same result.
    got = run(docs, in_task=1).select("n_units", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()
    assert sorted(tuple(r) for r in got) == want


def test_contamination(docs, empty, benchmark):
    got = {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in find_contamination(docs, benchmark).collect()}
    n = len(texts()[0])
    assert got == {(n - 3, 1, 1.0), (n - 2, 1, 1.0), (3, 4, 1.0)}
    assert find_contamination(empty, benchmark).count() == 0 == find_contamination(docs, benchmark.where("false")).count()


def test_simhash_equals_brute_force(docs, empty):
    got = {}
    for r in simhash.simhash_groups(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {}
    for i, t in rows.items():
        w = (t or "").lower().encode().split() if t is None or t.isascii() else t.encode().translate(simhash._LOWER).split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(prints, key=lambda i: (i is None, i or 0))
    for i in order:
        for j in order:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and (a := find(i)) != (b := find(j)):
                parent[max(a, b, key=order.index)] = min(a, b, key=order.index)
    for i, p in prints.items():
        assert got[i] == {(p - (1 << 64) if p >> 63 else p, find(i))}
    assert simhash.simhash_groups(empty).count() == 0


def test_vantage_point_tree_misses_no_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    x = np.unique(np.concatenate([rng.integers(0, 2**63, 3000, dtype=np.uint64), base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for _ in range(3))]))
    tree, met = simhash.build_tree(x[::7], 4), set()
    for _, rows in simhash.route(x, tree, 2):
        d = np.bitwise_count(x[rows][:, None] ^ x[rows][None, :]) <= 2
        met |= {(int(rows[a]), int(rows[b])) for a, b in zip(*np.nonzero(d), strict=True)}
    want = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2)}
    assert want == met and simhash.near_components is not None


def test_classifiers(docs, empty, labels):
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        model = fit(docs, labels)
        rows = score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert score(empty, fit(empty, labels.where("false"))).count() == 0


def test_training_reads_whole_texts(spark):
    rows = [(i, f"clean {i} " * 4_000 + "vile nasty horrid." if i % 2 else f"clean {i} " * 4_000) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    found = score_toxicity(docs, fit_toxicity(docs, labels, rest=-1)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in found)
    for r in found:
        assert len(r.sentences) == r.predicted and all(s["first"] > 30_000 and r.text.encode()[s["first"] : s["last"]].endswith(b"horrid") for s in r.sentences)


@pytest.mark.parametrize("fit, score, label, parts, rest", [(fit_quality, score_quality, "quality", 4, 2), (fit_toxicity, score_toxicity, "toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, fit, score, label, parts, rest):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = score(docs.join(F.broadcast(labels), "doc_id").select("doc_id", "text", label), fit(docs, labels, parts, rest)).select("doc_id", "predicted", label).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % parts == rest]
    assert len(held) > 100 and np.mean([r.predicted == r[label] for r in held]) > 0.97


def test_language_model(docs, empty):
    rows = lm.score_texts(docs).collect()
    plain = [(r.doc_id, (r.text or "").encode().translate(lm._LOWER).split() + [b"\n"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, ws in plain if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), round(float(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)), 4), held(i)) for i, ws in plain)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4), r.held_out) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    assert lm.score_texts(empty).count() == 0


def untrained(rng):
    """Class shares by made-up counts; ids under 500 and the end start words."""
    initial = np.arange(lm.IDS) < 500
    initial[lm.END] = True
    counts = rng.integers(1, 50, lm.IDS).astype(float)
    return lm.make_network(counts, np.where(initial, counts, 0), np.where(initial, counts // 9, 0), initial), initial


def probabilities(net, h):
    """Of every id after the state ``h``."""
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    low = np.stack([soft(h @ net.low[g]) for g in range(lm.GROUPS)])
    return (soft(h @ net.top)[:, None] * low)[net.group, net.leaf] * 10.0**net.share


def test_attention_scores_each_subword_once():
    rng = np.random.default_rng(1)
    net, initial = untrained(rng)
    flat = rng.integers(0, 1000, 300)
    sizes = np.array([0, 1, 31, 32, 33, 100, 103])
    own, kind, begins = lm.stream_scores(net, flat, sizes, batch=3)
    assert np.allclose(own, kind + net.share[flat])
    first = 0
    for size in sizes:
        ids = flat[first : first + size]
        before = np.concatenate(([lm.END], ids[:-1])) if size else ids
        done = 0
        while done < size:
            turn = 0 if done == 0 else (done - lm.WINDOW) // lm.STRIDE + 1
            begin = turn * lm.STRIDE
            x = np.full((1, lm.WINDOW), lm.END)
            n = min(lm.WINDOW, size - begin)
            x[0, :n] = before[begin : begin + n]
            h = lm.forward(net, x)[0][0]
            for k in range(done - begin, n):
                p = probabilities(net, h[k])
                assert abs(p.sum() - 1) < 1e-4 and abs(p[initial].sum() - 10.0 ** begins[first + begin + k]) < 1e-4
                assert abs(np.log10(p[ids[begin + k]]) - own[first + begin + k]) < 1e-3
            done = begin + n
        first += size


def test_words_have_at_most_one_together():
    """After any context: known words, all words of one subword and the end, and a bound on longer ones."""
    rng = np.random.default_rng(5)
    net, initial = untrained(rng)
    h = lm.forward(net, rng.integers(0, 900, (1, lm.WINDOW)))[0][0][-1]
    p = probabilities(net, h)
    start = p[initial].sum()
    class_mass = np.bincount((net.group * lm.LEAVES + net.leaf)[initial], p[initial], lm.GROUPS * lm.LEAVES) / start
    assert abs(class_mass.sum() - 1) < 1e-5
    counts = rng.integers(0, 50, lm.IDS).astype(float)
    # ``known`` spreads what is left over the counts of a class; spelt words have the rest, however they go on.
    cell = (net.group * lm.LEAVES + net.leaf)[initial & (np.arange(lm.IDS) != lm.END)]
    words = np.bincount(cell, np.random.default_rng(5).integers(1, 50, lm.IDS).astype(float)[initial & (np.arange(lm.IDS) != lm.END)], lm.GROUPS * lm.LEAVES)
    used = words > 0
    both = words * 10.0 ** net.known.reshape(-1) + 10.0 ** net.new.reshape(-1)
    assert np.allclose(both[used], 1, atol=1e-6) and counts.min() >= 0
    shares = np.bincount((net.group * lm.LEAVES + net.leaf)[initial], 10.0 ** net.share[initial], lm.GROUPS * lm.LEAVES)
    assert (shares < 1 + 1e-6).all()
    # Two words of a text, by hand: the second subword, then whatever starts a word.
    flat, lens = np.array([3, 700, 7, lm.END]), np.array([2, 1, 1])
    scores = lm.stream_scores(net, flat, np.array([4]))
    whole, spelt = lm.word_scores(net, flat, lens, scores)
    own, kind, begins = scores
    assert abs(spelt[0] - (kind[0] - begins[0] + net.new[net.group[3], net.leaf[3]] + net.share[3] + own[1] + begins[2])) < 1e-5
    assert abs(spelt[2] - (kind[3] - begins[3] + net.share[lm.END])) < 1e-5 and abs(net.share[lm.END]) < 1e-9 and whole[2] < -200


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net, _ = untrained(rng)
    net.embed = net.embed.astype(np.float64)
    x, y = rng.integers(0, 50, (2, lm.WINDOW)), rng.integers(0, 900, (2, lm.WINDOW))
    live = np.ones(x.shape, bool)
    _, _, rest = lm.gradients(net, x, y, live)
    for part, g in zip(net.parts()[1:], rest, strict=True):
        at = tuple(rng.integers(0, s) for s in part.shape)
        old, e = part[at], 1e-2
        part[at] = old + e
        up = lm.gradients(net, x, y, live)[0]
        part[at] = old - e
        down = lm.gradients(net, x, y, live)[0]
        part[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [1.0], "x"), (904, [None] + [1.0] * 15, "x"), (20, x[20].tolist(), "x"), (None, x[1].tolist(), "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string")
    got = nearest(table).toPandas()
    hit = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & set(own.vec_id))
    assert got.query_id.nunique() == 35 and hit / (35 * 20) >= 0.9
    few = nearest(table.where("vec_id < 12"))
    assert few.count() == 11 and nearest(table.where("false")).count() == 0


def test_every_query_reads_whole_tables(spark):
    from drivespark.llm import catalog

    for name in ("op3_quality", "op4_mix", "op10_toxicity"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
