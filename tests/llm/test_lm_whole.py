"""The network and its classes are learnt from every training text, not from the sample that it starts from."""

import numpy as np
from pyspark.sql import functions as F

from drivespark.llm import lm
from drivespark.llm.vectors import held_out


def _docs(spark, backwards: bool):
    rng, words = np.random.default_rng(4), "one two three four five six seven eight".split()
    rows = []
    for i in range(200):
        own = rng.choice(words, 60).tolist()
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = F.array_join(F.array_sort(F.split("text", " ")), " ")
    return docs.withColumn("text", F.when(held_out(F.col("doc_id"), 5, 1), F.col("text")).otherwise(turned if backwards else F.col("text")))


def test_the_order_of_words_in_training_texts_counts_without_the_sample(spark, monkeypatch):
    """Counts and the texts that hold a word are the same in both corpora; the sample teaches nothing."""
    monkeypatch.setattr(lm, "train", lambda net, streams: [])
    monkeypatch.setattr(lm, "topics", lambda streams: np.zeros((lm.IDS, 24), np.float32))
    a, b = ({r.doc_id: r.score for r in lm.score_texts(_docs(spark, x)).where("held_out").collect()} for x in (False, True))
    assert a.keys() == b.keys() and len(a) > 20
    assert all(abs(a[k] - b[k]) > 1e-3 for k in a)


def test_every_subword_is_learnt_from_once(spark):
    ranks = lm.read_ranks(spark)
    docs = _docs(spark, False).select(F.col("doc_id").alias("h"), "text").repartition(3)
    streams = lm.subword_streams(docs, spark.sparkContext.broadcast(ranks))
    ids = [np.frombuffer(r.ids, np.uint16) for r in streams.collect()]
    encode = lm.load_encoder(ranks).encode_ordinary
    assert sorted(x.tolist() for x in ids) == sorted([*encode(" " + r.text), lm.END] for r in docs.collect())
    initial = lm.word_starts(ranks)
    counts = np.bincount(np.concatenate(ids), minlength=lm.IDS).astype(float)
    net = lm.make_network(counts, np.where(initial, counts, 0), np.zeros(lm.IDS), initial, lm.corpus_directions(streams, lm.topics(ids[:5])))
    x, y, live = lm.windows_of(np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids]))
    plain = [np.stack(c) for c in zip(*(w for i in ids for w in lm.cut_windows(i.astype(np.int64), lm.WINDOW)), strict=True)]
    assert all((p == q).all() for p, q in zip((x, y, live), plain, strict=True))
    before = lm.gradients(net, x, y, live)[0]
    assert sum(lm.train_on_all(net, streams)) == sum(len(i) for i in ids)
    assert lm.gradients(net, x, y, live)[0] < before
