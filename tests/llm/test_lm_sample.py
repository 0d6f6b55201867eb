"""The network's training sample is never empty while there are training texts."""

from pyspark.sql import functions as F

from drivespark.llm import lm


def test_the_bound_holds_a_sample_at_every_size(spark):
    for texts in (1, 3_000, 10**6, 10**10, 10**13, 10**17):
        share = (lm.sample_bound(texts) + 1) / 2**63
        assert share == 1.0 or abs(share * texts - 1.5 * lm.SAMPLE_DOCS) < 0.01 * lm.SAMPLE_DOCS
    assert lm.sample_bound(0) == lm.sample_bound(1) == (1 << 63) - 1 and lm.sample_bound(10**30) > 0
    h = spark.range(200_000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"))
    assert 4_000 < h.where(F.col("h") <= lm.sample_bound(200_000)).count() < 5_000


def test_one_text_repeated_is_in_the_sample(spark, monkeypatch):
    """Rows that repeat share a hash, so a bound may miss all of them: the sample is then taken without it."""
    seen, train = [], lm.train
    monkeypatch.setattr(lm, "sample_bound", lambda texts: 0)
    monkeypatch.setattr(lm, "train", lambda net, streams: (seen.append(len(streams)), train(net, streams))[1])
    rows = lm.score_texts(spark.range(40).selectExpr("id AS doc_id", "'the same few words' AS text")).collect()
    assert len(rows) == 40 and {r.n_tokens for r in rows} == {5}
    assert seen == [sum(not r.held_out for r in rows)]
