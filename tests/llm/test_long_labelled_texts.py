"""A labelled text that is longer than the whole training sample, in any place of it."""

import pytest
from pyspark.sql import functions as F

from drivespark.llm import toxicity
from drivespark.llm.quality import fit_quality, score_quality


@pytest.mark.parametrize("place", ["first", "middle"])
def test_one_long_text_neither_ends_nor_empties_the_sample(spark, place):
    ids = [r.id for r in spark.range(60).selectExpr("id", "crc32(cast(cast(id as string) as binary)) % 4 = 2 AS held").where("NOT held").orderBy(F.xxhash64("id")).collect()]
    long_id = ids[0 if place == "first" else len(ids) // 2]
    good, bad = "careful prose about rivers and stone bridges", "buy cheap pills now now click"
    rows = [(i, f"{good if i % 2 else bad} {i}", i % 2) for i in ids]
    docs = spark.createDataFrame([(i, t if i != long_id else t * 600_000) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert docs.where("length(text) > 17000000").count() == 1
    sample = toxicity.training_rows(docs, labels, "quality", 4, 2, 1000)
    assert len(sample) == len(ids) - 1 and max(len(t) for t, _ in sample) < 1000
    scored = {r.doc_id: r.score for r in score_quality(docs.where(f"doc_id <> {long_id}"), fit_quality(docs, labels)).collect()}
    assert min(s for i, s in scored.items() if i % 2) > max(s for i, s in scored.items() if i % 2 == 0)
