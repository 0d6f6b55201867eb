"""The pipeline's stages hand texts to Python in batches bounded by bytes."""

import pyarrow as pa
import pytest

import corpus_pipeline
from drivespark.llm import common

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.cut_passages])
def test_batches_are_bounded_by_bytes(spark, stage):
    spark.conf.unset(NAME)
    docs = spark.range(0, 3_000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 600) AS text", "'a' AS source", "0L AS n_chars")
    try:
        stage(spark, docs.limit(20), "/root/testdata/sf0.001")
        found = docs.select("text").mapInArrow(sizes, "size long, n long").collect()
    finally:
        spark.conf.unset(NAME)
    assert sum(r.n for r in found) == 3_000 and max(r.size for r in found) < 1.2 * common.BATCH_BYTES
