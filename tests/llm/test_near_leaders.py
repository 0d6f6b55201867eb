"""What near-dedup broadcasts is measured, and no more than the comparison needs."""

import numpy as np
from pyspark.sql import functions as F

from drivespark.llm.common import small
from drivespark.llm.near_copies import leading


def test_only_groups_with_others_send_their_leaders(spark):
    blob = np.arange(4, dtype=np.uint64).tobytes()
    led = spark.createDataFrame([(1, 10, True, blob), (1, 11, False, blob), (2, 20, True, blob)], "g long, node long, stays boolean, shingles binary")
    others = spark.createDataFrame([(2, 21, 1, blob)], "g long, node long, turn long, shingles binary")
    assert [(r.g, len(r.held)) for r in leading(led, others).collect()] == [(2, 1)]


def test_what_lies_in_arrays_is_measured_before_a_broadcast(spark):
    lists = spark.range(40).select("id", F.array(F.lit(b"x" * 100_000), F.lit(b"y")).alias("held"), F.struct(F.lit("z").alias("s")).alias("t"))
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" in plan(small(lists)) and "Hint broadcast" not in plan(small(lists, size=3_900_000))
