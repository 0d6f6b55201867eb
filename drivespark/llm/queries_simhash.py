"""The query of SimHash near-deduplication (XXH64 isn't in SQL: tested against brute force)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common
from .simhash import simhash_groups


def op7_simhash(spark, sf_dir):
    groups = simhash_groups(common.read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
