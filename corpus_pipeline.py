"""The corpus pipeline: toxicity, SimHash near-dedup, substring dedup, decontamination, mixing.

Each stage takes what its predecessor kept and returns the columns of ``documents`` (the last one the mix); ``run`` writes
each result as Parquet to the shared folder and reads it again. Stages that pass texts to Python bound the session's Arrow
batches by bytes, as their executors serve all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivespark.llm import common
from drivespark.llm.decontaminate import find_contamination
from drivespark.llm.mixing import mix_sources
from drivespark.llm.near_copies import first_of_groups
from drivespark.llm.substrings import cut_repeated_words
from drivespark.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of all labels finds toxic go; null and empty texts stay, rows that repeat share their fate."""
    common.bound_batches(spark)
    model = fit_toxicity(docs, common.read(spark, sf_dir, "labels"), parts=5, rest=-1)
    plain = [f"c{i}" for i in range(len(docs.columns))]  # no name can clash with those of the scores
    scored = score_toxicity(docs.toDF(*plain), model, text_col=plain[docs.columns.index("text")])
    return scored.where("predicted = 0").select(*plain).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id stays; all null, empty and blank texts are copies of one another."""
    common.bound_batches(spark)
    return first_of_groups(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that start more than once go, and so do documents that have none left; clean texts stay as they
    were. Null texts stay null; rows that repeat are copies of each other, so all their passages go."""
    common.bound_batches(spark)
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "text"), F.col("text").isNull().alias("__null")).alias("row"), F.col("doc_id").alias("key"), "text")
    cut = cut_repeated_words(rows, as_is=True, id_col="row", key_col="key").where("n_units = 0 OR n_removed < n_units")
    text = F.when(~F.col("doc_id.__null"), F.col("kept").cast("string"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*(new.get(c, F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is as good as a benchmark item go; null and empty texts match nothing and stay."""
    k = common.spare(docs, "__key")
    keyed = docs.withColumn(k, common.row_key("doc_id", "text"))
    found = find_contamination(keyed, common.read(spark, sf_dir, "benchmark"), id_col=k)
    gone = common.small(common.staged(found.select(F.col("doc_id").alias(k)).distinct()))
    return keyed.join(gone, k, "left_anti").drop(k)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a row for each, null and empty texts with size 0."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
#: Learnt and hashed stages: tests/llm/test_pipeline.py holds the run against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir))
    return docs
