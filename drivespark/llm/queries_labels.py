"""Queries of the two classifiers (learnt, so tested by held-out accuracy)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common
from .quality import fit_quality, score_quality
from .toxicity import fit_toxicity, score_toxicity
from .vectors import held_out


def op3_quality(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, common.read(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op10_toxicity(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, common.read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "sentences")
