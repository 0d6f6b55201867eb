"""The query of language-model scoring (learnt, so tested on held-out texts; the base score also has a plain check)."""

from __future__ import annotations

from . import common
from .lm import score_texts


def op2_lm(spark, sf_dir):
    return score_texts(common.read(spark, sf_dir, "documents"))
