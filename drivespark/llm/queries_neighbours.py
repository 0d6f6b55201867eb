"""The query of approximate nearest neighbours (recall is tested against brute force)."""

from __future__ import annotations

from . import common
from .neighbours import nearest


def op9_neighbours(spark, sf_dir):
    return nearest(common.read(spark, sf_dir, "embeddings"))
