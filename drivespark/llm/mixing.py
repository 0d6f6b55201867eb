"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sizes are summed by (source, hash bucket); a running sum over at most 4,096 buckets of a source finds the bucket in
which the budget ends, and only the rows of that bucket are summed again over finer buckets, three levels deep. No row
is sorted, no source is gathered: a source that holds a third of all rows leaves one partial sum per bucket and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_text, small, staged

#: Hex digits of a level's bucket, and levels: three times 12 bits.
DIGITS, LEVELS = 3, 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from a table of ``source, source_size``, one row for each source.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn. The targets share the total of all sizes
    in proportion, but none exceeds ``most`` times its source's size: what is cut is shared anew by weight. The level at
    which that ends is found in one pass: sources are taken by the ratio of cap and weight; before the first source that
    stays under its cap all are capped, from it on none is. The windows run over one row for each source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = reduce(lambda e, i: e.when(turn == i, F.lit(float(weights[i]))), range(1, len(weights)), F.when(turn == 0, F.lit(float(weights[0]))))
    d = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    d = d.withColumn("level", (total - before) / rest).withColumn("at", F.row_number().over(order))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))).over(Window.partitionBy())
    d = d.withColumn("first", first)
    return d.select("source", "source_size", F.when(F.col("first.level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first.level") * F.col("w"))).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, h``: the number of words, and nine hex digits of a hash of id and source."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    h = F.substring(F.md5(F.concat(F.lit("mix:"), as_text(F.col(id_col))).cast("binary")), 1, DIGITS * LEVELS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), h.alias("h"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies, taken``.

    A source whose target is r times its size and a rest gives each of its documents r times, and those whose hash lies
    under the source's threshold once more, so that the taken words come near the target; raising a weight only adds
    documents. One row for each input row: null and empty texts have size 0, a null source is a source of its own, rows
    that repeat an id share its hash and so its fate, other columns are ignored. An empty table gives no rows.
    """
    d = staged(sized(docs, id_col, text_col, source_col))
    t = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(""))
    t = t.withColumn("half", F.lit(False))
    for level in range(LEVELS):
        t = _refined(d, staged(t), level)
    t = small(staged(t).select(F.col("source").alias("s"), "source_size", "target", "whole", "prefix", "half"))
    extra = (F.col("h") < F.col("prefix")) | (F.col("half") & (F.col("h") == F.col("prefix")))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    out = d.join(t, d.source.eqNullSafe(t.s), "left").withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _refined(d: DataFrame, t: DataFrame, level: int) -> DataFrame:
    """The thresholds one level deeper: the boundary's rows alone are summed by their next digits."""
    at, keep = level * DIGITS, ["source", "source_size", "target", "whole"]
    edge = small(t.select(F.col("source").alias("s"), "prefix")) if level else None
    rows = d if edge is None else d.join(edge, d.source.eqNullSafe(edge.s) & d.h.startswith(edge.prefix), "left_semi")
    sums = rows.groupBy("source", F.substring("h", at + 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("source").alias("s"), "bucket", "words", F.sum("words").over(run).alias("upto"))
    over = sums.join(small(t), sums.s.eqNullSafe(t.source)).where(F.col("upto") > F.col("rest"))
    first = over.groupBy("s").agg(F.min(F.struct("bucket", "words", "upto")).alias("b"))
    b, last = F.col("b"), level == LEVELS - 1
    left = F.col("rest") - (b.upto - b.words)
    return t.join(first, t.source.eqNullSafe(first.s), "left").select(
        *keep,
        F.when(b.isNull(), F.col("rest")).otherwise(left).alias("rest"),
        F.concat("prefix", F.coalesce(b.bucket, F.lit("0" * DIGITS))).alias("prefix"),
        (b.isNotNull() & (left * 2 > b.words) if last else F.lit(False)).alias("half"),
    )
