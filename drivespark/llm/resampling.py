"""Resampling documents by importance towards a target distribution of hashed n-grams.

Features are runs of 1 to ``N_GRAM`` words, hashed by CRC-32 into buckets. A worker computes the CRC of each distinct word
once; the CRC of a longer run is composed from those of its words by the combination algebra of ``crc``, so no n-gram's
bytes are ever made. Bucket counts of the corpus and of the target give each bucket a gain, a document weighs the mean gain
of its features, and a Gumbel draw without replacement takes the highest sums of weight and noise.

Two passes read the texts: one counts buckets (one row for each bucket and task), one weighs documents. Ranks come from a
histogram of the scores (whole numbers, so it is small) and an order within each score; nothing is sorted as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import crc
from .common import small, staged
from .vectors import byte_column, groups

N_GRAM, BUCKETS = 2, 10_000
#: Scores for one task of the histogram's running sums.
SPAN = 256
#: Bytes of a word: digits, letters, and all that is no ASCII; upper case is made lower, all else separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class WordCrcs:
    """CRC of each distinct word alone and after a space, and its bytes; forgotten beyond ``most`` words."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.alone, self.after, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            if len(self.number) + len(new) > self.most:
                self.forget()
                missing, new = np.arange(len(words)), list(dict.fromkeys(words))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            alone, size = np.fromiter(map(zlib.crc32, new), np.uint32, len(new)), np.fromiter(map(len, new), np.int64, len(new))
            after = crc.joined(np.full(len(new), crc.SPACE, np.uint32), alone, size)
            self.alone, self.after, self.size = np.append(self.alone, alone), np.append(self.after, after), np.append(self.size, size + 1)
            found[missing] = [self.number[words[i]] for i in missing.tolist()]
        return found


def features(texts: list[bytes], words: WordCrcs, n_gram: int = N_GRAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run: the CRC of every run of so many words of a text, and the text's number."""
    split = [t.translate(_WORDS).split() for t in texts]
    at = words.numbers([w for ws in split for w in ws])
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
    alone, after, size = words.alone[at], words.after[at], words.size[at]
    held = alone
    for n in range(n_gram):
        if n:  # runs of one more word: the CRC so far, and that of a space and the next word
            held = crc.joined(held[: max(0, len(alone) - n)], after[n:], size[n:])
        whole = doc[: len(held)] == doc[n:]
        yield held[whole], doc[n:][whole]


def bucket_counts(docs: DataFrame, text_col: str = "text", n_gram: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts each bucket holds (buckets without any have no row). Null texts have none."""

    def run(batches):
        words, held = WordCrcs(), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = byte_column(batch.column(0))
            for a, b in groups(texts):
                for crcs, _ in features(texts[a:b], words, n_gram):
                    held += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["bucket", "n"])

    text = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    return text.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain``, a row for each bucket: floor(1000 ln) of the ratio of its smoothed shares of target and source."""
    both = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for frame, name in ((source, "s"), (target, "t")):
        both = both.join(frame.select("bucket", F.col("n").alias(name)), "bucket", "left")
    total = lambda frame: frame.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    more = lambda frame: F.lit(float(total(frame)) + buckets)
    ratio = ((t + 1.0) * more(source)) / ((s + 1.0) * more(target))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, text_col: str = "text", n_gram: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` without its text, with ``n_words, n_features, weight``: the floored mean of the gains of its features.

    Texts without a feature weigh 0. Columns with the names of the new ones are replaced. The gains, one for each bucket,
    are sent to the tasks.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    by_bucket = np.zeros(buckets, np.int64)
    for r in gains.collect():  # as many rows as there are buckets
        by_bucket[r.bucket] = r.gain
    new = ["n_words", "n_features", "weight"]
    kept = [c for c in docs.columns if c != text_col and c.lower() not in new]
    schema = StructType([*(docs.schema[c] for c in kept), *(StructField(c, LongType(), False) for c in new)])

    def run(batches):
        words = WordCrcs()
        for batch in batches:
            texts = byte_column(batch.column(len(kept)))
            for a, b in groups(texts):
                per_run, total = [], np.zeros(b - a, np.int64)
                for crcs, doc in features(texts[a:b], words, n_gram):
                    per_run.append(np.bincount(doc, minlength=b - a))
                    gain = np.concatenate(([0], np.cumsum(by_bucket[crcs % np.uint32(buckets)])))  # texts lie end to end
                    ends = np.cumsum(per_run[-1])
                    total += gain[ends] - gain[ends - per_run[-1]]
                n = sum(per_run)
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), pa.array(per_run[0]), pa.array(n), pa.array(mean)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, schema)


def gumbel(id_col, seed: int):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(``<seed>:<id>``); a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, n_gram: int = N_GRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank``, one row for each row of ``docs``.

    Of the N rows with at least ``least_words`` words, floor(percent N / 100) are drawn: those of the highest scores, ties
    to the smaller id, then to the smaller text hash (a null id is the largest); ``rank`` is null where a row isn't drawn.
    Null and empty texts have no features and weigh 0; repeated rows have the same score and ranks that follow each other;
    an empty table gives no rows, an empty target only smooths; columns other than id and text are ignored, whatever their
    names.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("same"), F.col(f"`{text_col}`").cast("string").alias("text"))
    t = target.select(F.col(f"`{target_col}`").alias("text"))
    gains = bucket_gains(staged(bucket_counts(d, n_gram=n_gram, buckets=buckets)), staged(bucket_counts(t, n_gram=n_gram, buckets=buckets)), buckets)
    scored = staged(weigh(d, gains, n_gram=n_gram, buckets=buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    can = F.col("n_words") >= least_words
    hist = staged(scored.where(can).groupBy("score").agg(F.count("*").alias("n")))
    drawn = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent // 100
    before = small(staged(ranks_before(hist).where(F.col("before") < drawn)))
    ranked = scored.where(can).join(before, "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "same")
    rank = F.col("before") + F.row_number().over(order)
    taken = ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.join(before.select("score"), (scored["score"] == before["score"]) & can, "left_anti")
    return taken.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def ranks_before(hist: DataFrame) -> DataFrame:
    """``score, before``: how many rows of ``score, n`` have a higher score, by running sums within spans of scores and over spans."""
    part = hist.withColumn("span", F.floor(F.col("score") / SPAN))
    spans = part.groupBy("span").agg(F.sum("n").alias("held"))
    # A span for every 256 scores: a few hundred rows in all, as a score is a logarithm.
    above = spans.select("span", (F.sum("held").over(Window.orderBy(F.desc("span"))) - F.col("held")).alias("above"))
    within = F.sum("n").over(Window.partitionBy("span").orderBy(F.desc("score"))) - F.col("n")
    return part.join(above, "span").select("score", (F.col("above") + within).alias("before"))
