"""Suffix-array deduplication of bytes by bucket-pointer refinement.

1. Pointers (see ``pointers``) stand for the suffixes: each 200-byte string owns one, at a place that its content alone
   fixes. Initial buckets are the pointers' 32-byte grams; a bucket of one is done, nothing of it repeats.
2. Pointers of a bucket whose owned strings are all the same are one class, which repeats as a whole. Of each class of a
   bucket that has several, one member's bytes go on.
3. Bucket-pointer refinement finds which strings two classes share. All suffixes of the classes' bytes are sorted into
   initial buckets by eight bytes (and their place in relation to the pointer). Each round sorts the suffixes of every
   bucket of several by the *bucket identifier* of the suffix that lies the covered length further on, gives the parts new
   identifiers, and these serve all later rounds, so the covered length doubles: 8, 16, 32, 64, 128, 200. A bucket of one
   is closed and never sorted again. A bucket is refined in a task; one of many classes is parted before, by more of the
   bytes around the pointer (see ``parted``), so each of its classes costs a few rows and not one for each suffix.
4. Repeated strings become spans of bytes, and the spans are cut.
"""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, staged
from .pointers import SPAN_BITS, owned, unpacked
from .repeats import batch_of, by_bucket, classes_of, contexts, keyed, pointer_rows, removed, repeated, spans, stretches
from .vectors import BYTE_VALUE

LENGTH, GRAM = 200, 32
#: Bytes of the initial buckets of the refinement.
FIRST = 8
#: Buckets of up to this many classes are refined inside a task, on about ``PIECE`` bytes at once; larger ones are parted.
IN_TASK, PIECE = 3_000, 1 << 20


def rounds(length: int) -> list[tuple[int, int]]:
    """(covered, step) of each round: suffixes equal in ``covered`` bytes are sorted by the bucket ``step`` bytes on."""
    out, covered = [], min(FIRST, length)
    while covered < length:
        out.append((covered, min(covered, length - covered)))
        covered += out[-1][1]
    return out


def first_bytes(buf: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` (eight at most) bytes of each suffix as one number."""
    x = np.zeros(max(0, len(buf) - n + 1), np.uint64)
    for k in range(n):
        x = x << np.uint64(8) | buf[k : k + len(x)]
    return x


def _buckets(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each suffix by (major, minor): the place where it starts in sorted order; and the buckets' sizes there."""
    order = np.lexsort((minor, major))
    a, b = major[order], minor[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    size = np.diff(np.r_[start, len(a)])
    bucket, held = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
    bucket[order], held[order] = np.repeat(start, size), np.repeat(size, size)
    return bucket, held


def refine(buf: np.ndarray, sizes: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Positions of ``buf`` at which a string of ``length`` bytes starts that another context has at the same place.

    ``buf`` holds contexts of ``sizes`` bytes end to end; ``place`` numbers (bucket, offset from the pointer) of each byte.
    """
    until = np.repeat(np.cumsum(sizes), sizes)
    covered = min(FIRST, length)
    value = first_bytes(buf, covered)
    live = np.flatnonzero(np.arange(len(value)) + covered <= until[: len(value)])
    # A closed suffix has a bucket of its own, below zero.
    pointer = -1 - np.arange(len(buf))
    found, held = _buckets(place[live], value[live])
    live, found = live[held > 1], found[held > 1]
    pointer[live] = found
    for covered, step in rounds(length):
        closed = live
        live = live[live + covered + step <= until[live]]
        found, held = _buckets(pointer[live], pointer[live + step])
        pointer[closed] = -1 - closed
        live, found = live[held > 1], found[held > 1]
        pointer[live] = found
    return live


def _refined(t: pa.Table, length: int) -> pa.RecordBatch:
    bucket, origin, kind, is_open = (t.column(x).to_numpy() for x in ("bucket", "origin", "class", "open"))
    _, left, _ = unpacked(t.column("place").to_numpy())
    held = t.column("context").to_pylist()
    sizes = np.array([len(x) for x in held])
    row = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - left[row]
    number = np.cumsum(np.r_[0, bucket[1:] != bucket[:-1]])
    at = refine(np.frombuffer(b"".join(held), np.uint8), sizes, number[row] << 12 | (offset + 2048), length)
    at = np.sort(at[is_open[row[at]]])
    return stretches(origin[row[at]], kind[row[at]], offset[at])


def _bytes_of(length: int):
    """The bytes that a class's owned strings cover."""

    def made(text, place, bucket, kind, is_open, m):
        pos, left, count = unpacked(place)
        held = [text[a:b] for a, b in zip((pos - left).tolist(), (pos - left + count - 1 + length).tolist(), strict=True)]
        yield batch_of(bucket, kind, is_open, place, pa.array(held, pa.binary()), pa.array(m), "m")

    return made


FIELDS = ["bucket", "origin", "class", "open", "place", "context", "first", "last"]
_KINDS = "bucket long, origin long, class long, open boolean, place long, context binary, first int, last int"


def halved(rows: DataFrame, length: int) -> DataFrame:
    """For each of ``rows`` (``FIELDS``) one for each half of its windows, ``first`` to ``last`` bytes before the pointer.

    All windows of a half share the bytes from ``first`` before the pointer on to ``length - last`` behind it, so those
    that are the same in two contexts are so within one new bucket, which these bytes name.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in FIELDS]
            _, lefts, counts = unpacked(batch.column("place").to_numpy())
            for bucket, origin, kind, is_open, _, context, first, last, left, count in zip(*(batch.column(f).to_pylist() for f in FIELDS), lefts.tolist(), counts.tolist(), strict=True):
                middle = (first + last) // 2
                for a, b in ((first, middle), (middle + 1, last)):
                    lo, hi = max(a, left - count + 1), min(b, left)
                    if lo > hi:
                        continue
                    name = xxhash.xxh64(struct.pack("<qii", bucket, a, b) + context[left - a : left + length - b]).digest()
                    row = (struct.unpack("<q", name)[0], origin, kind, is_open, hi << SPAN_BITS | (hi - lo + 1), context[left - hi : left - lo + length], a, b)
                    for held, x in zip(out, row, strict=True):
                        held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, batch.schema, strict=True)], names=FIELDS)

    return rows.select(*FIELDS).mapInArrow(run, _KINDS)


def parted(rows: DataFrame, length: int, in_task: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For buckets of many classes: rows of buckets that a task can refine, and stretches that were found on the way.

    A bucket's windows are halved by how far they start before the pointer, and each half dealt to new buckets by the
    bytes that all its windows share; what is alone there repeats nowhere. Contexts that are the same now repeat as a
    whole, and one of them goes on. New buckets of many distinct contexts are halved again, until a half is one window.
    """
    few, found = [], []
    while not rows.isEmpty():
        half = staged(halved(rows, length).withColumn("c", F.xxhash64("place", "context")))
        same = staged(half.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.min("class").alias("one")))
        held = same.join(same.groupBy("bucket").agg(F.count("*").alias("m")), "bucket").where("n > 1 OR m > 1")
        half = staged(half.join(small(staged(held)), ["bucket", "c"]))
        left, count = F.shiftright("place", SPAN_BITS), F.col("place").bitwiseAND((1 << SPAN_BITS) - 1)
        found.append(half.where("n > 1 AND open").select(F.col("origin").alias("bucket"), "class", (-left).alias("lo"), (count - 1 - left).alias("hi")))
        on = half.where("m > 1 AND class = one").withColumn("open", F.expr("open AND n = 1"))
        few.append(on.where((F.col("m") <= in_task) | F.expr("first = last")).select(*FIELDS))
        rows = on.where((F.col("m") > in_task) & F.expr("first < last"))
    return few, found


def cut_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", in_task: int = IN_TASK) -> DataFrame:
    """``doc_id, n_units, n_removed, n_spans, kept``, one row for each input row.

    Every byte that a string of ``length`` bytes covers goes if that string also starts elsewhere, in this document or
    another; overlaps count, and strings are judged on the input. ``n_spans`` counts the maximal removed runs, ``kept`` is
    the rest (bytes; a cut may fall inside a character). Null and empty texts have 0 bytes; a text that is shorter than
    ``length`` stays whole; rows that repeat are copies of each other, so what is long enough in them goes; other columns
    are ignored. Grams and classes are told apart by 64-bit hashes each, a class only within its gram's bucket.
    """
    texts = keyed(docs, id_col, text_col)
    cut = lambda held: owned(BYTE_VALUE[np.frombuffer(b"".join(held), np.uint8)], np.array([len(t) for t in held], np.int64), length, (gram,), length - gram + 1)
    often = staged(repeated(pointer_rows(texts, cut, ["bucket", "class"], True), "bucket"))
    members = staged(pointer_rows(texts, cut, ["bucket", "class"], False).join(often, "bucket").select("k", "place", "bucket", "class"))
    classes = staged(classes_of(members))
    rows = contexts(texts, classes, _bytes_of(length), "bucket long, class long, open boolean, place long, context binary, m long")
    rows = rows.select("bucket", F.col("bucket").alias("origin"), "class", "open", "place", "context", F.lit(0).alias("first"), F.lit(length - gram).alias("last"), "m")
    many = rows.where(F.col("m") > in_task).dropDuplicates(["bucket", "class"])  # rows that repeat id and text
    few, found = parted(many, length, in_task)
    rows = reduce(DataFrame.unionByName, few, rows.where(F.col("m") <= in_task).select(*FIELDS)).drop("first", "last")
    refined = by_bucket(rows, lambda t: _refined(t, length), "bucket long, class long, lo long, hi long", PIECE)
    found = reduce(DataFrame.unionByName, found, refined)
    return removed(texts, spans(members, classes, staged(found), length), words=False)
