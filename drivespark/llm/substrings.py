"""Substring deduplication of words by level-wise doubling.

1. The first level looks at windows of 5 words. Not all of them: every final window owns one pointer among its first
   words (see ``pointers``), and the levels' windows start at pointers. Those that occur once are dropped.
2. Each further level extends the survivors alone to twice the length, 10 and 20 words, and drops those that occur once
   at that length. It ends when none survive, or when twice the length would be more than the final 35 words.
3. The last survivors are extended to the final windows that own them. Runs of such windows are compared as wholes first
   (a class of several repeats), and window by window only where copies of a pointer part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, staged
from .pointers import combined, names, owned, unpacked
from .repeats import _SPACE, batch_of, by_bucket, classes_of, contexts, keyed, pointer_rows, removed, repeated, spans, stretches
from .vectors import word_hashes

LENGTH, FIRST = 35, 5
#: Buckets of up to this many classes are compared inside a task, on about ``PIECE`` bytes at once; larger ones by a shuffle.
IN_TASK, PIECE = 30_000, 4 << 20


def levels(length: int, first: int = FIRST) -> tuple[int, ...]:
    """Lengths of the levels below the final one: each twice the one before."""
    out = [min(first, length)]
    while out[-1] * 2 < length:
        out.append(out[-1] * 2)
    return tuple(out)


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of ``texts``, end to end, and the number that each text has."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[False, ~_SPACE[buf], False].view(np.int8)))
    ends = np.cumsum([len(t) + 1 for t in texts])
    sizes = np.bincount(np.searchsorted(ends, edges[0::2], side="right"), minlength=len(texts))
    return word_hashes(buf, edges[0::2], edges[1::2]), sizes


def survivors(texts: DataFrame, length: int, lengths: tuple[int, ...]) -> DataFrame:
    """``k, place, bucket, class``: the pointers whose windows repeat at every level; ``bucket`` names the longest."""
    cut = lambda held: owned(*word_names(held), length, lengths, length - lengths[-1] + 1)
    at = [f"w{n}" for n in lengths]
    often = staged(repeated(pointer_rows(texts, cut, [*at, "class"], True), at[0]))
    left = staged(pointer_rows(texts, cut, [*at, "class"], False).join(often, at[0]))
    for shorter, longer in zip(at, at[1:], strict=False):
        if left.isEmpty():
            break
        # Written first, so that a window that a third of all pointers share is a skewed join, which Spark splits.
        left = staged(left.join(small(staged(repeated(left, shorter, longer))), [shorter, longer]))
    return left.select("k", "place", F.col(at[-1]).alias("bucket"), "class")


def _window_key(window: np.ndarray, bucket: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return combined(combined(window, bucket.view(np.uint64)), offset.astype(np.int64).view(np.uint64))


def _windows_of(length: int, in_task: int):
    """The names of a class's final windows; in buckets of many classes a row for each, with bucket and offset in its key."""

    def made(text, place, bucket, kind, is_open, m):
        pos, left, count = unpacked(place)
        window = names(word_names([text])[0], length)[0]
        few, many = np.flatnonzero(m <= in_task), np.flatnonzero(m > in_task)
        if len(few):
            held = [window[a:b].tobytes() for a, b in zip((pos - left)[few].tolist(), (pos - left + count)[few].tolist(), strict=True)]
            yield batch_of(bucket[few], kind[few], is_open[few], place[few], pa.array(held, pa.binary()), pa.nulls(len(few), pa.int64()), "window")
        if len(many):
            n = count[many]
            row = np.repeat(many, n)
            where = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) - left[row]
            key = _window_key(window[pos[row] + where], bucket[row], where).view(np.int64)
            yield batch_of(bucket[row], kind[row], is_open[row], where, pa.nulls(len(row), pa.binary()), pa.array(key), "window")

    return made


def _shared(t: pa.Table) -> pa.RecordBatch:
    """Windows of open classes that another class of the bucket has at the same offset."""
    bucket, kind, is_open = (t.column(x).to_numpy() for x in ("bucket", "class", "open"))
    _, left, count = unpacked(t.column("place").to_numpy())
    window = np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint64)
    row = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) - left[row]
    _, at, often = np.unique(_window_key(window, bucket[row], offset), return_inverse=True, return_counts=True)
    hit = np.flatnonzero((often[at] >= 2) & is_open[row])
    return stretches(bucket[row[hit]], kind[row[hit]], offset[hit])


def cut_repeated_words(docs: DataFrame, length: int = LENGTH, as_is: bool = False, id_col: str = "doc_id", text_col: str = "text", in_task: int = IN_TASK, key_col: str | None = None) -> DataFrame:
    """``doc_id, n_units, n_removed, n_spans, kept``, one row for each input row.

    Every word that a window of ``length`` consecutive words covers goes if the same words also start elsewhere, in this
    document or another; windows are judged on the input. ``kept`` (bytes) holds the words that stay, joined by a space; with
    ``as_is``, a text that loses nothing is left as it was.
    Words are what ASCII white space separates, unchanged. Null, empty and blank texts have no words; a text of fewer
    words than a window stays; rows that repeat are copies of each other; other columns are ignored. Windows are told apart
    by 64-bit hashes, at each level and within the window of the level before.
    """
    texts = keyed(docs, id_col, text_col, key_col)
    members = survivors(texts, length, levels(length))
    classes = staged(classes_of(members))
    rows = contexts(texts, classes, _windows_of(length, in_task), "bucket long, class long, open boolean, place long, context binary, window long")
    found = by_bucket(rows.where("context IS NOT NULL").drop("window"), _shared, "bucket long, class long, lo long, hi long", PIECE)
    hot = rows.where("context IS NULL").select("bucket", "class", "open", F.col("place").alias("offset"), "window")
    outside = hot.where("open").join(repeated(hot, "window"), "window").select("bucket", "class", F.col("offset").alias("lo"), F.col("offset").alias("hi"))
    return removed(texts, spans(members, classes, staged(found.unionByName(outside)), length), words=True, as_is=as_is)
