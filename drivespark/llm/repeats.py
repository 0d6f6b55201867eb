"""What the two exact deduplications share: texts by key, pointers that repeat, and cutting what was found.

``suffixes`` (bytes) and ``substrings`` (words) each find the windows that repeat in their own way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, staged
from .pointers import SPAN_BITS, packed
from .vectors import byte_column, groups

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``k, doc_id, text`` (bytes; null: empty); rows that agree in id and text share k, and every text of theirs counts.

    ``key_col`` stands for the id where that is of a kind that can't be hashed.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    return docs.select(row_key(F.col(f"`{key_col or id_col}`"), text).alias("k"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))


def pointer_rows(texts: DataFrame, owned_of: Callable, names: list[str], only_first: bool) -> DataFrame:
    """The pointers of ``texts(k, text)``: their first name alone, or ``k, place`` and all ``names``.

    ``owned_of`` maps a list of texts to the arrays of ``pointers.owned``.
    """
    wanted = names[:1] if only_first else ["k", "place", *names]

    def run(batches):
        for batch in batches:
            held, keys = byte_column(batch.column("text")), batch.column("k").to_numpy()
            for a, b in groups(held):
                doc, pos, left, count, *found = owned_of(held[a:b])
                columns = [x.view(np.int64) for x in found]
                columns = columns[:1] if only_first else [keys[a:b][doc], packed(pos, left, count), *columns]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=wanted)

    return texts.select("k", "text").mapInArrow(run, ", ".join(f"{c} long" for c in wanted))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The values of ``key`` that several of ``rows`` have; summed before the shuffle."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n >= 2").select(*key)


def squeezed(texts: DataFrame) -> DataFrame:
    """The texts zstd-compressed, for a shuffle."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            blobs = [z.compress(t) for t in byte_column(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("doc_id"), pa.array(blobs, pa.binary())], names=["k", "doc_id", "blob"])

    return texts.select("k", "doc_id", "text").mapInArrow(run, f"k long, doc_id {id_type}, blob binary")


def opened(column) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in column.to_pylist()]


def classes_of(members: DataFrame) -> DataFrame:
    """Pointers of a ``bucket`` whose owned windows are the same are one class: its size ``n``, one member, and ``m``, the classes of its bucket."""
    c = members.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.min(F.struct("k", "place")).alias("one"))
    c = staged(c.select("bucket", "class", "n", "one.k", "one.place"))
    return c.join(c.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")


def contexts(texts: DataFrame, classes: DataFrame, made: Callable, fields: str) -> DataFrame:
    """What ``made`` gives for one member of each class of a bucket that has several, from that member's text.

    ``made(text, place, bucket, class, open, m)`` yields record batches of ``fields``; ``open`` classes have one member.
    """
    lists = classes.where("m >= 2").groupBy("k").agg(F.collect_list(F.struct("place", "bucket", "class", (F.col("n") == 1).alias("open"), "m")).alias("own"))
    joined = squeezed(texts).join(lists, "k").select("k", "blob", "own")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                own = part.column("own").flatten()
                yield from made(opened(part.column("blob"))[0], *(own.field(x).to_numpy(zero_copy_only=False) for x in ("place", "bucket", "class", "open", "m")))

    return staged(joined.mapInArrow(run, fields))


def batch_of(bucket, kind, is_open, place, context: pa.Array, last: pa.Array, name: str) -> pa.RecordBatch:
    """Rows for ``contexts``: one for a class, or for each of its windows or suffixes, whose last field is called ``name``."""
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (bucket, kind, is_open, place)), context, last], names=["bucket", "class", "open", "place", "context", name])


def by_bucket(rows: DataFrame, refine: Callable[[pa.Table], pa.RecordBatch], fields: str, most: int) -> DataFrame:
    """``refine`` of tables that hold whole buckets of ``rows(bucket, class, ...)``: one, or several of about ``most`` bytes."""

    def pieces(t: pa.Table):
        b = t.column("bucket").to_numpy()
        cuts = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(b)]
        held = np.cumsum([len(x) for x in t.column("context").to_pylist()])
        first = 0
        for at, end in zip(cuts[1:].tolist(), [*cuts[2:].tolist(), 0], strict=True):
            if not end or held[end - 1] - (held[first - 1] if first else 0) > most:
                yield t.slice(first, at - first)
                first = at

    def run(batches):
        carried = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
            b = t.column("bucket").to_numpy()
            cut = int(np.searchsorted(b, b[-1])) if len(b) else 0
            carried = t.slice(cut)
            if cut:
                yield from map(refine, pieces(t.slice(0, cut)))
        if carried is not None and carried.num_rows:
            yield refine(carried)

    return rows.repartition("bucket").sortWithinPartitions("bucket", "class").mapInArrow(run, fields)


def stretches(bucket, kind, offset) -> pa.RecordBatch:
    """``bucket, class, lo, hi``: runs of consecutive offsets, which must be sorted within each class."""
    first = np.flatnonzero(np.r_[True, (np.diff(kind) != 0) | (np.diff(bucket) != 0) | (np.diff(offset) != 1)][: len(kind)])
    last = np.r_[first[1:], len(kind)][: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(kind[first]), pa.array(offset[first]), pa.array(offset[last])], names=["bucket", "class", "lo", "hi"])


def spans(members: DataFrame, classes: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """``k, spans``: stretches of units to remove, [first, end), in no order and with overlaps.

    Classes of several members go whole; of the others, the windows ``found(bucket, class, lo, hi)``, by offset from the pointer.
    """
    mask = (1 << SPAN_BITS) - 1
    pos, left, count = F.shiftright("place", 2 * SPAN_BITS), F.shiftright("place", SPAN_BITS).bitwiseAND(mask), F.col("place").bitwiseAND(mask)
    none = F.lit(None).cast("long")
    answers = classes.where("n >= 2").select("bucket", "class", none.alias("lo"), none.alias("hi")).unionByName(found)
    first = F.when(F.col("lo").isNull(), pos - left).otherwise(pos + F.col("lo"))
    end = F.when(F.col("lo").isNull(), pos - left + count - 1).otherwise(pos + F.col("hi")) + window
    return members.join(answers, ["bucket", "class"]).select("k", F.struct(first.alias("a"), end.alias("b")).alias("s")).groupBy("k").agg(F.collect_set("s").alias("spans"))


def removed(texts: DataFrame, cut: DataFrame, words: bool, as_is: bool = False) -> DataFrame:
    """``doc_id, n_units, n_removed, n_spans, kept`` (bytes): what is left of each text.

    ``as_is``: a text that loses nothing comes back unchanged; the words of others are joined by a space.
    """
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = []
            for blob, own in zip(opened(batch.column("blob")), batch.column("spans").to_pylist(), strict=True):
                made.append(_cut(blob, own or [], words, as_is))
            n, gone, runs, kept = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept, pa.binary())], names=["doc_id", "n_units", "n_removed", "n_spans", "kept"])

    return squeezed(texts).join(cut, "k", "left").select("doc_id", "blob", "spans").mapInArrow(run, f"doc_id {id_type}, n_units long, n_removed long, n_spans long, kept binary")


def _cut(text: bytes, own: list[dict], words: bool, as_is: bool) -> tuple[int, int, int, bytes]:
    parts = text.split() if words else text
    merged: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in own):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(parts[at:a])
        at = b
    if not merged:
        return len(parts), 0, 0, b" ".join(parts) if words and not as_is else text
    kept.append(parts[at:])
    gone = sum(b - a for a, b in merged)
    return len(parts), gone, len(merged), b" ".join(w for p in kept for w in p) if words else b"".join(kept)
