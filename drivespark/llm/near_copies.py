"""Near-duplicates by SimHash: vantage-point trees give groups, word shingles verify them, one document of each stays.

1. Equal texts are one node. Every node has ``SERIES`` fingerprints of its distinct words, each by hashes of its own: a few
   changed words move few bits, and of several draws the nearest counts.
2. The trees (see ``simhash``) link fingerprints within ``RADIUS`` bits, in every series; nodes that are linked, directly
   or through others, are a group. A tree can only prune at a small radius, so several narrow searches replace a wide one.
3. Groups are gone through in rounds. The next few nodes by id are compared with one another and the first of those that
   are alike stay; all other nodes of the group are compared with these and go if they are alike to one. So whatever goes
   is alike to a text that stays, and no two texts of a group that stay are alike.

A large group is never in one task: a round picks its few leaders by a limit that each task applies first, and the other
nodes meet the leaders by a broadcast, or by a join whose skewed partitions are split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, small, spare, staged
from .components import components
from .simhash import tree_links
from .vectors import byte_column, groups, mixed, runs, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
SERIES, RADIUS = 8, 2
#: Nodes of a group that lead in the first round; later rounds take ``GROWTH`` times as many, up to ``MOST``.
LEADERS, GROWTH, MOST = 8, 2, 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in A-Z, and the text of each."""
    buf = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    starts, ends = runs(~_SPACE[buf])
    return word_hashes(buf, starts, ends), np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")


def word_prints(texts: list[bytes], series: int = SERIES) -> np.ndarray:
    """(texts, series) fingerprints: a bit is set if it is in over half of the hashes of a text's distinct words. No words: 0."""
    h, doc = words_of(texts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    h, doc = h[new], doc[new]
    out = np.zeros((len(texts), series), np.uint64)
    if not len(h):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.diff(np.r_[first, len(h)])
    for s in range(series):
        x = mixed(h * (_ODD + np.uint64(2 * s)))
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[doc[first], s] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words; of all words, if they are fewer; none of none."""
    h, _ = words_of([text])
    if not len(h):
        return h
    width = min(shingle, len(h))
    x = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        x = mixed(x * _ODD + h[k : k + len(x)])
    return np.unique(x + np.uint64(width))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct shingles; two texts without any are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < 0.5 * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _opened(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", np.uint64)


def leaders_first(table: pa.Table, similarity: float) -> pa.Table:
    """Of one group's few nodes, in order, ``stays``: not alike to an earlier one that stays."""
    table = table.sort_by("turn")
    held, stays = [], []
    for blob in table.column("shingles").to_pylist():
        own = _opened(blob)
        stays.append(all(alike(own, x) < similarity for x in held))
        if stays[-1]:
            held.append(own)
    return pa.table({"g": table.column("g"), "node": table.column("node"), "stays": pa.array(stays, pa.bool_()), "shingles": table.column("shingles")})


def leading(led: DataFrame, others: DataFrame) -> DataFrame:
    """``g, held``: the shingles of the leaders that stay, for those groups alone that have ``others`` to compare with them."""
    wanted = small(staged(others.select("g").distinct()))
    return led.where("stays").join(wanted, "g", "left_semi").groupBy("g").agg(F.collect_list("shingles").alias("held"))


def unlike_those_that_stay(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node``: those of ``members(g, node, turn, shingles)`` that go, as the third step has it; ``turn`` orders a group."""
    gone, most = members.select("node").where("false"), LEADERS
    left = members
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("g").orderBy("turn", "node"))
        few = left.withColumn("place", place).where(F.col("place") <= most).drop("place")
        led = staged(few.groupBy("g").applyInArrow(lambda t: leaders_first(t, similarity), "g long, node long, stays boolean, shingles binary"))
        gone = gone.unionByName(led.where("NOT stays").select("node"))
        others = staged(left.join(small(led.select("node")), "node", "left_anti"))
        if others.isEmpty():
            return gone
        lists = small(staged(leading(led, others)))
        rest = others.join(lists, "g")

        def compare(batches):
            for b in batches:
                own, held = b.column("shingles").to_pylist(), b.column("held")
                hit, known = [], (None, [])
                for i, g in enumerate(b.column("g").to_pylist()):
                    if known[0] != g:
                        known = (g, [_opened(x) for x in held[i].as_py()])
                    x = _opened(own[i])
                    hit.append(any(alike(x, y) >= similarity for y in known[1]))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("g", "node", "turn", "shingles")] + [pa.array(hit, pa.bool_())], names=["g", "node", "turn", "shingles", "hit"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.select("g", "node", "turn", "shingles").schema)
        after = staged(rest.select("g", "node", "turn", "shingles", "held").mapInArrow(compare, f"{kinds}, hit boolean"))
        gone = gone.unionByName(after.where("hit").select("node"))
        left, most = after.where("NOT hit").drop("hit"), min(MOST, most * GROWTH)
    return gone


def text_prints(rows: DataFrame, series: int = SERIES) -> DataFrame:
    """``i, k, t, prints`` of ``rows(i, k, t, text)``."""
    kind = rows.schema["i"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = byte_column(b.column(3))
            for first, end in groups(texts):
                prints = word_prints(texts[first:end], series).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(prints.reshape(-1)), series).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, end - first) for c in range(3)), lists], names=["i", "k", "t", "prints"])

    return rows.mapInArrow(run, f"i {kind}, k long, t long, prints array<long>")


def linked_groups(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``node, label`` for those of ``nodes(t, prints)`` that a fingerprint links to another one."""
    each = nodes.select("t", F.posexplode("prints").alias("s", "fp"))
    prints = staged(each.groupBy("s", "fp").agg(F.min("t").alias("node"), F.count("*").alias("n")))
    several = small(staged(prints.where("n > 1").select("s", "fp", "node")))
    same = each.join(several, ["s", "fp"]).where("t <> node").select(F.col("t").alias("a"), F.col("node").alias("b"))
    return components(staged(same.unionByName(tree_links(prints, radius)).distinct()))


def first_of_groups(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, series: int = SERIES, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of texts of a group that are alike, the one with the smallest id stays.

    Alike: the distinct runs of ``shingle`` words (A-Z lower-cased; fewer words: one run of all) that two texts share are
    at least ``similarity`` of all that they have. Groups are nodes within ``radius`` bits in any of ``series``
    fingerprints, and whatever these chain to. Null, empty and blank texts are equal, and one of them stays (a null id
    comes first). Rows that repeat id and text are copies, so one of them stays. All columns are kept, whatever their
    names; an empty table gives no rows. Texts are told apart by a 64-bit hash.
    """
    text, key = F.col(f"`{text_col}`"), spare(docs, "__key")
    k = row_key(F.col(f"`{id_col}`"), text)
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), k.alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), F.coalesce(text.cast("binary"), F.lit("").cast("binary")).alias("text"))
    seen = staged(text_prints(rows, series))
    first = F.min(F.struct("i", "k")).alias("first")
    nodes = staged(seen.groupBy("t").agg(first, F.any_value("prints").alias("prints"), F.count("*").alias("n")))
    grouped = staged(linked_groups(nodes.select("t", "prints"), radius))
    heads = small(staged(grouped.join(nodes.select(F.col("t").alias("node"), "first"), "node").select(F.col("first.k").alias("k"), "node", F.col("label").alias("g"), F.col("first").alias("turn"))))

    def run(batches):
        for b in batches:
            held = [shingle_hashes(x, shingle).tobytes() for x in byte_column(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("node"), b.column("turn"), pa.array(held, pa.binary())], names=["g", "node", "turn", "shingles"])

    kind = heads.schema["turn"].dataType.simpleString()
    members = rows.select("k", "text").join(heads, "k").select("g", "node", "turn", "text")
    members = staged(members.mapInArrow(run, f"g long, node long, turn {kind}, shingles binary").dropDuplicates(["node"]))
    gone = staged(unlike_those_that_stay(members, similarity).select(F.col("node").alias("t"), F.lit(True).alias("gone")))
    # What changes: nodes of several rows, which keep one, and nodes that go.
    some = small(staged(nodes.select("t", F.col("first.k").alias("head"), "n").join(small(gone), "t", "left").where("n > 1 OR gone")))
    drop = seen.select("k", "t").join(some, "t").where("gone OR k <> head").select(F.col("k").alias(key)).distinct()
    twice = seen.select("k", "t").join(some.where("n > 1"), "t").groupBy(F.col("k").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key)
    left = docs.withColumn(key, k).join(small(staged(drop)), key, "left_anti")
    repeated = small(staged(twice))
    once, more = left.join(repeated, key, "left_anti"), left.join(repeated, key, "left_semi").dropDuplicates([key])
    return once.unionByName(more).drop(key)
