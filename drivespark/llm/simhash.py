"""SimHash near-duplicates: fingerprints within a Hamming radius, found by a vantage-point tree.

The upper levels of the tree deal the distinct fingerprints out to shards, one task sees one shard, and the same
recursion goes on inside it. At a node with pivot p and radius r, fingerprints at a distance of at most r are inner, the
others outer. By the triangle inequality, an inner one can only be within ``radius`` bits of an outer one if its distance
is over r - radius: just those overlap the boundary and go to both sides. So every pair within the radius meets in a
leaf, exactly, and no branch further off is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components

SHINGLE, RADIUS = 3, 2
#: Aim of distinct fingerprints in a shard; rows from which the tree's pivots are picked (they decide speed, never links).
SHARD, PIVOT_SAMPLE = 4_000, 65_536
LEAF = 256
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles: a bit is set if it is in over half of the XXH64 values. No words: 0."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words))).tolist()
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, last, strict=False)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long), one row for each input row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    id_type = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {id_type}, fp long")


def _split(fps: np.ndarray, pivot: np.uint64, r: int, radius: int):
    d = np.bitwise_count(fps ^ pivot)
    return d <= r, (d > r) | (d > r - radius)


def _choose(fps: np.ndarray, radius: int):
    """A pivot and radius that part ``fps`` evenly with little overlap; None where nothing tried parts them."""
    best = None
    for pivot in fps[np.linspace(0, len(fps) - 1, min(6, len(fps))).astype(int)]:
        counts = np.bincount(np.bitwise_count(fps ^ pivot), minlength=66).cumsum()
        for r in range(0, 64):
            inner, outer = counts[r], len(fps) - (counts[r - radius] if r >= radius else 0)
            cost = float(inner) ** 2 + float(outer) ** 2
            if inner < len(fps) and outer < len(fps) and (best is None or cost < best[0]):
                best = (cost, pivot, r)
    return best and best[1:]


def build_tree(sample: np.ndarray, levels: int, radius: int = RADIUS):
    """Nested (pivot, r, inner, outer) down to ``levels``; a leaf is None."""
    if levels <= 0 or len(sample) < 8:
        return None
    node = _choose(sample, radius)
    if node is None:
        return None
    inner, outer = _split(sample, *node, radius)
    return (*node, build_tree(sample[inner], levels - 1, radius), build_tree(sample[outer], levels - 1, radius))


def route(fps: np.ndarray, tree, radius: int, path: int = 1):
    """(leaf, members' positions) for each leaf of the tree that holds any of ``fps``."""
    stack = [(tree, np.arange(len(fps)), path)]
    while stack:
        node, rows, path = stack.pop()
        if not len(rows):
            continue
        if node is None:
            yield path, rows
            continue
        inner, outer = _split(fps[rows], node[0], node[1], radius)
        stack += [(node[2], rows[inner], path * 2), (node[3], rows[outer], path * 2 + 1)]


def _near(a: np.ndarray, b: np.ndarray, radius: int):
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct ``fps``, the position of each one's root: pairs within ``radius`` share one. A tree, then leaves."""
    root = np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(rows, others):
        for k in range(0, len(rows), LEAF):
            x, y = _near(fps[rows[k : k + LEAF]], fps[others], radius)
            cuts = np.flatnonzero(np.diff(x)) + 1
            for i, js in zip(rows[k + x[np.r_[0, cuts]]].tolist() if len(x) else (), np.split(others[y], cuts), strict=False):
                if len(js) > 1 or js[0] != i:  # a dense group takes one step for each of its roots, not for each pair
                    roots = {find(j) for j in np.unique(root[js]).tolist()} | {find(i)}
                    least = min(roots)
                    for j in roots:
                        root[j] = least

    stack = [np.arange(len(fps))]
    while stack:
        rows = stack.pop()
        node = _choose(fps[rows[:: max(1, len(rows) // 512)]], radius) if len(rows) > LEAF else None
        if node is not None:
            inner, outer = (rows[m] for m in _split(fps[rows], *node, radius))
            if max(len(inner), len(outer)) < 0.9 * len(rows):
                stack += [inner, outer]
                continue
        for k in range(0, len(rows), 4096):
            join(rows, rows[k : k + 4096])
    return np.array([find(i) for i in range(len(fps))], np.int64) if len(fps) else root


def tree_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``a, b``: nodes of ``prints(s, fp, node)``, whose fingerprints are distinct in each series ``s`` (0, 1, ...).

    Of each series, pairs within ``radius`` bits are linked, directly or through others that are: a shard gives one link
    from a node to its root, not all pairs. Each series has a tree of its own.
    """
    sizes = {r.s: r["count"] for r in prints.groupBy("s").count().collect()}
    levels = {s: max(0, int(np.ceil(np.log2(n / shard)))) for s, n in sizes.items()}
    picked = prints.select("s", "fp").orderBy(F.xxhash64("s", "fp"), "s", "fp").limit(PIVOT_SAMPLE).toPandas() if any(levels.values()) else None
    trees = {s: build_tree(picked["fp"].to_numpy(np.int64)[picked["s"].to_numpy() == s].view(np.uint64), n, radius) if n else None for s, n in levels.items()}

    def deal(batches):
        for b in batches:
            series, all_fps, nodes = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2)
            for s in np.unique(series).tolist():
                own = np.flatnonzero(series == s)
                fps = all_fps[own]
                for leaf, rows in route(fps, trees.get(s), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), s, np.int32)), pa.array(np.full(len(rows), leaf, np.int64)), pa.array(fps[rows].view(np.int64)), nodes.take(pa.array(own[rows]))], names=["s", "leaf", "fp", "node"])

    def pairs(table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fps)
        roots = linked(fps[order], radius)
        rows = np.flatnonzero(roots != np.arange(len(fps)))
        nodes = table.column("node").combine_chunks()
        return pa.table({"a": nodes.take(pa.array(order[rows])), "b": nodes.take(pa.array(order[roots[rows]]))})

    shards = prints.select(F.col("s").cast("int").alias("s"), "fp", "node").mapInArrow(deal, "s int, leaf long, fp long, node long")
    return shards.groupBy("s", "leaf").applyInArrow(pairs, "a long, b long")


def near_components(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``fp, component_id`` for each distinct fingerprint of ``prints(doc_id, fp)``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id that is reachable.
    Copies share a fingerprint and count once.
    """
    own = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(tree_links(own.select(F.lit(0).alias("s"), "fp", F.col("fp").alias("node")), radius, shard)).withColumnRenamed("node", "fp")
    roots = own.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    firsts = roots.groupBy("label").agg(F.min("least").alias("component_id"))
    return roots.join(firsts, "label").select("fp", "component_id")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``, one row for each input row.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; fewer words than a shingle give one shingle of
    them all; null, empty and blank texts have fingerprint 0, which links like any other. A document with no id has none
    to be named by and gets the smallest of its group, or null. Rows that repeat an id are rows of their own; other
    columns are ignored; an empty table gives no rows.
    """
    prints = staged(fingerprints(docs, shingle, id_col, text_col))
    return prints.join(near_components(prints, radius), "fp").select("doc_id", "fp", "component_id")
