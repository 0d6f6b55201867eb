"""Ranked lexical search: the best documents of each item by integer weights of shared terms.

Documents are reordered by recursive graph bisection (a tree fitted on a bounded sample, down which every document goes) and
stored as shards of neighbours in that order: postings of the items' terms with their impacts, and for each term the
largest impact in the shard. The sum of these over an item's terms bounds every score in the shard. Items visit shards
by falling bound, a few first, then ever more, and stop when no shard is left whose bound reaches the item's score in
last place so far: what is left can't hold a better document, nor one that ties with a smaller id, so results are exact.
Within a shard documents are held by id, which is where places map back to for ties.

Items come in blocks of bounded vocabulary, and a block is searched in one index; a shard holds at most about ``SHARD_DOCS``
documents and ``SHARD_POSTINGS`` postings, whatever the number of documents in a leaf of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .bisection import Tree, fit_tree
from .common import row_key, small, staged
from .vectors import BLOCK, byte_column, groups

#: The sample that fits the tree has at most so many documents, and the tree so many levels.
SAMPLE_DOCS, LEVELS = 8_192, 8
SHARD_DOCS, SHARD_POSTINGS = 2_048, 1_000_000
#: Items and terms of a block (one item with more terms is a block of its own).
BLOCK_ITEMS, BLOCK_TERMS = 1_000, 16_384
#: Shards that an item visits in the first rounds; the last round takes all that can still matter.
VISITS = (4, 16, 64)
#: Bytes of a term: digits, letters, and all that is no ASCII; upper case is made lower, all else separates.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about a block of bytes (a term is never cut)."""
    low = text.translate(_TERMS)
    first = 0
    while len(low) - first > BLOCK:
        cut = low.find(b" ", first + BLOCK)
        if cut < 0:
            break
        yield low[first:cut].split()
        first = cut
    yield low[first:].split() if first else low.split()


@dataclass
class Block:
    """Items with their distinct terms as codes, end to end, and each code's weight."""

    item_ids: list
    codes: np.ndarray
    starts: np.ndarray
    vocabulary: dict[bytes, int]
    weights: np.ndarray | None = None


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_items: int, most_terms: int) -> Iterator[Block]:
    """Blocks of the items that have a term, in the order of their ids."""

    def distinct(batches):
        for batch in batches:
            own = [sorted({w for ws in split_terms(t) for w in ws}) for t in byte_column(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(distinct, f"item_id {kind}, terms array<binary>")
    block, codes, sizes, ids = {}, [], [], []
    for r in staged(rows.where(F.size("terms") > 0)).orderBy("item_id", "terms").toLocalIterator():
        terms = [bytes(t) for t in r.terms]
        if ids and (len(ids) >= most_items or len(block) + sum(t not in block for t in terms) > most_terms):
            yield Block(ids, np.array(codes, np.int64), np.cumsum([0, *sizes[:-1]]), block)
            block, codes, sizes, ids = {}, [], [], []
        codes += [block.setdefault(t, len(block)) for t in terms]
        sizes.append(len(terms))
        ids.append(r.item_id)
    if ids:
        yield Block(ids, np.array(codes, np.int64), np.cumsum([0, *sizes[:-1]]), block)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tf``: all terms of a text counted, and those of the vocabulary by code with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = len(vocabulary)

    def run(batches):
        find = shared.value.get
        for batch in batches:
            texts = byte_column(batch.column(1))
            for a, b in groups(texts):
                n, keys = np.zeros(b - a, np.int64), []
                for i, text in enumerate(texts[a:b]):
                    for words in split_terms(text):
                        n[i] += len(words)
                        code = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                        keys.append(code[code >= 0] + i * size)
                key, tf = np.unique(np.concatenate(keys), return_counts=True)
                cut = pa.array(np.searchsorted(key, np.arange(b - a + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (key % max(size, 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *lists], names=["doc_id", "n", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all elements of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()


def fit_order(counted: DataFrame, n_terms: int, n_docs: int) -> Tree:
    """The bisection tree of the sample with the least hashes, with leaves for about ``SHARD_DOCS`` documents each."""
    levels = min(LEVELS, max(0, n_docs // SHARD_DOCS).bit_length())
    # Only hashes that can be among the least are sorted: else each task would send the driver a sample of its own.
    below = min(1 << 63, (SAMPLE_DOCS << 64) // max(1, n_docs)) - 1
    keyed = counted.where(F.size("terms") > 0).select(F.shiftrightunsigned(row_key("doc_id", "terms"), 1).alias("h"), "terms")
    rows = keyed.where(F.col("h") <= F.lit(below)).orderBy("h").limit(SAMPLE_DOCS if levels else 0).toPandas()
    sizes = rows["terms"].map(len).to_numpy(np.int64)
    terms = np.concatenate([np.zeros(0, np.int64), *(np.asarray(t, np.int64) for t in rows["terms"])])
    return fit_tree(np.repeat(np.arange(len(rows)), sizes), terms, len(rows), n_terms, levels)


def build_shards(counted: DataFrame, tree: Tree, n_docs: int, n_words: int) -> DataFrame:
    """The index: for each shard its documents by id, the terms it holds, their postings and the largest impact of each."""
    spark, id_kind = counted.sparkSession, counted.schema["doc_id"].dataType
    shared = spark.sparkContext.broadcast(tree)

    def with_leaf(batches):
        for batch in batches:
            doc, term = _pairs(batch.column(2))
            leaf = shared.value.leaves(doc, term, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    placed = counted.where(F.size("terms") > 0).mapInArrow(with_leaf, StructType([*counted.schema, StructField("leaf", IntegerType())]))
    held = placed.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum(F.size("terms")).alias("postings"))
    parts = held.select("leaf", F.ceil(F.greatest(F.col("docs") / SHARD_DOCS, F.col("postings") / SHARD_POSTINGS)).alias("parts"))
    shard = F.col("leaf").cast("long") * (1 << 40) + F.pmod(row_key("doc_id", "terms", "tf", "n"), "parts")
    dealt = placed.join(F.broadcast(parts), "leaf").withColumn("shard", shard).select("shard", "doc_id", "n", "terms", "tf")
    ints = ArrayType(IntegerType())
    schema = StructType([StructField("shard", LongType()), StructField("docs", ArrayType(id_kind)), *(StructField(c, ints) for c in ("terms", "first", "doc", "impact", "most"))])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()  # nulls come last
        column = lambda c: table.column(c).combine_chunks()
        doc, term = _pairs(column("terms"))
        tf, n = column("tf").flatten().to_numpy().astype(np.int64), column("n").to_numpy().astype(np.int64)
        if int(n.max()) * 90 * n_docs >= 1 << 63:
            n = n.astype(object)
        m = (10 + 90 * n * n_docs // n_words).astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, term))
        held, first = np.unique(term[order], return_index=True)
        lists = [held, np.append(first, len(term)), doc[order], impact[order], np.maximum.reduceat(impact[order], first)]
        ids = pa.LargeListArray.from_arrays(pa.array([0, len(table)], pa.int64()), column("doc_id")).cast(pa.list_(table.schema.field("doc_id").type))
        return pa.Table.from_arrays([table.column("shard").slice(0, 1), ids, *(pa.array([x.astype(np.int32)]) for x in lists)], names=schema.names)

    return staged(dealt.groupBy("shard").applyInArrow(build, schema))


def shard_bounds(index: DataFrame, block: Block) -> DataFrame:
    """``item, shard, bound``: for each item and shard that share a term, a sum that no score there exceeds."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        own = shared.value
        for batch in batches:
            for i in range(len(batch)):
                most = np.zeros(len(own.vocabulary), np.int64)
                most[batch.column(1)[i].values.to_numpy()] = batch.column(2)[i].values.to_numpy()
                bound = np.add.reduceat(own.weights[own.codes] * most[own.codes], own.starts)
                item = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.full(len(item), batch.column(0)[i].as_py())), pa.array(bound[item])], names=["item", "shard", "bound"])

    return index.select("shard", "terms", "most").mapInArrow(run, "item int, shard long, bound long")


def score_shards(index: DataFrame, visits: DataFrame, block: Block, k: int, least: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: of each visited shard the ``k`` best documents of its items that reach the items' ``least`` score."""
    shared = index.sparkSession.sparkContext.broadcast((block, least))
    work = index.join(visits, "shard").select("docs", "terms", "first", "doc", "impact", "items")

    def run(batches):
        own, least = shared.value
        ends = np.append(own.starts[1:], len(own.codes))
        for batch in batches:
            for row in range(len(batch)):
                ids = batch.column(0)[row].values
                terms, first, doc, impact, items = (batch.column(c)[row].values.to_numpy() for c in range(1, 6))
                found = []
                for item in items.tolist():
                    codes = own.codes[own.starts[item] : ends[item]]
                    at = np.minimum(np.searchsorted(terms, codes), len(terms) - 1)
                    at = at[terms[at] == codes]
                    size = first[at + 1] - first[at]
                    place = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    score = np.zeros(len(ids), np.int64)
                    np.add.at(score, doc[place], np.repeat(own.weights[terms[at]], size) * impact[place])
                    good = np.flatnonzero(score >= max(1, least[item]))
                    good = good[np.argsort(-score[good], kind="stable")[:k]]  # of equal scores the smaller id stays
                    found.append((np.full(len(good), item, np.int32), good, score[good]))
                item, good, score = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(good)), pa.array(score)], names=["item", "doc_id", "score"])

    kind = index.schema["docs"].dataType.elementType.simpleString()
    return work.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(counted: DataFrame, block: Block, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``item, doc_id, score, rank`` of one block, in rounds of visits."""
    spark = counted.sparkSession
    df = np.zeros(len(block.vocabulary), np.float64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row for each term of the block
        df[r.term] = r.df
    block.weights = np.floor(1000.0 * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)
    index = build_shards(counted, fit_order(counted, len(df), n_docs), n_docs, n_words)
    bounds = staged(shard_bounds(index, block))
    n = len(block.item_ids)
    least, cut = np.zeros(n, np.int64), [(1 << 62, -1)] * n
    top = None
    for visits in (*VISITS, None):
        state = spark.createDataFrame([(i, int(least[i]), *cut[i]) for i in range(n)], "item int, least long, last_bound long, last_shard long")
        after = (F.col("bound") < F.col("last_bound")) | (F.col("bound") == F.col("last_bound")) & (F.col("shard") > F.col("last_shard"))
        open_ = bounds.join(F.broadcast(state), "item").where(after & (F.col("bound") >= F.col("least"))).select("item", "shard", "bound")
        if visits:
            order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
            open_ = open_.withColumn("at", F.row_number().over(order)).where(F.col("at") <= visits)
        chosen = staged(open_)
        ends = chosen.groupBy("item").agg(F.min(F.struct("bound", -F.col("shard"))).alias("end")).collect()  # a row for each item of the block
        if not ends:
            break
        for r in ends:
            cut[r.item] = (r.end[0], -r.end[1])
        by_shard = small(staged(chosen.groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items"))))
        found = score_shards(index, by_shard, block, k, least)
        top = staged(_best(found if top is None else found.unionByName(top.select("item", "doc_id", "score")), k))
        for r in top.where(F.col("rank") == k).select("item", "score").collect():
            least[r.item] = r.score
    return top


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, best first, ties to the smaller id.

    Only scores above 0 count, so an item without terms, or whose terms no document holds, has no rows. Null and empty
    texts have no terms and aren't found. Every row is a document of its own, and every row of ``items`` an item of its own,
    so repeats are ranked one after the other; a null doc_id is the largest. Other columns are ignored, whatever
    their names; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_kind, item_kind = d.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = [spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {id_kind}, score long")]
    for block in item_blocks(items, item_col, item_text_col, block_items, block_terms):
        counted = staged(count_terms(d, block.vocabulary))
        n_docs, n_words = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        top = search_block(counted, block, n_docs, n_words, k) if n_docs else None
        if top is not None:
            names = spark.createDataFrame(list(enumerate(block.item_ids)), f"item int, item_id {item_kind}")
            out.append(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
