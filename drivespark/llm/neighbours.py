"""Approximate nearest neighbours: a neighbour graph by NN-descent joins, searched greedily.

Build: every vector starts with the best of a random block. Then neighbours of neighbours are joined: around each centre,
the vectors that it points to and those that point to it are compared with one another, and each keeps its best so far.
Search: each query has a beam of the best vectors found; round by round, the best that weren't opened yet are joined with
the graph, which brings their neighbours. All steps are joins by id; neighbours' vectors travel as one byte a component.
Final scores are exact, on the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged

#: Neighbours kept in the graph; rows of a starting block; rounds of the build; links to a vector that a round follows
#: (a hash decides which): the method's own sampling, whose recall tests measure against brute force.
DEGREE, BLOCK, ROUNDS, BACK = 28, 512, 5, 28
#: Vectors that a query keeps, opens in a round, and the rounds.
BEAM, OPEN, HOPS = 160, 20, 7
TOP = 20


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, vec`` (doubles): no null, zero or non-finite vectors, the commonest length only, one vector for each id."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    sizes = v.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).agg(F.max_by("n", F.struct("c", "n")).alias("n"))
    v = v.join(F.broadcast(sizes), F.size("vec") == F.col("n")).select("id", "vec")
    return v.groupBy("id").agg(F.min("vec").alias("vec"))


def _bytes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    return np.round(x / scale).astype(np.int8), scale[:, 0].astype(np.float32)


def squeezed(vectors: DataFrame) -> DataFrame:
    """``id, code`` with the vector as its scale (4 bytes) and a signed byte for each component."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("vec").to_numpy(zero_copy_only=False))
                q, scale = _bytes_of(x)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() + r.tobytes() for s, r in zip(scale, q, strict=True)], pa.binary())], names=["id", "code"])

    return vectors.mapInArrow(run, "id long, code binary")


def _matrix(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest of each row, in no order."""
    return np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s, pa.float32())], names=["u", "v", "s"])


def _kept(edges: DataFrame, k: int) -> DataFrame:
    """``u, near``: each vector's ``k`` best distinct neighbours, best first."""
    best = edges.groupBy("u", "v").agg(F.max("s").alias("s")).groupBy("u").agg(F.collect_list(F.struct((-F.col("s")).alias("d"), "v")).alias("l"))
    return best.select("u", F.slice(F.array_sort("l"), 1, k).alias("near"))


def _start(codes: DataFrame, rows: int, degree: int) -> DataFrame:
    def run(table):
        ids = table.column("id").to_numpy()
        m = _matrix(table.column("code").to_pylist())
        s = m @ m.T
        np.fill_diagonal(s, -np.inf)
        k = min(degree, len(ids) - 1)
        at = _best(s, k) if k else np.zeros((len(ids), 0), int)
        return pa.Table.from_batches([_edges(np.repeat(ids, k), ids[at].reshape(-1), np.take_along_axis(s, at, 1).reshape(-1))])

    blocks = max(1, rows // BLOCK)
    parts = [codes.select("id", "code", F.pmod(F.xxhash64("id", F.lit(t)), F.lit(blocks)).alias("b")).withColumn("t", F.lit(t)) for t in range(2 if blocks > 1 else 1)]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("t", "b").applyInArrow(run, "u long, v long, s float")


def _round(graph: DataFrame, codes: DataFrame, degree: int, turn: int) -> DataFrame:
    """New edges: all pairs around each centre that are better than what the first of the pair has."""
    flat = graph.select("u", F.explode("near.v").alias("v"))
    into = flat.groupBy("v").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.lit(1_000_000)) / 1e6
    back = flat.join(into, "v").where(chance < F.lit(float(BACK)) / F.col("n")).select(F.col("v").alias("c"), F.col("u").alias("m"))
    around = flat.select(F.col("u").alias("c"), F.col("v").alias("m")).unionByName(back).distinct()
    worst = graph.select(F.col("u").alias("m"), F.when(F.size("near") < degree, F.lit(-3e38)).otherwise(-F.element_at("near", -1).d).cast("float").alias("worst"))
    held = codes.select(F.col("id").alias("m"), "code").join(worst, "m", "left")
    lists = around.join(held, "m").groupBy("c").agg(F.collect_list(F.struct("m", "code", "worst")).alias("l"))

    def run(batches):
        for batch in batches:
            us, vs, ss = [], [], []
            for i in range(batch.num_rows):
                own = batch.column("l").slice(i, 1).flatten()
                ids, worst = own.field("m").to_numpy(), own.field("worst").to_numpy(zero_copy_only=False)
                if len(ids) < 2:
                    continue
                x = _matrix(own.field("code").to_pylist())
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                at = _best(s, min(6, len(ids) - 1))
                top = np.take_along_axis(s, at, 1)
                r, c = np.nonzero(top > worst[:, None])
                us.append(ids[r])
                vs.append(ids[at[r, c]])
                ss.append(top[r, c])
            if us:
                yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    return lists.mapInArrow(run, "u long, v long, s float")


def build_graph(codes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """``u, near``: for each id, up to ``degree`` near ones (d: minus the inner product, v: id), best first."""
    graph = staged(_kept(_start(codes, codes.count(), degree), degree))
    for turn in range(rounds):
        old = graph.select("u", F.explode("near").alias("n")).select("u", "n.v", (-F.col("n.d")).cast("float").alias("s"))
        graph = staged(_kept(old.unionByName(_round(graph, codes, degree, turn)), degree))
    return graph


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, beam: int = BEAM, opened: int = OPEN, hops: int = HOPS) -> DataFrame:
    """``q, found`` for ``queries(q)``, ids of the graph: the beam (d, v, done), best first."""
    flat = graph.select("u", F.explode("near.v").alias("v"))
    into = flat.groupBy("v").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000)) / 1e6
    both = flat.unionByName(flat.join(into, "v").where(chance < F.lit(float(BACK)) / F.col("n")).select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    table = staged(both.join(codes.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.collect_list(F.struct("v", "code")).alias("l")))
    own = staged(queries.join(codes.withColumnRenamed("id", "q"), "q").select("q", F.col("code").alias("q_code")))
    state = own.select("q", F.array(F.struct(F.lit(float("-inf")).cast("float").alias("d"), F.col("q").alias("v"), F.lit(False).alias("done"))).alias("found"))

    def run(batches):
        for batch in batches:
            qs, founds = [], []
            for q, code, i in zip(batch.column("q").to_numpy(), batch.column("q_code").to_pylist(), range(batch.num_rows), strict=True):
                l = batch.column("l").slice(i, 1).flatten()
                s = _matrix(l.field("code").to_pylist()) @ _matrix([code])[0]
                ids = l.field("v").to_numpy()
                qs.append(q)
                founds.append([{"d": float(-x), "v": int(v)} for x, v in zip(s, ids, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(founds, pa.list_(pa.struct([("d", pa.float32()), ("v", pa.int64())])))], names=["q", "l"])

    for _ in range(hops):
        todo = F.slice(F.filter("found", lambda x: ~x.done), 1, opened)
        front = small(staged(state.select("q", F.explode(todo).alias("t")).select("q", F.col("t.v").alias("u")).join(own, "q")))
        seen = front.join(table, "u").select("q", "q_code", "l").mapInArrow(run, "q long, l array<struct<d: float, v: long>>")
        fresh = seen.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("l"))).alias("l"))
        known = F.transform("found", lambda x: x.v)
        marked = F.transform("found", lambda x, i: x.withField("done", x.done | F.array_contains(F.transform(todo, lambda t: t.v), x.v)))
        new = F.transform(F.filter(F.coalesce("l", F.array().cast("array<struct<d: float, v: long>>")), lambda x: ~F.array_contains(known, x.v)), lambda x: F.struct(x.d.alias("d"), x.v.alias("v"), F.lit(False).alias("done")))
        state = staged(state.join(fresh, "q", "left").select("q", F.slice(F.array_sort(F.concat(marked, new)), 1, beam).alias("found")))
    return state


def _ranked(rows: DataFrame, by: str, top: int) -> DataFrame:
    """The first ``top`` rows of each ``by``, by score, then id; a limit that each task applies before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id that ``every`` divides, the ``top`` nearest others found.

    Nearness is the inner product, ties go to the smaller id. Equal vectors are one in the graph; of the ids that share one
    the ``top`` + 1 smallest can be among the nearest, and no others. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those of another length than most; of rows that repeat an id, the smallest
    vector counts; other columns are ignored. Fewer candidates than ``top`` give them all; an empty table gives no rows.
    """
    v = staged(usable(vectors, id_col, vec_col))
    own = staged(v.groupBy("vec").agg(F.min("id").alias("rep")))
    of = staged(v.join(own, "vec").select("id", "rep"))
    same = staged(of.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= top + 1).select("rep", "id"))
    one = own.select(F.col("rep").alias("id"), "vec")
    codes = staged(squeezed(one))
    asked = staged(of.where(F.col("id") % every == 0))
    found = search(build_graph(codes), codes, asked.select(F.col("rep").alias("q")).distinct())
    near = found.select("q", F.explode(F.slice("found", 1, 4 * top + 1)).alias("f")).select("q", F.col("f.v").alias("rep"))
    score = F.aggregate(F.zip_with("q_vec", "vec", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = near.join(one.withColumnRenamed("id", "rep"), "rep").join(one.select(F.col("id").alias("q"), F.col("vec").alias("q_vec")), "q").select("q", "rep", score.alias("score"))
    best = staged(_ranked(scored.join(same, "rep").select("q", "id", "score"), "q", top + 1))
    # A query's own id, if it is among them, leaves ``top`` others.
    mine = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("q")).join(best.select("q", "id", "score"), "q").where("id <> query_id")
    return _ranked(mine, "query_id", top).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
