"""Joins in time and space. As-of joins are a union and a window by key: no range join, one shuffle by the drive."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..staging import staged

#: A table of at most this many rows may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``rows`` rows in it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def last_at_or_before(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], max_age: float | None = None) -> DataFrame:
    """``left`` with ``values`` and ``at`` of the last right row of the key at or before its time; of rows at one time the
    greatest values. Null where there is none, or where it is older than ``max_age``."""
    r = F.struct(F.col(time).alias("at"), *(F.col(v) for v in values))
    a = left.select(F.struct(*left.columns).alias("__l"), *keys, F.col(time).alias("__t"), F.lit(1).alias("__side")).withColumn("__r", F.lit(None).cast(right.select(r.alias("r")).schema["r"].dataType))
    b = right.select(F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), *keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), r.alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__r", F.last("__r", True).over(w)).where("__side = 1")
    fresh = F.lit(True) if max_age is None else F.col("__t") - F.col("__r.at") <= max_age
    return both.select("__l.*", *(F.when(fresh, F.col(f"__r.{c}")).alias(c) for c in ("at", *values)))


def align_streams(grid: DataFrame, stream: DataFrame, keys: Sequence[str], time: str, linear: Sequence[str], held: Sequence[str], max_gap: float = 0.35, margin: float = 0.05) -> DataFrame:
    """``stream`` on the grid's times: linear interpolation, or the last value held; null in gaps over ``max_gap`` and more
    than ``margin`` outside the stream."""
    s = F.struct(F.col(time).alias("t"), *(F.col(c) for c in [*linear, *held]))
    a = grid.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side")).withColumn("__s", F.lit(None).cast(stream.select(s.alias("s")).schema["s"].dataType))
    b = stream.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), s.alias("__s"))
    # The next value is the last one of the order turned round: frames that only grow cost one step a row.
    upto = (Window.unboundedPreceding, 0)
    on, back = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(*upto), Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(*upto)
    both = a.unionByName(b).withColumn("p", F.last("__s", True).over(on)).withColumn("n", F.last("__s", True).over(back)).where("__side = 1")
    t, p, n = F.col("__t"), F.col("p"), F.col("n")
    inside = p.isNotNull() & n.isNotNull() & (n.t - p.t <= max_gap)
    edge = F.when(p.isNull() & (n.t - t <= margin), n).when(n.isNull() & (t - p.t <= margin), p)
    both = both.withColumn("__e", edge)
    share = F.when(n.t > p.t, F.try_divide(t - p.t, n.t - p.t)).otherwise(0.0)
    lin = lambda c: F.when(inside, p[c] + (n[c] - p[c]) * share).otherwise(F.col("__e")[c])
    hold = lambda c: F.when(inside, p[c]).otherwise(F.col("__e")[c])
    return both.select(*keys, t.alias(time), *(lin(c).alias(c) for c in linear), *(hold(c).alias(c) for c in held))


def row_pair_streams(a: DataFrame, b: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of equal number within a key, as far as both go; ``b``'s columns are named b_..."""
    n = lambda d: d.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    right = n(b).select(*keys, "__n", *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    return n(a).join(right, [*keys, "__n"]).withColumnRenamed("__n", "row")


def known_session_filter(batch: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and missing ids: a batch is taken whole or not at all."""
    missing = batch.select("batch_id", "session_id").distinct().join(sessions.select("session_id"), "session_id", "left_anti")
    return batch.join(missing.select("batch_id").distinct(), "batch_id", "left_anti"), missing


def seed_segments(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` with ``action``: inserted, or skipped because it is short, known, or repeated inside the batch."""
    known = existing.select("region", "id").distinct().withColumn("__known", F.lit(True))
    d = new.join(known, ["region", "id"], "left").withColumn("__r", F.row_number().over(Window.partitionBy("region", "id").orderBy("seq")))
    action = F.when(F.col("points") < 2, "short").when(F.col("__known"), "known").when(F.col("__r") > 1, "repeated").otherwise("inserted")
    return d.withColumn("action", action).drop("__known", "__r")


def nearby_edges(points: DataFrame, edges: DataFrame, radius_m: float = 60.0, k: int = 8, cell_m: float = 250.0, ref_lat: float = 12.0) -> DataFrame:
    """The ``k`` nearest segments within ``radius_m`` of each point: ``point_id, edge_id, perp_m, along_m``.

    Segments are filed under every grid cell that their box, widened by the radius, meets; a point looks in its own cell,
    so the join is an equi-join and no pair is met twice. Cells are counted in metres at ``ref_lat``. Places are searched once,
    however many points are at them; of a segment's projection only what its box, widened by the radius, may reach is made.
    """
    import math

    wide_lat = radius_m / 110_000
    wide_lon = wide_lat / math.cos(math.radians(min(80.0, abs(ref_lat) + 5)))
    at = lambda lat, lon: geo.grid_cell(lat, lon, cell_m, ref_lat)
    south, west = F.least("a_lat", "b_lat") - wide_lat, F.least("a_lon", "b_lon") - wide_lon
    north, east = F.greatest("a_lat", "b_lat") + wide_lat, F.greatest("a_lon", "b_lon") + wide_lon
    lo, hi = at(south, west), at(north, east)
    own_lon = F.lit(wide_lat) / F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + 1)))
    e = edges.withColumn("gx", F.explode(F.sequence(lo[0], hi[0]))).withColumn("gy", F.explode(F.sequence(lo[1], hi[1])))
    spots = points.select("lat", "lon").distinct()
    gx, gy = at(F.col("lat"), F.col("lon"))
    d = spots.withColumns({"gx": gx, "gy": gy, "__w": own_lon}).join(e, ["gx", "gy"])
    d = d.where(F.col("lat").between(south, north) & F.col("lon").between(F.least("a_lon", "b_lon") - F.col("__w"), F.greatest("a_lon", "b_lon") + F.col("__w")))
    foot = geo.project_point_to_segment(*(F.col(c) for c in ("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon")))
    # inline() evaluates the projection once for each candidate; what follows reads plain columns.
    near = d.select("lat", "lon", "edge_id", F.inline(F.array(foot))).where(F.col("perp_m") <= radius_m)
    best = near.groupBy("lat", "lon", "edge_id").agg(F.min(F.struct("perp_m", "along_m")).alias("f")).select("lat", "lon", "edge_id", "f.*")
    place = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("perp_m", "edge_id"))
    best = best.withColumn("__r", place).where(F.col("__r") <= k).drop("__r")
    # A point that repeats its id at another place is one point, and the nearest of all its places counts.
    met = points.select("point_id", "lat", "lon").join(best, ["lat", "lon"])
    met = met.groupBy("point_id", "edge_id").agg(F.min(F.struct("perp_m", "along_m")).alias("f")).select("point_id", "edge_id", "f.*")
    r = F.row_number().over(Window.partitionBy("point_id").orderBy("perp_m", "edge_id"))
    return met.withColumn("rank", r).where(F.col("rank") <= k).select("point_id", "edge_id", "rank", "perp_m", "along_m")


def roads_in_bbox(segments: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Segments (a to b) that meet a box, by clipping their parameter range (Liang-Barsky)."""
    dlat, dlon = F.col("b_lat") - F.col("a_lat"), F.col("b_lon") - F.col("a_lon")
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dlon, F.col("a_lon") - west), (dlon, F.lit(east) - F.col("a_lon")), (-dlat, F.col("a_lat") - south), (dlat, F.lit(north) - F.col("a_lat"))):
        r = F.try_divide(q, p)
        lo = F.when(p < 0, F.greatest(lo, r)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, r)).otherwise(hi)
        ok = ok & ((p != 0) | (q >= 0))
    return segments.where(ok & (lo <= hi))


def nearest_roads(points: DataFrame, edges: DataFrame, k: int = 5, max_m: float = 5_000.0, start_m: float = 100.0, **grid) -> DataFrame:
    """The ``k`` nearest segments of each point up to ``max_m``: the radius grows fourfold for the points that lack some.

    Each round is written once, so no radius is searched again for the next one."""
    found, left, radius = None, points, start_m
    while True:
        near = staged(nearby_edges(left, edges, radius, k, max(250.0, radius), **grid))
        full = near.groupBy("point_id").agg(F.count("*").alias("n")).where(F.lit(radius >= max_m) | (F.col("n") >= k)).select("point_id")
        part = near.join(full, "point_id", "left_semi")
        found = part if found is None else found.unionByName(part)
        if radius >= max_m:
            return found
        left, radius = staged(left.join(full, "point_id", "left_anti")), min(max_m, radius * 4)


def way_nodes_join(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, coords`` in the order of the refs; unknown refs are dropped."""
    refs = ways.select("id", F.posexplode("refs").alias("pos", "node"))
    d = refs.join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node")
    lists = d.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))).alias("l"))
    return lists.select("id", F.transform("l", lambda x: F.array(x.lat, x.lon)).alias("coords"))


def attach_predictions(records: DataFrame, preds: DataFrame, keys: Sequence[str], truth: str, label: str, max_diff: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Records with their predictions by exact key, and one row that says whether they belong together: at least 99 % of
    the labels meet a record and none differs from its truth by ``max_diff``."""
    d = records.join(preds, list(keys), "left")
    met = preds.join(records.select(*keys, truth), list(keys), "left").agg(F.count("*").alias("labels"), F.count(truth).alias("met"), F.coalesce(F.max(F.abs(F.col(truth) - F.col(label))), F.lit(0.0)).alias("worst"))
    return d, met.withColumn("accepted", (F.col("met") >= 0.99 * F.col("labels")) & (F.col("worst") < max_diff))


def pair_within(fixes: DataFrame, preds: DataFrame, key: str, time: str, tol: int) -> DataFrame:
    """Each fix with the newest prediction within ``tol``, each prediction with its first such fix only."""
    cand = fixes.select(key, F.col(time).alias("fix_t"), F.explode(F.array(*(F.floor(F.col(time) / tol) + i for i in (-1, 0, 1)))).alias("slot"))
    p = preds.select(key, F.col(time).alias("pred_t"), F.floor(F.col(time) / tol).alias("slot"))
    d = cand.join(p, [key, "slot"]).where(F.abs(F.col("fix_t") - F.col("pred_t")) <= tol)
    newest = d.groupBy(key, "fix_t").agg(F.max("pred_t").alias("pred_t"))
    return newest.groupBy(key, "pred_t").agg(F.min("fix_t").alias("fix_t"))


def records_in_windows(records: DataFrame, windows: DataFrame, key: str, time: str) -> DataFrame:
    """Records inside [start, start + length) of a window of their drive."""
    w = windows.select(F.col(key).alias("__k"), "window_id", "start", "length")
    return records.join(w, (F.col(key) == F.col("__k")) & (F.col(time) >= F.col("start")) & (F.col(time) < F.col("start") + F.col("length"))).drop("__k")


def match_descriptors(queries: DataFrame, anchors: DataFrame, words: int = 4, block: int = BROADCAST_ROWS) -> DataFrame:
    """Best and second similarity (1 - Hamming / bits) of each query to the anchors, descriptors as arrays of longs.

    Every query meets every anchor, in numpy: a block of about ``block`` anchors goes to all tasks at a time, and a batch of
    queries keeps the two best of it, so no pair is a row. Of equal similarities the smaller anchor counts; a null in a
    descriptor is less similar than anything.
    """
    bits = 64 * words
    named = [F.col("descriptor")[i].alias(f"w{i}") for i in range(words)]
    held = staged(anchors.select("anchor_id", *named))
    asked = staged(queries.select("query_id", *named))
    parts = -(-held.count() // block)
    kinds = {n: t for d in (asked, held) for n, t in d.dtypes}
    schema = f"query_id {kinds['query_id']}, anchor_id {kinds['anchor_id']}, apart int"

    def best(part: int) -> DataFrame:
        table = held.where(F.pmod(F.xxhash64("anchor_id"), F.lit(parts)) == part).orderBy("anchor_id").toArrow().combine_chunks()
        ids, (bad, descriptors) = table["anchor_id"], _descriptors(table, words)

        def run(batches):
            for batch in batches:
                no, rows = _descriptors(batch, words)
                for at in range(0, len(rows), 64):
                    near, apart = _two_nearest(rows[at : at + 64], no[at : at + 64], descriptors, bad, bits)
                    n, k = near.shape
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(at, at + n), k))), ids.take(pa.array(near.ravel())).combine_chunks(), pa.array(apart.ravel(), pa.int32())], ["query_id", "anchor_id", "apart"])

        return asked.repartition(F.col("query_id")).mapInArrow(run, schema) if len(table) else asked.sparkSession.createDataFrame([], schema)

    found = [staged(best(part)) for part in range(parts)]
    if not found:
        return asked.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, anchor_id {kinds['anchor_id']}, best double, second double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("apart", "anchor_id"))
    two = reduce(DataFrame.unionByName, found).withColumn("place", place).where("place <= 2").withColumn("similarity", F.when(F.col("apart") <= bits, F.lit(1.0) - F.col("apart") / float(bits)))
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    return two.groupBy("query_id").agg(at(1, "anchor_id").alias("anchor_id"), at(1, "similarity").alias("best"), at(2, "similarity").alias("second"))


def _descriptors(table: pa.Table | pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a null, and the words of all."""
    columns = [table.column(f"w{i}") for i in range(words)]
    columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns]
    bad = np.zeros(len(table), bool)
    for x in columns:
        bad |= x.is_null().to_numpy(zero_copy_only=False)
    return bad, np.stack([x.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for x in columns], axis=1)


def _two_nearest(rows: np.ndarray, no: np.ndarray, anchors: np.ndarray, bad: np.ndarray, bits: int, step: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers of the two nearest anchors (one, if there is one) and the bits they are apart, the first of equals."""
    near, apart = [], []
    every = np.arange(len(rows))
    for at in range(0, len(anchors), step):
        own = anchors[at : at + step]
        d = np.bitwise_count(rows[:, None, 0] ^ own[None, :, 0]).astype(np.uint16)
        for w in range(1, own.shape[1]):
            d += np.bitwise_count(rows[:, None, w] ^ own[None, :, w])
        d[:, bad[at : at + step]] = bits + 1
        d[no] = bits + 1
        for _ in range(min(2, len(own))):
            i = d.argmin(1)
            near.append(i + at)
            apart.append(d[every, i].astype(np.int32))
            d[every, i] = np.iinfo(np.uint16).max
    near, apart = np.stack(near, axis=1), np.stack(apart, axis=1)
    order = np.argsort(apart, axis=1, kind="stable")[:, :2]
    return np.take_along_axis(near, order, 1), np.take_along_axis(apart, order, 1)


def match_anchors(obs: DataFrame, anchors: DataFrame, distance: Column, floor_m: float = 50.0) -> DataFrame:
    """Scanned payloads against registered anchors, with the reason of each refusal."""
    d = obs.join(anchors, "payload", "left")
    gate = F.greatest(F.lit(floor_m), 4 * F.col("sigma_m") + F.col("anchor_sigma_m"))
    reason = F.when(F.col("anchor_id").isNull(), "unknown anchor").when(~F.col("in_outage"), "not in an outage").when(F.col("sigma_m").isNull(), "no estimate").when(distance > gate, "too far").otherwise("accepted")
    return d.withColumn("reason", reason)
