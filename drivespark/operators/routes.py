"""Planned routes: their shape, manoeuvres and tunnels from steps on edges, and the progress of drives along them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..staging import staged
from .folds import PIECE, carried
from .joins import last_at_or_before

#: Degrees from which a turn is slight, plain, sharp, a U-turn; metres.
SLIGHT_DEG, TURN_DEG, SHARP_DEG, U_TURN_DEG = 20.0, 45.0, 135.0, 170.0
MERGE_M, SAMPLE_M, PASSED_M, ARRIVED_M = 15.0, 10.0, 5.0, 30.0
#: What of the route is searched around the progress, what a metre along it costs, and when a drive is off it.
BACK_M, FORWARD_M, ALONG_PENALTY, OFF_M, OFF_FIXES = 150.0, 1000.0, 0.05, 50.0, 3

#: Pieces of routes, twice over, that drives followed together have at most (one longer route goes alone).
TOGETHER = 400_000

c = F.col


def placed_steps(steps: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps with ``start_m, end_m`` on their route and what their edge says, and the routes' straight pieces.

    ``steps``: ``route_id, seq, edge_id, forward, from_along_m, to_along_m``, in metres from the edge's start (beyond an end
    means that end); ``edges``: ``edge_id, from_node, to_node, polyline, name, tunnel``. Pieces: ``route_id, at_m, size_m, a_lat,
    a_lon, b_lat, b_lon``, in driving direction; those without length are left out. A route with a null in a step or with a
    step whose edge is unknown, or has no polyline of two points, is left out whole. Of rows that repeat route and
    number, or an edge's id, the least counts.
    """
    once = lambda d, keys, values: d.groupBy(*keys).agg(F.min(F.struct(*values)).alias("v")).select(*keys, "v.*")
    e = once(edges, ["edge_id"], ["from_node", "to_node", "polyline", "name", "tunnel"])
    s = once(steps, ["route_id", "seq"], ["edge_id", "forward", "from_along_m", "to_along_m"])
    drawn = F.coalesce((F.size("polyline") >= 4) & ~F.exists("polyline", lambda x: x.isNull()), F.lit(False))
    known = s.join(e, "edge_id", "left").withColumn("__ok", drawn & c("forward").isNotNull() & c("from_along_m").isNotNull() & c("to_along_m").isNotNull() & c("seq").isNotNull())
    every = Window.partitionBy("route_id")
    s = staged(known.withColumn("__ok", F.min("__ok").over(every)).where("__ok AND route_id IS NOT NULL").drop("__ok", "polyline"))

    at = lambda i: F.element_at("polyline", i.cast("int"))
    ends = F.transform(F.sequence(F.lit(1), F.size("polyline") - 3, F.lit(2)), lambda i: F.struct(at(i).alias("a_lat"), at(i + 1).alias("a_lon"), at(i + 2).alias("b_lat"), at(i + 3).alias("b_lon")))
    g = e.where(drawn).select("edge_id", F.posexplode(ends).alias("i", "s")).select("edge_id", "i", "s.*")
    g = g.withColumn("own_m", geo.horizontal_distance_m(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon")))
    g = g.withColumn("upto_m", F.sum("own_m").over(Window.partitionBy("edge_id").orderBy("i")))
    low, high = F.least("from_along_m", "to_along_m"), F.greatest("from_along_m", "to_along_m")
    begin = c("upto_m") - c("own_m")
    share = lambda m: F.try_divide(m - begin, c("own_m"))
    cut = s.select("route_id", "seq", "edge_id", "forward", low.alias("low"), high.alias("high")).join(g, "edge_id")
    # Where a step lies beyond an end, it is at that end.
    cut = cut.withColumns({"t0": F.greatest(F.lit(0.0), share(c("low"))), "t1": F.least(F.lit(1.0), share(c("high")))}).where("t0 < t1")
    on = lambda x, t: c(f"a_{x}") + (c(f"b_{x}") - c(f"a_{x}")) * c(t)
    first, last = F.struct(on("lat", "t0").alias("lat"), on("lon", "t0").alias("lon")), F.struct(on("lat", "t1").alias("lat"), on("lon", "t1").alias("lon"))
    p = cut.select("route_id", "seq", F.when(c("forward"), c("i")).otherwise(-c("i")).alias("i"), F.when(c("forward"), first).otherwise(last).alias("a"), F.when(c("forward"), last).otherwise(first).alias("b"))
    p = p.select("route_id", "seq", "i", c("a.lat").alias("a_lat"), c("a.lon").alias("a_lon"), c("b.lat").alias("b_lat"), c("b.lon").alias("b_lon"))
    p = staged(p.withColumn("size_m", geo.horizontal_distance_m(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon"))).where("size_m > 0"))

    own = Window.partitionBy("route_id", "seq").orderBy("i")
    inner = F.sum("size_m").over(own.rowsBetween(Window.unboundedPreceding, -1))
    along = Window.partitionBy("route_id").orderBy("seq")
    sizes = p.withColumn("m", F.sum("size_m").over(own)).groupBy("route_id", "seq").agg(F.max("m").alias("m"))
    s = s.join(sizes, ["route_id", "seq"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    s = s.withColumns({"start_m": F.coalesce(F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "end_m": F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, 0))}).drop("m")
    s = staged(s)
    p = p.withColumn("inner", F.coalesce(inner, F.lit(0.0))).join(s.select("route_id", "seq", "start_m"), ["route_id", "seq"])
    return s, p.select("route_id", (c("start_m") + c("inner")).alias("at_m"), "size_m", "a_lat", "a_lon", "b_lat", "b_lon")


def _merge(frame: pd.DataFrame, starts, ends, states: list, *_) -> tuple[dict, list]:
    """Numbers of groups: a turn joins the one that stands before it if it is near; the larger of the two stands then."""
    groups, metres, turns, left = [], frame["at_m"].tolist(), frame["turn_deg"].tolist(), []
    for a, b, state in zip(starts.tolist(), ends.tolist(), states, strict=True):
        at, turn, group = state or (-np.inf, 0.0, 0)
        for m, deg in zip(metres[a:b], turns[a:b], strict=True):
            if m - at >= MERGE_M:
                at, turn, group = m, abs(deg), group + 1
            elif abs(deg) > turn:
                at, turn = m, abs(deg)
            groups.append(group)
        left.append([at, turn, group])
    return {"group": np.array(groups, np.int64)}, left


def route_maneuvers(placed: tuple[DataFrame, DataFrame], edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """``route_id, n, kind, at_m, lat, lon, name, turn_deg``: what a driver is told along a route, ``n`` from 0; ``placed`` is what
    ``placed_steps`` gave.

    ``depart`` and ``arrive`` are the ends (the first step's name, and null). Between them a step may end at a manoeuvre, if
    three edges or more touch the node there (an edge from a node to itself counts twice): the turn is that of the
    directions 10 m before and after; from 20 degrees it is slight, from 45 plain, from 135 sharp, from 170 a U-turn; below, a
    new name is ``continue``, and the rest nothing. Of manoeuvres less than 15 m after one that stands the larger turn stands,
    of equal ones the first. Routes without length are left out.
    """
    steps, pieces = placed
    route = Window.partitionBy("route_id")
    after = Window.partitionBy("route_id").orderBy("seq")
    s = steps.withColumns({"next": F.lead(F.struct("name", F.lit(1).alias("is"))).over(after), "total_m": F.max("end_m").over(route), "node": F.when(c("forward"), c("to_node")).otherwise(c("from_node"))}).where("total_m > 0")
    degree = edges.groupBy("edge_id").agg(F.min(F.struct("from_node", "to_node")).alias("v")).select(F.explode(F.array("v.from_node", "v.to_node")).alias("node")).groupBy("node").count().where("count >= 3").drop("count")
    inner = s.where("next IS NOT NULL").join(degree, "node", "left_semi").select("route_id", "seq", c("end_m").alias("at_m"), "total_m", c("next.name").alias("name"), (~c("name").eqNullSafe(c("next.name"))).alias("renamed"))
    end = lambda kind, m, name: F.struct(F.lit(kind).alias("kind"), m.alias("at_m"), name.alias("name"))
    ends = s.groupBy("route_id").agg(F.first("total_m").alias("total_m"), F.min_by(F.struct("name"), "seq").alias("f"))
    ends = ends.select("route_id", "total_m", F.inline(F.array(end(0, F.lit(0.0), c("f.name")), end(2, c("total_m"), F.lit(None).cast("string")))))
    asked = inner.withColumn("kind", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    asked = asked.withColumn("off", F.explode(F.when(c("kind") == 1, F.array(F.lit(-SAMPLE_M), F.lit(0.0), F.lit(SAMPLE_M))).otherwise(F.array(F.lit(0.0)))))
    asked = asked.withColumns({"here_m": c("at_m"), "at_m": F.greatest(F.lit(0.0), F.least("total_m", c("at_m") + c("off")))})
    found = last_at_or_before(asked, pieces, ["route_id"], "at_m", ["size_m", "a_lat", "a_lon", "b_lat", "b_lon"])
    t = F.least(F.lit(1.0), (c("at_m") - c("at")) / c("size_m"))
    found = found.select("route_id", "seq", "kind", "here_m", "name", "renamed", "off", *((c(f"a_{x}") + (c(f"b_{x}") - c(f"a_{x}")) * t).alias(x) for x in ("lat", "lon")))
    at = lambda off, x: F.max(F.when(c("off") == off, c(x)))
    d = found.groupBy("route_id", "seq", "kind").agg(F.first("here_m").alias("at_m"), F.first("name").alias("name"), F.first("renamed").alias("renamed"), *(at(o, x).alias(f"{n}_{x}") for o, n in ((-SAMPLE_M, "p"), (0.0, "h"), (SAMPLE_M, "q")) for x in ("lat", "lon")))
    turn = geo.angle_diff_deg(geo.bearing_deg(c("h_lat"), c("h_lon"), c("q_lat"), c("q_lon")), geo.bearing_deg(c("p_lat"), c("p_lon"), c("h_lat"), c("h_lon")))
    d = staged(d.withColumn("turn_deg", F.when(c("kind") == 1, turn)))
    size, side = F.abs("turn_deg"), F.when(c("turn_deg") > 0, "right").otherwise("left")
    told = d.where("kind = 1").withColumn("word", F.when(size < SLIGHT_DEG, F.when(c("renamed"), F.lit("continue"))).when(size < TURN_DEG, F.concat(F.lit("slight_"), side)).when(size < SHARP_DEG, side).when(size < U_TURN_DEG, F.concat(F.lit("sharp_"), side)).otherwise("u_turn"))
    told = carried(told.where("word IS NOT NULL"), "route_id", ["at_m", "seq"], ["at_m", "turn_deg"], _merge, "group long", piece, many=True)
    stands = Window.partitionBy("route_id", "group").orderBy(F.desc(size), "at_m", "seq")
    told = told.withColumn("__r", F.row_number().over(stands)).where("__r = 1")
    whole = d.where("kind <> 1").withColumn("word", F.when(c("kind") == 0, "depart").otherwise("arrive")).unionByName(told.select(*d.columns, "word"))
    n = F.row_number().over(Window.partitionBy("route_id").orderBy("kind", "at_m", "seq")) - 1
    return whole.select("route_id", n.alias("n"), c("word").alias("kind"), "at_m", c("h_lat").alias("lat"), c("h_lon").alias("lon"), "name", "turn_deg")


def route_tunnels(placed: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``route_id, from_m, to_m``: the stretches of a route in tunnels; those that touch are one."""
    w = Window.partitionBy("route_id").orderBy("seq")
    t = placed[0].where("tunnel").withColumn("new", F.coalesce(F.abs(c("start_m") - F.lag("end_m").over(w)) >= 1e-6, F.lit(True)).cast("int"))
    t = t.withColumn("group", F.sum("new").over(w))
    return t.groupBy("route_id", "group").agg(F.min("start_m").alias("from_m"), F.max("end_m").alias("to_m")).drop("group")


def _scales(lat):
    """Of places: what ``_north_east`` divides and multiplies by."""
    s = np.sin(np.radians(lat))
    w = 1 - geo.ECCENTRICITY_2 * s * s
    return w * np.sqrt(w), np.sqrt(w), np.cos(np.radians(lat))


def _north_east(lat0, lon0, scales, lat, lon):
    """Metres north and east of places, as ``geo.ned_between`` has them."""
    cubed, root, cos = scales
    turn = np.pi - (np.pi - np.radians(lon - lon0)) % (2 * np.pi)
    return np.radians(lat - lat0) * (geo.SEMI_MAJOR_M * (1 - geo.ECCENTRICITY_2)) / cubed, turn * geo.SEMI_MAJOR_M / root * cos


def _padded(arrays: list, fill: float) -> np.ndarray:
    out = np.full((len(arrays), max(map(len, arrays), default=0)), fill)
    for row, x in zip(out, arrays, strict=True):
        row[: len(x)] = x
    return out


def _follow(frame: pd.DataFrame, starts, ends, states: list, held: pd.DataFrame, first: list) -> tuple[dict, list]:
    """Progress fix by fix, of all drives of a batch together: each is held against its route's pieces near the progress."""
    total = len(frame)
    out = {n: np.full(total, np.nan) for n in ("along_m", "off_m", "remaining_m", "remaining_s", "next_in_m")} | {n: np.full(total, None, object) for n in ("off_route", "arrived", "next_kind")}
    left, fixes = [x or [0.0, 0, False] for x in states], [frame[x].to_numpy(float) for x in ("lat", "lon", "accuracy_m")]
    lines = held["polyline"].tolist()
    keys = sorted((i for i, row in enumerate(first) if row >= 0), key=lambda i: len(lines[first[i]]))
    while keys:  # drives with routes of about one length, as many as a table of their pieces may hold
        n = max(1, TOGETHER // len(lines[first[keys[-1]]]))
        keys, some = keys[:-n], keys[-n:]
        some.sort(key=lambda i: starts[i] - ends[i])
        own = held.iloc[[first[i] for i in some]]
        _follow_some(fixes, out, starts[some], (ends - starts)[some], own, some, left)
    return out, left


def _follow_some(fixes: list, out: dict, starts, counts, own: pd.DataFrame, some: list, left: list) -> None:
    """``_follow`` for drives in order of falling counts of fixes: the first fixes of all, then the second ones, and so on."""
    routes = [np.asarray(x, float).reshape(-1, 2) for x in own["polyline"]]
    size = np.array([len(x) - 1 for x in routes])
    a_lat, a_lon, b_lat, b_lon = (_padded([x[cut, j] for x in routes], 0.0) for cut in (slice(None, -1), slice(1, None)) for j in (0, 1))
    scales = _scales(a_lat)
    bn, be = _north_east(a_lat, a_lon, scales, b_lat, b_lon)
    square = bn * bn + be * be
    root, flat, whole = np.sqrt(square), square < 1e-9, np.maximum(square, 1e-9)
    number = np.arange(a_lat.shape[1])
    real = number < size[:, None]
    upto = np.concatenate([np.zeros((len(some), 1)), np.cumsum(np.where(real, root, 0.0), axis=1)], axis=1)
    length = upto[:, -1]
    upto[:, 1:][~real] = np.inf
    told = [x if x is not None else [] for x in own["told"]]
    told_m, told_n = _padded([[m["at_m"] for m in x] for x in told], np.inf), np.array([len(x) for x in told])
    duration = own["duration_s"].to_numpy(float)
    along, streak, gone = (np.array([left[i][j] for i in some], t) for j, t in enumerate((float, int, bool)))
    lat_of, lon_of, accuracy_of = fixes

    def piece_at(m, k):
        return np.clip((upto[:k] <= m[:, None]).sum(1) - 1, 0, size[:k] - 1)

    for j in range(int(counts[0])):
        k = int(np.searchsorted(-counts, -j, "left"))  # the drives that have more than j fixes
        at_row, each = starts[:k] + j, np.arange(k)
        lat, lon, accuracy, here = lat_of[at_row], lon_of[at_row], accuracy_of[at_row], along[:k]
        pn, pe = _north_east(a_lat[:k], a_lon[:k], tuple(x[:k] for x in scales), lat[:, None], lon[:, None])
        t = np.where(flat[:k], 0.0, np.clip((pn * bn[:k] + pe * be[:k]) / whole[:k], 0.0, 1.0))
        offs, ats = np.sqrt((pn - bn[:k] * t) ** 2 + (pe - be[:k] * t) ** 2), upto[:k, :-1] + root[:k] * t
        with np.errstate(invalid="ignore"):
            score = np.where(real[:k], offs + ALONG_PENALTY * np.abs(ats - here[:, None]), np.inf)
        lo, hi = piece_at(np.maximum(0.0, here - BACK_M), k), piece_at(np.minimum(length[:k], here + FORWARD_M), k)
        near = np.where((number >= lo[:, None]) & (number <= hi[:, None]), score, np.inf).argmin(1)
        far = score.argmin(1)  # anywhere on the route
        off = offs[each, near]
        best = np.where((off > OFF_M) & (offs[each, far] < off), far, near)
        off, at = offs[each, best], ats[each, best]
        on = off <= np.maximum(OFF_M, np.where(np.isnan(accuracy), 0.0, 2 * accuracy))
        streak[:k] = np.where(on, 0, streak[:k] + 1)
        gone[:k] = ~on & (gone[:k] | (streak[:k] >= OFF_FIXES))
        along[:k] = np.where(on, at, here)
        rest = np.maximum(0.0, length[:k] - along[:k])
        with np.errstate(invalid="ignore", divide="ignore"):
            seconds = np.where(length[:k] > 0, duration[:k] * (rest / length[:k]), 0.0)
        for name, x in (("along_m", along[:k]), ("off_m", off), ("off_route", gone[:k]), ("remaining_m", rest), ("remaining_s", seconds), ("arrived", rest < ARRIVED_M)):
            out[name][at_row] = x
        passed = (told_m[:k] <= (along[:k] + PASSED_M)[:, None]).sum(1)
        for i in np.flatnonzero(passed < told_n[:k]).tolist():
            out["next_kind"][at_row[i]], out["next_in_m"][at_row[i]] = told[i][passed[i]]["kind"], told_m[i, passed[i]] - along[i]
    for i, state in zip(some, zip(along.tolist(), streak.tolist(), gone.tolist(), strict=True), strict=True):
        left[i] = list(state)


def route_progress(fixes: DataFrame, routes: DataFrame, maneuvers: DataFrame, key: str = "drive_id", piece: int = PIECE) -> DataFrame:
    """Adds ``along_m, off_m, off_route, remaining_m, remaining_s, arrived, next_kind, next_in_m`` to fixes ``t_us, lat, lon,
    accuracy_m`` of drives on a planned route each (``key, polyline, duration_s``; manoeuvres ``key, at_m, kind``).

    A fix is projected on the route from 150 m behind the progress to 1,000 m ahead, where a metre between a place and the
    progress costs as much as 5 cm beside the road; if it is over 50 m off there and nearer to another part by the same
    measure, that counts. The progress follows unless the fix is farther off than 50 m or twice its accuracy; after three such
    fixes in a row the drive is off its route, until one is on it. ``remaining_s`` is the share of the duration; within
    30 m of the end it has arrived; the next manoeuvre is at least 5 m ahead. Only the progress goes from fix to fix, in
    pieces with carried state; a piece's task holds the drive's route once. Fixes of one time go by place. Fixes without a
    time or a finite place are left out; those of drives without a route of two points get nulls; of several routes of a
    drive the least counts.
    """
    drawn = "size(polyline) >= 4 AND NOT exists(polyline, x -> x IS NULL) AND duration_s IS NOT NULL"
    r = routes.where(drawn).groupBy(key).agg(F.min(F.struct("polyline", F.col("duration_s").cast("double").alias("duration_s"))).alias("v")).select(key, "v.*")
    told = maneuvers.where("at_m IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(c("at_m").cast("double").alias("at_m"), "kind"))).alias("told"))
    told = told.withColumnRenamed(key, "__k")
    beside = r.join(told, r[key].eqNullSafe(told["__k"]), "left").drop("__k")
    whole = fixes.where("t_us IS NOT NULL AND abs(lat) <= 90 AND abs(lon) < double('infinity')").withColumn("accuracy_m", c("accuracy_m").cast("double"))
    added = "along_m double, off_m double, off_route boolean, remaining_m double, remaining_s double, arrived boolean, next_kind string, next_in_m double"
    return carried(whole, key, ["t_us", "lat", "lon", "accuracy_m"], ["t_us", "lat", "lon", "accuracy_m"], _follow, added, piece, beside, many=True)
