"""Queries of planned routes and of drives along them, over whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routes as R
from ..session import read_table
from .demo import ROAD_POSITIONS, ROADS, road_positions, roads
from .queries_aggregates import rounded
from .queries_gnss import _apart
from .queries_sensors import _WRAP

c = F.col


def _streets(spark, sf):
    """The edges of ``roads`` in short blocks that aren't square."""
    at = lambda k: (F.lit(12.0) + F.floor(k / 50) * 0.00012 + k * 13 % 7 * 0.00002, F.lit(77.0) + k % 50 * 0.00012 + k * 11 % 5 * 0.00002)
    return roads(spark, sf).withColumn("polyline", F.array(*at(c("from_node")), *at(c("to_node"))))


def _steps(spark, sf):
    """From every part along six edges, one of them backwards; the first and the last not whole."""
    k = c("p_partkey")
    step = lambda n, edge, forward, start, end: F.struct(F.lit(n).alias("seq"), edge.alias("edge_id"), F.lit(forward).alias("forward"), F.lit(start).alias("from_along_m"), F.lit(end).alias("to_along_m"))
    path = [step(1, k * 2, True, 3.0, 100.0), step(2, k * 2 + 3, True, 0.0, 100.0), step(3, k * 2 + 102, True, 0.0, 100.0), step(4, k * 2 + 5, False, 100.0, 0.0), step(5, k * 2 + 4, True, 0.0, 100.0), step(6, k * 2 + 7, True, 0.0, 8.0)]
    return read_table(spark, sf, "part").select(k.alias("route_id"), F.inline(F.array(*path)))


def maneuvers(spark, sf):
    edges = _streets(spark, sf)
    d = R.route_maneuvers(R.placed_steps(_steps(spark, sf), edges), edges)
    return rounded(d.withColumns({"at_m": F.round("at_m", 3), "turn_deg": F.round("turn_deg", 3)}))


def tunnels(spark, sf):
    d = R.route_tunnels(R.placed_steps(_steps(spark, sf), _streets(spark, sf)))
    return d.select("route_id", F.round("from_m", 3).alias("from_m"), F.round("to_m", 3).alias("to_m"))


def _bearing(a, b):
    lat0, lon0, lat1, lon1 = f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon"
    s = f"(1 - 0.00669437999014::DOUBLE * pow(sin(radians({lat0})), 2))"
    return f"degrees(atan2(radians({lon1} - {lon0}) / sqrt({s}) * cos(radians({lat0})), radians({lat1} - {lat0}) * (1 - 0.00669437999014::DOUBLE) / ({s} * sqrt({s}))))"


_PLACED = f"""{ROADS}, nd AS (SELECT k, 12.0::DOUBLE + k // 50 * 0.00012::DOUBLE + k * 13 % 7 * 0.00002::DOUBLE AS lat, 77.0::DOUBLE + k % 50 * 0.00012::DOUBLE + k * 11 % 5 * 0.00002::DOUBLE AS lon FROM part2),
st AS (SELECT k AS r, seq, k * 2 + d AS edge_id, fwd, lo, hi FROM part2 CROSS JOIN (VALUES (1, 0, true, 3.0::DOUBLE, 100.0::DOUBLE), (2, 3, true, 0, 100), (3, 102, true, 0, 100), (4, 5, false, 0, 100), (5, 4, true, 0, 100), (6, 7, true, 0, 8)) v(seq, d, fwd, lo, hi)),
s0 AS (SELECT st.*, road.name, tunnel, from_node, to_node, a.lat AS y, a.lon AS x, b.lat AS y2, b.lon AS x2, {_apart("a.lat", "a.lon", "b.lat", "b.lon")} AS m, count(*) OVER (PARTITION BY r) AS found FROM st JOIN road USING (edge_id) JOIN nd a ON a.k = from_node JOIN nd b ON b.k = to_node),
s1 AS (SELECT *, lo / m AS t0, least(1, hi / m) AS t1 FROM s0 WHERE found = 6),
s2 AS (SELECT *, {{'lat': y + (y2 - y) * CASE WHEN fwd THEN t0 ELSE t1 END, 'lon': x + (x2 - x) * CASE WHEN fwd THEN t0 ELSE t1 END}} AS p, {{'lat': y + (y2 - y) * CASE WHEN fwd THEN t1 ELSE t0 END, 'lon': x + (x2 - x) * CASE WHEN fwd THEN t1 ELSE t0 END}} AS q FROM s1),
s3 AS (SELECT *, {_apart("p.lat", "p.lon", "q.lat", "q.lon")} AS size FROM s2),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY r ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin, sum(size) OVER (PARTITION BY r ORDER BY seq) AS upto FROM s3)"""
MANEUVERS = f"""WITH RECURSIVE {_PLACED},
dg AS (SELECT k FROM (SELECT from_node AS k FROM road UNION ALL SELECT to_node FROM road) GROUP BY k HAVING count(*) >= 3),
b AS (SELECT a.r, a.seq, a.upto AS at_m, z.name, z.name IS DISTINCT FROM a.name AS renamed, a.q AS h FROM s a JOIN s z ON z.r = a.r AND z.seq = a.seq + 1 WHERE CASE WHEN a.fwd THEN a.to_node ELSE a.from_node END IN (SELECT k FROM dg)),
o AS (SELECT b.*, off, at_m + off AS x FROM b CROSS JOIN (VALUES (-10), (10)) v(off)),
l AS (SELECT o.r, o.seq, off, arg_max({{'lat': p.lat + (q.lat - p.lat) * least(1, (o.x - begin) / size), 'lon': p.lon + (q.lon - p.lon) * least(1, (o.x - begin) / size)}}, s.seq) AS at FROM (SELECT o.r, o.seq, off, greatest(0, x) AS x FROM o) o JOIN s ON s.r = o.r AND begin <= o.x GROUP BY ALL),
t AS (SELECT b.*, {_WRAP(_bearing("b.h", "n.at") + " - " + _bearing("w.at", "b.h"))} AS turn FROM b JOIN l w ON w.r = b.r AND w.seq = b.seq AND w.off = -10 JOIN l n ON n.r = b.r AND n.seq = b.seq AND n.off = 10),
k AS (SELECT *, CASE WHEN abs(turn) < 20 THEN CASE WHEN renamed THEN 'continue' END WHEN abs(turn) >= 170 THEN 'u_turn' ELSE CASE WHEN abs(turn) < 45 THEN 'slight_' WHEN abs(turn) >= 135 THEN 'sharp_' ELSE '' END || CASE WHEN turn > 0 THEN 'right' ELSE 'left' END END AS kind FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY seq) AS i FROM k WHERE kind IS NOT NULL),
g AS (SELECT r, i, at_m AS m, abs(turn) AS turn, i AS stands, 1 AS n FROM c WHERE i = 1
  UNION ALL SELECT c.r, c.i, CASE WHEN c.at_m - m >= 15 OR abs(c.turn) > g.turn THEN c.at_m ELSE m END, CASE WHEN c.at_m - m >= 15 OR abs(c.turn) > g.turn THEN abs(c.turn) ELSE g.turn END, CASE WHEN c.at_m - m >= 15 OR abs(c.turn) > g.turn THEN c.i ELSE stands END, n + (c.at_m - m >= 15)::INT FROM g JOIN c ON c.r = g.r AND c.i = g.i + 1),
kept AS (SELECT r, n, arg_max(stands, i) AS i FROM g GROUP BY r, n),
a AS (SELECT r, 0 AS o, 'depart' AS kind, 0.0::DOUBLE AS at_m, p AS h, name, NULL::DOUBLE AS turn FROM s WHERE seq = 1 UNION ALL SELECT c.r, 1, kind, at_m, h, name, turn FROM c JOIN kept USING (r, i) UNION ALL SELECT r, 2, 'arrive', upto, q, NULL, NULL FROM s WHERE seq = 6)
SELECT r AS route_id, (row_number() OVER (PARTITION BY r ORDER BY o, at_m) - 1)::INT AS n, kind, round(at_m, 3) AS at_m, round(h.lat, 6) AS lat, round(h.lon, 6) AS lon, name, round(turn, 3) AS turn_deg FROM a"""
TUNNELS = f"""WITH {_PLACED}, t AS (SELECT r, seq, begin, upto, seq - row_number() OVER (PARTITION BY r ORDER BY seq) AS g FROM s WHERE tunnel)
SELECT r AS route_id, round(min(begin), 3) AS from_m, round(max(upto), 3) AS to_m FROM t GROUP BY r, g"""


def _there_and_back(spark, sf):
    """Positions of ``road_positions``; a third of the drives turn round after a kilometre, some leave their route."""
    u, n, far = c("drive_id"), c("seq"), 0.0096
    west = F.lit(77.0) + u % 20 / 1000.0
    gone = (c("lon") - west) * F.when(u % 3 == 0, 3).otherwise(1)
    back = (u % 3 == 0) & (gone > far)
    lat = c("lat") + F.when(back, 0.0004).otherwise(0.0) + F.when((u % 5 == 0) & n.between(5, 8), 0.0008).otherwise(0.0)
    return road_positions(spark, sf).select("drive_id", n.cast("long").alias("t_us"), lat.alias("lat"), (west + F.when(back, 2 * far - gone).otherwise(gone)).alias("lon"), (c("sigma_m") * F.when(u % 4 == 0, 3).otherwise(1)).alias("accuracy_m"))


def _planned(spark, sf):
    """A route for most customers: a kilometre east and, 44 m beside, back."""
    u = c("c_custkey")
    rows = read_table(spark, sf, "part").agg((F.floor(F.max("p_partkey") / 50) + 1).alias("rows"))
    lat = lambda j: F.lit(12.0) + u % c("rows") / 1000.0 + (0.0004 if j > 12 else 0.0) + j * j % 3 * 0.00005
    lon = lambda j: F.lit(77.0) + u % 20 / 1000.0 + (j if j <= 12 else 25 - j) * 0.0008
    at = [x for j in range(26) for x in (lat(j), lon(j))]
    d = read_table(spark, sf, "customer").where(u % 13 > 0).crossJoin(F.broadcast(rows))  # one row
    told = d.select(u.alias("drive_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n")).select("drive_id", (c("n") * 150.0 + c("drive_id") % 10).alias("at_m"), F.concat(F.lit("turn "), c("n").cast("string")).alias("kind"))
    return d.select(u.alias("drive_id"), F.array(*at).alias("polyline"), (F.lit(600.0) + u % 7 * 10).alias("duration_s")), told


def progress(spark, sf):
    d = R.route_progress(_there_and_back(spark, sf), *_planned(spark, sf))
    metres = [F.round(x, 3).alias(x) for x in ("along_m", "off_m", "remaining_m", "remaining_s", "next_in_m")]
    return d.select("drive_id", "t_us", *metres, "off_route", "arrived", "next_kind")


_NORTH = "6378137.0::DOUBLE * (1 - 0.00669437999014::DOUBLE) / pow(1 - 0.00669437999014::DOUBLE * pow(sin(radians(y)), 2), 1.5)"
_EAST = "6378137.0::DOUBLE / sqrt(1 - 0.00669437999014::DOUBLE * pow(sin(radians(y)), 2)) * cos(radians(y))"
_BEST = lambda lo, hi: f"list_min([{{'score': z.off + 0.05::DOUBLE * abs(z.at - along), 'i': z.i, 'off': z.off, 'at': z.at}} for z in l if z.i BETWEEN {lo} AND {hi}])"
_PIECE_AT = lambda m: f"greatest(0, len([z for z in l if z.begin <= {m}]) - 1)"
PROGRESS = f"""WITH RECURSIVE {ROAD_POSITIONS},
f0 AS (SELECT *, 77.0::DOUBLE + drive_id % 20 / 1000.0::DOUBLE AS west FROM pos),
f1 AS (SELECT *, (lon - west) * CASE WHEN drive_id % 3 = 0 THEN 3 ELSE 1 END AS gone FROM f0),
f AS (SELECT drive_id AS u, seq AS n, lat + CASE WHEN drive_id % 3 = 0 AND gone > 0.0096::DOUBLE THEN 0.0004::DOUBLE ELSE 0 END + CASE WHEN drive_id % 5 = 0 AND seq BETWEEN 5 AND 8 THEN 0.0008::DOUBLE ELSE 0 END AS lat,
        west + CASE WHEN drive_id % 3 = 0 AND gone > 0.0096::DOUBLE THEN 0.0192::DOUBLE - gone ELSE gone END AS lon, sigma_m * CASE WHEN drive_id % 4 = 0 THEN 3 ELSE 1 END AS acc FROM f1),
v AS (SELECT c_custkey AS u, j, 12.0::DOUBLE + c_custkey % rows / 1000.0::DOUBLE + CASE WHEN j > 12 THEN 0.0004::DOUBLE ELSE 0 END + j * j % 3 * 0.00005::DOUBLE AS y, 77.0::DOUBLE + c_custkey % 20 / 1000.0::DOUBLE + CASE WHEN j <= 12 THEN j ELSE 25 - j END * 0.0008::DOUBLE AS x
  FROM customer CROSS JOIN range(26) r(j) CROSS JOIN (SELECT max(p_partkey) // 50 + 1 AS rows FROM part) WHERE c_custkey % 13 > 0),
e0 AS (SELECT *, lead(y) OVER w AS y2, lead(x) OVER w AS x2 FROM v WINDOW w AS (PARTITION BY u ORDER BY j)),
e1 AS (SELECT u, j AS i, y, x, radians(y2 - y) * {_NORTH} AS bn, radians(x2 - x) * {_EAST} AS be FROM e0 WHERE y2 IS NOT NULL),
e AS (SELECT *, sqrt(bn * bn + be * be) AS m, coalesce(sum(sqrt(bn * bn + be * be)) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM e1),
tot AS (SELECT u, sum(m) AS total FROM e GROUP BY u),
p AS (SELECT f.u, n, i, begin, m, bn, be, radians(lat - y) * {_NORTH} AS pn, radians(lon - x) * {_EAST} AS pe FROM f JOIN e USING (u)),
q AS (SELECT *, greatest(0, least(1, (pn * bn + pe * be) / (m * m))) AS t FROM p),
fl AS (SELECT u, n, list({{'i': i, 'begin': begin, 'off': sqrt(pow(pn - bn * t, 2) + pow(pe - be * t, 2)), 'at': begin + m * t}} ORDER BY i) AS l FROM q GROUP BY u, n),
r AS (
  SELECT u, 0::BIGINT AS n, 0.0::DOUBLE AS along, 0 AS streak, false AS gone, NULL::DOUBLE AS off FROM tot
  UNION ALL
  SELECT u, n, CASE WHEN b.off <= reach THEN b.at ELSE along END, CASE WHEN b.off <= reach THEN 0 ELSE streak + 1 END, CASE WHEN b.off <= reach THEN false ELSE gone OR streak >= 2 END, b.off
  FROM (
    SELECT *, CASE WHEN near.off > 50 AND far.off < near.off THEN far ELSE near END AS b
    FROM (
      SELECT r.u, f.n, along, streak, gone, greatest(50, 2 * acc) AS reach, {_BEST(_PIECE_AT("along - 150").replace("along - 150", "greatest(0, along - 150)"), _PIECE_AT("along + 1000"))} AS near, {_BEST("0", "24")} AS far
      FROM r JOIN f ON f.u = r.u AND f.n = r.n + 1 JOIN fl ON fl.u = f.u AND fl.n = f.n) a) b2),
told AS (SELECT c_custkey AS u, k, k * 150.0::DOUBLE + c_custkey % 10 AS at_m FROM customer CROSS JOIN range(1, 9) g(k)),
nx AS (SELECT r.u, r.n, min(at_m) AS at_m, arg_min(k, at_m) AS k FROM r JOIN told ON told.u = r.u AND at_m > along + 5 GROUP BY r.u, r.n)
SELECT f.u AS drive_id, f.n AS t_us, round(along, 3) AS along_m, round(off, 3) AS off_m, round(rest, 3) AS remaining_m, round((600.0::DOUBLE + f.u % 7 * 10) * (rest / total), 3) AS remaining_s,
       round(nx.at_m - along, 3) AS next_in_m, gone AS off_route, rest < 30 AS arrived, 'turn ' || nx.k AS next_kind
FROM f LEFT JOIN (SELECT r.*, total, greatest(0, total - along) AS rest FROM r JOIN tot USING (u)) r ON r.u = f.u AND r.n = f.n LEFT JOIN nx ON nx.u = f.u AND nx.n = f.n"""

CASES = {"g09_route_maneuvers": (maneuvers, MANEUVERS), "g09_route_tunnels": (tunnels, TUNNELS), "g10_route_progress": (progress, PROGRESS)}
