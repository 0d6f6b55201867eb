"""Queries of road networks and of drives on them, over whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph as G
from ..operators import matching as M
from ..operators import noding as N
from ..operators import tiles as T
from ..session import read_table
from .demo import ROAD_POSITIONS, ROADS, road_positions, roads
from .queries_aggregates import rounded

c = F.col
_MER, _NOR = "6378137.0::DOUBLE * (1 - 0.00669437999014::DOUBLE) / pow(1 - 0.00669437999014::DOUBLE * pow(sin(radians(a_lat)), 2), 1.5)", "6378137.0::DOUBLE / sqrt(1 - 0.00669437999014::DOUBLE * pow(sin(radians(a_lat)), 2)) * cos(radians(a_lat))"


def _lines(spark, sf):
    """An edge for each order line, from its order's node to another of the same 16 nodes."""
    k = c("l_orderkey")
    block = F.floor(k / 16) * 16
    return read_table(spark, sf, "lineitem").select(k.alias("from_node"), (block + c("l_partkey") % (F.floor(k / 16) % 12 + 4)).alias("to_node"), (c("l_quantity").cast("double") + 1).alias("length_m"), (k % 4 == 0).alias("one_way"), (k % 5).alias("region"), F.when(k % 2 == 0, "primary").otherwise("residential").alias("class"), F.when(k % 3 > 0, F.lit("n")).alias("name"), F.when(k % 7 == 0, 13.9).alias("max_speed_mps"), (k % 10 == 1).alias("tunnel"))


_LINES = "edg AS (SELECT l_orderkey AS a, l_orderkey // 16 * 16 + l_partkey % (l_orderkey // 16 % 12 + 4) AS b, l_quantity::DOUBLE + 1 AS m, l_orderkey % 4 = 0 AS ow, l_orderkey % 5 AS region, CASE WHEN l_orderkey % 2 = 0 THEN 'primary' ELSE 'residential' END AS class, l_orderkey % 3 > 0 AS named, l_orderkey % 7 = 0 AS lim, l_orderkey % 10 = 1 AS tunnel FROM lineitem)"


def components(spark, sf):
    return G.connected_components(_lines(spark, sf))


_REACH = f"""WITH RECURSIVE {_LINES}, u AS (SELECT a, b FROM edg UNION SELECT b, a FROM edg), n AS (SELECT DISTINCT a AS node FROM u),
r(node, seen) AS (SELECT node, node FROM n UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen), comp AS (SELECT node, min(seen) AS component FROM r GROUP BY node)"""
COMPONENTS = f"{_REACH} SELECT node, component FROM comp"


def network_topology(spark, sf):
    return rounded(G.topology(_lines(spark, sf)))


TOPOLOGY = f"""{_REACH}, cn AS (SELECT count(*) AS n FROM comp GROUP BY component), dg AS (SELECT a, count(*) AS d FROM u WHERE a <> b GROUP BY a)
SELECT (SELECT sum(n)::BIGINT FROM cn) AS nodes, round((SELECT max(n) / sum(n) FROM cn), 6) AS largest_share, round((SELECT count(*) FILTER (d >= 3) FROM dg) / (SELECT sum(n) FROM cn), 6) AS junction_share, round((SELECT count(*) FILTER (d = 1) FROM dg) / (SELECT sum(n) FROM cn), 6) AS dead_end_share, round((SELECT avg(CASE WHEN ow THEN 1.0::DOUBLE ELSE 0 END) FROM edg), 6) AS one_way_share"""


def network_summary(spark, sf):
    return rounded(G.graph_summary(_lines(spark, sf)))


NET_SUMMARY = f"WITH {_LINES} SELECT region, class, count(*) AS edges, round(sum(m) / 1000, 6) AS km, count(*) FILTER (named) AS named, count(*) FILTER (lim) AS with_limit FROM edg GROUP BY region, class"


def coverage(spark, sf):
    return rounded(G.road_coverage(_lines(spark, sf), ("primary", "residential")))


COVERAGE = f"WITH {_LINES} SELECT region, count(*) AS lines, round(sum(CASE WHEN class = 'primary' THEN m / 1000 ELSE 0 END), 6) AS km_primary, round(sum(CASE WHEN class = 'residential' THEN m / 1000 ELSE 0 END), 6) AS km_residential, round(sum(CASE WHEN ow THEN m ELSE 0 END) / sum(m), 6) AS one_way_share, round(sum(CASE WHEN tunnel THEN m ELSE 0 END) / sum(m), 6) AS tunnel_share, round(sum(CASE WHEN named THEN m ELSE 0 END) / sum(m), 6) AS named_share FROM edg GROUP BY region"


def routes(spark, sf):
    """From every node to two others, at most 420 m."""
    pairs = read_table(spark, sf, "part").select(c("p_partkey").alias("origin"), F.explode(F.array(c("p_partkey") + 52, c("p_partkey") - 101)).alias("target"))
    return rounded(G.bounded_route_cost(roads(spark, sf), pairs, 420.0))


_FROM_ALL = """e AS (SELECT a, b, min(m) AS m FROM (SELECT from_node AS a, to_node AS b, length_m AS m FROM road WHERE ok UNION ALL SELECT to_node, from_node, length_m FROM road WHERE ok AND NOT one_way) GROUP BY a, b),
r(origin, node, cost) AS (SELECT k, k, 0::DOUBLE FROM part2 UNION SELECT r.origin, e.b, r.cost + e.m FROM r JOIN e ON r.node = e.a WHERE r.cost + e.m <= CAP), d AS (SELECT origin, node, min(cost) AS cost FROM r GROUP BY ALL)"""
ROUTES = f"""WITH RECURSIVE {ROADS}, {_FROM_ALL.replace("CAP", "420").replace("WHERE ok AND", "WHERE").replace("WHERE ok ", "")}, p AS (SELECT k AS origin, k + 52 AS target FROM part2 UNION ALL SELECT k, k - 101 FROM part2)
SELECT p.origin, p.target, round(cost, 6) AS cost FROM p LEFT JOIN d ON d.origin = p.origin AND d.node = p.target"""


def projected_routes(spark, sf):
    """Between places on edges: for every part and each of two others, for cars, at most 450 m."""
    k = c("p_partkey")
    other = F.explode(F.array(k * 2 + 102, k * 2 + 1, k * 2 - 3, k * 2))
    pairs = read_table(spark, sf, "part").select((k * 2).alias("from_edge"), (c("p_size") * 1.5).cast("double").alias("from_along_m"), other.alias("to_edge"), (F.lit(80.0) - c("p_size")).alias("to_along_m"), (F.lit(150.0) + k % 7 * 50).alias("cap"))
    return rounded(G.projected_route_m(roads(spark, sf), pairs, "cars").drop("cap"))


PROJECTED = f"""WITH RECURSIVE {ROADS.replace("a.z % 11 <> 0 AS cars", "a.z % 11 <> 0 AS ok")}, {_FROM_ALL.replace("CAP", "450")},
p AS (SELECT row_number() OVER () AS i, * FROM (SELECT k * 2 AS from_edge, z * 1.5::DOUBLE AS from_along_m, unnest([k * 2 + 102, k * 2 + 1, k * 2 - 3, k * 2]) AS to_edge, 80.0::DOUBLE - z AS to_along_m, 150.0::DOUBLE + k % 7 * 50 AS cap FROM part2)),
q AS (SELECT p.*, a.from_node AS af, a.to_node AS at_, a.length_m AS am, a.one_way AS ao, b.from_node AS bf, b.to_node AS bt, b.length_m AS bm, b.one_way AS bo FROM p JOIN road a ON a.edge_id = from_edge AND a.ok JOIN road b ON b.edge_id = to_edge AND b.ok),
x AS (SELECT i, cap, at_ AS leave, am - from_along_m AS head, bf AS enter, to_along_m AS tail FROM q UNION ALL SELECT i, cap, at_, am - from_along_m, bt, bm - to_along_m FROM q WHERE NOT bo UNION ALL SELECT i, cap, af, from_along_m, bf, to_along_m FROM q WHERE NOT ao UNION ALL SELECT i, cap, af, from_along_m, bt, bm - to_along_m FROM q WHERE NOT ao AND NOT bo),
w AS (SELECT i, min(head + cost + tail) AS route_m FROM x JOIN d ON d.origin = leave AND d.node = enter WHERE head + cost <= cap GROUP BY i)
SELECT p.from_edge, round(p.from_along_m, 6) AS from_along_m, p.to_edge, round(p.to_along_m, 6) AS to_along_m,
       round(CASE WHEN p.from_edge = p.to_edge THEN CASE WHEN q.i IS NOT NULL AND NOT (ao AND p.to_along_m - p.from_along_m < -1) THEN abs(p.to_along_m - p.from_along_m) END ELSE route_m END, 6) AS route_m
FROM p LEFT JOIN q USING (i) LEFT JOIN w USING (i)"""


def candidates(spark, sf):
    """Candidate roads of every position and the logarithm of their emission."""
    p = road_positions(spark, sf).withColumn("point_id", F.struct("drive_id", "seq"))
    e = roads(spark, sf)
    d = M.road_candidates(p, e, vehicle="cars").join(p.select("point_id", "sigma_m", "heading_deg", "speed_mps"), "point_id").join(e.select("edge_id", "one_way", "max_speed_mps"), "edge_id")
    log = M.emission(*(c(x) for x in ("perp_m", "sigma_m", "heading_deg", "speed_mps", "road_deg", "one_way", "max_speed_mps")))
    return d.select("point_id.drive_id", "point_id.seq", "edge_id", F.round("perp_m", 4).alias("perp_m"), F.round("along_m", 4).alias("along_m"), F.round(log, 4).alias("log"))


CANDIDATES = f"""WITH {ROADS}, {ROAD_POSITIONS},
m AS (SELECT *, {_MER} AS mer, {_NOR} AS nor FROM pos JOIN road ON cars AND lat BETWEEN least(a_lat, b_lat) - 0.002 AND greatest(a_lat, b_lat) + 0.002 AND lon BETWEEN least(a_lon, b_lon) - 0.002 AND greatest(a_lon, b_lon) + 0.002),
v AS (SELECT *, radians(b_lat - a_lat) * mer AS bn, radians(b_lon - a_lon) * nor AS be, radians(lat - a_lat) * mer AS pn, radians(lon - a_lon) * nor AS pe FROM m),
t AS (SELECT *, greatest(0, least(1, (pn * bn + pe * be) / (bn * bn + be * be))) AS t FROM v),
f AS (SELECT *, sqrt(pow(pn - bn * t, 2) + pow(pe - be * t, 2)) AS perp_m, sqrt(bn * bn + be * be) * t AS along_m, degrees(atan2(be, bn)) AS road_deg FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY drive_id, seq ORDER BY perp_m, edge_id) AS place FROM f WHERE perp_m <= least(300, 60 + 2 * sigma_m)),
h AS (SELECT *, abs(180 - ((180 - (heading_deg - road_deg)) % 360 + 360) % 360) AS forward FROM r WHERE place <= 8),
g AS (SELECT *, CASE WHEN speed_mps > 2 THEN CASE WHEN one_way THEN forward ELSE least(forward, 180 - forward) END END AS turned FROM h)
SELECT drive_id, seq::INT AS seq, edge_id, round(perp_m, 4) AS perp_m, round(along_m, 4) AS along_m,
       round(CASE WHEN turned IS NULL OR turned <= 90 - 1e-6 * 180 / pi() THEN -0.5 * pow(perp_m / greatest(sigma_m, 3), 2) - 0.5 * pow(coalesce(turned, 0) / 45, 2) - CASE WHEN speed_mps > max_speed_mps * 1.6 THEN 1 ELSE 0 END END, 4) AS log FROM g"""


def matched(spark, sf):
    return rounded(M.match_to_roads(road_positions(spark, sf), roads(spark, sf), vehicle="cars"))


def _loose(spark, sf):
    """A road line of three vertices for each part, a dozen to a block of some 200 m."""
    k = c("p_partkey")
    block = F.floor(k / 12)
    lat0, lon0 = F.lit(12.0) + F.floor(block / 40) * 0.003, F.lit(77.0) + block % 40 * 0.003
    at = lambda a, b: (lat0 + k * a % 11 * 0.0002, lon0 + k * b % 11 * 0.0002)
    return read_table(spark, sf, "part").select(k.alias("line_id"), F.array(*at(7, 5), *at(3, 8), *at(9, 2)).alias("polyline"), (c("p_size") % 4 == 0).alias("one_way"), (c("p_size") % 9 == 0).alias("elevated"))


def noded(spark, sf):
    """Pieces of all lines, with the number of points of each."""
    _, edges = N.node_road_lines(_loose(spark, sf), ref_lat=12.0)
    return rounded(edges.select("line_id", "piece", "from_node", "to_node", "one_way", F.size("polyline").alias("n_values"), geo.polyline_length_m(c("polyline")).alias("length_m")))


def crossed(spark, sf):
    """Where the parts' lines cross, in metres."""
    at = lambda i: F.element_at("polyline", i) * N.METRES_PER_DEGREE
    seg = lambda s: F.struct(F.lit(s).alias("seg"), at(2 * s + 2).alias("ax"), at(2 * s + 1).alias("ay"), at(2 * s + 4).alias("bx"), at(2 * s + 3).alias("by"))
    s = _loose(spark, sf).select("line_id", F.inline(F.array(seg(0), seg(1))))
    return N.crossings(s).select("line_a", "seg_a", "line_b", "seg_b", F.round("t", 4).alias("t"), F.round("u", 4).alias("u"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


CROSSED = """WITH l AS (SELECT p_partkey AS k, 12.0::DOUBLE + p_partkey // 12 // 40 * 0.003::DOUBLE AS lat0, 77.0::DOUBLE + p_partkey // 12 % 40 * 0.003::DOUBLE AS lon0 FROM part),
s AS (SELECT k, i AS seg, (lon0 + k * q[i + 1] % 11 * 0.0002::DOUBLE) * 111320.0::DOUBLE AS ax, (lat0 + k * p[i + 1] % 11 * 0.0002::DOUBLE) * 111320.0::DOUBLE AS ay, (lon0 + k * q[i + 2] % 11 * 0.0002::DOUBLE) * 111320.0::DOUBLE AS bx, (lat0 + k * p[i + 2] % 11 * 0.0002::DOUBLE) * 111320.0::DOUBLE AS by
  FROM (SELECT *, [7, 3, 9] AS p, [5, 8, 2] AS q FROM l) CROSS JOIN (VALUES (0), (1)) v(i)),
j AS (SELECT a.k AS line_a, a.seg AS seg_a, b.k AS line_b, b.seg AS seg_b, a.ax, a.ay, a.bx - a.ax AS ex, a.by - a.ay AS ey, b.bx - b.ax AS fx, b.by - b.ay AS fy, b.ax - a.ax AS hx, b.ay - a.ay AS hy
  FROM s a JOIN s b ON a.k < b.k AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) AND least(b.ax, b.bx) <= greatest(a.ax, a.bx) AND least(a.ay, a.by) <= greatest(b.ay, b.by) AND least(b.ay, b.by) <= greatest(a.ay, a.by)),
m AS (SELECT *, sqrt(ex * ex + ey * ey) AS la, sqrt(fx * fx + fy * fy) AS lb, ex * fy - ey * fx AS d FROM j),
t AS (SELECT *, (hx * fy - hy * fx) / d AS t, (hx * ey - hy * ex) / d AS u FROM m WHERE la * lb >= 1e-9 AND abs(d) >= 0.3 * la * lb)
SELECT line_a, seg_a, line_b, seg_b, round(t, 4) AS t, round(u, 4) AS u, round(ax + t * ex, 2) AS x, round(ay + t * ey, 2) AS y FROM t WHERE t * la >= 1.5 AND (1 - t) * la >= 1.5 AND u * lb >= 1.5 AND (1 - u) * lb >= 1.5"""


def clipped(spark, sf):
    """The parts of each line in the middle of its block."""
    block = F.floor(c("line_id") / 12)
    south, west = F.lit(12.00045) + F.floor(block / 40) * 0.003, F.lit(77.00045) + block % 40 * 0.003
    d = T.clip_to_box(_loose(spark, sf), south, west, south + 0.001, west + 0.001)
    return d.select("line_id", "piece", F.size("polyline").alias("n_values"), F.round(F.aggregate("polyline", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


CLIPPED = """WITH l AS (SELECT p_partkey AS k, 12.0::DOUBLE + p_partkey // 12 // 40 * 0.003::DOUBLE AS lat0, 77.0::DOUBLE + p_partkey // 12 % 40 * 0.003::DOUBLE AS lon0 FROM part),
g AS (SELECT k, i, lat0 + 0.00045::DOUBLE AS s, lon0 + 0.00045::DOUBLE AS w, lat0 + k * p[i + 1] % 11 * 0.0002::DOUBLE AS y, lon0 + k * q[i + 1] % 11 * 0.0002::DOUBLE AS x, lat0 + k * p[i + 2] % 11 * 0.0002::DOUBLE AS y2, lon0 + k * q[i + 2] % 11 * 0.0002::DOUBLE AS x2 FROM (SELECT *, [7, 3, 9] AS p, [5, 8, 2] AS q FROM l) CROSS JOIN (VALUES (0), (1)) v(i)),
d AS (SELECT *, y2 - y AS dy, x2 - x AS dx FROM g),
t AS (
  SELECT *, greatest(0, CASE WHEN dx > 0 THEN (w - x) / dx WHEN dx < 0 THEN (w + 0.001::DOUBLE - x) / dx END, CASE WHEN dy > 0 THEN (s - y) / dy WHEN dy < 0 THEN (s + 0.001::DOUBLE - y) / dy END) AS t0,
         least(1, CASE WHEN dx > 0 THEN (w + 0.001::DOUBLE - x) / dx WHEN dx < 0 THEN (w - x) / dx END, CASE WHEN dy > 0 THEN (s + 0.001::DOUBLE - y) / dy WHEN dy < 0 THEN (s - y) / dy END) AS t1 FROM d),
c AS (SELECT * FROM t WHERE t0 <= t1 AND (dx <> 0 OR x BETWEEN w AND w + 0.001::DOUBLE) AND (dy <> 0 OR y BETWEEN s AND s + 0.001::DOUBLE)),
j AS (SELECT a.*, NOT coalesce(a.t0 = 0 AND b.t1 = 1, false) AS fresh FROM c a LEFT JOIN c b ON b.k = a.k AND b.i = a.i - 1),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY k ORDER BY i) - 1 AS piece FROM j)
SELECT k AS line_id, piece::BIGINT AS piece, sum(CASE WHEN fresh THEN 4 ELSE 2 END)::INT AS n_values, round(sum(CASE WHEN fresh THEN y + t0 * dy + x + t0 * dx ELSE 0 END + y + t1 * dy + x + t1 * dx), 5) AS total FROM n GROUP BY k, piece"""

CASES = {
    "g04_bounded_routes": (routes, ROUTES), "g04_projected_routes": (projected_routes, PROJECTED), "g05_components": (components, COMPONENTS), "g05_topology": (network_topology, TOPOLOGY), "a25_graph_summary": (network_summary, NET_SUMMARY), "a26_road_coverage": (coverage, COVERAGE),
    "g02_node_lines": (noded, None), "g02_crossings": (crossed, CROSSED), "g03_clip_to_tile": (clipped, CLIPPED), "g06_candidates": (candidates, CANDIDATES), "g06_match": (matched, None),
}
