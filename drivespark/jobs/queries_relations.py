"""Queries of gates, splits, rules, joins, searches and road graphs over derived tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, tags
from ..operators import graph as G
from ..operators import joins as J
from ..operators import quality as Q
from ..session import read_table
from .demo import CHAN, TEL, channels, telemetry
from .queries_aggregates import rounded
from .queries_functions import r6

c = F.col


def _trips(spark, sf):
    s = read_table(spark, sf, "supplier")
    k = c("s_suppkey")
    return s.select(k.alias("trip_id"), (k % 4).cast("string").alias("category"), (c("s_nationkey") % 8).cast("string").alias("driver"), (k * 37 % 900 + 100).alias("valid_samples"), (k % 11 / 10.0).alias("speed_corr"), (k % 17 * 1.5).alias("max_speed_ms"), F.when(k % 9 == 0, "none").otherwise("own").alias("mount_source"), F.when(k % 5 == 0, "session").otherwise("own").alias("lag_source"))


_TRIP = """trip AS (SELECT s_suppkey AS trip_id, (s_suppkey % 4)::VARCHAR AS category, (s_nationkey % 8)::VARCHAR AS driver, s_suppkey * 37 % 900 + 100 AS valid_samples,
  concat_ws(',', CASE WHEN s_suppkey * 37 % 900 + 100 < 300 THEN 'too short' END, CASE WHEN s_suppkey % 11 / 10.0::DOUBLE < 0.8 THEN 'not the same drive' END, CASE WHEN s_suppkey % 17 * 1.5::DOUBLE < 1 THEN 'stationary' END, CASE WHEN s_suppkey % 9 = 0 THEN 'mount unknown' END) AS reasons, s_suppkey % 5 <> 0 AS own FROM supplier),
gate AS (SELECT *, reasons = '' AS included, reasons = '' AND own AS eval_eligible FROM trip)"""


def gate(spark, sf):
    return Q.trip_gate(_trips(spark, sf)).select("trip_id", F.array_join("reasons", ",").alias("reasons"), "included", "eval_eligible")


GATE = f"WITH {_TRIP} SELECT trip_id, reasons, included, eval_eligible FROM gate"
_SPLIT = f"""{_TRIP}, n AS (SELECT * FROM gate WHERE included), rest AS (SELECT *, sum(valid_samples) OVER (PARTITION BY category) AS al, count(*) OVER (PARTITION BY category) AS cn FROM n WHERE driver <> '3' AND category <> '2'),
v AS (SELECT trip_id, row_number() OVER (PARTITION BY category ORDER BY abs(valid_samples - al * 0.12::DOUBLE), trip_id) AS r FROM rest WHERE eval_eligible AND cn >= 2),
sp AS (SELECT trip_id, CASE WHEN driver = '3' OR category = '2' THEN CASE WHEN eval_eligible THEN 'test' ELSE 'dropped' END WHEN trip_id IN (SELECT trip_id FROM v WHERE r = 1) THEN 'val' ELSE 'train' END AS split FROM n)"""


def splits(spark, sf):
    return Q.assign_splits(Q.trip_gate(_trips(spark, sf)), ["3"], ["2"])


SPLITS = f"WITH {_SPLIT} SELECT trip_id, split FROM sp"


def closest(spark, sf):
    return Q.closest_to_target(Q.trip_gate(_trips(spark, sf))).select("category", "trip_id")


CLOSEST = f"WITH {_TRIP}, a AS (SELECT *, sum(valid_samples) OVER (PARTITION BY category) AS al, count(*) OVER (PARTITION BY category) AS cn FROM gate), v AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY abs(valid_samples - al * 0.12::DOUBLE), trip_id) AS r FROM a WHERE eval_eligible AND cn >= 2) SELECT category, trip_id FROM v WHERE r = 1"


def leaks(spark, sf):
    trips = Q.trip_gate(_trips(spark, sf))
    bad = Q.assign_splits(trips, ["3"], ["2"]).where("trip_id % 13 <> 0")
    return Q.leak_checks(bad.unionByName(bad.where("trip_id % 7 = 0").withColumn("split", F.lit("train"))), trips, ["3"])


LEAKS = f"""WITH {_SPLIT}, b AS (SELECT * FROM sp WHERE trip_id % 13 <> 0 UNION ALL SELECT trip_id, 'train' FROM sp WHERE trip_id % 13 <> 0 AND trip_id % 7 = 0)
SELECT 'in two splits' AS rule, (SELECT count(*) FROM (SELECT trip_id FROM b GROUP BY trip_id HAVING count(DISTINCT split) > 1)) AS violations UNION ALL
SELECT 'held-out driver trained on', (SELECT count(*) FROM b JOIN gate USING (trip_id) WHERE split IN ('train', 'val') AND driver = '3') UNION ALL SELECT 'no split', (SELECT count(*) FROM n WHERE trip_id NOT IN (SELECT trip_id FROM b))"""


def merged(spark, sf):
    t = telemetry(spark, sf)
    imu = t.where("k % 2 = 0").select(c("session_id").alias("drive_id"), c("t_us").alias("u"), c("speed").alias("a"))
    fix = t.where("k % 2 = 1").select(c("session_id").alias("drive_id"), c("t_us").alias("u"), "lat", "lon")
    return rounded(Q.merge_records(imu, fix))


MERGED = f"WITH {TEL} SELECT session_id AS drive_id, t_us AS u, CASE WHEN k % 2 = 0 THEN round(speed, 6) END AS a, CASE WHEN k % 2 = 1 THEN round(lat, 6) END AS lat, CASE WHEN k % 2 = 1 THEN round(lon, 6) END AS lon FROM tel"


def lines(spark, sf):
    ids = F.array(c("l_partkey") % 7, c("l_suppkey") % 5, c("l_linenumber") % 6)
    d = read_table(spark, sf, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("line_id"), ids.cast("array<long>").alias("place_ids"), (c("l_orderkey") % 2 == 0).alias("one_way"))
    return Q.distinct_lines(d.groupBy("line_id").agg(F.min("place_ids").alias("place_ids"), F.min("one_way").alias("one_way"))).select("line_id", "one_way")


LINES = """WITH l0 AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, min([l_partkey % 7, l_suppkey % 5, l_linenumber % 6]) AS ids, min(l_orderkey % 2 = 0) AS one_way FROM lineitem GROUP BY 1),
k AS (SELECT *, CASE WHEN one_way OR ids <= list_reverse(ids) THEN ids ELSE list_reverse(ids) END AS k FROM l0) SELECT min(line_id) AS line_id, one_way FROM k GROUP BY k, one_way"""


def _models(spark, sf):
    k = c("p_partkey")
    return read_table(spark, sf, "part").select(k.alias("id"), c("p_brand").alias("model_type"), (k % 90).cast("string").alias("version"), (k % 11 == 0).alias("is_active"), (k * 7919 % 10007).alias("uploaded_at"))


def registry(spark, sf):
    return Q.registry_violations(_models(spark, sf))


REGISTRY = """WITH m AS (SELECT p_brand AS t, p_partkey % 90 AS v, p_partkey % 11 = 0 AS a FROM part) SELECT t AS model_type, 'duplicate version' AS rule, count(*) AS n FROM (SELECT t, v FROM m GROUP BY t, v HAVING count(*) > 1) GROUP BY t
UNION ALL SELECT t, 'several active', count(*) FILTER (a) FROM m GROUP BY t HAVING count(*) FILTER (a) > 1"""


def storage_keys(spark, sf):
    return _models(spark, sf).select("id", Q.storage_key(c("model_type"), c("version")).alias("storage_key"))


STORAGE = "SELECT p_partkey AS id, 'models/' || regexp_replace(lower(trim(p_brand)), '[^a-z0-9._-]+', '-', 'g') || '/' || (p_partkey % 90) AS storage_key FROM part"


def upserted(spark, sf):
    t = telemetry(spark, sf).select("session_id", "t_us", "speed", "event_id")
    return rounded(Q.upsert(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1"), "session_id", "t_us").drop("event_id"))


UPSERTED = f"WITH {TEL} SELECT session_id, t_us, round(speed, 6) AS speed FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_us DESC, event_id % 2 DESC) AS r FROM tel) WHERE r = 1"


def seen(spark, sf):
    return Q.last_seen(telemetry(spark, sf), "session_id", "t_us")


SEEN = f"WITH {TEL} SELECT session_id, min(t_us) AS registered, max(t_us) AS last_seen FROM tel GROUP BY session_id"


def cascade(spark, sf):
    t = telemetry(spark, sf)
    return Q.cascade_delete(t, t.where("session_id % 3 = 0").select("session_id"), "session_id").select("event_id", "session_id")


CASCADE = f"WITH {TEL} SELECT event_id, session_id FROM tel WHERE session_id % 3 <> 0"


def ordered(spark, sf):
    return Q.ordered_telemetry(telemetry(spark, sf), 7).select("event_id", "t_us")


ORDERED = f"WITH {TEL} SELECT event_id, t_us FROM tel WHERE session_id = 7 ORDER BY t_us, event_id"


def search(spark, sf):
    f = read_table(spark, sf, "part").select(c("p_partkey").alias("place_id"), c("p_name").alias("name"), (c("p_size") * 11.5).alias("metres"))
    q = spark.range(3).select(c("id").alias("query_id"), F.element_at(F.array(F.lit("a"), F.lit("re"), F.lit("st")), (c("id") + 1).cast("int")).alias("query"))
    return Q.place_search(f, q, tags.match_tier(c("name"), c("query")), c("metres")).select("query_id", "place_id", "tier", "rank")


SEARCH = r"""WITH q(query_id, q) AS (VALUES (0, 'a'), (1, 're'), (2, 'st')), t AS (SELECT query_id, p_partkey AS place_id, p_size, CASE WHEN lower(p_name) = q THEN 0 WHEN starts_with(lower(p_name), q) THEN 1 WHEN regexp_matches(lower(p_name), '[\s,./-]' || q) THEN 2 WHEN contains(lower(p_name), q) THEN 3 END AS tier FROM part CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, p_size, place_id) AS rank FROM t WHERE tier IS NOT NULL) SELECT query_id::BIGINT AS query_id, place_id, tier, rank::INT AS rank FROM r WHERE rank <= 20"""


def latest(spark, sf):
    return Q.latest_active(_models(spark, sf)).select("model_type", "id")


LATEST = "SELECT model_type, id FROM (SELECT p_brand AS model_type, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 7919 % 10007 DESC, p_partkey DESC) AS r FROM part WHERE p_partkey % 11 = 0) WHERE r = 1"


def longest(spark, sf):
    return Q.longest_segment(channels(spark, sf).withColumn("seg_id", c("i") % 7 + F.floor(c("i") / 300)))


LONGEST = f"WITH {CHAN}, n AS (SELECT trip_id, i % 7 + i // 300 AS seg, count(*) AS rows FROM chan GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY rows DESC, seg) AS k FROM n) SELECT trip_id, seg AS seg_id, rows FROM r WHERE k = 1"


def asof(spark, sf):
    t = telemetry(spark, sf)
    fixes = t.where("k % 3 = 0").groupBy("session_id", "t_us").agg(F.max("lat").alias("lat"))
    return J.last_at_or_before(t.where("k % 3 <> 0").select("session_id", "t_us", "event_id"), fixes, ["session_id"], "t_us", ["lat"], 36_000_000_000.0).select("event_id", c("at").alias("fix_us"), r6(c("lat"), "lat"))


ASOF = f"WITH {TEL}, f AS (SELECT session_id, t_us, max(lat) AS lat FROM tel WHERE k % 3 = 0 GROUP BY ALL) SELECT e.event_id, CASE WHEN e.t_us - f.t_us <= 36000000000 THEN f.t_us END AS fix_us, CASE WHEN e.t_us - f.t_us <= 36000000000 THEN round(f.lat, 6) END AS lat FROM (SELECT * FROM tel WHERE k % 3 <> 0) e ASOF LEFT JOIN f ON e.session_id = f.session_id AND e.t_us >= f.t_us"


def aligned(spark, sf):
    d = channels(spark, sf)
    stream = d.where("i % 5 <> 2 AND i % 60 < 50").select("trip_id", "t", "ax", "speed_ms")
    return rounded(J.align_streams(d.select("trip_id", (c("t") + 0.02).alias("t")), stream, ["trip_id"], "t", ["ax"], ["speed_ms"]))


ALIGNED = f"""WITH {CHAN}, s AS (SELECT trip_id, t, ax, speed_ms FROM chan WHERE i % 5 <> 2 AND i % 60 < 50), g AS (SELECT trip_id, t + 0.02::DOUBLE AS t FROM chan),
b AS (SELECT g.trip_id, g.t, p.t AS pt, p.ax AS pa, p.speed_ms AS ps FROM g ASOF LEFT JOIN s p ON g.trip_id = p.trip_id AND g.t >= p.t), n AS (SELECT b.*, q.t AS nt, q.ax AS na, q.speed_ms AS ns FROM b ASOF LEFT JOIN s q ON b.trip_id = q.trip_id AND b.t <= q.t)
SELECT trip_id, round(t, 6) AS t, round(CASE WHEN pt IS NOT NULL AND nt IS NOT NULL AND nt - pt <= 0.35 THEN pa + (na - pa) * CASE WHEN nt > pt THEN (t - pt) / (nt - pt) ELSE 0 END WHEN pt IS NULL AND nt - t <= 0.05 THEN na WHEN nt IS NULL AND t - pt <= 0.05 THEN pa END, 6) AS ax,
  round(CASE WHEN pt IS NOT NULL AND nt IS NOT NULL AND nt - pt <= 0.35 THEN ps WHEN pt IS NULL AND nt - t <= 0.05 THEN ns WHEN nt IS NULL AND t - pt <= 0.05 THEN ps END, 6) AS speed_ms FROM n"""


def paired(spark, sf):
    d = channels(spark, sf)
    return rounded(J.row_pair_streams(d.where("i % 2 = 0").select("trip_id", "i", "ax"), d.where("i % 3 = 0").select("trip_id", "i", "gz"), ["trip_id"], "i"))


PAIRED = f"WITH {CHAN}, a AS (SELECT trip_id, i, ax, row_number() OVER (PARTITION BY trip_id ORDER BY i) AS row FROM chan WHERE i % 2 = 0), b AS (SELECT trip_id, i, gz, row_number() OVER (PARTITION BY trip_id ORDER BY i) AS row FROM chan WHERE i % 3 = 0) SELECT trip_id, row::INT AS row, a.i, round(a.ax, 6) AS ax, b.i AS b_i, round(b.gz, 6) AS b_gz FROM a JOIN b USING (trip_id, row)"


def known(spark, sf):
    b = telemetry(spark, sf).select("event_id", "session_id", F.floor(c("event_id") / 20).alias("batch_id"))
    ok, missing = J.known_session_filter(b, b.select("session_id").where("session_id % 40 <> 9").distinct())
    return ok.select("batch_id", "session_id", "event_id").unionByName(missing.select("batch_id", "session_id", F.lit(-1).cast("long").alias("event_id")))


KNOWN = "WITH b AS (SELECT event_id, user_id AS session_id, event_id // 20 AS batch_id FROM events), m AS (SELECT DISTINCT batch_id, session_id FROM b WHERE session_id % 40 = 9) SELECT batch_id, session_id, event_id FROM b WHERE batch_id NOT IN (SELECT batch_id FROM m) UNION ALL SELECT batch_id, session_id, -1 FROM m"


def seeded(spark, sf):
    n = read_table(spark, sf, "lineitem").select((c("l_suppkey") % 5).alias("region"), (c("l_partkey") % 400).alias("id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), (c("l_partkey") % 400 % 9).alias("points")).groupBy("region", "id", "seq").agg(F.max("points").alias("points"))
    return J.seed_segments(n, n.where("id % 10 = 0").select("region", "id")).groupBy("region", "action").agg(F.count("*").alias("n"))


SEEDED = """WITH n AS (SELECT DISTINCT l_suppkey % 5 AS region, l_partkey % 400 AS id, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY region, id ORDER BY seq) AS r FROM n)
SELECT region, CASE WHEN id % 9 < 2 THEN 'short' WHEN id % 10 = 0 THEN 'known' WHEN r > 1 THEN 'repeated' ELSE 'inserted' END AS action, count(*) AS n FROM r GROUP BY ALL"""


def _segments(spark, sf):
    k = c("p_partkey")
    lat, lon = F.lit(12.0) + k % 101 / 1000.0, F.lit(77.0) + k % 97 / 1000.0
    return read_table(spark, sf, "part").select(k.alias("edge_id"), lat.alias("a_lat"), lon.alias("a_lon"), (lat + (c("p_size") - 25) / 20000.0).alias("b_lat"), (lon + (k % 13 - 6) / 5000.0).alias("b_lon"))


_SEG = "seg AS (SELECT p_partkey AS edge_id, 12.0::DOUBLE + p_partkey % 101 / 1000.0::DOUBLE AS a_lat, 77.0::DOUBLE + p_partkey % 97 / 1000.0::DOUBLE AS a_lon, 12.0::DOUBLE + p_partkey % 101 / 1000.0::DOUBLE + (p_size - 25) / 20000.0::DOUBLE AS b_lat, 77.0::DOUBLE + p_partkey % 97 / 1000.0::DOUBLE + (p_partkey % 13 - 6) / 5000.0::DOUBLE AS b_lon FROM part)"
_MER, _NOR = "6378137.0::DOUBLE * (1 - 0.00669437999014::DOUBLE) / pow(1 - 0.00669437999014::DOUBLE * pow(sin(radians(a_lat)), 2), 1.5)", "6378137.0::DOUBLE / sqrt(1 - 0.00669437999014::DOUBLE * pow(sin(radians(a_lat)), 2)) * cos(radians(a_lat))"
_NEAR = f"""{_SEG}, pt AS (SELECT event_id AS point_id, lat + 0.0003::DOUBLE AS lat, lon + 0.0002::DOUBLE AS lon FROM tel), m AS (SELECT point_id, edge_id, lat, lon, a_lat, a_lon, b_lat, b_lon, {_MER} AS mer, {_NOR} AS nor FROM pt JOIN seg ON abs(lat - a_lat) < DELTA AND abs(lon - a_lon) < DELTA),
v AS (SELECT *, radians(b_lat - a_lat) * mer AS bn, radians(b_lon - a_lon) * nor AS be, radians(lat - a_lat) * mer AS pn, radians(lon - a_lon) * nor AS pe FROM m),
t AS (SELECT *, CASE WHEN bn * bn + be * be < 1e-9 THEN 0 ELSE greatest(0, least(1, (pn * bn + pe * be) / (bn * bn + be * be))) END AS t FROM v), f AS (SELECT point_id, edge_id, sqrt(pow(pn - bn * t, 2) + pow(pe - be * t, 2)) AS perp_m, sqrt(bn * bn + be * be) * t AS along_m FROM t)"""


def _points(spark, sf):
    return telemetry(spark, sf).select(c("event_id").alias("point_id"), (c("lat") + 0.0003).alias("lat"), (c("lon") + 0.0002).alias("lon"))


def nearby(spark, sf):
    d = J.nearby_edges(_points(spark, sf), _segments(spark, sf), 120.0, 4)
    return d.select("point_id", "edge_id", "rank", F.round("perp_m", 4).alias("perp_m"), F.round("along_m", 4).alias("along_m"))


NEARBY = f"WITH {TEL}, {_NEAR.replace('DELTA', '0.01')}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY perp_m, edge_id) AS rank FROM f WHERE perp_m <= 120) SELECT point_id, edge_id, rank::INT AS rank, round(perp_m, 4) AS perp_m, round(along_m, 4) AS along_m FROM r WHERE rank <= 4"


def nearest(spark, sf):
    d = J.nearest_roads(_points(spark, sf), _segments(spark, sf), 3, 1600.0)
    return d.where("rank <= 3").select("point_id", "edge_id", "rank", F.round("perp_m", 4).alias("perp_m"))


NEAREST = f"WITH {TEL}, {_NEAR.replace('DELTA', '0.03')}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY perp_m, edge_id) AS rank FROM f WHERE perp_m <= 1600) SELECT point_id, edge_id, rank::INT AS rank, round(perp_m, 4) AS perp_m FROM r WHERE rank <= 3"


def in_box(spark, sf):
    return J.roads_in_bbox(_segments(spark, sf), 12.0305, 77.0205, 12.0615, 77.0505).select("edge_id")


IN_BOX = f"""WITH {_SEG}, d AS (SELECT *, b_lat - a_lat AS dy, b_lon - a_lon AS dx FROM seg), t AS (SELECT *, CASE WHEN dx <> 0 THEN least((77.0205::DOUBLE - a_lon) / dx, (77.0505::DOUBLE - a_lon) / dx) ELSE CASE WHEN a_lon BETWEEN 77.0205 AND 77.0505 THEN 0 ELSE 2 END END AS x0, CASE WHEN dx <> 0 THEN greatest((77.0205::DOUBLE - a_lon) / dx, (77.0505::DOUBLE - a_lon) / dx) ELSE 1 END AS x1,
  CASE WHEN dy <> 0 THEN least((12.0305::DOUBLE - a_lat) / dy, (12.0615::DOUBLE - a_lat) / dy) ELSE CASE WHEN a_lat BETWEEN 12.0305 AND 12.0615 THEN 0 ELSE 2 END END AS y0, CASE WHEN dy <> 0 THEN greatest((12.0305::DOUBLE - a_lat) / dy, (12.0615::DOUBLE - a_lat) / dy) ELSE 1 END AS y1 FROM d)
SELECT edge_id FROM t WHERE greatest(0, x0, y0) <= least(1, x1, y1)"""


def way_nodes(spark, sf):
    li = read_table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey).alias("refs"))
    nodes = read_table(spark, sf, "part").where("p_partkey % 5 > 0").select(c("p_partkey").alias("id"), (c("p_partkey") / 100.0).alias("lat"), (c("p_size") / 10.0).alias("lon"))
    d = J.way_nodes_join(li, nodes)
    return d.select("id", F.size("coords").alias("points"), r6(F.element_at(F.element_at("coords", 1), 1), "first_lat"), r6(F.element_at(F.element_at("coords", -1), 2), "last_lon"))


WAY_NODES = "WITH r AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey, p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 5 > 0) SELECT id, count(*)::INT AS points, round(arg_min(l_partkey, (ln, l_partkey)) / 100.0::DOUBLE, 6) AS first_lat, round(arg_max(p_size, (ln, l_partkey)) / 10.0::DOUBLE, 6) AS last_lon FROM r GROUP BY id"


def attached(spark, sf):
    d = channels(spark, sf)
    p = d.where("i % 20 = 19").select("trip_id", "i", c("speed_ms").alias("label"), "pred_ms")
    rows, check = J.attach_predictions(d.select("trip_id", "i", "speed_ms"), p, ["trip_id", "i"], "speed_ms", "label")
    return rows.groupBy("trip_id").agg(F.count("*").alias("rows"), F.count("pred_ms").alias("with_pred")).crossJoin(check.select("labels", "met", "accepted"))


ATTACHED = f"WITH {CHAN} SELECT trip_id, count(*) AS rows, count(*) FILTER (i % 20 = 19) AS with_pred, (SELECT count(*) FROM chan WHERE i % 20 = 19) AS labels, (SELECT count(*) FROM chan WHERE i % 20 = 19) AS met, true AS accepted FROM chan GROUP BY trip_id"


def within(spark, sf):
    t = telemetry(spark, sf)
    return J.pair_within(t.where("k % 4 = 0"), t.where("k % 4 = 1"), "session_id", "t_us", 7_200_000_000)


WITHIN = f"WITH {TEL}, p AS (SELECT f.session_id, f.t_us AS fix_t, max(g.t_us) AS pred_t FROM tel f JOIN tel g ON f.session_id = g.session_id AND f.k % 4 = 0 AND g.k % 4 = 1 AND abs(f.t_us - g.t_us) <= 7200000000 GROUP BY ALL) SELECT session_id, pred_t, min(fix_t) AS fix_t FROM p GROUP BY session_id, pred_t"


def scripted(spark, sf):
    t = telemetry(spark, sf)
    w = t.groupBy("session_id").agg(F.min("t_us").alias("m")).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("session_id", "window_id", (c("m") + c("window_id") * 400_000_000_000).alias("start"), F.lit(250_000_000_000).alias("length"))
    return J.records_in_windows(t.select("session_id", "t_us", "event_id"), w, "session_id", "t_us").select("event_id", "window_id")


SCRIPTED = f"WITH {TEL}, m AS (SELECT session_id, min(t_us) AS m FROM tel GROUP BY session_id), w AS (SELECT session_id, x AS window_id, m + x * 400000000000 AS s FROM m CROSS JOIN (VALUES (0), (1), (2)) v(x)) SELECT event_id, window_id FROM tel JOIN w USING (session_id) WHERE t_us >= s AND t_us < s + 250000000000"


def descriptors(spark, sf):
    word = lambda k, i: (k * (7919 + i) * 1_000_003 + k * k * 31).cast("long")
    make = lambda k: F.array(*(word(k, i) for i in range(4)))
    q = read_table(spark, sf, "part").select(c("p_partkey").alias("query_id"), make(c("p_partkey") + 3).alias("descriptor"))
    a = read_table(spark, sf, "supplier").select(c("s_suppkey").alias("anchor_id"), make(c("s_suppkey") * 5).alias("descriptor"))
    return rounded(J.match_descriptors(q, a))


_WORD = lambda k, i: f"(({k})::BIGINT * {(7919 + i) * 1_000_003} + ({k})::BIGINT * ({k}) * 31)"
DESCRIPTORS = f"""WITH d AS (SELECT p_partkey AS query_id, s_suppkey AS anchor_id, 1 - ({' + '.join(f'bit_count(xor({_WORD("p_partkey + 3", i)}, {_WORD("s_suppkey * 5", i)}))::INT' for i in range(4))}) / 256.0::DOUBLE AS s FROM part CROSS JOIN supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, anchor_id) AS k FROM d) SELECT query_id, max(anchor_id) FILTER (k = 1) AS anchor_id, round(max(s) FILTER (k = 1), 6) AS best, round(max(s) FILTER (k = 2), 6) AS second FROM r WHERE k <= 2 GROUP BY query_id"""


def anchors(spark, sf):
    obs = telemetry(spark, sf).select("event_id", F.concat(F.lit("A"), c("k").cast("string")).alias("payload"), (c("event_type") == "error").alias("in_outage"), F.when(c("event_id") % 6 > 0, c("k") / 4.0).alias("sigma_m"), c("speed").alias("residual"))
    a = read_table(spark, sf, "nation").select(c("n_nationkey").alias("anchor_id"), F.concat(F.lit("A"), (c("n_nationkey") * 3).cast("string")).alias("payload"), (c("n_nationkey") % 4 * 5.0).alias("anchor_sigma_m"))
    return J.match_anchors(obs, a, c("residual")).select("event_id", "reason")


ANCHORS = f"""WITH {TEL} SELECT event_id, CASE WHEN n_nationkey IS NULL THEN 'unknown anchor' WHEN event_type <> 'error' THEN 'not in an outage' WHEN event_id % 6 = 0 THEN 'no estimate' WHEN speed > greatest(50, k + n_nationkey % 4 * 5) THEN 'too far' ELSE 'accepted' END AS reason FROM tel LEFT JOIN nation ON n_nationkey * 3 = k"""


CASES = {
    "q01_trip_gate": (gate, GATE), "q02_splits": (splits, SPLITS), "q03_leak_checks": (leaks, LEAKS), "q04_merge_records": (merged, MERGED), "q05_distinct_lines": (lines, LINES), "q06_registry_rules": (registry, REGISTRY), "q06_storage_keys": (storage_keys, STORAGE), "q07_upsert": (upserted, UPSERTED), "q07_last_seen": (seen, SEEN), "q08_cascade": (cascade, CASCADE),
    "t01_ordered_telemetry": (ordered, ORDERED), "t02_place_search": (search, SEARCH), "t03_latest_active": (latest, LATEST), "t04_closest_to_target": (closest, CLOSEST), "t05_longest_segment": (longest, LONGEST),
    "j01_align_streams": (aligned, ALIGNED), "j02_row_pairs": (paired, PAIRED), "j03_known_sessions": (known, KNOWN), "j04_seed_segments": (seeded, SEEDED), "j05_nearby_edges": (nearby, NEARBY), "j06_roads_in_bbox": (in_box, IN_BOX), "j07_nearest_roads": (nearest, NEAREST), "j08_way_nodes": (way_nodes, WAY_NODES), "j09_attach_predictions": (attached, ATTACHED), "j10_pair_within": (within, WITHIN), "j11_last_at_or_before": (asof, ASOF), "j12_records_in_windows": (scripted, SCRIPTED), "j13_match_anchors": (anchors, ANCHORS), "j14_match_descriptors": (descriptors, DESCRIPTORS),
}
