"""Planted answers and nulls of the column functions."""

import math

from pyspark.sql import functions as F

from drivespark.functions import geo, sensing, tags
from drivespark.operators import graph, series


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_null_stays_null(spark):
    none = F.lit(None).cast("double")
    north, east = geo.ned_between(none, F.lit(1.0), F.lit(1.0), F.lit(1.0))
    x, y = geo.tile_of(none, none, 10)
    got = one(spark, geo.haversine_m(none, F.lit(1.0), F.lit(1.0), F.lit(1.0)), north, x, y, sensing.pressure_height_m(none, F.lit(1000.0)), sensing.gnss_fix_quality(none)["score"], tags.parse_max_speed(F.lit(None).cast("string")), tags.carrier_band(none))
    assert all(v is None for v in got)


def test_distances(spark):
    a, b, c, d = (F.lit(v) for v in (12.0, 77.0, 12.01, 77.0))
    hav, bearing = one(spark, geo.haversine_m(a, b, c, d), geo.bearing_deg(a, b, c, d))
    assert abs(hav - 1111.95) < 0.1 and abs(bearing) < 1e-9
    # Over the date line it is a short way.
    assert one(spark, geo.horizontal_distance_m(F.lit(0.0), F.lit(179.9995), F.lit(0.0), F.lit(-179.9995)))[0] < 120
    w = one(spark, geo.wrap_pi(F.lit(-math.pi)), geo.wrap_pi(F.lit(math.pi)), geo.angle_diff_deg(F.lit(350.0), F.lit(10.0)))
    assert w[0] == w[1] == math.pi and w[2] == -20


def test_limits_and_tags(spark):
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    got = one(spark, tags.parse_max_speed(F.lit("60")), tags.parse_max_speed(F.lit("30 mph")), tags.parse_max_speed(F.lit("IN:urban")), tags.is_one_way(m(highway="motorway")), tags.is_one_way(m(highway="motorway", oneway="no")), tags.is_drivable(m(highway="footway"), F.array(F.lit(1), F.lit(2))))
    assert abs(got[0] - 16.6667) < 1e-3 and abs(got[1] - 13.4112) < 1e-6 and got[2] is None and got[3] and not got[4] and not got[5]
    import hashlib
    import hmac

    assert one(spark, tags.pseudonymise_id(F.lit("dev-1"), "k" * 80))[0] == hmac.new(b"k" * 80, b"dev-1", hashlib.sha256).hexdigest()


def test_road_graph_of_three_ways(spark):
    nodes = spark.createDataFrame([(1, 12.0, 77.0), (2, 12.001, 77.0), (3, 12.002, 77.0), (4, 12.001, 77.001), (5, 12.0, 77.002)], "id long, lat double, lon double")
    ways = spark.createDataFrame(
        [(10, [1, 2, 3], {"highway": "primary", "maxspeed": "60", "name": "Through"}), (11, [2, 4], {"highway": "residential"}), (12, [2, 5], {"highway": "footway"})], "id long, refs array<long>, tags map<string,string>"
    )
    used, edges = graph.build_road_graph(nodes, ways)
    assert sorted((r.from_node, r.to_node) for r in edges.collect()) == [(1, 2), (2, 3), (2, 4)]
    assert sorted(r.id for r in used.collect()) == [1, 2, 3, 4]
    assert abs(edges.where("way_id = 10").first().max_speed_mps - 16.6667) < 1e-3


def test_windows_of_segments(spark):
    rows = [("a", s, i / 10, 1.0, 0.0, 9.81, 5.0 + i) for s, n in ((0, 40), (1, 60), (2, 25), (3, 19)) for i in range(n)]
    d = spark.createDataFrame(rows, "trip_id string, seg_id int, t double, ax double, ay double, az double, speed_ms double").withColumn("norm_a", F.lit(9.81))
    got = {r.seg_id: r["count"] for r in series.make_windows(d, ["ax", "ay"], "speed_ms", stride=1).groupBy("seg_id").count().collect()}
    assert got == {0: 21, 1: 41, 2: 6}
