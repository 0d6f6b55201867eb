"""Queries of the column functions, each over a whole derived table, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, sensing, tags
from ..session import read_table
from .demo import CHAN, TEL, channels, telemetry

c = F.col


def r6(x, name):
    return F.round(x, 6).alias(name)


def r4(x, name):
    return F.round(x, 4).alias(name)


def _tel(columns):
    return lambda spark, sf: telemetry(spark, sf).select("event_id", *columns())


_PREV = f"WITH {TEL}, p AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY t_us, event_id))"


def _previous(spark, sf):
    w = Window.partitionBy("session_id").orderBy("t_us", "event_id")
    return telemetry(spark, sf).withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)})


_RADII = "6378137.0::DOUBLE * (1 - 0.00669437999014::DOUBLE) / pow(1 - 0.00669437999014::DOUBLE * pow(sin(radians(lat0)), 2), 1.5)", "6378137.0::DOUBLE / sqrt(1 - 0.00669437999014::DOUBLE * pow(sin(radians(lat0)), 2))"
_NED = f", n AS (SELECT *, radians(lat - lat0) * {_RADII[0]} AS north, radians(lon - lon0) * {_RADII[1]} * cos(radians(lat0)) AS east FROM p)"


def haversine(spark, sf):
    return _previous(spark, sf).select("event_id", r4(geo.haversine_m(c("lat0"), c("lon0"), c("lat"), c("lon")), "step_m"), r4(geo.haversine_m(c("lat0"), c("lon0"), c("lat"), c("lon"), geo.BACKEND_RADIUS_M), "backend_m"))


_HAV = "2 * {r}::DOUBLE * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))"
HAVERSINE = f"{_PREV} SELECT event_id, round({_HAV.format(r='6371008.8')}, 4) AS step_m, round({_HAV.format(r='6378137.0')}, 4) AS backend_m FROM p"


def local_displacement(spark, sf):
    d = _previous(spark, sf)
    north, east = geo.ned_between(c("lat0"), c("lon0"), c("lat"), c("lon"))
    back_lat, back_lon = geo.add_ned(c("lat0"), c("lon0"), north, east)
    return d.select("event_id", r4(north, "north_m"), r4(east, "east_m"), F.round(geo.horizontal_distance_m(c("lat0"), c("lon0"), c("lat"), c("lon")), 3).alias("dist_m"), r4(back_lat, "lat"), r4(back_lon, "lon"))


DISPLACEMENT = f"{_PREV}{_NED} SELECT event_id, round(north, 4) AS north_m, round(east, 4) AS east_m, round(sqrt(north * north + east * east), 3) AS dist_m, CASE WHEN lat0 IS NOT NULL THEN round(lat, 4) END AS lat, CASE WHEN lat0 IS NOT NULL THEN round(lon, 4) END AS lon FROM n"


def enu(spark, sf):
    east, north = geo.latlon_to_enu(c("lat"), c("lon"), F.lit(12.0), F.lit(77.0))
    lat, lon = geo.enu_to_latlon(east, north, F.lit(12.0), F.lit(77.0))
    return telemetry(spark, sf).select("event_id", r6(east, "east_m"), r6(north, "north_m"), r6(lat, "lat"), r6(lon, "lon"))


ENU = f"WITH {TEL} SELECT event_id, round(radians(lon - 77) * 6378137.0::DOUBLE * cos(radians(12.0)), 6) AS east_m, round(radians(lat - 12) * 6378137.0::DOUBLE, 6) AS north_m, round(lat, 6) AS lat, round(lon, 6) AS lon FROM tel"

angles = _tel(lambda: [r6(geo.wrap_pi(F.radians(c("heading") * 3 - 500)), "wrapped"), r6(geo.wrap_360(c("heading") - 400), "turned"), r6(geo.angle_diff_deg(c("heading"), F.lit(200.5)), "diff"), r6(geo.compass_to_math_rad(c("heading")), "math_rad"), r6(geo.math_to_compass_deg(F.radians(c("heading"))), "compass")])
ANGLES = f"""WITH {TEL}, a AS (SELECT event_id, heading, radians(heading * 3 - 500) AS w, heading - 200.5 AS d, radians(90 - heading) AS m FROM tel)
SELECT event_id, round(pi() - ((pi() - w) - 2 * pi() * floor((pi() - w) / (2 * pi()))), 6) AS wrapped,
  round((heading - 400) - 360 * floor((heading - 400) / 360), 6) AS turned, round(180 - ((180 - d) - 360 * floor((180 - d) / 360)), 6) AS diff,
  round(pi() - ((pi() - m) - 2 * pi() * floor((pi() - m) / (2 * pi()))), 6) AS math_rad, round((90 - heading) - 360 * floor((90 - heading) / 360), 6) AS compass FROM a"""


def bearing(spark, sf):
    return _previous(spark, sf).select("event_id", r6(geo.bearing_deg(c("lat0"), c("lon0"), c("lat"), c("lon")), "bearing"))


BEARING = f"{_PREV}{_NED}, b AS (SELECT event_id, degrees(atan2(east, north)) AS d FROM n) SELECT event_id, round(d - 360 * floor(d / 360), 6) AS bearing FROM b"


def _lines(spark, sf):
    w = Window.partitionBy("session_id").orderBy("t_us", "event_id").rowsBetween(-3, 0)
    return telemetry(spark, sf).withColumn("line", F.flatten(F.collect_list(F.array("lat", "lon")).over(w)))


def polyline_length(spark, sf):
    return _lines(spark, sf).select("event_id", r4(geo.polyline_length_m(c("line")), "length_m"))


POLYLINE = f"""{_PREV}, s AS (SELECT session_id, event_id, t_us, {_HAV.format(r='6371008.8')} AS m FROM p),
q AS (SELECT event_id, m, lag(m, 1) OVER w AS m1, lag(m, 2) OVER w AS m2 FROM s WINDOW w AS (PARTITION BY session_id ORDER BY t_us, event_id))
SELECT event_id, round(coalesce(m2, 0) + coalesce(m1, 0) + coalesce(m, 0), 4) AS length_m FROM q"""


def segment_projection(spark, sf):
    w = Window.partitionBy("session_id").orderBy("t_us", "event_id")
    d = _previous(spark, sf).withColumns({"p_lat": F.lead("lat").over(w), "p_lon": F.lead("lon").over(w)})
    s = geo.project_point_to_segment(c("p_lat"), c("p_lon"), c("lat0"), c("lon0"), c("lat"), c("lon"))
    return d.where("p_lat IS NOT NULL AND lat0 IS NOT NULL").select("event_id", s.alias("s")).select("event_id", r4(c("s.perp_m"), "perp_m"), r4(c("s.along_m"), "along_m"), r4(c("s.foot_lat"), "foot_lat"), r4(c("s.foot_lon"), "foot_lon"))


PROJECTION = f"""WITH {TEL}, p AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lead(lat) OVER w AS p_lat, lead(lon) OVER w AS p_lon FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY t_us, event_id))
, r AS (SELECT *, {_RADII[0]} AS mer, {_RADII[1]} * cos(radians(lat0)) AS nor FROM p WHERE lat0 IS NOT NULL AND p_lat IS NOT NULL),
v AS (SELECT *, radians(lat - lat0) * mer AS bn, radians(lon - lon0) * nor AS be, radians(p_lat - lat0) * mer AS pn, radians(p_lon - lon0) * nor AS pe FROM r),
t AS (SELECT *, bn * bn + be * be AS sq, CASE WHEN bn * bn + be * be < 1e-9 THEN 0 ELSE greatest(0, least(1, (pn * bn + pe * be) / (bn * bn + be * be))) END AS t FROM v)
SELECT event_id, round(sqrt(pow(pn - bn * t, 2) + pow(pe - be * t, 2)), 4) AS perp_m, round(sqrt(sq) * t, 4) AS along_m,
  round(lat0 + degrees(bn * t / mer), 4) AS foot_lat, round(lon0 + degrees(be * t / nor), 4) AS foot_lon FROM t"""


def point_on_line(spark, sf):
    at = geo.point_at_distance(c("line"), F.array(F.lit(0.0), F.lit(40.0), F.lit(100.0), F.lit(100.0)), c("k") * 1.5 - 10.0)
    return _lines(spark, sf).where(F.size("line") == 8).select("event_id", at.alias("p")).select("event_id", F.round(c("p.lat"), 9).alias("lat"), F.round(c("p.lon"), 9).alias("lon"))


POINT = f"""WITH {TEL}, p AS (SELECT event_id, k, lag(lat, 3) OVER w AS a0, lag(lat, 2) OVER w AS a1, lag(lat) OVER w AS a2, lat AS a3, lag(lon, 3) OVER w AS o0, lag(lon, 2) OVER w AS o1, lag(lon) OVER w AS o2, lon AS o3
  FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY t_us, event_id)), d AS (SELECT *, greatest(0, least(100, k * 1.5::DOUBLE - 10)) AS m FROM p WHERE a0 IS NOT NULL)
SELECT event_id, round(CASE WHEN m >= 100 THEN a2 WHEN m >= 40 THEN a1 + (a2 - a1) * ((m - 40) / 60) ELSE a0 + (a1 - a0) * (m / 40) END, 9) AS lat,
  round(CASE WHEN m >= 100 THEN o2 WHEN m >= 40 THEN o1 + (o2 - o1) * ((m - 40) / 60) ELSE o0 + (o1 - o0) * (m / 40) END, 9) AS lon FROM d"""


def tiles(spark, sf):
    x, y = geo.tile_of(c("lat"), c("lon"), 15)
    lat, lon = geo.tile_corner(15, c("x"), c("y"))
    return telemetry(spark, sf).select("event_id", x.alias("x"), y.alias("y")).select("event_id", "x", "y", r6(lat, "corner_lat"), r6(lon, "corner_lon"))


TILES = f"""WITH {TEL}, t AS (SELECT event_id, floor((lon + 180) / 360 * 32768)::INT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768)::INT AS y FROM tel)
SELECT event_id, x, y, round(degrees(2 * atan(exp(pi() * (1 - 2.0::DOUBLE * y / 32768))) - pi() / 2), 6) AS corner_lat, round(x / 32768.0::DOUBLE * 360 - 180, 6) AS corner_lon FROM t"""


def cells(spark, sf):
    mx, my = geo.mercator_cell(c("lat"), c("lon"))
    gx, gy = geo.grid_cell(c("lat"), c("lon"), 60.0, 12.0)
    return telemetry(spark, sf).select("event_id", mx.alias("mx"), my.alias("my"), gx.alias("gx"), gy.alias("gy"))


CELLS = f"""WITH {TEL} SELECT event_id, floor(6378137.0::DOUBLE * radians(lon) / 250)::BIGINT AS mx, floor(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)) / 250)::BIGINT AS my,
  floor(lon * (6371008.8::DOUBLE * pi() / 180 * cos(radians(12.0)) / 60))::BIGINT AS gx, floor(lat * (6371008.8::DOUBLE * pi() / 180 / 60))::BIGINT AS gy FROM tel"""


def wallclock(spark, sf):
    text = F.when(c("k") % 7 == 0, F.lit("not a time")).otherwise(F.concat(F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss"), F.lit(":"), F.lpad((c("event_id") % 1000).cast("string"), 3, "0")))
    return telemetry(spark, sf).select("event_id", tags.parse_wallclock(text).alias("p")).select("event_id", r6(c("p.sec_of_day"), "sec_of_day"), "p.yyyymmdd")


WALLCLOCK = f"""WITH {TEL} SELECT event_id, CASE WHEN k % 7 <> 0 THEN round((t_us // 1000000) % 86400 + (event_id % 1000) / 1000.0::DOUBLE, 6) END AS sec_of_day,
  CASE WHEN k % 7 <> 0 THEN strftime(make_timestamp(t_us), '%Y%m%d')::INT END AS yyyymmdd FROM tel"""


def speed_limits(spark, sf):
    p = read_table(spark, sf, "part")
    raw = F.when(c("p_size") % 4 == 0, F.concat(c("p_size").cast("string"), F.lit(" mph"))).when(c("p_size") % 4 == 1, c("p_size").cast("string")).when(c("p_size") % 4 == 2, F.concat(c("p_size").cast("string"), F.lit("km/h"))).otherwise("IN:urban")
    return p.select("p_partkey", r6(tags.parse_max_speed(raw), "limit_mps"))


SPEED_LIMITS = "SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN p_size * 0.44704::DOUBLE WHEN 3 THEN NULL ELSE p_size * (1 / 3.6::DOUBLE) END, 6) AS limit_mps FROM part"


def _tagged(spark, sf):
    kinds = F.array(*map(F.lit, ("motorway", "primary_link", "living_street", "footway", "road")))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (c("p_partkey") % len(v) + 1).cast("int"))
    entry = lambda k, v: F.map_filter(F.create_map(F.lit(k), v), lambda _, x: x.isNotNull())
    highway = F.element_at(kinds, (c("p_size") % 5 + 1).cast("int"))
    t = F.map_concat(entry("highway", highway), entry("oneway", pick("yes", None, "-1", "no")), entry("motor_vehicle", pick(None, "no", "yes")), entry("motorcar", pick(None, "yes", None, None, None)), entry("access", pick(None, None, "private", None, None, None)))
    return read_table(spark, sf, "part").select("p_partkey", "p_name", "p_size", t.alias("tags"), F.sequence(F.lit(1), (c("p_size") % 4 + 1).cast("int")).alias("refs"))


def road_tags(spark, sf):
    t = c("tags")
    return _tagged(spark, sf).select("p_partkey", tags.road_class(t).alias("class"), tags.is_one_way(t).alias("one_way"), tags.is_reversed(t).alias("reversed"), F.array_join(tags.access_list(t), ",").alias("access"), tags.is_drivable(t, c("refs")).alias("drivable"))


_TAGS = """t AS (SELECT p_partkey, p_size, (['motorway', 'primary_link', 'living_street', 'footway', 'road'])[p_size % 5 + 1] AS hw, (['yes', NULL, '-1', 'no'])[p_partkey % 4 + 1] AS ow,
  ([NULL, 'no', 'yes'])[p_partkey % 3 + 1] AS mv, ([NULL, 'yes', NULL, NULL, NULL])[p_partkey % 5 + 1] AS mc, ([NULL, NULL, 'private', NULL, NULL, NULL])[p_partkey % 6 + 1] AS acc, p_size % 4 + 1 AS refs FROM part)"""
ROAD_TAGS = f"""WITH {_TAGS} SELECT p_partkey, CASE hw WHEN 'motorway' THEN 'motorway' WHEN 'primary_link' THEN 'primary' WHEN 'living_street' THEN 'residential' ELSE 'unclassified' END AS class,
  coalesce(ow IN ('yes', '-1'), false) OR (ow IS NULL AND hw = 'motorway') AS one_way, coalesce(ow = '-1', false) AS reversed,
  concat_ws(',', CASE WHEN coalesce(coalesce(mc, mv) <> 'no', true) THEN 'cars' END, CASE WHEN coalesce(mv <> 'no', true) THEN 'twoWheelers' END) AS access,
  hw <> 'footway' AND acc IS NULL AND refs >= 2 AS drivable FROM t"""


def imported_segments(spark, sf):
    coords = F.transform(c("refs"), lambda i: F.array(i.cast("double"), (i * 2).cast("double")))
    d = _tagged(spark, sf).select("p_partkey", tags.road_segment_from_way(c("p_partkey"), F.map_concat(c("tags"), F.create_map(F.lit("maxspeed"), F.concat(c("p_size").cast("string"), F.lit(" km/h")))), coords).alias("s"))
    return d.where("s IS NOT NULL").select("s.id", "s.name", "s.highway_type", "s.speed_limit_kmh", F.size("s.coordinates").alias("points"))


IMPORTED = f"WITH {_TAGS} SELECT p_partkey::VARCHAR AS id, 'OSM Way ' || p_partkey AS name, hw AS highway_type, p_size::INT AS speed_limit_kmh, refs::INT AS points FROM t WHERE hw <> 'footway' AND refs >= 2"


def wkt(spark, sf):
    coords = F.transform(F.sequence(F.lit(1), (c("p_size") % 3 + 1).cast("int")), lambda i: F.array((i + 0.5).cast("double"), (i + 10.25).cast("double")))
    return read_table(spark, sf, "part").select("p_partkey", tags.linestring_wkt(coords).alias("wkt"))


WKT = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'MULTILINESTRING((11.25 1.5, 12.25 2.5))' ELSE 'MULTILINESTRING((11.25 1.5, 12.25 2.5, 13.25 3.5))' END AS wkt FROM part"

valid_telemetry = _tel(lambda: [F.array_join(sensing.failed_telemetry_fields(c("lat") * 8, c("lon") * 2.4, c("speed") - 5, c("heading") + 10, c("confidence") + 0.3), ",").alias("failed")])
VALID = f"""WITH {TEL} SELECT event_id, concat_ws(',', CASE WHEN lat * 8 > 90 THEN 'latitude' END, CASE WHEN lon * 2.4::DOUBLE > 180 THEN 'longitude' END, CASE WHEN speed - 5 < 0 THEN 'speed' END,
  CASE WHEN heading + 10 >= 360 THEN 'heading' END, CASE WHEN confidence + 0.3::DOUBLE > 1 OR confidence + 0.3::DOUBLE < 0 THEN 'confidence' END) AS failed FROM tel"""


def features_13(spark, sf):
    return sensing.imu_features_13(channels(spark, sf)).select("trip_id", "i", *(r6(c(f), f) for f in sensing.FEATURES))


FEATURES_13 = f"""WITH {CHAN}, f AS (SELECT *, lag(ax) OVER w AS px, lag(ay) OVER w AS py, lag(az) OVER w AS pz FROM chan WINDOW w AS (PARTITION BY trip_id, seg_id ORDER BY t))
SELECT trip_id, i, round(ax, 6) AS ax, round(ay, 6) AS ay, round(az, 6) AS az, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz, round(sqrt(ax * ax + ay * ay + az * az), 6) AS norm_a,
  round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS norm_g, round(coalesce((ax - px) / 0.1, 0), 6) AS dax, round(coalesce((ay - py) / 0.1, 0), 6) AS day, round(coalesce((az - pz) / 0.1, 0), 6) AS daz,
  round(atan2(ax, sqrt(ay * ay + az * az)), 6) AS pitch, round(atan2(ay, az), 6) AS roll FROM f"""


def axis_remap(spark, sf):
    s = sensing.phone_to_vehicle(c("ax"), c("ay"), c("az"), c("gx"), c("gy"), c("gz"), c("trip_id") / 100.0)
    return channels(spark, sf).select("trip_id", "i", s.alias("s")).select("trip_id", "i", *(r6(c(f"s.{x}"), x) for x in ("ax", "ay", "az", "gx", "gy", "gz")))


AXIS_REMAP = f"""WITH {CHAN} SELECT trip_id, i, round(cos(trip_id / 100.0::DOUBLE) * ax + sin(trip_id / 100.0::DOUBLE) * ay, 6) AS ax, round(cos(trip_id / 100.0::DOUBLE) * ay - sin(trip_id / 100.0::DOUBLE) * ax, 6) AS ay,
  round(az, 6) AS az, round(gz, 6) AS gx, round(gx, 6) AS gy, round(gy, 6) AS gz FROM chan"""


def thermal(spark, sf):
    temp = F.when(c("i") % 5 > 0, c("i") % 40 + 0.5)
    return channels(spark, sf).select("trip_id", "i", sensing.thermal_correct(c("ax"), c("gx"), temp).alias("s")).select("trip_id", "i", r6(c("s.accel"), "accel"), r6(c("s.gyro"), "gyro"), "s.active")


THERMAL = f"""WITH {CHAN} SELECT trip_id, i, round(ax - CASE WHEN i % 5 > 0 THEN (i % 40 + 0.5::DOUBLE - 25) * 0.0015::DOUBLE ELSE 0 END, 6) AS accel,
  round(gx - CASE WHEN i % 5 > 0 THEN (i % 40 + 0.5::DOUBLE - 25) * 0.0008::DOUBLE ELSE 0 END, 6) AS gyro, i % 5 > 0 AS active FROM chan"""

pressure_height = _tel(lambda: [r6(sensing.pressure_height_m(c("speed") * 3 + 700, F.lit(1013.25)), "height_m")])
PRESSURE = f"WITH {TEL} SELECT event_id, round(CASE WHEN speed * 3 + 700 > 300 AND speed * 3 + 700 < 1100 THEN 44330.0::DOUBLE * (1 - pow((speed * 3 + 700) / 1013.25::DOUBLE, 1 / 5.255::DOUBLE)) END, 6) AS height_m FROM tel"

bands = _tel(lambda: [tags.carrier_band(F.element_at(F.array(F.lit(1176450000.0), F.lit(1575420000.0), F.lit(2492028000.0), F.lit(1227600000.0), F.lit(None).cast("double")), (c("event_id") % 5 + 1).cast("int"))).alias("band")])
BANDS = "SELECT event_id, (['L5', 'L1', 'S', '1227.6 MHz', NULL])[event_id % 5 + 1] AS band FROM events"


def name_tiers(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", tags.match_tier(c("p_name"), F.lit("Gr")).alias("tier"))


NAME_TIERS = r"""SELECT p_partkey, CASE WHEN lower(p_name) = 'gr' THEN 0 WHEN starts_with(lower(p_name), 'gr') THEN 1 WHEN regexp_matches(lower(p_name), '[\s,./-]gr') THEN 2 WHEN contains(lower(p_name), 'gr') THEN 3 END AS tier FROM part"""

mount = _tel(lambda: [sensing.mount_quality(F.when(c("k") % 3 > 0, c("k") / 5.0), c("k") % 10 == 0, c("k") / 80.0, F.when(c("k") % 4 > 0, c("k") * 1.2), c("confidence")).alias("m")])


def mount_quality(spark, sf):
    return mount(spark, sf).select("event_id", r6(c("m.overall"), "overall"), c("m.label").alias("label"), c("m.unstable").alias("unstable"))


MOUNT = f"""WITH {TEL}, m AS (SELECT event_id, k, CASE WHEN k % 10 = 0 THEN 20.0::DOUBLE WHEN k % 3 = 0 THEN 100.0::DOUBLE ELSE 100 * (1 - least(2.0::DOUBLE, k / 5.0::DOUBLE / 8) / 2) END AS st, 100 * (1 - least(1.0::DOUBLE, k / 80.0::DOUBLE)) AS vi,
  CASE WHEN k % 4 = 0 THEN 70.0::DOUBLE WHEN k * 1.2::DOUBLE < 15 OR k * 1.2::DOUBLE > 90 THEN 0 ELSE greatest(0, least(100, 100 * (1 - abs(k * 1.2::DOUBLE - 52.5) / 37.5))) END AS mg, 100 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence)) AS al FROM tel),
o AS (SELECT *, (st + vi + mg + al) / 4 AS overall FROM m)
SELECT event_id, round(overall, 6) AS overall, CASE WHEN overall >= 65 AND al < 50 THEN 'fair' WHEN overall >= 85 THEN 'excellent' WHEN overall >= 65 THEN 'good' WHEN overall >= 40 THEN 'fair' ELSE 'poor' END AS label,
  k % 10 = 0 OR (k % 3 > 0 AND k / 5.0::DOUBLE >= 8) AS unstable FROM o"""

_conf = _tel(lambda: [sensing.confidence_score(c("k") / 10.0, F.when(c("k") % 5 > 0, c("k") * 500), F.element_at(F.array(F.lit("DEAD_RECKONING_ONLY"), F.lit("DEGRADED"), F.lit("FUSION")), (c("event_id") % 3 + 1).cast("int"))).alias("s")])


def confidence(spark, sf):
    return _conf(spark, sf).select("event_id", "s.score", "s.band")


CONFIDENCE = f"""WITH {TEL}, s AS (SELECT event_id, greatest(0, least(100, floor(100 - k / 10.0::DOUBLE * 3 - CASE event_id % 3 WHEN 0 THEN CASE WHEN k % 5 > 0 THEN k * 500 / 1000.0::DOUBLE * 1.5 ELSE 0 END WHEN 1 THEN 10 ELSE 0 END + 0.5)))::INT AS score FROM tel)
SELECT event_id, score, CASE WHEN score >= 80 THEN 'reliable' WHEN score >= 50 THEN 'degraded' ELSE 'unreliable' END AS band FROM s"""


def fix_quality(spark, sf):
    return telemetry(spark, sf).select("event_id", sensing.gnss_fix_quality(c("k") * 1.5).alias("s")).select("event_id", r6(c("s.score"), "score"), c("s.class").alias("class"))


FIX_QUALITY = f"""WITH {TEL}, s AS (SELECT event_id, k * 1.5::DOUBLE AS a FROM tel), q AS (SELECT event_id, a, CASE WHEN a <= 8 THEN 1.0::DOUBLE WHEN a <= 20 THEN 1 - 0.25::DOUBLE * ((a - 8) / 12) WHEN a <= 50 THEN 0.75::DOUBLE - 0.3::DOUBLE * ((a - 20) / 30)
  ELSE 0.45::DOUBLE - 0.35::DOUBLE * least(1, (a - 50) / 70) END AS score FROM s)
SELECT event_id, round(score, 6) AS score, CASE WHEN score >= 0.9 AND a <= 8 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.45 THEN 'degraded' ELSE 'poor' END AS class FROM q"""


def pseudonyms(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", tags.pseudonymise_id(c("c_custkey").cast("string"), "demo-key").alias("pseudonym"))


_PAD = [bytes(b ^ p for b in b"demo-key".ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
PSEUDONYMS = f"SELECT c_custkey, sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || c_custkey::VARCHAR::BLOB))) AS pseudonym FROM customer"

CASES = {
    "p01_haversine": (haversine, HAVERSINE), "p02_ned_displacement": (local_displacement, DISPLACEMENT), "p03_enu": (enu, ENU), "p04_angles": (angles, ANGLES), "p05_bearing": (bearing, BEARING),
    "p06_polyline_length": (polyline_length, POLYLINE), "p07_segment_projection": (segment_projection, PROJECTION), "p08_point_at_distance": (point_on_line, POINT), "p09_tiles": (tiles, TILES), "p10_p11_cells": (cells, CELLS),
    "p12_wallclock": (wallclock, WALLCLOCK), "p13_speed_limits": (speed_limits, SPEED_LIMITS), "p14_road_tags": (road_tags, ROAD_TAGS), "p15_imported_segments": (imported_segments, IMPORTED), "p16_linestring_wkt": (wkt, WKT),
    "p17_valid_telemetry": (valid_telemetry, VALID), "p18_features_13": (features_13, FEATURES_13), "p19_axis_remap": (axis_remap, AXIS_REMAP), "p20_thermal": (thermal, THERMAL), "p21_pressure_height": (pressure_height, PRESSURE),
    "p22_carrier_band": (bands, BANDS), "p23_match_tier": (name_tiers, NAME_TIERS), "p24_mount_quality": (mount_quality, MOUNT), "p25_confidence": (confidence, CONFIDENCE), "p26_fix_quality": (fix_quality, FIX_QUALITY), "p27_pseudonyms": (pseudonyms, PSEUDONYMS),
}
