"""Queries of fault flags, ellipsoids and vibration lines over all order lines, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ellipsoid as E
from ..operators import flags as L
from ..operators import motion as M
from ..operators import vibration as V
from .demo import CHAN, channels
from .queries_aggregates import rounded
from .queries_gnss import _apart

c = F.col


def _predicted(spark, sf):
    """A fix for each row of a drive, a second apart, with what was predicted before it."""
    i, u = c("i"), c("trip_id")
    lat = F.lit(12.0) + i * 0.0001
    return channels(spark, sf).select(
        u.alias("drive_id"), (i.cast("long") * 1_000_000).alias("t_us"), lat.alias("lat"), F.lit(77.0).alias("lon"), (i * (u % 3) % 360).cast("double").alias("bearing_deg"), (c("speed_ms") + u % 5).alias("speed_mps"), (F.lit(4.0) + i % 5).alias("sigma_m"), (i % 7 > 0).alias("usable"),
        ((u % 3) * F.when(i % 7 == 1, 2).otherwise(1) + c("gx") * 4 + u % 4 * 0.2).alias("yaw_deg"), F.when(i % 23 > 0, lat + (c("ax") + u % 6 * 2) * 0.00001).alias("p_lat"), (F.lit(77.0) + c("ay") * 0.00002).alias("p_lon"), (F.lit(0.5) + i % 3).alias("p_sigma_m"), (F.lit(2.0) + c("speed_ms")).alias("p_mps"),
        (c("gz") * 100).alias("p_deg"), (c("gy") + F.when(i > 200, (u % 7) * 0.05).otherwise(0.0)).alias("accel_bias"), F.when(i % 11 > 0, c("gx") / 4 + F.when(i > 100 + u % 50, u % 3 * 0.02).otherwise(0.0)).alias("bias_x"), (c("gy") / 10).alias("bias_y"), F.lit(0.0).alias("bias_z"),
    )


def flags(spark, sf):
    return L.fault_flags(_predicted(spark, sf))


_WRAP = lambda x: f"(180 - ((180 - ({x})) % 360 + 360) % 360)"
_SIDED = lambda n, bound: f"nn = {n} AND abs(mean) >= {bound} AND CASE WHEN mean > 0 THEN up ELSE down END / {n}.0::DOUBLE >= 0.7"
#: The cumulated sum of the integrity detector goes from row to row here.
FLAGS = f"""WITH RECURSIVE {CHAN},
x AS (
  SELECT trip_id AS k, i, i * 1000000 AS t, 12.0::DOUBLE + i * 0.0001::DOUBLE AS lat, 77.0::DOUBLE AS lon, (i * (trip_id % 3) % 360)::DOUBLE AS b, speed_ms + trip_id % 5 AS v, 4.0::DOUBLE + i % 5 AS s, i % 7 > 0 AS usable,
         (trip_id % 3) * CASE WHEN i % 7 = 1 THEN 2 ELSE 1 END + gx * 4 + trip_id % 4 * 0.2::DOUBLE AS yaw, CASE WHEN i % 23 > 0 THEN 12.0::DOUBLE + i * 0.0001::DOUBLE + (ax + trip_id % 6 * 2) * 0.00001::DOUBLE END AS pla, 77.0::DOUBLE + ay * 0.00002::DOUBLE AS plo, 0.5::DOUBLE + i % 3 AS ps, 2.0::DOUBLE + speed_ms AS pv,
         gz * 100 AS pd, gy + CASE WHEN i > 200 THEN (trip_id % 7) * 0.05::DOUBLE ELSE 0 END AS ab, CASE WHEN i % 11 > 0 THEN gx / 4 + CASE WHEN i > 100 + trip_id % 50 THEN trip_id % 3 * 0.02::DOUBLE ELSE 0 END END AS bx, gy / 10 AS by_ FROM chan),
g AS (SELECT *, row_number() OVER w AS n, lag(t) OVER w AS t0, lag(b) OVER w AS b0, lag(v) OVER w AS v0, first_value(ab) OVER w AS ab0 FROM x WHERE usable AND pla IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY t)),
gy AS (SELECT k, t, (yaw - {_WRAP("b - b0")}) / ((t - t0) / 1000000.0::DOUBLE) AS r FROM g WHERE v > 3 AND v0 > 3),
g2 AS (SELECT *, count(*) OVER w AS nn, avg(r) OVER w AS mean, count(*) FILTER (r > 0) OVER w AS up, count(*) FILTER (r < 0) OVER w AS down FROM gy WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
a2 AS (SELECT *, count(*) OVER w AS nn, avg(r) OVER w AS mean, count(*) FILTER (r > 0) OVER w AS up, count(*) FILTER (r < 0) OVER w AS down FROM (SELECT k, t, ab - ab0 AS r FROM g) WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
z AS (SELECT k, n, t, {_apart("pla", "plo", "lat", "lon")} / sqrt(s * s + ps * ps) AS z FROM g),
q AS (SELECT k, n, t, greatest(0, z - 0.5) AS c FROM z WHERE n = 1 UNION ALL SELECT z.k, z.n, z.t, greatest(0, q.c + z.z - 0.5) FROM q JOIN z ON z.k = q.k AND z.n = q.n + 1),
m AS (SELECT *, radians(pla - lat) * 6378137.0::DOUBLE * (1 - 0.00669437999014::DOUBLE) / pow(1 - 0.00669437999014::DOUBLE * pow(sin(radians(lat)), 2), 1.5) AS no, radians(plo - lon) * 6378137.0::DOUBLE / sqrt(1 - 0.00669437999014::DOUBLE * pow(sin(radians(lat)), 2)) * cos(radians(lat)) AS ea FROM g WHERE pv >= 3),
l AS (SELECT k, t, ps, pv, no * cos(radians(pd)) + ea * sin(radians(pd)) AS al, abs(ea * cos(radians(pd)) - no * sin(radians(pd))) AS cr FROM m),
d AS (SELECT *, count(*) OVER w AS nn, avg(r) OVER w AS mean, count(*) FILTER (r > 0.15) OVER w AS up FROM (SELECT k, t, al / pv AS r FROM l WHERE al > 0 AND cr <= al * 0.4 AND al >= ps * 3) WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
j AS (SELECT k, t, sqrt(pow(bx - lag(bx) OVER w, 2) + pow(by_ - lag(by_) OVER w, 2)) AS j FROM x WHERE bx IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY t)),
f AS (
  SELECT k, 'gyro_bias' AS mechanism, t FROM g2 WHERE {_SIDED(20, 0.35)} UNION ALL SELECT k, 'accel_bias', t FROM a2 WHERE {_SIDED(10, 0.15)} UNION ALL SELECT k, 'integrity', t FROM q WHERE c > 15
  UNION ALL SELECT k, 'delay', t FROM d WHERE nn = 10 AND up >= 7 AND mean > 0.3 UNION ALL SELECT k, 'bias_jump', t FROM j WHERE j > 0.03)
SELECT k AS drive_id, mechanism, min(t) AS t_us FROM f GROUP BY k, mechanism"""


def _magnetic(spark, sf):
    """Samples around an ellipsoid of each supplier's own, a little off it."""
    a, b = c("i") * 0.7, c("i") * 0.31 + c("trip_id") % 7
    near = F.lit(1.0) + c("gx") / 10
    return channels(spark, sf).select(c("trip_id").alias("sensor_id"), (F.lit(30.0) * near * F.cos(a) * F.cos(b) + c("trip_id") % 9).alias("x"), ((F.lit(30.0) + c("trip_id") % 11) * near * F.cos(a) * F.sin(b) - 4).alias("y"), (F.lit(25.0) * near * F.sin(a) + 2).alias("z"))


def normals(spark, sf):
    s = E.normal_sums(_magnetic(spark, sf))
    return s.select("sensor_id", "n", *(F.round(c(x) / 1000, 3).alias(x) for x in ("s_pp", "s_pq", "s_px", "s_po", "s_xy", "s_zt", "s_pt", "s_ot")))


_MAGNETIC = "mag AS (SELECT trip_id AS sensor_id, 30.0::DOUBLE * (1 + gx / 10) * cos(i * 0.7::DOUBLE) * cos(i * 0.31::DOUBLE + trip_id % 7) + trip_id % 9 AS x, (30.0::DOUBLE + trip_id % 11) * (1 + gx / 10) * cos(i * 0.7::DOUBLE) * sin(i * 0.31::DOUBLE + trip_id % 7) - 4 AS y, 25.0::DOUBLE * (1 + gx / 10) * sin(i * 0.7::DOUBLE) + 2 AS z FROM chan)"
NORMALS = f"""WITH {CHAN}, {_MAGNETIC} SELECT sensor_id, count(*) AS n, round(sum(y * y * y * y) / 1000, 3) AS s_pp, round(sum(y * y * z * z) / 1000, 3) AS s_pq, round(sum(y * y * x) / 1000, 3) AS s_px, round(sum(y * y) / 1000, 3) AS s_po, round(sum(x * y) / 1000, 3) AS s_xy,
round(sum(z * -x * x) / 1000, 3) AS s_zt, round(sum(y * y * -x * x) / 1000, 3) AS s_pt, round(sum(-x * x) / 1000, 3) AS s_ot FROM mag GROUP BY sensor_id"""


def ellipsoids(spark, sf):
    return rounded(E.ellipsoid_fit(_magnetic(spark, sf)))


def _shaken(spark, sf):
    """50 samples a second for each tenth of the suppliers, with a line that follows the speed of a fix each second."""
    n = F.row_number().over(Window.partitionBy(c("trip_id") % 10).orderBy("trip_id", "i")) - 1
    d = channels(spark, sf).select((c("trip_id") % 10).alias("drive_id"), n.alias("n"), "az")
    speed = F.lit(8.0) + F.floor(c("n") / 1000) % 9
    return d.withColumns({"t_us": (c("n").cast("long") * 20_000), "speed_mps": speed, "z": c("az") + 2 * F.sin(c("n") / 50.0 * (speed / 2.1) * 2 * F.pi())})


def vibration(spark, sf):
    d = _shaken(spark, sf)
    return rounded(V.vibration_scale(V.vibration_lines(d), d.where("n % 50 = 0")))


def scales(spark, sf):
    """The scale learnt from lines that are given, with three fixes around each; no ratio is a short decimal, which two
    engines could round differently."""
    d = channels(spark, sf).select(c("trip_id").alias("drive_id"), (c("i").cast("long") * 5_000_000 + 4_000_000).alias("t_us"), (F.lit(5.0) + c("trip_id") % 13).alias("v"), "gx", "gy", "i")
    lines = d.select("drive_id", "t_us", (c("v") / (F.lit(2.0) + c("gx") * 3) + F.when(c("i") % 9 == 0, 3).otherwise(0)).alias("peak_hz"), F.lit(0.2).alias("bin_hz"))
    fixes = d.select("drive_id", "v", "gy", F.explode(F.array(*(c("t_us") - x for x in (3_300_000, 2_100_000, 900_000)))).alias("t_us")).select("drive_id", "t_us", ((c("v") + c("gy") * (c("t_us") % 1_000_000 / 400_000)) * 1.0488088481701516).alias("speed_mps"))
    return rounded(V.vibration_scale(lines, fixes).drop("bin_hz"))


SCALES = f"""WITH {CHAN}, d AS (SELECT trip_id AS drive_id, i, i * 5000000 + 4000000 AS t_us, 5.0::DOUBLE + trip_id % 13 AS v, gx, gy FROM chan),
o AS (SELECT *, v / (2.0::DOUBLE + gx * 3) + CASE WHEN i % 9 = 0 THEN 3 ELSE 0 END AS peak_hz, (v + gy * (700000 / 400000.0::DOUBLE)) * 1.0488088481701516::DOUBLE AS s1, (v + gy * (900000 / 400000.0::DOUBLE)) * 1.0488088481701516::DOUBLE AS s2, (v + gy * (100000 / 400000.0::DOUBLE)) * 1.0488088481701516::DOUBLE AS s3 FROM d),
m AS (SELECT *, (s1 + s2 + s3) / 3 AS mean, greatest(s1, s2, s3) - least(s1, s2, s3) AS change FROM o),
r AS (SELECT *, CASE WHEN mean BETWEEN 4 AND 45 AND change <= 0.04 * mean THEN mean / peak_hz END AS ratio FROM m),
w AS (SELECT *, list(ratio) OVER (PARTITION BY drive_id, ratio IS NULL ORDER BY t_us ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS l FROM r),
n AS (SELECT *, CASE WHEN ratio IS NOT NULL THEN list_aggregate(l, 'median') END AS med FROM w),
f AS (SELECT *, CASE WHEN ratio IS NOT NULL THEN list_filter(l, lambda x: abs(x - med) <= 0.08 * med) END AS near FROM n),
h AS (SELECT *, CASE WHEN len(near) > 0 THEN list_aggregate(near, 'avg') ELSE med END AS sc, CASE WHEN len(near) > 0 THEN list_aggregate(near, 'stddev_pop') / list_aggregate(near, 'avg') ELSE 1 END AS spr, len(l) >= 12 AND len(near) >= 0.8 * len(l) AS tr FROM f),
p AS (SELECT *, last_value(CASE WHEN ratio IS NOT NULL THEN sc END IGNORE NULLS) OVER q AS scale, last_value(CASE WHEN ratio IS NOT NULL THEN spr END IGNORE NULLS) OVER q AS spread, coalesce(last_value(CASE WHEN ratio IS NOT NULL THEN tr END IGNORE NULLS) OVER q, false) AS trusted FROM h WINDOW q AS (PARTITION BY drive_id ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN trusted AND scale * peak_hz BETWEEN 4 AND 45 THEN scale * peak_hz END AS speed_mps FROM p)
SELECT drive_id, t_us, round(peak_hz, 6) AS peak_hz, round(ratio, 6) AS ratio, round(scale, 6) AS scale, trusted, round(speed_mps, 6) AS speed_mps, round(CASE WHEN speed_mps IS NOT NULL THEN greatest(0.4, least(2.5, sqrt(pow(speed_mps * spread, 2) + pow(scale * 0.1::DOUBLE, 2)))) END, 6) AS sigma_mps FROM s"""


def yaw(spark, sf):
    d = channels(spark, sf).select(c("trip_id").alias("drive_id"), (c("i").cast("long") * 100_000 + c("i") % 3 * 7_000).alias("t_us"), "ax", "ay", "az", "gx", "gy", "gz")
    return rounded(M.yaw_rate_invariant(d).select("drive_id", "t_us", "yaw_rate", "wobble_deg", "handling"))


YAW = f"""WITH RECURSIVE {CHAN}, s AS (SELECT trip_id AS k, i, i * 100000 + i % 3 * 7000 AS t, ax, ay, az, gx, gy, gz FROM chan),
r AS (SELECT k, i, t, ax AS x, ay AS y, az AS z FROM s WHERE i = 0 UNION ALL
  SELECT k, i, t, x * a + ax * (1 - a), y * a + ay * (1 - a), z * a + az * (1 - a) FROM (SELECT s.*, r.x, r.y, r.z, exp(-((s.t - r.t) / 1000000.0::DOUBLE) / 2) AS a FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1) q),
u AS (SELECT r.k, r.t, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z, gx, gy, gz FROM r JOIN s ON s.k = r.k AND s.i = r.i),
w AS (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(z) OVER w AS fz FROM u WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW)),
o AS (SELECT k, t, -(gx * x + gy * y + gz * z) AS yaw, degrees(acos(greatest(-1, least(1, fx * x + fy * y + fz * z)))) AS wobble FROM w)
SELECT k AS drive_id, t AS t_us, round(yaw, 6) AS yaw_rate, round(wobble, 6) AS wobble_deg, wobble > 3 AS handling FROM o"""

CASES = {"w33_fault_flags": (flags, FLAGS), "a31_normal_sums": (normals, NORMALS), "a31_ellipsoid_fit": (ellipsoids, None), "w26_vibration": (vibration, None), "w26_scale": (scales, SCALES), "w30_yaw_rate": (yaw, YAW)}
