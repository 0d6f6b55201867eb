"""Queries of the operators on faults, stops, courses and audits over the derived rows, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration as K
from ..operators import faults as X
from ..operators.graph import dedup_places
from ..session import read_table
from .demo import CHAN, channels
from .queries_outages import _TRUTH, _fixes, _ned, rounded

c = F.col


def sensor_faults(spark, sf):
    i = c("i")
    kind = F.when(i % 3 == 0, "gyroscope").when(i % 3 == 1, "accelerometer").otherwise("magnetometer")
    still = F.floor(i / 200) % 2 == 0
    at = lambda x, k: F.when(i % 91 == 17, F.lit(float("nan"))).when(still, F.lit(k)).otherwise(c(x) * F.when(kind == "magnetometer", 9.0).otherwise(12.0))
    d = channels(spark, sf).select(c("trip_id").alias("drive"), kind.alias("sensor"), (i * 10_000 + F.floor(i / 70) * 600_000).cast("long").alias("t_us"), at("ax", 1.0).alias("x"), at("ay", 2.0).alias("y"), at("az", 3.0).alias("z"))
    return rounded(X.sensor_faults(d).select("drive", "sensor", "t_us", "magnitude", "noise", "fault", "stalls"))


_AT = "CASE WHEN i % 91 = 17 THEN NULL WHEN (i // 200) % 2 = 0 THEN {1}::DOUBLE ELSE {0} * CASE WHEN i % 3 = 2 THEN 9 ELSE 12 END END"
FAULTS = f"""WITH {CHAN}, s AS (SELECT trip_id AS drive, ['gyroscope', 'accelerometer', 'magnetometer'][i % 3 + 1] AS sensor, i * 10000 + (i // 70) * 600000 AS t, {_AT.format("ax", 1)} AS x, {_AT.format("ay", 2)} AS y, {_AT.format("az", 3)} AS z FROM chan),
m AS (SELECT *, sqrt(x * x + y * y + z * z) AS m, row_number() OVER w AS n, CASE WHEN x = lag(x) OVER w AND y = lag(y) OVER w AND z = lag(z) OVER w THEN 0 ELSE 1 END AS fresh, coalesce(lead(t) OVER w - t > 500000, false) AS stalls FROM s WINDOW w AS (PARTITION BY drive, sensor ORDER BY t)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY drive, sensor ORDER BY t) AS run, stddev_pop(m) OVER (PARTITION BY drive, sensor, m IS NULL ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sd FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY drive, sensor, run ORDER BY t) - 1 AS held, CASE WHEN m IS NOT NULL AND n >= 25 THEN sd END AS noise FROM r)
SELECT drive, sensor, t AS t_us, round(m, 6) AS magnitude, round(noise, 6) AS noise, CASE WHEN m IS NULL OR m > CASE sensor WHEN 'accelerometer' THEN 100 WHEN 'gyroscope' THEN 35 END THEN 'out_of_range' WHEN sensor = 'magnetometer' AND NOT m BETWEEN 15 AND 90 THEN 'magnetic_disturbance'
  WHEN held >= 50 AND NOT CASE sensor WHEN 'gyroscope' THEN m < 1e-4 WHEN 'accelerometer' THEN abs(m - 9.81) < 0.25 ELSE m BETWEEN 15 AND 90 END THEN 'frozen' WHEN noise > CASE sensor WHEN 'accelerometer' THEN 12 WHEN 'gyroscope' THEN 6 END THEN 'excessive_noise' ELSE 'none' END AS fault, stalls FROM k"""


def _stops(spark, sf):
    i = c("i")
    d = channels(spark, sf).select(c("trip_id").alias("drive"), (i * 100_000 + F.floor(i / 130) * 3_000_000).cast("long").alias("t_us"), (F.lit(9.81) + c("ax") * F.when(i % 60 < 25, 0.05).otherwise(1.0)).alias("magnitude"))
    return X.stop_intervals(X.stop_detection(d))


_SECOND = "(PARTITION BY drive ORDER BY t RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW)"
STOPS = f"""WITH {CHAN}, s AS (SELECT trip_id AS drive, i * 100000 + (i // 130) * 3000000 AS t, 9.81::DOUBLE + ax * CASE WHEN i % 60 < 25 THEN 0.05::DOUBLE ELSE 1 END AS m FROM chan),
q AS (SELECT *, stddev_pop(m) OVER {_SECOND} < 0.6 AS quiet, count(*) OVER {_SECOND} >= 3 AS many FROM s),
n AS (SELECT *, CASE WHEN quiet IS NOT DISTINCT FROM lag(quiet) OVER w THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY drive, many ORDER BY t)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY drive, many ORDER BY t) AS run FROM n), a AS (SELECT *, t - min(t) OVER (PARTITION BY drive, many, run) AS age FROM r),
z AS (SELECT *, CASE WHEN many AND quiet AND age >= 800000 THEN 1 WHEN many AND NOT quiet AND age >= 250000 THEN 0 END AS x FROM a),
g AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY drive ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS stop FROM z),
h AS (SELECT *, CASE WHEN stop = lag(stop) OVER (PARTITION BY drive ORDER BY t) THEN 0 ELSE 1 END AS turned FROM g), k AS (SELECT *, sum(turned) OVER (PARTITION BY drive ORDER BY t) AS part FROM h)
SELECT drive, min(t) AS start_us, max(t) AS end_us, count(*) AS samples FROM k WHERE stop = 1 GROUP BY drive, part"""


def courses(spark, sf):
    return rounded(X.gnss_course(_fixes(spark, sf)))


def _plane(a, b):
    return f"(({b}.lat - {a}.lat) * 111320)", f"(({b}.lon - {a}.lon) * 111320 * cos(radians({a}.lat)))"


def _metres(a, b):
    n, e = _plane(a, b)
    return f"sqrt({n} * {n} + {e} * {e})"


def _course(a, b):
    n, e = _plane(a, b)
    return f"degrees(atan2({e}, {n}))"


def _bend(a, b):
    return f"abs(degrees(atan2(sin(radians({a} - {b})), cos(radians({a} - {b})))))"


COURSES = f"""WITH {CHAN}, {_TRUTH}, g AS (SELECT drive, t_us AS t, lat, lon, accuracy_m AS acc FROM fx WHERE accuracy_m <= 30),
a AS (SELECT p.drive, p.t, max(q.t) AS anchor FROM g p JOIN g q ON q.drive = p.drive AND q.t BETWEEN p.t - 6000000 AND p.t WHERE {_metres("q", "p")} >= 20 GROUP BY ALL),
m AS (SELECT a.drive, a.t, a.anchor, min(q.t) AS mt FROM a JOIN g q ON q.drive = a.drive AND q.t BETWEEN (a.anchor + a.t) // 2 AND a.t GROUP BY ALL),
d AS (SELECT m.drive, m.t, m.anchor, {_metres("a", "p")} AS base, {_course("a", "p")} AS w, {_metres("a", "h")} AS h1, {_metres("h", "p")} AS h2, {_course("a", "h")} AS c1, {_course("h", "p")} AS c2, greatest(a.acc, p.acc) AS acc
  FROM m JOIN g a ON a.drive = m.drive AND a.t = m.anchor JOIN g p ON p.drive = m.drive AND p.t = m.t JOIN g h ON h.drive = m.drive AND h.t = m.mt WHERE m.anchor < m.t)
SELECT drive, t AS t_us, round(w - 360 * floor(w / 360), 6) AS course_deg, round(greatest(5, degrees(atan2(0.25::DOUBLE * acc * sqrt(2), base))), 6) AS sigma_deg FROM d
WHERE base / ((t - anchor) / 1e6::DOUBLE) >= 3 AND (h1 < 5 OR h2 < 5 OR greatest({_bend("c1", "w")}, {_bend("c2", "w")}) <= 20)"""


def effects(spark, sf):
    f, i = _fixes(spark, sf), c("i")
    specs = f.groupBy("drive").agg((F.min("t_us") + 40_000_000 + c("drive") % 9 * 1_000_000).alias("start_us")).withColumn("end_us", c("start_us") + 20_000_000)
    bad = f.where(i % 23 != 4).select("drive", "t_us", (c("lat") + F.greatest(i - 40, F.lit(0)) / 1e6).alias("lat"), "lon", F.when((i > 50) & ((i + c("drive")) % 13 == 2), F.concat(F.lit("m"), c("drive") % 3)).alias("mechanism"), ((i + c("drive")) % 37 != 11).alias("leads"))
    return rounded(X.fault_effect(f.where(i % 29 != 8), bad, specs), digits=3)


_GAP = _ned("k.lat", "k.lon", "b.lat", "b.lon")
EFFECTS = f"""WITH {CHAN}, {_TRUTH}, sp AS (SELECT drive, min(t_us) + 40000000 + drive % 9 * 1000000 AS start_us, min(t_us) + 60000000 + drive % 9 * 1000000 AS end_us FROM fx GROUP BY drive),
b AS (SELECT drive, t_us, lat + greatest(i - 40, 0) / 1e6::DOUBLE AS lat, lon, CASE WHEN i > 50 AND (i + drive) % 13 = 2 THEN 'm' || drive % 3 END AS mech, (i + drive) % 37 <> 11 AS leads FROM fx WHERE i % 23 <> 4), k AS (SELECT * FROM fx WHERE i % 29 <> 8),
d AS (SELECT b.drive, b.t_us, start_us, end_us, sqrt(pow({_GAP[0]}, 2) + pow({_GAP[1]}, 2)) AS e, b.t_us <= end_us + 8000000 AND NOT leads AS lost, CASE WHEN b.t_us <= end_us + 8000000 THEN coalesce(mech, CASE WHEN NOT leads THEN 'lost lead' END) END AS sign
  FROM b JOIN sp ON sp.drive = b.drive AND b.t_us >= start_us LEFT JOIN k ON k.drive = b.drive AND k.t_us = b.t_us)
SELECT drive, start_us, end_us, round(max(e), 3) AS max_error_m, round(arg_max(e, t_us) FILTER (e IS NOT NULL), 3) AS end_error_m, count(sign) > 0 AS detected, round((min(t_us) FILTER (sign IS NOT NULL) - start_us) / 1e6::DOUBLE, 3) AS latency_s, arg_min(sign, t_us) FILTER (sign IS NOT NULL) AS mechanism, NOT bool_or(lost) AS kept_leading FROM d GROUP BY drive, start_us, end_us"""


def outages(spark, sf):
    i = c("i")
    f = _fixes(spark, sf).withColumns({"accepted": ~c("mocked") & (i % 47 > 8), "est_lat": c("lat") + i % 5 / 100_000.0, "est_lon": c("lon")})
    return rounded(X.outage_events(f, keys=("drive",)), digits=3)


_LEN, _MISS = _ned("lat0", "lon0", "lat1", "lon1"), _ned("lat1", "lon1", "elat", "lon1")
OUTAGES = f"""WITH {CHAN}, {_TRUTH}, a AS (SELECT drive, t_us AS start_us, lead(t_us) OVER w AS end_us, lat AS lat0, lon AS lon0, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(lat + (i % 5) / 100000.0::DOUBLE) OVER w AS elat FROM fx WHERE NOT mocked AND i % 47 > 8 WINDOW w AS (PARTITION BY drive ORDER BY t_us)),
d AS (SELECT *, (end_us - start_us) / 1e6::DOUBLE AS s, sqrt(pow({_LEN[0]}, 2) + pow({_LEN[1]}, 2)) AS m, sqrt(pow({_MISS[0]}, 2) + pow({_MISS[1]}, 2)) AS e FROM a)
SELECT drive, start_us, end_us, round(s, 3) AS duration_s, round(m, 3) AS distance_m, round(e, 3) AS error_m FROM d WHERE s >= 5 AND m >= 25"""


def evidence(spark, sf):
    i = c("i")
    sats = F.transform(F.sequence(F.lit(1), i % 4), lambda k: F.struct((k + i % 5).alias("constellation"), (c("speed_ms") + k).alias("cn0")))
    d = channels(spark, sf).select(c("trip_id").alias("drive"), i.alias("t_us"), (i % 211 == 50).alias("raw"), (i % 17).alias("visible"), (i % 5).alias("raw_measurements"), (i % 3).alias("adr"), F.when(i % 4 > 0, sats).otherwise(F.slice(sats, 1, 0)).alias("satellites"))
    return rounded(X.receiver_evidence(d))


EVIDENCE = f"""WITH {CHAN}, k AS (SELECT unnest([1, 2, 3]) AS k), s AS (SELECT trip_id, sum(speed_ms + k) / count(*) AS cn0, bool_or(k + i % 5 = 7) AS navic FROM chan JOIN k ON k <= i % 4 GROUP BY trip_id)
SELECT c.trip_id AS drive, count(*) AS samples, bool_or(i % 211 = 50) AS raw_seen, coalesce(any_value(navic), false) AS navic_seen, max(i % 17) AS max_visible, max(i % 5) AS max_raw, max(i % 3) AS max_adr, round(any_value(cn0), 6) AS mean_cn0 FROM chan c LEFT JOIN s USING (trip_id) GROUP BY c.trip_id"""


def _audit(spark, sf):
    k, d = c("trip_id"), channels(spark, sf)
    bins = F.array(*(F.count_if(F.floor(c("speed_ms")) == b) for b in range(25)))
    a = d.groupBy("trip_id").agg(F.avg("speed_ms").alias("dt_ms"), F.stddev_pop("speed_ms").alias("dt_std_ms"), bins.alias("histogram"), F.count_if(c("gx") > 0.03).alias("gaps"), F.count_if(c("gx") > 0.04).alias("long_gaps"), F.max("pred_ms").alias("largest_gap_s"), F.count_if(c("gy") < 0).alias("backward_jumps"), F.count("*").alias("rows_phone"))
    return a.withColumns({
        "fix_interval_s": F.when(k % 7 != 3, k % 10 + 0.5), "rows_vbox": c("rows_phone") + k % 4 - 1, "start_offset_s": F.when(k % 5 != 2, (k % 11 - 5) * 0.7), "row_lag": k % 23 - 11, "lag": k % 9 - 4, "gps_lag_s": k % 6 * 0.5, "gps_corr": k % 50 / 50.0,
        "lag_source": F.when(k % 3 == 0, "own").when(k % 3 == 1, "session").otherwise("unverified"), "mode": F.when(k % 8 == 1, "row").otherwise("clock"),
    })


_AUDIT = f"""{CHAN}, au AS (SELECT trip_id, trip_id AS k, avg(speed_ms) AS dt_ms, stddev_pop(speed_ms) AS dt_std, count(*) FILTER (floor(speed_ms) BETWEEN 19 AND 20) AS inside, count(*) FILTER (floor(speed_ms) BETWEEN 0 AND 24) AS whole, count(*) FILTER (gx > 0.03) AS gaps, count(*) FILTER (gx > 0.04) AS long_gaps,
  max(pred_ms) AS largest, count(*) FILTER (gy < 0) AS back, count(*) AS n, CASE WHEN trip_id % 7 <> 3 THEN trip_id % 10 + 0.5::DOUBLE END AS fix FROM chan GROUP BY trip_id)"""


def sampling(spark, sf):
    return rounded(X.sampling_summary(_audit(spark, sf)))


SAMPLING = f"WITH {_AUDIT} SELECT round(median(dt_ms), 6) AS dt_ms, round(median(dt_std), 6) AS dt_std_ms, round(sum(inside)::DOUBLE / sum(whole)::DOUBLE, 6) AS share_in_band, sum(gaps)::BIGINT AS gaps, sum(long_gaps)::BIGINT AS long_gaps, round(max(largest), 6) AS largest_gap_s, sum(back)::BIGINT AS backward_jumps, median(fix) AS fix_interval_s, min(fix) AS fix_min_s, max(fix) AS fix_max_s, count(*) FILTER (fix <= 1.5) AS trips_1s_fixes, count(*) FILTER (fix >= 8.5) AS trips_9s_fixes FROM au"


def syncs(spark, sf):
    return rounded(X.sync_summary(_audit(spark, sf)))


SYNCS = f"""WITH {_AUDIT}, s AS (SELECT *, k % 4 - 1 AS dn, CASE WHEN k % 5 <> 2 THEN abs((k % 11 - 5) * 0.7::DOUBLE) END AS off, CASE WHEN k % 3 = 0 THEN abs(k % 23 - 11) * 0.1::DOUBLE END AS rl, CASE WHEN k % 3 = 0 THEN abs(k % 9 - 4) * 0.1::DOUBLE END AS cl, CASE WHEN k % 50 / 50.0::DOUBLE > 0.8 THEN k % 6 * 0.5::DOUBLE END AS gl FROM au)
SELECT count(*) FILTER (dn = 0) AS equal_rows, count(*) FILTER (dn <> 0) AS different_rows, max(abs(dn)) AS largest_row_difference, round(median(off), 6) AS start_offset_s, round(max(off), 6) AS max_start_offset_s, round(median(rl), 6) AS row_lag_s, round(max(rl), 6) AS max_row_lag_s, round(median(cl), 6) AS clock_lag_s, round(max(cl), 6) AS max_clock_lag_s,
  count(*) FILTER (k % 8 = 1) AS row_fallbacks, count(*) FILTER (k % 3 = 0) AS lags_own, count(*) FILTER (k % 3 = 1) AS lags_session, count(*) FILTER (k % 3 = 2) AS lags_unverified, median(gl) AS gps_lag_s, min(gl) AS gps_lag_min_s, max(gl) AS gps_lag_max_s, count(*) FILTER (k % 50 / 50.0::DOUBLE >= 0.8) AS gps_corr_high FROM s"""


def _plain_speed(x):
    """A linear predictor of speed and log variance, as a stand-in for a user's model."""
    return x @ [0.5, -0.25, 0.1], x[:, 0] * 0.2


def scored_windows(spark, sf):
    d = channels(spark, sf).select("trip_id", "i", F.array("ax", F.when(c("i") % 41 != 6, c("ay")), "az").alias("features"))
    return rounded(X.score_windows(d, _plain_speed, means=(0.1, 0.2, 9.8), scales=(2.0, 0.5, 0.4)).drop("features"))


SCORED = f"""WITH {CHAN}, z AS (SELECT trip_id, i, (ax - 0.1::DOUBLE) / 2 AS x, CASE WHEN i % 41 <> 6 THEN (ay - 0.2::DOUBLE) / 0.5::DOUBLE END AS y, (az - 9.8::DOUBLE) / 0.4::DOUBLE AS z FROM chan)
SELECT trip_id, i, round(0.5::DOUBLE * x - 0.25::DOUBLE * y + 0.1::DOUBLE * z, 6) AS speed_ms, round(CASE WHEN y IS NOT NULL THEN exp(x * 0.1::DOUBLE) END, 6) AS sigma_ms, round(CASE WHEN y IS NOT NULL THEN greatest(abs(x), abs(y), abs(z)) END, 6) AS z_max FROM z"""

def blackouts(spark, sf):
    f, i = _fixes(spark, sf), c("i")
    f = f.withColumn("run", F.floor(i / 60))
    part = f.where((i % 60 < 25) & (i % 3 != 1) & ((c("run") + c("drive")) % 6 != 2))
    plan = f.groupBy("drive", "run").agg((F.max_by("lat", "t_us") + 0.0003).alias("est_lat"), (F.max_by("lon", "t_us") - 0.0001).alias("est_lon"), F.when(c("run") % 4 != 3, F.min("lat")).alias("restored_lat"), F.min("lon").alias("restored_lon"))
    sigma = f.where(i % 60 < 25).select("drive", "run", "t_us", (F.lit(1.0) + i * 7 % 11).alias("sigma_m"))
    return rounded(X.simulated_outage_score(plan, part, sigma, ("drive", "run")), digits=3)


BLACKOUTS = f"""WITH {CHAN}, {_TRUTH}, g AS (SELECT *, i // 60 AS run FROM fx),
pl AS (SELECT drive, run, arg_max(lat, t_us) + 0.0003::DOUBLE AS ela, arg_max(lon, t_us) - 0.0001::DOUBLE AS elo, CASE WHEN run % 4 <> 3 THEN min(lat) END AS rla, min(lon) AS rlo FROM g GROUP BY drive, run),
w AS (SELECT *, first_value(lat) OVER o AS lat0, lag(lat) OVER o AS pa, lag(lon) OVER o AS po FROM g WHERE i % 60 < 25 AND i % 3 <> 1 AND (run + drive) % 6 <> 2 WINDOW o AS (PARTITION BY drive, run ORDER BY t_us)),
m AS (SELECT *, (lat - pa) * 111320 AS dn, (lon - po) * 111320 * cos(radians(lat0)) AS de FROM w), t AS (SELECT drive, run, coalesce(sum(sqrt(dn * dn + de * de)), 0) AS dist FROM m GROUP BY drive, run),
z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY drive, run ORDER BY t_us DESC) = 1),
s AS (SELECT drive, run, arg_min(1.0::DOUBLE + i * 7 % 11, t_us) AS s0, max(1.0::DOUBLE + i * 7 % 11) AS s1, arg_max(1.0::DOUBLE + i * 7 % 11, t_us) AS s2 FROM g WHERE i % 60 < 25 GROUP BY drive, run),
e AS (SELECT pl.*, dist, s0, s1, s2, accuracy_m, dn, de, (ela - lat) * 111320 AS n, (elo - lon) * 111320 * cos(radians(lat0)) AS x, (rla - ela) * 111320 AS jn, (rlo - elo) * 111320 * cos(radians(lat0)) AS jx, CASE WHEN sqrt(dn * dn + de * de) > 1e-6 THEN sqrt(dn * dn + de * de) END AS way
  FROM pl LEFT JOIN t USING (drive, run) LEFT JOIN z USING (drive, run) LEFT JOIN s USING (drive, run))
SELECT drive, run, round(dist, 3) AS distance_m, round(sqrt(n * n + x * x), 3) AS endpoint_error_m, round(abs(n * dn + x * de) / way, 3) AS along_m, round(abs(n * de - x * dn) / way, 3) AS cross_m, s0 AS first_sigma_m, s1 AS peak_sigma_m, s2 AS last_sigma_m, round(sqrt(jn * jn + jx * jx), 3) AS recovery_jump_m, accuracy_m AS fix_accuracy_m FROM e"""


def calibrations(spark, sf):
    small = F.when(c("i") % 300 < 200 + c("trip_id") % 5 * 20, 0.002).otherwise(0.05)
    d = channels(spark, sf).select(c("trip_id").alias("drive"), "i", (c("ax") * small).alias("ax"), (c("ay") * small).alias("ay"), (F.lit(9.81) + c("az") * small).alias("az"), (F.lit(0.01) + c("gx") * small).alias("gx"), (c("gy") * small).alias("gy"), (c("gz") * small + c("trip_id") % 4 * 0.08).alias("gz"))
    return rounded(K.still_calibration(d, least=60))


_SMALL = "CASE WHEN i % 300 < 200 + trip_id % 5 * 20 THEN 0.002::DOUBLE ELSE 0.05::DOUBLE END"
_LAST = "OVER (PARTITION BY drive ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
CALIBRATIONS = f"""WITH {CHAN}, d AS (SELECT trip_id AS drive, i, ax * {_SMALL} AS ax, ay * {_SMALL} AS ay, 9.81::DOUBLE + az * {_SMALL} AS az, 0.01::DOUBLE + gx * {_SMALL} AS gx, gy * {_SMALL} AS gy, gz * {_SMALL} + trip_id % 4 * 0.08::DOUBLE AS gz FROM chan),
m AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS a, sqrt(gx * gx + gy * gy + gz * gz) AS g FROM d), s AS (SELECT *, count(*) {_LAST} >= 50 AND stddev_pop(a) {_LAST} < 0.08 AND stddev_pop(g) {_LAST} < 0.015 AS still FROM m),
k AS (SELECT drive, count(*) FILTER (still) AS samples, avg(gx) FILTER (still) AS bx, avg(gy) FILTER (still) AS byy, avg(gz) FILTER (still) AS bz, stddev_pop(g) FILTER (still) AS gn, stddev_pop(a) FILTER (still) AS an FROM s GROUP BY drive),
r AS (SELECT *, CASE WHEN samples < 60 THEN 'too_few' WHEN sqrt(bx * bx + byy * byy + bz * bz) > 0.2 THEN 'moving' END AS refused FROM k)
SELECT drive, samples, CASE WHEN refused IS NULL THEN round(bx, 6) END AS bias_x, CASE WHEN refused IS NULL THEN round(byy, 6) END AS bias_y, CASE WHEN refused IS NULL THEN round(bz, 6) END AS bias_z, CASE WHEN refused IS NULL THEN round(gn, 6) END AS gyro_noise, CASE WHEN refused IS NULL THEN round(an, 6) END AS accel_noise,
  CASE WHEN refused IS NULL THEN round(least(0.99, 0.55 + 0.45 * least(1, samples / 180.0::DOUBLE) * greatest(0, 1 - gn / 0.03::DOUBLE)), 6) END AS quality, refused FROM r"""


def unique_places(spark, sf):
    k = c("c_custkey")
    d = read_table(spark, sf, "customer").select(k.alias("id"), F.when(k % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"), (F.lit(12.0) + k * 37 % 1009 / 10_000.0).alias("lat"), (F.lit(77.0) + k * 91 % 997 / 10_000.0).alias("lon"), (k % 3 + 1).alias("priority"))
    return dedup_places(d).select("id", "place_id", "kept")


_APART = _ned("a.lat", "a.lon", "b.lat", "b.lon")
PLACES = f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, lower(c_mktsegment) AS name, 12.0::DOUBLE + (c_custkey * 37 % 1009) / 10000.0::DOUBLE AS lat, 77.0::DOUBLE + (c_custkey * 91 % 997) / 10000.0::DOUBLE AS lon, c_custkey % 3 + 1 AS pr FROM customer),
l AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.name = b.name AND a.id < b.id WHERE sqrt(pow({_APART[0]}, 2) + pow({_APART[1]}, 2)) < 300), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT id, id AS o FROM p UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.o), k AS (SELECT id, min(o) AS place_id FROM r GROUP BY id)
SELECT id, place_id, row_number() OVER (PARTITION BY place_id ORDER BY pr DESC, id) = 1 AS kept FROM k JOIN p USING (id)"""


def lag_drift(spark, sf):
    d = channels(spark, sf).withColumn("late", F.lag("ax", 3).over(Window.partitionBy("trip_id").orderBy("i")))
    return rounded(K.coarse_lag_drift(d, "ax", "late", block=100, search=8, max_lag=20))


CASES = {
    "w17_simulated_outages": (blackouts, BLACKOUTS), "a33_still_calibration": (calibrations, CALIBRATIONS), "j15_dedup_places": (unique_places, PLACES), "w38_lag_drift": (lag_drift, None),
    "w20_sensor_faults": (sensor_faults, FAULTS), "w23_stops": (_stops, STOPS), "w28_gnss_course": (courses, COURSES), "w36_fault_effect": (effects, EFFECTS), "r07_outage_events": (outages, OUTAGES), "a19_receiver_evidence": (evidence, EVIDENCE),
    "a05_sampling_summary": (sampling, SAMPLING), "a06_sync_summary": (syncs, SYNCS), "h03_score_windows": (scored_windows, SCORED),
}
