"""Queries of the outage and monitoring operators over the derived rows, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import ECCENTRICITY_2, SEMI_MAJOR_M
from ..operators import monitor as M
from ..operators import outages as O
from ..operators import replay as R
from .demo import CHAN, channels

c = F.col


def rounded(df, *cols, digits=6):
    """Doubles to six decimals; metres over long ways to three."""
    return df.select(*(F.round(c(n), digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes if not cols or n in cols))


def _drive(spark, sf):
    d = channels(spark, sf)
    return d.withColumns({"east": c("i") * 0.9, "north": c("i") * 0.4, "pred_ms": F.when(c("i") % 97 != 5, c("pred_ms"))})


_WINDOWS = {"horizons_s": (3, 6), "distances_m": (50.0,), "stride_s": 1.0}


def drift(spark, sf):
    return rounded(O.drift_over_windows(_drive(spark, sf), {"model": "pred_ms"}, "speed_ms", **_WINDOWS))


def drift_summary(spark, sf):
    return rounded(O.drift_window_summary(O.drift_over_windows(_drive(spark, sf), {"model": "pred_ms"}, "speed_ms", **_WINDOWS)))


_MODES = [("model", "true_heading", "pred_ms", "radians(heading_deg)"), ("model", "gyro_heading", "pred_ms", "g"), ("hold", "true_heading", "1.0::DOUBLE", "radians(heading_deg)"), ("hold", "gyro_heading", "1.0::DOUBLE", "g")]
_SUMS = ", ".join(f"sum(coalesce({v}, 0) * {f}({a}) * 0.1::DOUBLE) OVER w AS {s}_{m}_{f}" for s, m, v, a in _MODES for f in ("sin", "cos"))


def _case(s, m):
    de, dn = f"(b.{s}_{m}_sin - a.{s}_{m}_sin)", f"(b.{s}_{m}_cos - a.{s}_{m}_cos)"
    if m == "gyro_heading":
        h = "(radians(a.heading_deg) + a.g)"
        de, dn = f"(sin({h}) * {dn} - cos({h}) * {de})", f"(cos({h}) * {dn} + sin({h}) * {de})"
    if s == "hold":
        de, dn = f"({de} * a.speed_ms)", f"({dn} * a.speed_ms)"
    bad = "(b.dist - a.dist) / ((b.n - a.n) * 0.1::DOUBLE) < 3" + (" OR b.missing > a.missing" if s == "model" else "")
    return f"SELECT a.trip_id, a.seg_id, label, a.n::INT AS i0, '{s}' AS strategy, '{m}' AS heading_mode, {bad} AS skipped, CASE WHEN NOT ({bad}) THEN sqrt(pow({de} - (b.east - a.east), 2) + pow({dn} - (b.north - a.north), 2)) END AS error_m, b.dist - a.dist AS distance_m, (b.n - a.n) * 0.1::DOUBLE AS duration_s FROM e JOIN q a ON a.trip_id = e.trip_id AND a.seg_id = e.seg_id AND a.n = e.n JOIN q b ON b.trip_id = e.trip_id AND b.seg_id = e.seg_id AND b.n = e.m"


_DRIFT = f"""WITH {CHAN}, k AS (SELECT * EXCLUDE (pred_ms), CASE WHEN i % 97 <> 5 THEN pred_ms END AS pred_ms, i * 0.9::DOUBLE AS east, i * 0.4::DOUBLE AS north, row_number() OVER (PARTITION BY trip_id, seg_id ORDER BY i) - 1 AS n FROM chan),
g AS (SELECT *, sum(gz * 0.1::DOUBLE) OVER w AS g, sum(CASE WHEN n > 0 THEN speed_ms * 0.1::DOUBLE ELSE 0 END) OVER w AS dist, sum(CASE WHEN pred_ms IS NULL THEN 1 ELSE 0 END) OVER w AS missing FROM k WINDOW w AS (PARTITION BY trip_id, seg_id ORDER BY n)),
q AS (SELECT *, {_SUMS} FROM g WINDOW w AS (PARTITION BY trip_id, seg_id ORDER BY n)),
s AS (SELECT trip_id, seg_id, n, dist FROM q WHERE n >= 19 AND (n - 19) % 10 = 0),
e AS (SELECT trip_id, seg_id, n, n + 30 AS m, '3s' AS label FROM s UNION ALL SELECT trip_id, seg_id, n, n + 60, '6s' FROM s
  UNION ALL SELECT s.trip_id, s.seg_id, s.n, min(q.n), '50m' FROM s JOIN q ON q.trip_id = s.trip_id AND q.seg_id = s.seg_id AND q.dist >= s.dist + 50 GROUP BY ALL),
d AS ({" UNION ALL ".join(_case(s, m) for s, m, _, _ in _MODES)}), x AS (SELECT *, error_m * 100 / distance_m AS drift_pct FROM d)"""
DRIFT = f"{_DRIFT} SELECT trip_id, seg_id, label, i0, strategy, heading_mode, skipped, round(error_m, 6) AS error_m, round(distance_m, 6) AS distance_m, round(duration_s, 6) AS duration_s, round(drift_pct, 6) AS drift_pct FROM x"
DRIFT_SUMMARY = f"{_DRIFT} SELECT strategy, heading_mode, label, count(*) FILTER (NOT skipped) AS n_windows, round(median(drift_pct), 6) AS median_pct, round(avg(drift_pct), 6) AS mean_pct, round(quantile_cont(drift_pct, 0.9), 6) AS p90_pct, round(avg(CASE WHEN NOT skipped THEN (drift_pct < 10)::INT::DOUBLE END), 6) AS share_under_10_pct, round(median(distance_m) FILTER (NOT skipped), 6) AS median_distance_m, round(median(duration_s) FILTER (NOT skipped), 6) AS median_duration_s, count(*) FILTER (skipped) AS skipped FROM x GROUP BY strategy, heading_mode, label"


def _fixes(spark, sf):
    d, i = channels(spark, sf), c("i")
    return d.select(
        c("trip_id").alias("drive"), (i * 1_000_000).cast("long").alias("t_us"), (F.lit(12.0) + (i * 12 + c("speed_ms")) / 111_000).alias("lat"), (F.lit(77.0) + i % 50 / 100_000.0).alias("lon"), (F.lit(5.0) + i % 11).alias("accuracy_m"),
        F.when(i % 7 != 3, c("speed_ms") * 1.0488088481701516).alias("speed"), F.when(i % 5 != 2, c("heading_deg")).alias("bearing"), (i % 31 == 7).alias("mocked"), i.alias("i"),
    )


def _logs(fixes):
    return fixes.groupBy("drive").agg((F.min("t_us") + 5_000_000).alias("lead_us"), F.max("t_us").alias("end_us"))


def hold_outages(spark, sf):
    f = _fixes(spark, sf)
    return rounded(O.hold_velocity_outages(f, _logs(f)), digits=3).withColumnsRenamed({"lat": "truth_lat", "lon": "truth_lon"})


def _estimates(fixes):
    i = c("i")
    return fixes.select("drive", "t_us", (c("lat") + i % 5 / 100_000.0).alias("lat"), c("lon"), (F.lit(1.0) + i % 9).alias("sigma_m"), (i % 13 != 4).alias("leading"))


def _scored(spark, sf):
    f = _fixes(spark, sf)
    return O.score_estimates(O.hold_velocity_outages(f, _logs(f)), _estimates(f))


def scored(spark, sf):
    return rounded(_scored(spark, sf).select("drive", "start_us", "duration_s", "reason", "est_error_m", "est_sigma_m", "max_sigma_m", "hold_error_m"), digits=3)


def _radii(lat):
    w = f"(1 - {ECCENTRICITY_2!r}::DOUBLE * pow(sin(radians({lat})), 2))"
    return f"({SEMI_MAJOR_M * (1 - ECCENTRICITY_2)!r}::DOUBLE / pow({w}, 1.5))", f"({SEMI_MAJOR_M!r}::DOUBLE / sqrt({w}))"


def _ned(lat0, lon0, lat1, lon1):
    m, n = _radii(lat0)
    return f"(radians({lat1} - {lat0}) * {m})", f"(radians({lon1} - {lon0}) * {n} * cos(radians({lat0})))"


_STEP = _ned("pa", "po", "lat", "lon")
_M, _N = _radii("olat")
_HELD = _ned("lat", "lon", "hlat", "hlon")
_TRUTH = f"""fx AS (SELECT trip_id AS drive, i * 1000000 AS t_us, 12.0::DOUBLE + (i * 12 + speed_ms) / 111000 AS lat, 77.0::DOUBLE + (i % 50) / 100000.0::DOUBLE AS lon, 5.0::DOUBLE + i % 11 AS accuracy_m, CASE WHEN i % 7 <> 3 THEN speed_ms * 1.0488088481701516::DOUBLE END AS speed, CASE WHEN i % 5 <> 2 THEN heading_deg END AS bearing, i % 31 = 7 AS mocked, i FROM chan),
f0 AS (SELECT *, lag(t_us) OVER w AS pt, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(speed) OVER w AS ps FROM fx WHERE NOT mocked AND accuracy_m <= 12 WINDOW w AS (PARTITION BY drive ORDER BY t_us)),
f1 AS (SELECT *, {_STEP[0]} AS sn, {_STEP[1]} AS se, (t_us - pt) / 1e6::DOUBLE AS gap FROM f0),
f2 AS (SELECT *, sqrt(sn * sn + se * se) AS step, (degrees(atan2(se, sn)) + 360) - 360 * floor((degrees(atan2(se, sn)) + 360) / 360) AS course FROM f1),
f3 AS (SELECT *, coalesce(speed, CASE WHEN gap > 0 AND gap <= 3 THEN step END / gap, 0) AS v0, coalesce(bearing, CASE WHEN gap > 0 AND gap <= 3 AND step > 3 THEN course END) AS b0 FROM f2),
f AS (SELECT *, sum(coalesce((speed + ps) * 0.5::DOUBLE * gap, 0)) OVER w AS by_speed, sum(coalesce(step, 0)) OVER w AS by_step, sum((speed IS NULL)::INT) OVER w AS no_speed, (speed IS NULL)::INT AS gone, CASE WHEN v0 > 1 AND b0 IS NOT NULL THEN v0 ELSE 0 END AS v, coalesce(b0, 0) AS b, CASE WHEN step > 3 THEN course ELSE bearing END AS travel FROM f3 WINDOW w AS (PARTITION BY drive ORDER BY t_us)),
lg AS (SELECT drive, min(t_us) + 15000000 AS a, max(t_us) - 10000000 AS z, max(t_us) AS end_us FROM fx GROUP BY drive),
st AS (SELECT drive, end_us, unnest(range(a, z + 1, greatest(20000000, (z - a) // 16))) AS start_us FROM lg WHERE a <= z),
o AS (SELECT drive, start_us, d AS duration_s, start_us + d * 1000000 AS t_us FROM st, (SELECT unnest([10, 30, 60, 120]) AS d) WHERE start_us + d * 1000000 <= end_us),
o1 AS (SELECT o.*, f.t_us AS ot, f.lat AS olat, f.lon AS olon, f.by_speed AS os, f.by_step AS op, f.no_speed AS onone, f.gone AS ogone, f.v AS ov, f.b AS ob FROM o ASOF LEFT JOIN f ON o.drive = f.drive AND o.start_us >= f.t_us),
o2 AS (SELECT o1.*, f.t_us AS kt, f.lat, f.lon, f.travel, CASE WHEN f.no_speed - onone + ogone = 0 THEN f.by_speed - os ELSE f.by_step - op END AS dist, (f.t_us - ot) / 1e6::DOUBLE AS secs FROM o1 ASOF LEFT JOIN f ON o1.drive = f.drive AND o1.t_us >= f.t_us),
o3 AS (SELECT *, CASE WHEN ov = 0 THEN olat ELSE olat + degrees(ov * cos(radians(ob)) * secs / {_M}) END AS hlat, CASE WHEN ov = 0 THEN olon ELSE olon + degrees(ov * sin(radians(ob)) * secs / ({_N} * cos(radians(olat)))) END AS hlon,
  CASE WHEN ot IS NULL OR start_us - ot > 3000000 THEN 'noRecentFix' WHEN kt <= start_us OR t_us - kt > 2000000 THEN 'noTruthAtEnd' WHEN dist < 20 THEN 'tooLittleTravel' END AS reason FROM o2),
o4 AS (SELECT *, reason IS NULL AS ok, {_HELD[0]} AS n, {_HELD[1]} AS e, radians(travel) AS way FROM o3)"""
HOLD = f"WITH {CHAN}, {_TRUTH} SELECT drive, start_us, duration_s, reason, CASE WHEN ok THEN kt END AS truth_us, CASE WHEN ok THEN round(lat, 3) END AS truth_lat, CASE WHEN ok THEN round(lon, 3) END AS truth_lon, CASE WHEN ok THEN round(dist, 3) END AS distance_m, CASE WHEN ok THEN round(sqrt(n * n + e * e), 3) END AS hold_error_m, CASE WHEN ok THEN round(n * cos(way) + e * sin(way), 3) END AS along_m, CASE WHEN ok THEN round(e * cos(way) - n * sin(way), 3) END AS cross_m FROM o4"
_EST = _ned("lat", "lon", "e_lat", "e_lon")
_SCORED = f"""{_TRUTH}, es AS (SELECT drive, t_us, lat + (i % 5) / 100000.0::DOUBLE AS e_lat, lon AS e_lon, 1.0::DOUBLE + i % 9 AS sigma, i % 13 <> 4 AS leading FROM fx),
p1 AS (SELECT o4.* EXCLUDE (reason), CASE WHEN NOT coalesce(es.leading, false) THEN 'engineNotLeading' ELSE reason END AS reason FROM o4 ASOF LEFT JOIN es ON o4.drive = es.drive AND o4.start_us >= es.t_us),
p2 AS (SELECT p1.*, es.e_lat, es.e_lon, es.sigma FROM (SELECT *, CASE WHEN ok THEN kt END AS truth_us FROM p1) p1 ASOF LEFT JOIN es ON p1.drive = es.drive AND p1.truth_us >= es.t_us),
p3 AS (SELECT p2.drive, p2.start_us, duration_s, max(es.sigma) AS max_sigma FROM p2 JOIN es ON es.drive = p2.drive AND es.t_us BETWEEN p2.start_us AND p2.t_us GROUP BY ALL),
p AS (SELECT p2.*, max_sigma, CASE WHEN reason IS NULL THEN sqrt(pow({_EST[0]}, 2) + pow({_EST[1]}, 2)) END AS est_error_m FROM p2 LEFT JOIN p3 USING (drive, start_us, duration_s))"""
SCORED = f"WITH {CHAN}, {_SCORED} SELECT drive, start_us, duration_s, reason, round(est_error_m, 3) AS est_error_m, round(sigma, 3) AS est_sigma_m, round(max_sigma, 3) AS max_sigma_m, CASE WHEN ok THEN round(sqrt(n * n + e * e), 3) END AS hold_error_m FROM p"


def log_summary(spark, sf):
    d = _scored(spark, sf).where("duration_s = 30").withColumn("error_m", F.round("est_error_m"))
    return rounded(O.outage_log_summary(d), digits=3)


LOG_SUMMARY = f"""WITH {CHAN}, {_SCORED}, d AS (SELECT drive, start_us, CASE WHEN ok THEN dist END AS m, round(est_error_m) AS e FROM p WHERE duration_s = 30), k AS (SELECT *, m IS NOT DISTINCT FROM lag(m) OVER w AND e IS NOT DISTINCT FROM lag(e) OVER w AND lag(start_us) OVER w IS NOT NULL AS same FROM d WINDOW w AS (PARTITION BY drive ORDER BY start_us)), x AS (SELECT drive, e * 100 / m AS p FROM k WHERE NOT same)
SELECT drive, count(*) AS n, count(*) FILTER (p < 10) AS met, round(median(p), 3) AS median_pct, round(max(p), 3) AS worst_pct FROM x GROUP BY drive"""


def timing(spark, sf):
    d = channels(spark, sf)
    at = c("i") * 100_000 + (c("i") * c("i") % 7) * 5_000 + F.floor(c("i") / 50) * 400_000
    return rounded(M.stream_timing(d.select(c("trip_id").alias("drive"), F.when(c("i") % 3 == 0, "gyro").otherwise("accel").alias("sensor"), at.cast("long").alias("t_us"))))


TIMING = f"""WITH RECURSIVE {CHAN}, s AS (SELECT trip_id AS drive, CASE WHEN i % 3 = 0 THEN 'gyro' ELSE 'accel' END AS sensor, i * 100000 + (i * i % 7) * 5000 + (i // 50) * 400000 AS t FROM chan),
d AS (SELECT *, (t - lag(t) OVER w)::DOUBLE AS dt, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY drive, sensor ORDER BY t)),
r AS (SELECT drive, sensor, n, dt AS mean, 0.0::DOUBLE AS v, 0::BIGINT AS lost FROM d WHERE n = 2
  UNION ALL SELECT r.drive, r.sensor, d.n, r.mean + 0.05::DOUBLE * (d.dt - r.mean), 0.95::DOUBLE * (r.v + 0.05::DOUBLE * (d.dt - r.mean) * (d.dt - r.mean)), r.lost + CASE WHEN d.dt > r.mean * 3 THEN greatest(1, round(d.dt / r.mean)::BIGINT - 1) ELSE 0 END FROM r JOIN d ON d.drive = r.drive AND d.sensor = r.sensor AND d.n = r.n + 1),
k AS (SELECT drive, sensor, count(*) AS received FROM d GROUP BY drive, sensor), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY drive, sensor ORDER BY n DESC) = 1),
x AS (SELECT k.*, mean, coalesce(lost, 0) AS lost, CASE WHEN received >= 5 AND mean > 0 THEN sqrt(v) / mean END AS jitter FROM k LEFT JOIN l USING (drive, sensor))
SELECT drive, sensor, received, round(mean, 6) AS mean_us, lost AS dropped, round(jitter, 6) AS jitter, round(CASE WHEN received >= 3 AND mean > 0 THEN 1e6::DOUBLE / mean END, 6) AS hz, CASE WHEN received < 5 OR jitter IS NULL THEN 'good' WHEN lost / (received + lost)::DOUBLE > 0.2 THEN 'invalid' WHEN lost / (received + lost)::DOUBLE > 0.05 THEN 'degraded' WHEN jitter <= 0.15 THEN 'excellent' WHEN jitter <= 0.35 THEN 'good' ELSE 'degraded' END AS quality FROM x"""


def integrity(spark, sf):
    # No short decimals: means of those lie on halves, which two engines round differently.
    d = channels(spark, sf).select(c("trip_id").alias("drive"), c("i").alias("t_us"), (c("speed_ms") * 2.622022120425379).alias("mean_cn0"), (c("i") % 9).alias("used"), (c("i") % 9 + c("i") % 5 * 4).alias("visible"))
    return rounded(M.signal_integrity(d))


INTEGRITY = f"""WITH {CHAN}, s AS (SELECT trip_id AS drive, i AS t_us, speed_ms * 2.622022120425379::DOUBLE AS mean_cn0, i % 9 AS used, i % 9 + i % 5 * 4 AS visible FROM chan), k AS (SELECT *, CASE WHEN visible > 0 THEN mean_cn0 - avg(mean_cn0) OVER (PARTITION BY drive, visible > 0 ORDER BY t_us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS ch, CASE WHEN visible > 0 THEN used / visible::DOUBLE ELSE 0 END AS ratio FROM s)
SELECT drive, t_us, round(mean_cn0, 6) AS mean_cn0, used, visible, round(ch, 6) AS change_cn0, round(ratio, 6) AS used_ratio, CASE WHEN visible = 0 THEN 'degraded' WHEN ch <= -12 AND ratio < 0.35 THEN 'anomaly' WHEN mean_cn0 < 25 OR ratio < 0.35 THEN 'degraded' ELSE 'healthy' END AS state FROM k"""


def turns(spark, sf):
    d = channels(spark, sf).select("trip_id", (c("i") * 100_000).cast("long").alias("t_us"), (c("ay") + 4).alias("lat_acc"), (c("gz") + 0.2).alias("yaw"))
    return rounded(M.turn_speed(d, "lat_acc", "yaw"))


TURNS = f"""WITH RECURSIVE {CHAN}, s AS (SELECT trip_id, i * 100000 AS t, ay + 4 AS la, gz + 0.2::DOUBLE AS yaw FROM chan), k AS (SELECT trip_id, t, avg(la) OVER w AS a, avg(yaw) OVER w AS w, stddev_pop(yaw) OVER w AS sd, count(*) OVER w AS n, t - min(t) OVER w AS span FROM s WINDOW w AS (PARTITION BY trip_id ORDER BY t RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW)),
v AS (SELECT trip_id, t, a / w AS v, sqrt(pow(0.35::DOUBLE / abs(w), 2) + pow(a / w * 0.012::DOUBLE / abs(w), 2)) AS s FROM k WHERE n >= 3 AND span >= 800000 AND abs(w) BETWEEN 0.1 AND 1.2 AND abs(a) >= 0.6 AND sign(a) = sign(w) AND sd / abs(w) <= 0.35), ok AS (SELECT * FROM v WHERE v BETWEEN 2 AND 45 AND s <= 2.5),
nx AS (SELECT trip_id, t, first_value(t) OVER (PARTITION BY trip_id ORDER BY t RANGE BETWEEN 1000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM ok), r AS (SELECT trip_id, min(t) AS t FROM ok GROUP BY trip_id UNION ALL SELECT r.trip_id, nx.nt FROM r JOIN nx ON nx.trip_id = r.trip_id AND nx.t = r.t WHERE nx.nt IS NOT NULL)
SELECT trip_id, t AS t_us, round(v, 6) AS speed_ms, round(s, 6) AS sigma_ms FROM r JOIN ok USING (trip_id, t)"""


def trust(spark, sf):
    d = channels(spark, sf).select(c("trip_id").alias("drive"), (c("i") * 1_000_000 + F.when(c("i") % 40 > 36, c("i") % 2 * 100_000).otherwise(0)).cast("long").alias("t_us"), (c("i") * c("ax")).alias("x"), (c("i") * 2 + c("ay")).alias("y"), F.abs(c("ax") * (c("i") % 60)).alias("miss_m"))
    return rounded(M.earned_trust(d), "drive", "t_us", "hold_miss_m", "trusted")


TRUST = f"""WITH {CHAN}, s AS (SELECT trip_id AS drive, i * 1000000 + CASE WHEN i % 40 > 36 THEN i % 2 * 100000 ELSE 0 END AS t, i * ax AS x, i * 2 + ay AS y, abs(ax * (i % 60)) AS miss FROM chan), l AS (SELECT *, t - lag(t) OVER w AS gap, lag(t) OVER w - lag(t, 2) OVER w AS bef, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY drive ORDER BY t)),
k AS (SELECT *, coalesce(gap <= 2500000 AND bef <= 2500000 AND bef > 0, false) AS ok FROM l), h AS (SELECT *, CASE WHEN ok THEN sqrt(pow(x - (x1 + (x1 - x2) * gap / bef), 2) + pow(y - (y1 + (y1 - y2) * gap / bef), 2)) END AS hm FROM k)
SELECT drive, t AS t_us, round(hm, 6) AS hold_miss_m, ok AND count(hm) OVER w >= 10 AND coalesce(quantile_cont(miss, 0.5) OVER w <= quantile_cont(hm, 0.5) OVER w * 1.25 + 2, false) AS trusted FROM h WINDOW w AS (PARTITION BY drive, ok ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


def errors(spark, sf):
    f = _fixes(spark, sf)
    return rounded(M.continuous_error(_estimates(f).withColumn("t_us", c("t_us") + 300_000), f.where("NOT mocked")))


_ERR = _ned("e.lat", "e.lon", "t.lat", "t.lon")
ERRORS = f"""WITH {CHAN}, {_TRUTH}, e AS (SELECT drive, t_us + 300000 AS t_us, lat + (i % 5) / 100000.0::DOUBLE AS lat, lon FROM fx), t AS (SELECT * FROM fx WHERE NOT mocked), d AS (SELECT e.drive, e.t_us, sqrt(pow({_ERR[0]}, 2) + pow({_ERR[1]}, 2)) AS m FROM e ASOF JOIN t ON e.drive = t.drive AND e.t_us >= t.t_us WHERE e.t_us - t.t_us <= 1000000)
SELECT drive, count(*) AS n, round(avg(m), 6) AS mean_m, round(median(m), 6) AS median_m, round(quantile_cont(m, 0.95), 6) AS p95_m, round(max(m), 6) AS max_m, round(max_by(m, t_us), 6) AS final_m FROM d GROUP BY drive"""


def profile(spark, sf):
    d, i = channels(spark, sf), c("i")
    return rounded(M.log_profile(d.select(c("trip_id").alias("drive"), F.when(i % 10 == 0, "g").otherwise("i").alias("kind"), (i * 100_000 + i % 3 * 1_000).cast("long").alias("t_us"), (F.lit(5.0) + i % 11).alias("accuracy_m"), (i % 31 == 7).alias("mocked"), (c("trip_id") % 2 == 0).alias("has_mag"), (i > 590).alias("has_baro"))))


PROFILE = f"""WITH {CHAN}, d AS (SELECT trip_id AS drive, CASE WHEN i % 10 = 0 THEN 'g' ELSE 'i' END AS kind, i * 100000 + i % 3 * 1000 AS t, 5.0::DOUBLE + i % 11 AS acc, i % 31 = 7 AS mocked, trip_id % 2 = 0 AS mag, i > 590 AS baro FROM chan), g AS (SELECT *, t - lag(t) OVER (PARTITION BY drive, kind ORDER BY t) AS gap FROM d),
k AS (SELECT drive, kind, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM g GROUP BY drive, kind), h AS (SELECT drive, max(CASE WHEN kind = 'i' THEN l[len(l) // 2 + 1] END) AS gi, max(CASE WHEN kind = 'g' THEN l[len(l) // 2 + 1] END) AS gg FROM k GROUP BY drive),
a AS (SELECT drive, (max(t) - min(t)) / 1e6::DOUBLE AS dur, count(*) FILTER (kind = 'g') AS fixes, count(*) FILTER (kind = 'g' AND NOT mocked AND acc <= 12) AS tf, median(acc) FILTER (kind = 'g' AND NOT mocked AND acc <= 12) AS ma, bool_or(mag) AS has_mag, bool_or(baro) AS has_baro FROM d GROUP BY drive)
SELECT drive, round(dur, 6) AS duration_s, round(1e6::DOUBLE / gi, 6) AS imu_hz, round(1e6::DOUBLE / gg, 6) AS gnss_hz, fixes, tf AS true_fixes, round(ma, 6) AS median_accuracy_m, has_mag, has_baro FROM a JOIN h USING (drive)"""


def noise(spark, sf):
    d = channels(spark, sf).withColumns({"h": F.radians("heading_deg"), "v": c("speed_ms") + 3})
    return rounded(M.imu_noise_density(d, "ax", "gz", "v", "h"))


NOISE = f"""WITH {CHAN}, d AS (SELECT trip_id, i, ax, gz, speed_ms + 3 AS v, radians(heading_deg) AS h, hz FROM chan, (SELECT unnest([5.0::DOUBLE, 10.0::DOUBLE, 30.0::DOUBLE]) AS hz)), b AS (SELECT trip_id, hz, i // round(hz / 0.1)::BIGINT AS b, count(*) AS n, min(v) AS lo, sum(ax) * 0.1::DOUBLE - min_by(ax, i) * 0.1::DOUBLE - (max_by(v, i) - min_by(v, i)) AS dv, sum(gz) * 0.1::DOUBLE - min_by(gz, i) * 0.1::DOUBLE - (max_by(h, i) - min_by(h, i)) AS dh FROM d GROUP BY ALL)
SELECT trip_id, hz AS horizon_s, count(*) AS windows, round(sqrt(avg(dv * dv)) / sqrt(hz), 6) AS accel_density, round(sqrt(avg(pow(atan2(sin(dh), cos(dh)), 2))) / sqrt(hz), 6) AS yaw_density FROM b WHERE n = round(hz / 0.1)::BIGINT AND lo >= 3 GROUP BY trip_id, hz"""


def signals(spark, sf):
    return rounded(M.stream_signal_checks(channels(spark, sf)))


SIGNALS = f"""WITH {CHAN}, d AS (SELECT *, heading_deg - lag(heading_deg) OVER w AS dh, (speed_ms - lag(speed_ms) OVER w) / 0.1::DOUBLE AS dv, sqrt(ax * ax + ay * ay + az * az) AS norm FROM chan WINDOW w AS (PARTITION BY trip_id ORDER BY i)), k AS (SELECT *, -radians(180 - (180 - dh - 360 * floor((180 - dh) / 360))) / 0.1::DOUBLE AS turn FROM d)
SELECT trip_id, round(corr(gz, turn) FILTER (speed_ms > 1), 6) AS yaw_corr, round(corr(ax, dv), 6) AS accel_corr, round(corr(ay, speed_ms * gz) FILTER (speed_ms > 1), 6) AS lateral_corr, round(stddev_pop(norm) FILTER (speed_ms < 0.3), 6) AS rest_std, NOT (avg(norm) BETWEEN 7 AND 12) AS units_warning FROM k GROUP BY trip_id"""


def lags(spark, sf):
    return rounded(R.xcorr_lag(channels(spark, sf).withColumn("gz", F.when(c("i") % 17 != 3, c("gz"))), "ax", "gz", max_lag=8))


LAGS = f"""WITH {CHAN}, d AS (SELECT trip_id, i, ax AS a, CASE WHEN i % 17 <> 3 THEN gz END AS b FROM chan), m AS (SELECT trip_id, count(b) AS n, avg(a) FILTER (b IS NOT NULL) AS ma, avg(b) AS mb, stddev_pop(a) FILTER (b IS NOT NULL) AS sa, stddev_pop(b) AS sb FROM d GROUP BY trip_id), z AS (SELECT d.trip_id, i, CASE WHEN b IS NULL THEN 0 ELSE a - ma END AS a, CASE WHEN b IS NULL THEN 0 ELSE b - mb END AS b FROM d JOIN m USING (trip_id)),
l AS (SELECT x.trip_id, g.lag, sum(x.a * y.b) AS s FROM z x, (SELECT unnest(range(-8, 9)) AS lag) g JOIN z y ON y.trip_id = x.trip_id AND y.i = x.i + g.lag GROUP BY ALL), v AS (SELECT trip_id, lag, n, s / (n * sa * sb + 1e-12::DOUBLE) AS r FROM l JOIN m USING (trip_id)), b AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY round(abs(r), 12) DESC, lag) AS k FROM v)
SELECT trip_id, (CASE WHEN n >= 50 THEN lag ELSE 0 END)::INT AS lag, round(CASE WHEN n >= 50 THEN r ELSE 0 END, 6) AS corr, n, round(CASE WHEN n >= 50 THEN abs(r) ELSE 0 END * sqrt(n / 50.0::DOUBLE), 6) AS z FROM b WHERE k = 1"""


def fused(spark, sf):
    d, i = channels(spark, sf), c("i")
    fix = lambda x: F.when(i % 10 == 0, x)
    rows = d.select(c("trip_id").alias("drive"), c("t").alias("t_s"), c("ax").alias("accel"), c("gz").alias("yaw"), fix(c("t") * 9).alias("fix_x"), fix(c("t") * 2).alias("fix_y"), fix(F.lit(16.0)).alias("fix_var"), fix(c("speed_ms")).alias("fix_speed"), fix(F.radians("heading_deg")).alias("fix_heading"))
    return rounded(R.fuse_drive(rows))


CASES = {
    "w14_drift_windows": (drift, DRIFT), "a15_drift_summary": (drift_summary, DRIFT_SUMMARY), "w15_hold_outages": (hold_outages, HOLD), "w16_score_estimates": (scored, SCORED), "a28_outage_log": (log_summary, LOG_SUMMARY),
    "w19_stream_timing": (timing, TIMING), "w37_signal_integrity": (integrity, INTEGRITY), "w25_turn_speed": (turns, TURNS), "w39_earned_trust": (trust, TRUST), "a17_continuous_error": (errors, ERRORS), "a16_log_profile": (profile, PROFILE),
    "a29_imu_noise": (noise, NOISE), "a32_signal_checks": (signals, SIGNALS), "h01_xcorr_lag": (lags, LAGS), "h02_fuse_drive": (fused, None),
}
