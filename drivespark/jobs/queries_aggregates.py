"""Queries of the aggregations over derived telemetry and 10 Hz rows, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.sensing import FEATURES
from ..operators import aggregates as A
from ..session import read_table
from .demo import CHAN, TEL, channels, telemetry
from .queries_functions import r6

c = F.col


def rounded(df, *exact):
    return df.select(*(x if x in exact or t not in ("double", "float") else r6(c(x), x) for x, t in df.dtypes))


def _sessions(spark, sf):
    t = telemetry(spark, sf).groupBy("session_id").agg(F.min("t_us").alias("started_us"), F.max("t_us").alias("last"))
    return t.select("session_id", "started_us", F.when(c("session_id") % 5 > 0, c("last")).alias("stopped_us"))


_NOW = 1_800_000_000_000_000
_SES = f"ses AS (SELECT session_id, min(t_us) AS started_us, CASE WHEN session_id % 5 > 0 THEN max(t_us) END AS stopped_us FROM tel GROUP BY session_id)"


def summaries(spark, sf):
    return A.session_summary(_sessions(spark, sf), telemetry(spark, sf), F.lit(_NOW))


def session_summary(spark, sf):
    return rounded(summaries(spark, sf))


_SUM = f"""{_SES}, sm AS (SELECT s.session_id, count(t.session_id) AS records, greatest(0, coalesce(any_value(stopped_us), {_NOW}) - any_value(started_us)) / 1e6::DOUBLE AS duration_s, sqrt(avg(pow(1 - confidence, 2))) AS rmse, max(1 - confidence) AS max_error,
  avg(CASE WHEN mode = 'DEAD_RECKONING' THEN 1.0::DOUBLE ELSE 0 END) * 100 AS dr_share_pct FROM ses s LEFT JOIN tel t ON s.session_id = t.session_id GROUP BY s.session_id)"""
SUMMARY = f"WITH {TEL}, {_SUM} SELECT session_id, records, round(duration_s, 6) AS duration_s, round(rmse, 6) AS rmse, round(max_error, 6) AS max_error, round(dr_share_pct, 6) AS dr_share_pct FROM sm"


def dashboard(spark, sf):
    return rounded(A.dashboard(summaries(spark, sf)).withColumn("duration_s", F.round("duration_s", 3)))


DASHBOARD = f"WITH {TEL}, {_SUM} SELECT count(*) AS sessions, sum(records)::BIGINT AS records, round(sum(duration_s), 3) AS duration_s, round(100 - avg(max_error) * 100) AS mean_confidence FROM sm"


def recent(spark, sf):
    return A.recent_sessions(_sessions(spark, sf).select("session_id", "started_us"))


RECENT = f"WITH {TEL}, {_SES} SELECT session_id, started_us FROM ses ORDER BY started_us DESC, session_id LIMIT 5"


def raw_stats(spark, sf):
    d = channels(spark, sf).withColumn("clock", c("i") * 0.1 + F.floor(c("i") / 97) * 1.5 - (c("i") % 50 == 0).cast("int") * 0.15)
    return rounded(A.raw_trip_stats(d.withColumn("gx", F.when(c("i") % 9 > 0, c("gx"))), "clock", checked=["gx"]))


RAW = f"""WITH {CHAN}, k AS (SELECT trip_id, i, CASE WHEN i % 9 > 0 THEN gx END AS gx, i * 0.1::DOUBLE + (i // 97) * 1.5::DOUBLE - CASE WHEN i % 50 = 0 THEN 0.15::DOUBLE ELSE 0 END AS clock FROM chan),
d AS (SELECT *, clock - lag(clock) OVER (PARTITION BY trip_id ORDER BY i) AS dt FROM k), q AS (SELECT trip_id, quantile_cont(dt, 0.01) AS lo, quantile_cont(dt, 0.99) AS hi FROM d GROUP BY trip_id)
SELECT d.trip_id, count(*) AS rows, round(quantile_cont(dt, 0.5), 6) AS dt_median, round(stddev_pop(CASE WHEN dt > lo AND dt < hi THEN dt END), 6) AS dt_std_trimmed, count(*) FILTER (dt <= 0) AS backwards, count(*) FILTER (dt > 1.0) AS gaps,
  count(*) FILTER (abs(dt - 0.1::DOUBLE) > 0.011) AS glitches, count(*) FILTER (gx IS NULL) AS missing_gx FROM d JOIN q USING (trip_id) GROUP BY d.trip_id"""


def histogram(spark, sf):
    return A.interval_histogram(telemetry(spark, sf).withColumn("h", c("t_us") / 3.6e9), "h", "session_id", "t_us", 4.0, 400.0)


HISTOGRAM = f"WITH {TEL}, d AS (SELECT session_id, (t_us / 3.6e9::DOUBLE) - lag(t_us / 3.6e9::DOUBLE) OVER (PARTITION BY session_id ORDER BY t_us) AS dt FROM tel) SELECT session_id, floor(greatest(0, least(400, dt)) / 4)::BIGINT AS bin, count(*) AS n FROM d WHERE dt IS NOT NULL GROUP BY ALL"


def speeds(spark, sf):
    return rounded(A.speed_stats(channels(spark, sf), "trip_id"))


SPEEDS = f"WITH {CHAN} SELECT trip_id, round(sum(speed_ms) * 0.1 / 1000, 6) AS distance_km, round(avg(speed_ms) * 3.6, 6) AS mean_kmh, round(quantile_cont(speed_ms, 0.95) * 3.6, 6) AS p95_kmh, round(max(speed_ms) * 3.6, 6) AS max_kmh, round(avg(CASE WHEN speed_ms < 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS stationary_share FROM chan GROUP BY trip_id"


def _trips(spark, sf):
    s = channels(spark, sf).groupBy("trip_id").agg(F.count("*").alias("rows"), (F.sum("speed_ms") * 0.1 / 1000).alias("km"))
    n = read_table(spark, sf, "supplier").select(c("s_suppkey").alias("trip_id"), c("s_nationkey").cast("string").alias("driver"), (c("s_suppkey") % 3).cast("string").alias("category"))
    return s.join(n, "trip_id").withColumn("included", c("rows") >= 600)


_TRIPS = "trips AS (SELECT c.*, s_nationkey::VARCHAR AS driver, (s_suppkey % 3)::VARCHAR AS category, rows >= 600 AS included FROM (SELECT trip_id, count(*) AS rows, sum(speed_ms) * 0.1 / 1000 AS km FROM chan GROUP BY trip_id) c JOIN supplier ON s_suppkey = trip_id)"


def groups(spark, sf):
    return rounded(A.group_table(_trips(spark, sf)))


GROUPS = f"""WITH {CHAN}, {_TRIPS} SELECT CASE WHEN grouping(driver) = 0 THEN 'driver' WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS dim, coalesce(driver, category) AS value, count(*) AS trips, sum(rows)::BIGINT AS rows, round(sum(rows) / 36000.0::DOUBLE, 6) AS hours, round(sum(km), 6) AS km,
  count(*) FILTER (included) AS included_trips, round(coalesce(sum(km) FILTER (included), 0), 6) AS included_km FROM trips GROUP BY GROUPING SETS ((driver), (category), ())"""


def distribution(spark, sf):
    return rounded(A.speed_distribution(channels(spark, sf), keys=["trip_id"]))


DISTRIBUTION = f"""WITH {CHAN}, v AS (SELECT trip_id, speed_ms * 3.6::DOUBLE AS v FROM chan) SELECT trip_id, {', '.join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99))}, round(avg(v), 6) AS mean, round(max(v), 6) AS max,
  {', '.join(f"round(avg(CASE WHEN v >= {a} AND v < {b} THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_{a}_{b}" for a, b in zip(A.BAND_EDGES_KMH[:-1], A.BAND_EDGES_KMH[1:], strict=True))} FROM v GROUP BY trip_id"""


def metrics(spark, sf):
    return rounded(A.speed_metrics(channels(spark, sf), "speed_ms", "pred_ms", ["trip_id"]))


_METRICS = """count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(sqrt(avg(e * e)) * 3.6, 6) AS rmse_kmh, round(CASE WHEN var_pop(y) > 0 THEN 1 - avg(e * e) / var_pop(y) END, 6) AS r2, round(avg(e), 6) AS bias,
  round(quantile_cont(abs(e), 0.5), 6) AS median_abs, round(quantile_cont(abs(e), 0.9), 6) AS p90_abs, round(quantile_cont(abs(e), 0.95), 6) AS p95_abs"""
METRICS = f"WITH {CHAN}, e AS (SELECT trip_id, speed_ms AS y, pred_ms - speed_ms AS e FROM chan) SELECT trip_id, {_METRICS} FROM e GROUP BY trip_id"


def bands(spark, sf):
    return rounded(A.speed_band_table(channels(spark, sf), "speed_ms", "pred_ms", keys=["trip_id"]).withColumn("bias", F.round("bias", 4)))


BANDS = f"WITH {CHAN}, e AS (SELECT trip_id, speed_ms AS y, pred_ms - speed_ms AS e, CASE {' '.join(f'WHEN speed_ms * 3.6::DOUBLE >= {a} AND speed_ms * 3.6::DOUBLE < {b} THEN {chr(39)}{a}-{b}{chr(39)}' for a, b in zip(A.BAND_EDGES_KMH[:-1], A.BAND_EDGES_KMH[1:], strict=True))} END AS band FROM chan) SELECT trip_id, band, {_METRICS.replace('round(avg(e), 6)', 'round(avg(e), 4)')} FROM e WHERE band IS NOT NULL GROUP BY trip_id, band"


def calibration(spark, sf):
    d = channels(spark, sf).withColumn("sigma", F.abs("ax") / 2 + 0.1)
    d = d.withColumn("error", F.round(c("pred_ms") - c("speed_ms"), 4)).withColumn("zero", F.lit(0.0))
    return rounded(A.sigma_calibration(d.withColumn("sigma", F.round("sigma", 4)), "zero", "error", "sigma", ["trip_id"]))


CALIBRATION = f"""WITH {CHAN}, d AS (SELECT trip_id, round(abs(ax) / 2 + 0.1::DOUBLE, 4) AS s, round(pred_ms - speed_ms, 4) AS e FROM chan), r AS (SELECT *, rank() OVER (PARTITION BY trip_id ORDER BY abs(e)) + (count(*) OVER (PARTITION BY trip_id, abs(e)) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY trip_id ORDER BY s) + (count(*) OVER (PARTITION BY trip_id, s) - 1) / 2.0::DOUBLE AS rs FROM d)
SELECT trip_id, round(corr(ra, rs), 6) AS spearman, round(avg(CASE WHEN abs(e) <= s THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_1, round(avg(CASE WHEN abs(e) <= 2 * s THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_2, round(stddev_pop(e / s), 6) AS z_std FROM r GROUP BY trip_id"""


def _outages(spark, sf):
    d = channels(spark, sf)
    pick = F.element_at(F.array(*map(F.lit, (10, 30, 60, 120))), (c("i") % 4 + 1).cast("int"))
    return d.select("trip_id", pick.alias("duration_s"), F.when(c("i") % 7 > 0, F.abs(c("ax")) * 10 + c("gz")).alias("est_error_m"), (F.abs(c("ay")) * 20 + 3).alias("hold_error_m"), (c("speed_ms") * 20 + 1).alias("distance_m"))


_OUT = "out AS (SELECT trip_id, ([10, 30, 60, 120])[i % 4 + 1] AS duration_s, CASE WHEN i % 7 > 0 THEN abs(ax) * 10 + gz END AS e, abs(ay) * 20 + 3 AS h, speed_ms * 20 + 1 AS m FROM chan)"


def outage_stats(spark, sf):
    return rounded(A.outage_stats(_outages(spark, sf)))


_STATS = """count(*) AS n, median(e) AS median_m, list_sort(list(e))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95_m, max(e) AS worst_m, median(e * 100 / m) AS median_drift_pct, count(*) FILTER (e < h) AS wins, median(e * 100 / m) < 10 AS meets_target"""
OUTAGES = f"WITH {CHAN}, {_OUT}, s AS (SELECT duration_s, {_STATS} FROM out WHERE e IS NOT NULL GROUP BY duration_s) SELECT duration_s, n, round(median_m, 6) AS median_m, round(p95_m, 6) AS p95_m, round(worst_m, 6) AS worst_m, round(median_drift_pct, 6) AS median_drift_pct, wins, meets_target FROM s"


def over_drives(spark, sf):
    return rounded(A.median_over_drives(A.outage_stats(_outages(spark, sf), ("trip_id", "duration_s")), min_n=3))


OVER_DRIVES = f"WITH {CHAN}, {_OUT}, s AS (SELECT trip_id, duration_s, {_STATS} FROM out WHERE e IS NOT NULL GROUP BY ALL) SELECT duration_s, count(*) AS drives, round(median(median_drift_pct), 6) AS median_drift_pct, count(*) FILTER (median_drift_pct < 10) AS under_target FROM s WHERE n >= 3 GROUP BY duration_s"


def satellites(spark, sf):
    d = telemetry(spark, sf).select("session_id", F.when(c("event_id") % 3 == 0, "NAVIC").when(c("event_id") % 3 == 1, "GPS").otherwise("GLONASS").alias("constellation"), (c("k") % 4 > 0).alias("used"), (c("k") / 2.0).alias("snr"))
    return rounded(A.satellite_breakdown(d, ["session_id"]))


SATELLITES = f"""WITH {TEL}, b AS (SELECT session_id, count(*) FILTER (event_id % 3 = 1) AS gps_n, avg(k / 2.0::DOUBLE) FILTER (event_id % 3 = 1) AS gps_snr, count(*) FILTER (event_id % 3 = 0) AS navic_n, avg(k / 2.0::DOUBLE) FILTER (event_id % 3 = 0) AS navic_snr, count(*) AS used FROM tel WHERE k % 4 > 0 GROUP BY session_id),
s AS (SELECT *, gps_n * greatest(coalesce(gps_snr, 0), 1) AS g, navic_n * greatest(coalesce(navic_snr, 0), 1) AS v FROM b) SELECT session_id, gps_n, round(gps_snr, 6) AS gps_snr, navic_n, round(navic_snr, 6) AS navic_snr, used, round(CASE WHEN g + v > 0 THEN g / (g + v) ELSE 0 END, 6) AS gps_weight, round(CASE WHEN g + v > 0 THEN v / (g + v) ELSE 0 END, 6) AS navic_weight FROM s"""


def risk(spark, sf):
    gx, gy = geo.mercator_cell(c("lat"), c("lon"), 2000.0)
    return rounded(A.risk_cells(telemetry(spark, sf).select(gx.alias("mx"), gy.alias("my"), c("session_id").alias("journey_id"), (c("event_type") == "error").alias("degraded"))))


RISK = f"""WITH {TEL}, j AS (SELECT floor(6378137.0::DOUBLE * radians(lon) / 2000)::BIGINT AS mx, floor(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)) / 2000)::BIGINT AS my, session_id, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS share FROM tel GROUP BY ALL)
SELECT mx, my, sum(n)::BIGINT AS observations, count(*) AS journeys, round(avg(share), 6) AS risk FROM j GROUP BY mx, my HAVING sum(n) >= 6 AND count(*) >= 3"""


def mount(spark, sf):
    s = A.mount_stats(channels(spark, sf), "ax", "ay", "gx", "gz", "trip_id")
    pooled = A.pool_mount(s.withColumn("session", c("trip_id") % 10), "session")
    return rounded(A.fit_mount(s).select("trip_id", F.lit("trip").alias("level"), "theta", "rho", "z").unionByName(A.fit_mount(pooled).select(c("session").alias("trip_id"), F.lit("session").alias("level"), "theta", "rho", "z")))


MOUNT = f"""WITH {CHAN}, s AS (SELECT trip_id, count(*) AS n, count(*) * (covar_pop(ax, gx) + covar_pop(ay, gz)) AS a, count(*) * (covar_pop(ay, gx) - covar_pop(ax, gz)) AS b, count(*) * (var_pop(ax) + var_pop(ay)) AS pp, count(*) * (var_pop(gx) + var_pop(gz)) AS ee FROM chan GROUP BY trip_id),
u AS (SELECT trip_id, 'trip' AS level, n, a, b, pp, ee FROM s UNION ALL SELECT trip_id % 10, 'session', sum(n), sum(a), sum(b), sum(pp), sum(ee) FROM s GROUP BY trip_id % 10), f AS (SELECT *, CASE WHEN n >= 50 THEN sqrt(a * a + b * b) / sqrt(pp * ee) ELSE 0 END AS rho FROM u)
SELECT trip_id, level, round(CASE WHEN n >= 50 THEN atan2(b, a) ELSE 0 END, 6) AS theta, round(rho, 6) AS rho, round(rho * sqrt(n / 50.0::DOUBLE), 6) AS z FROM f"""


def lags(spark, sf):
    d = read_table(spark, sf, "supplier").select(c("s_suppkey").alias("trip_id"), c("s_nationkey").alias("session"), (c("s_suppkey") % 31 - 15).alias("lag"), (c("s_suppkey") % 7 / 1.5).alias("z"), (c("s_suppkey") % 9 / 10.0 + 0.05).alias("corr"), (c("s_suppkey") * 13 % 900 + 50).alias("n"))
    return A.choose_lags(d)


LAGS = """WITH d AS (SELECT s_suppkey AS trip_id, s_nationkey AS session, s_suppkey % 31 - 15 AS lag, s_suppkey % 7 / 1.5::DOUBLE AS z, (s_suppkey * 13 % 900 + 50) * pow(s_suppkey % 9 / 10.0::DOUBLE + 0.05, 2) AS w FROM supplier),
r AS (SELECT session, lag, sum(w) OVER (PARTITION BY session ORDER BY lag, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(w) OVER (PARTITION BY session) AS al FROM d WHERE z >= 3), m AS (SELECT session, min(lag) AS m FROM r WHERE upto * 2 >= al GROUP BY session)
SELECT trip_id, CASE WHEN z >= 3 THEN lag ELSE coalesce(m, 0) END AS lag, CASE WHEN z >= 3 THEN 'own' WHEN m IS NOT NULL THEN 'session' ELSE 'unverified' END AS source FROM d LEFT JOIN m USING (session)"""


def scaler(spark, sf):
    return rounded(A.fit_scaler(channels(spark, sf), FEATURES[:6]))


SCALER = f"WITH {CHAN} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 6) AS std FROM chan" for f in FEATURES[:6])


def correlations(spark, sf):
    return rounded(A.feature_correlation(channels(spark, sf), ["ax", "ay", "az", "gz"]))


CORRELATIONS = f"WITH {CHAN} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM chan" for i, a in enumerate(("ax", "ay", "az", "gz")) for b in ("ax", "ay", "az", "gz")[i:])


def gates(spark, sf):
    d = telemetry(spark, sf).select("event_id", "t_us", c("event_type").alias("source"), (c("k") % 3 > 0).alias("accepted"), F.concat(F.lit("r"), (c("k") % 9).cast("string")).alias("reason"))
    return A.gate_counts(d, F.lit(1_705_000_000_000_000), 86_400 * 4)


GATES = f"WITH {TEL} SELECT event_type AS source, count(*) FILTER (k % 3 > 0) AS accepted, count(*) FILTER (k % 3 = 0) AS refused, arg_max('r' || (k % 9), (t_us, event_id)) AS last_reason, max(t_us) AS last_us FROM tel WHERE t_us > 1705000000000000 - 86400 * 4 * 1000000::BIGINT AND t_us <= 1705000000000000 GROUP BY event_type"


def speed_fit(spark, sf):
    return rounded(A.speed_calibration(channels(spark, sf), "trip_id", "i", "pred_ms", "speed_ms"))


SPEED_FIT = f"""WITH {CHAN}, d AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY i DESC) AS r FROM chan), s AS (SELECT trip_id, count(*) AS n, regr_slope(speed_ms, pred_ms) AS slope, avg(speed_ms) AS mg, avg(pred_ms) AS mm, stddev_pop(pred_ms) AS spread FROM d WHERE r <= 300 GROUP BY trip_id),
u AS (SELECT *, spread >= 2 AND slope BETWEEN 0.7 AND 1.4 AS ok FROM s) SELECT trip_id, n, round(CASE WHEN ok THEN slope ELSE 1 END, 6) AS scale, round(mg - CASE WHEN ok THEN slope ELSE 1 END * mm, 6) AS "offset", n >= 30 AND NOT (spread >= 2 AND NOT ok) AS ready FROM u"""

CASES = {
    "session_summary": (session_summary, SUMMARY), "a01_raw_trip_stats": (raw_stats, RAW), "a01_interval_histogram": (histogram, HISTOGRAM), "a02_speed_stats": (speeds, SPEEDS), "a03_group_table": (groups, GROUPS), "a04_speed_distribution": (distribution, DISTRIBUTION),
    "a08_speed_metrics": (metrics, METRICS), "a09_speed_bands": (bands, BANDS), "a10_sigma_calibration": (calibration, CALIBRATION), "a12_dashboard": (dashboard, DASHBOARD), "a12_recent_sessions": (recent, RECENT), "a13_outage_stats": (outage_stats, OUTAGES),
    "a14_median_over_drives": (over_drives, OVER_DRIVES), "a18_satellites": (satellites, SATELLITES), "a20_risk_cells": (risk, RISK), "a21_mount_fit": (mount, MOUNT), "a22_choose_lags": (lags, LAGS), "a23_scaler": (scaler, SCALER), "a24_correlation": (correlations, CORRELATIONS),
    "a27_gate_counts": (gates, GATES), "a30_speed_calibration": (speed_fit, SPEED_FIT),
}
