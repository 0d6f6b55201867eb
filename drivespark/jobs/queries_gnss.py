"""Queries of fixes and receivers along drives, over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gnss as N
from .demo import TEL, telemetry
from .queries_aggregates import rounded

c = F.col


def _fixes(spark, sf):
    """A fix for each event, some broken, mocked, inaccurate or without a bearing; hours are made seconds."""
    e, v = c("event_id"), c("speed")
    return telemetry(spark, sf).select(
        c("session_id").alias("drive_id"), e.alias("fix_id"), F.floor(c("t_us") / 2000).alias("t_us"), F.when(e % 37 > 0, F.lit(12.0) + c("k") / 20000.0 + F.floor(e % 700 / 650) / 50.0).alias("lat"), (F.lit(77.0) + e % 100 / 20000.0).alias("lon"),
        (e * 7 % 130).cast("double").alias("accuracy_m"), v.alias("speed_mps"), F.when(e % 5 > 0, c("heading")).alias("bearing_deg"), (e % 31 == 0).alias("mocked"), F.when(e % 4 > 0, v + e % 29 - 14).alias("inertial_mps"), (c("heading") + e % 90).alias("inertial_deg"),
    )


def gates(spark, sf):
    return rounded(N.gnss_gates(_fixes(spark, sf)).select("drive_id", "fix_id", "reason", "score", "integrity", "sigma_m"))


def _apart(lat0, lon0, lat1, lon1):
    s = f"(1 - 0.00669437999014::DOUBLE * pow(sin(radians({lat0})), 2))"
    return f"sqrt(pow(radians({lat1} - {lat0}) * 6378137.0::DOUBLE * (1 - 0.00669437999014::DOUBLE) / ({s} * sqrt({s})), 2) + pow(radians({lon1} - {lon0}) * 6378137.0::DOUBLE / sqrt({s}) * cos(radians({lat0})), 2))"


_ORDER = "t_us, lat NULLS FIRST, lon, accuracy_m"
GATES = f"""WITH RECURSIVE {TEL},
f0 AS (
  SELECT session_id AS drive_id, event_id AS fix_id, t_us // 2000 AS t_us, CASE WHEN event_id % 37 > 0 THEN 12.0::DOUBLE + k / 20000.0::DOUBLE + (event_id % 700 // 650) / 50.0::DOUBLE END AS lat, 77.0::DOUBLE + event_id % 100 / 20000.0::DOUBLE AS lon,
         (event_id * 7 % 130)::DOUBLE AS accuracy_m, speed AS v, CASE WHEN event_id % 5 > 0 THEN heading END AS bearing, event_id % 31 = 0 AS mocked, CASE WHEN event_id % 4 > 0 THEN speed + event_id % 29 - 14 END AS iv, heading + event_id % 90 AS ih FROM tel),
f AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY {_ORDER}) AS n, CASE WHEN lat IS NULL THEN 'non_finite' WHEN lat = 0 AND lon = 0 THEN 'out_of_bounds' WHEN mocked THEN 'mocked' WHEN accuracy_m <= 0 OR accuracy_m > 120 THEN 'accuracy' END AS own FROM f0),
r AS (
  SELECT DISTINCT drive_id, 0::BIGINT AS n, 'start' AS reason, NULL::DOUBLE AS implied, NULL::BIGINT AS lt, NULL::DOUBLE AS llat, NULL::DOUBLE AS llon, NULL::DOUBLE AS lacc, NULL::DOUBLE AS lv, NULL::DOUBLE AS lb, NULL::DOUBLE AS reached FROM f
  UNION ALL
  SELECT drive_id, n, reason, CASE WHEN reason <> 'stale' AND own IS NULL THEN implied END, CASE WHEN reason = 'none' THEN t_us ELSE lt END, CASE WHEN reason = 'none' THEN lat ELSE llat END, CASE WHEN reason = 'none' THEN lon ELSE llon END, CASE WHEN reason = 'none' THEN accuracy_m ELSE lacc END,
         CASE WHEN reason = 'none' THEN v ELSE lv END, CASE WHEN reason = 'none' THEN bearing ELSE lb END, CASE WHEN reason = 'none' THEN coalesce(implied, v) ELSE reached END
  FROM (
    SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN lt IS NULL THEN 'none' WHEN dt <= 0 THEN 'stale' WHEN implied > 90 + spread THEN 'jump' WHEN abs(implied - reached) / dt > 15 + spread / greatest(dt, 0.2) THEN 'acceleration'
      WHEN v > 2 AND lv > 2 AND abs(180 - ((180 - (bearing - lb)) % 360 + 360) % 360) / dt > least(120, degrees(8.0) / greatest(v, 1)) THEN 'heading' ELSE 'none' END AS reason
    FROM (
      SELECT f.*, lt, llat, llon, lacc, lv, lb, reached, (t_us - lt) / 1000000.0::DOUBLE AS dt, CASE WHEN t_us > lt THEN (lacc + accuracy_m) / ((t_us - lt) / 1000000.0::DOUBLE) END AS spread,
             CASE WHEN t_us > lt THEN {_apart("llat", "llon", "lat", "lon")} / ((t_us - lt) / 1000000.0::DOUBLE) END AS implied
      FROM r JOIN f ON f.drive_id = r.drive_id AND f.n = r.n + 1) x) y),
g AS (SELECT f.*, r.reason, r.implied, r.reason = 'none' AS ok FROM f JOIN r ON f.drive_id = r.drive_id AND f.n = r.n),
w AS (SELECT *, list(struct_pack(a := lat, b := lon)) OVER q AS rec, avg(lat) OVER q AS mlat, avg(lon) OVER q AS mlon FROM g WINDOW q AS (PARTITION BY drive_id, ok ORDER BY {_ORDER} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, coalesce(ok AND iv >= 3 AND len(rec) = 8 AND len(list_filter(rec, lambda p: {_apart("mlat", "mlon", "p.a", "p.b")} > 6)) = 0, false) AS swings FROM w),
s AS (SELECT *, CASE WHEN ok THEN CASE WHEN accuracy_m <= 8 THEN 1.0::DOUBLE WHEN accuracy_m <= 20 THEN 1 - 0.25::DOUBLE * (accuracy_m - 8) / 12 WHEN accuracy_m <= 50 THEN 0.75::DOUBLE - 0.3::DOUBLE * (accuracy_m - 20) / 30 ELSE 0.45::DOUBLE - 0.35::DOUBLE * (accuracy_m - 50) / 70 END
  * CASE WHEN swings THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN v > 3 AND iv > 3 AND abs(180 - ((180 - (bearing - ih)) % 360 + 360) % 360) > 60 THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN abs(v - iv) > 10 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN iv < 0.3 AND implied > 8 THEN 0.4::DOUBLE ELSE 1 END ELSE 0 END AS score FROM o),
k AS (SELECT *, sum(CASE WHEN NOT ok OR score < 0.5 OR swings THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id ORDER BY {_ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS strikes FROM s)
SELECT drive_id, fix_id, reason, round(score, 6) AS score, CASE WHEN strikes >= 3 THEN 'anomaly' WHEN strikes = 2 THEN 'unreliable' WHEN strikes = 1 THEN 'degraded' ELSE 'healthy' END AS integrity,
       round(CASE WHEN ok THEN accuracy_m / greatest(score, 0.2) WHEN accuracy_m > 0 THEN accuracy_m ELSE 0 END, 6) AS sigma_m FROM k"""


def _receiver(spark, sf):
    """A fix or a receiver's sample for each event, some 2 seconds apart."""
    e = c("event_id")
    return telemetry(spark, sf).select(
        c("session_id").alias("drive_id"), F.floor(c("t_us") / 20000).alias("t_us"), F.when(e % 3 > 0, "fix").otherwise("sample").alias("kind"), F.when(e % 41 == 0, "jump").when(e % 43 == 0, "heading").alias("reject"), (F.lit(3.0) + e % 17).alias("accuracy_m"),
        (e % 14).cast("int").alias("visible"), (e % 11).cast("int").alias("used"), (F.lit(21.0) + e * 13 % 23).cast("double").alias("mean_cn0"), (e * 5 % 41).cast("double").alias("cn0_range"), (e % 4).cast("int").alias("kinds"), (e % 10 / 10.0).alias("low_share"),
        F.when(e % 2 == 0, (e * 3 % 11).cast("double")).alias("gain_db"), (e % 50 / 12).cast("int").alias("multipath"), F.when(e % 6 > 0, F.floor(e / 900).cast("int")).alias("clock_count"),
    )


def health(spark, sf):
    return N.gnss_health(_receiver(spark, sf)).withColumn("reasons", F.array_join("reasons", ","))


CASES = {"w22_gnss_gates": (gates, GATES), "r05_gnss_health": (health, None)}
