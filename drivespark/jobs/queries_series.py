"""Queries of the time-series operators over the derived 10 Hz rows, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sensing import FEATURES, imu_features_13
from ..operators import series as S
from .demo import CHAN, channels
from .queries_functions import r6

c = F.col
TRIP, SEG = ("trip_id",), ("trip_id", "seg_id")
_W = "WINDOW w AS (PARTITION BY trip_id ORDER BY i)"


def _clock(spark, sf):
    return channels(spark, sf).withColumn("clock", (c("i") * 977) % 86_400)


def day_clock(spark, sf):
    return S.unwrap_day_clock(_clock(spark, sf), "clock", TRIP, "i").select("trip_id", "i", "clock")


DAY_CLOCK = f"WITH {CHAN}, k AS (SELECT trip_id, i, (i * 977) % 86400 AS clock FROM chan), d AS (SELECT *, CASE WHEN lag(clock) OVER w - clock > 43200 THEN 1 ELSE 0 END AS r FROM k {_W}) SELECT trip_id, i, (clock + 86400 * sum(r) OVER w)::BIGINT AS clock FROM d {_W}"


def repaired_time(spark, sf):
    d = channels(spark, sf).withColumn("clock", (c("i") - c("i") % 3 * (c("i") % 5 == 1).cast("int")).cast("double"))
    return S.repair_time(d.withColumn("clock", F.floor(c("clock") / 2) * 1.0), "clock", TRIP, "i").select("trip_id", "i", r6(c("clock"), "clock"))


REPAIRED = f"""WITH {CHAN}, k AS (SELECT trip_id, i, floor((i - CASE WHEN i % 5 = 1 THEN i % 3 ELSE 0 END) / 2.0::DOUBLE) AS clock FROM chan), g AS (SELECT *, CASE WHEN coalesce(clock <> lag(clock) OVER w, true) THEN i END AS gi, CASE WHEN coalesce(clock <> lag(clock) OVER w, true) THEN clock END AS gt FROM k {_W}),
b AS (SELECT *, last_value(gi IGNORE NULLS) OVER u AS ai, last_value(gt IGNORE NULLS) OVER u AS at0, first_value(gi IGNORE NULLS) OVER v AS bi, first_value(gt IGNORE NULLS) OVER v AS bt FROM g WINDOW u AS (PARTITION BY trip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY trip_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT trip_id, i, round(CASE WHEN bi IS NULL OR ai = bi THEN at0 ELSE at0 + (bt - at0) * ((i - ai) / (bi - ai)::DOUBLE) END, 6) AS clock FROM b"""


def segments(spark, sf):
    return S.valid_segments(channels(spark, sf).drop("seg_id").withColumn("valid", c("speed_ms") < 16.5), "valid", TRIP, "i", 5).select("trip_id", "i", "seg_id")


SEGMENTS = f"""WITH {CHAN}, v AS (SELECT trip_id, i, speed_ms < 16.5 AS ok FROM chan), g AS (SELECT *, i - row_number() OVER (PARTITION BY trip_id, ok ORDER BY i) AS run FROM v), n AS (SELECT *, count(*) OVER (PARTITION BY trip_id, ok, run) AS len FROM g),
f AS (SELECT *, ok AND len >= 5 AS keep FROM n), s AS (SELECT *, CASE WHEN keep AND NOT coalesce(lag(keep) OVER w, false) THEN 1 ELSE 0 END AS first FROM f {_W})
SELECT trip_id, i, CASE WHEN keep THEN sum(first) OVER w - 1 ELSE -1 END::BIGINT AS seg_id FROM s {_W}"""


def shifted(spark, sf):
    return S.shift_channels(channels(spark, sf).withColumn("lag_rows", (c("trip_id") % 7 - 3).cast("int")), ["ax", "gz"], TRIP, "i", "lag_rows", max_lag=3).select("trip_id", "i", r6(c("ax"), "ax"), r6(c("gz"), "gz"))


SHIFTED = f"WITH {CHAN} SELECT trip_id, i, round(CASE trip_id % 7 - 3 WHEN -3 THEN lag(ax, 3) OVER w WHEN -2 THEN lag(ax, 2) OVER w WHEN -1 THEN lag(ax) OVER w WHEN 0 THEN ax WHEN 1 THEN lead(ax) OVER w WHEN 2 THEN lead(ax, 2) OVER w ELSE lead(ax, 3) OVER w END, 6) AS ax, round(CASE trip_id % 7 - 3 WHEN -3 THEN lag(gz, 3) OVER w WHEN -2 THEN lag(gz, 2) OVER w WHEN -1 THEN lag(gz) OVER w WHEN 0 THEN gz WHEN 1 THEN lead(gz) OVER w WHEN 2 THEN lead(gz, 2) OVER w ELSE lead(gz, 3) OVER w END, 6) AS gz FROM chan {_W}"


def ages(spark, sf):
    d = channels(spark, sf).withColumns({"la": F.floor(c("i") / 4) % 3 * 1.0, "lo": F.floor(c("i") / 6) * 1.0})
    return S.fix_age(d, "la", "lo", TRIP, "i").select("trip_id", "i", r6(c("fix_age_s"), "fix_age_s"))


AGES = f"WITH {CHAN}, p AS (SELECT trip_id, i, (i // 4) % 3 AS la, i // 6 AS lo FROM chan), g AS (SELECT *, CASE WHEN coalesce(la = lag(la) OVER w AND lo = lag(lo) OVER w, false) THEN NULL ELSE i END AS m FROM p {_W}) SELECT trip_id, i, round((i - max(m) OVER w) * 0.1::DOUBLE, 6) AS fix_age_s FROM g {_W}"


def cleaned(spark, sf):
    return S.clean_channels(channels(spark, sf), {"ax": 2.0, "gz": 0.02}, SEG, "i").select("trip_id", "i", r6(c("ax"), "ax"), r6(c("gz"), "gz"))


_MED = "greatest(least({0}, {1}), least({1}, {2}), least({0}, {2}))"
CLEANED = f"""WITH {CHAN}, n AS (SELECT trip_id, i, ax, gz, coalesce(lag(ax) OVER w, 0) AS a0, coalesce(lead(ax) OVER w, 0) AS a2, coalesce(lag(gz) OVER w, 0) AS g0, coalesce(lead(gz) OVER w, 0) AS g2 FROM chan WINDOW w AS (PARTITION BY trip_id, seg_id ORDER BY i))
SELECT trip_id, i, round(greatest(-2.0, least(2.0, {_MED.format('a0', 'ax', 'a2')})), 6) AS ax, round(greatest(-0.02, least(0.02, {_MED.format('g0', 'gz', 'g2')})), 6) AS gz FROM n"""


def jumps(spark, sf):
    return S.speed_jump_mask(channels(spark, sf), "speed_ms", TRIP, "i").select("trip_id", "i", "valid")


JUMPS = f"WITH {CHAN} SELECT trip_id, i, coalesce(abs(speed_ms - lag(speed_ms) OVER w) <= 3, true) AS valid FROM chan {_W}"


def accels(spark, sf):
    return S.truth_accels(channels(spark, sf), "speed_ms", "heading_deg", TRIP, "i").select("trip_id", "i", r6(c("a_long"), "a_long"), r6(c("a_lat"), "a_lat"))


def _fit(at: int) -> str:
    terms = []
    for k, weight in enumerate(S.savgol_weights(11, 2, at)):
        off = k - at
        terms.append(f"{weight!r}::DOUBLE * " + ("g" if not off else f"{'lead' if off > 0 else 'lag'}(g, {abs(off)}) OVER w"))
    return "(" + " + ".join(terms) + ")"


ACCELS = f"""WITH {CHAN}, g AS (SELECT trip_id, i, speed_ms, heading_deg, count(*) OVER (PARTITION BY trip_id) AS m, CASE WHEN lag(speed_ms) OVER w IS NULL THEN (lead(speed_ms) OVER w - speed_ms) / 0.1 WHEN lead(speed_ms) OVER w IS NULL THEN (speed_ms - lag(speed_ms) OVER w) / 0.1 ELSE (lead(speed_ms) OVER w - lag(speed_ms) OVER w) / 0.2 END AS g FROM chan {_W}),
s AS (SELECT trip_id, i, speed_ms, heading_deg, CASE WHEN m < 11 THEN coalesce(g, 0) {' '.join(f'WHEN i = {k} THEN {_fit(k)} WHEN m - i = {k + 1} THEN {_fit(10 - k)}' for k in range(5))} ELSE {_fit(5)} END AS a FROM g {_W})
SELECT trip_id, i, round(a, 6) AS a_long, round(speed_ms * radians(heading_deg), 6) AS a_lat FROM s"""


def windows(spark, sf):
    d = S.make_windows(imu_features_13(channels(spark, sf)), FEATURES, "speed_ms")
    last, first = F.element_at("features", -1), F.element_at("features", 1)
    return d.select("trip_id", "seg_id", "start", "stop", F.size("features").alias("rows"), F.round(F.element_at(first, 1).cast("double"), 3).alias("first_ax"), F.round(F.element_at(last, 7).cast("double"), 3).alias("last_norm"), F.round(c("y").cast("double"), 2).alias("y"), F.round(c("vib").cast("double"), 4).alias("vib"))


WINDOWS = f"""WITH {CHAN}, f AS (SELECT *, row_number() OVER v AS n, sqrt(ax * ax + ay * ay + az * az) AS nrm, lag(ax, 19) OVER v AS ax0 FROM chan WINDOW v AS (PARTITION BY trip_id, seg_id ORDER BY t)),
g AS (SELECT *, avg(abs(nrm - 9.81)) OVER (PARTITION BY trip_id, seg_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vb FROM f)
SELECT trip_id, seg_id, n - 20 AS start, n AS stop, 20 AS rows, round(ax0::FLOAT::DOUBLE, 3) AS first_ax, round(nrm::FLOAT::DOUBLE, 3) AS last_norm, round(speed_ms::FLOAT::DOUBLE, 2) AS y, round(least(1.0, vb / 3)::FLOAT::DOUBLE, 4) AS vib FROM g WHERE n >= 20 AND (n - 20) % 2 = 0"""


def quiet(spark, sf):
    return S.stationary_flags(channels(spark, sf), SEG, "i", max_std=0.3, max_yaw=0.015).select("trip_id", "i", "quiet")


QUIET = f"""WITH {CHAN}, n AS (SELECT trip_id, seg_id, i, sqrt(ax * ax + ay * ay + az * az) AS m, abs(gz) AS g FROM chan)
SELECT trip_id, i, coalesce(count(m) OVER w = 10 AND stddev_samp(m) OVER w < 0.3 AND avg(g) OVER w < 0.015, false) AS quiet FROM n WINDOW w AS (PARTITION BY trip_id, seg_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""


def hold(spark, sf):
    return S.baseline_hold(channels(spark, sf), "speed_ms", SEG, "i", 30).select("trip_id", "i", r6(c("pred"), "pred"))


HOLD = f"WITH {CHAN} SELECT trip_id, i, round(first_value(speed_ms) OVER (PARTITION BY trip_id, seg_id, (i % 100) // 30 ORDER BY i), 6) AS pred FROM chan"


def classical(spark, sf):
    d = channels(spark, sf).withColumn("quiet", c("i") % 11 == 0)
    return S.baseline_classical_dr(d, "ax", "quiet", "speed_ms", SEG, "i", 10).select("trip_id", "i", r6(c("pred"), "pred"))


CLASSICAL = f"""WITH RECURSIVE {CHAN}, r(trip_id, i, v) AS (SELECT trip_id, i, speed_ms FROM chan WHERE i % 10 = 0
  UNION ALL SELECT x.trip_id, x.i, CASE WHEN x.i % 11 = 0 AND r.v < 2 THEN 0 ELSE greatest(0, r.v + x.ax * 0.1) END FROM r JOIN chan x ON x.trip_id = r.trip_id AND x.i = r.i + 1 WHERE x.i % 10 <> 0)
SELECT trip_id, i, round(v, 6) AS pred FROM r"""


def track(spark, sf):
    d = S.dr_track(channels(spark, sf), "speed_ms", TRIP, "i", heading_deg="heading_deg").select("trip_id", "i", "gz", "speed_ms", "heading_deg", r6(c("east"), "east"), r6(c("north"), "north"))
    g = S.dr_track(d.drop("east", "north"), "speed_ms", TRIP, "i", gz="gz", heading0="heading_deg")
    return d.select("trip_id", "i", "east", "north").join(g.select("trip_id", "i", r6(c("east"), "gyro_east"), r6(c("north"), "gyro_north")), ["trip_id", "i"])


TRACK = f"""WITH {CHAN}, h AS (SELECT *, radians(first_value(heading_deg) OVER w) - sum(gz * 0.1::DOUBLE) OVER w AS g FROM chan {_W})
SELECT trip_id, i, round(sum(speed_ms * sin(radians(heading_deg)) * 0.1::DOUBLE) OVER w, 6) AS east, round(sum(speed_ms * cos(radians(heading_deg)) * 0.1::DOUBLE) OVER w, 6) AS north,
  round(sum(speed_ms * sin(g) * 0.1::DOUBLE) OVER w, 6) AS gyro_east, round(sum(speed_ms * cos(g) * 0.1::DOUBLE) OVER w, 6) AS gyro_north FROM h {_W}"""


def upsampled(spark, sf):
    return S.upsample_linear(channels(spark, sf), ["ax", "gz"], SEG, "t").select("trip_id", r6(c("t"), "t"), r6(c("ax"), "ax"), r6(c("gz"), "gz"))


UPSAMPLED = f"""WITH {CHAN}, n AS (SELECT *, lead(t) OVER w AS t1, lead(ax) OVER w AS ax1, lead(gz) OVER w AS gz1 FROM chan WINDOW w AS (PARTITION BY trip_id, seg_id ORDER BY t))
SELECT trip_id, round(t + CASE WHEN t1 IS NULL THEN s * 0.05::DOUBLE ELSE (t1 - t) * s / 2 END, 6) AS t, round(ax + coalesce(ax1 - ax, 0) * s / 2, 6) AS ax, round(gz + coalesce(gz1 - gz, 0) * s / 2, 6) AS gz FROM n CROSS JOIN (VALUES (0), (1)) x(s)"""


def anomalies(spark, sf):
    d = channels(spark, sf).select("trip_id", (c("i") * 100).alias("t_ms"), (c("speed_ms") - 8).alias("a"))
    return S.road_anomalies(d, "a", TRIP, "t_ms").select("trip_id", "t_ms", r6(c("a"), "a"), "severity")


ANOMALIES = f"""WITH RECURSIVE {CHAN}, d AS (SELECT trip_id, i, speed_ms - 8 AS a, abs(speed_ms - 8) - avg(abs(speed_ms - 8)) OVER (PARTITION BY trip_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS d FROM chan), h AS (SELECT * FROM d WHERE d >= 2.5),
x AS (SELECT h.trip_id, h.i, (SELECT min(n.i) FROM h n WHERE n.trip_id = h.trip_id AND n.i >= h.i + 5) AS nx FROM h),
e(trip_id, i) AS (SELECT trip_id, min(i) FROM h GROUP BY trip_id UNION ALL SELECT x.trip_id, x.nx FROM e JOIN x ON x.trip_id = e.trip_id AND x.i = e.i WHERE x.nx IS NOT NULL)
SELECT h.trip_id, h.i * 100 AS t_ms, round(h.a, 6) AS a, CASE WHEN d >= 7 THEN 'HIGH' WHEN d >= 4.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM e JOIN h ON e.trip_id = h.trip_id AND e.i = h.i"""

CASES = {
    "p28_upsample": (upsampled, UPSAMPLED), "w01_day_clock": (day_clock, DAY_CLOCK), "w02_repair_time": (repaired_time, REPAIRED), "w03_valid_segments": (segments, SEGMENTS), "w04_shift_channels": (shifted, SHIFTED), "w05_fix_age": (ages, AGES),
    "w06_clean_channels": (cleaned, CLEANED), "w07_speed_jumps": (jumps, JUMPS), "w08_truth_accels": (accels, ACCELS), "w09_windows": (windows, WINDOWS), "w10_stationary": (quiet, QUIET), "w11_hold": (hold, HOLD),
    "w12_classical_dr": (classical, CLASSICAL), "w13_dr_track": (track, TRACK), "w18_road_anomalies": (anomalies, ANOMALIES),
}
