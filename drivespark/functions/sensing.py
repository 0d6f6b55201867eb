"""Sensor and positioning scores on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geo import clamp

FEATURES = ("ax", "ay", "az", "gx", "gy", "gz", "norm_a", "norm_g", "dax", "day", "daz", "pitch", "roll")


def failed_telemetry_fields(lat: Column, lon: Column, speed: Column, heading: Column, confidence: Column) -> Column:
    """Names of the fields out of range, in this order; a null field fails."""
    bad = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), name)
    return F.array_compact(F.array(
        bad((lat >= -90) & (lat <= 90), "latitude"), bad((lon >= -180) & (lon <= 180), "longitude"), bad(speed >= 0, "speed"),
        bad((heading >= 0) & (heading < 360), "heading"), bad((confidence >= 0) & (confidence <= 1), "confidence"),
    ))


def imu_features_13(df: DataFrame, keys: tuple[str, ...] = ("trip_id", "seg_id"), order: str = "t", dt: float = 0.1) -> DataFrame:
    """``df`` with norms, jerk (backward difference by dt, 0 at a segment's start) and tilt."""
    w = Window.partitionBy(*keys).orderBy(order)
    ax, ay, az, gx, gy, gz = (F.col(c) for c in FEATURES[:6])
    jerk = {f"d{c}": F.coalesce((F.col(c) - F.lag(c).over(w)) / dt, F.lit(0.0)) for c in ("ax", "ay", "az")}
    return df.withColumns({
        "norm_a": F.sqrt(ax * ax + ay * ay + az * az), "norm_g": F.sqrt(gx * gx + gy * gy + gz * gz), **jerk,
        "pitch": F.atan2(ax, F.sqrt(ay * ay + az * az)), "roll": F.atan2(ay, az),
    })


def phone_to_vehicle(acc_x: Column, acc_y: Column, acc_z: Column, gyro_yaw: Column, gyro_pitch: Column, gyro_roll: Column, theta: Column) -> Column:
    """Vehicle axes (forward, left, up) from a phone that lies flat: the horizontal plane turns by ``theta``; the column
    labelled pitch carries the yaw rate."""
    c, s = F.cos(theta), F.sin(theta)
    return F.struct((c * acc_x + s * acc_y).alias("ax"), (c * acc_y - s * acc_x).alias("ay"), acc_z.alias("az"), gyro_roll.alias("gx"), gyro_yaw.alias("gy"), gyro_pitch.alias("gz"))


def thermal_correct(accel: Column, gyro: Column, temp_c: Column, reference_c: float = 25.0, accel_coeff: float = 0.0015, gyro_coeff: float = 0.0008) -> Column:
    """One axis of each, less a bias that is linear in temperature; without a temperature only the flag says so."""
    known = temp_c.isNotNull() & ~F.isnan(temp_c)
    delta = F.when(known, temp_c - reference_c).otherwise(0.0)
    return F.struct((accel - delta * accel_coeff).alias("accel"), (gyro - delta * gyro_coeff).alias("gyro"), F.coalesce(known, F.lit(False)).alias("active"))


def pressure_height_m(p_hpa: Column, ref_hpa: Column) -> Column:
    """Height over the reference pressure; null unless both lie between 300 and 1100 hPa."""
    fits = lambda p: (p > 300) & (p < 1100)
    return F.when(fits(p_hpa) & fits(ref_hpa), F.lit(44330.0) * (F.lit(1.0) - F.pow(p_hpa / ref_hpa, F.lit(1 / 5.255))))


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return clamp(x, float(lo), float(hi))


def mount_quality(wobble_deg: Column, handling: Column, vibration: Column, field_ut: Column, align_conf: Column, unstable_deg: float = 8.0, field_range: tuple[float, float] = (15.0, 90.0)) -> Column:
    """Four scores of 0 to 100, their mean, a label (at most fair while the alignment is unknown) and whether it moves."""
    lo, hi = field_range
    steady = F.when(handling, 20.0).when(wobble_deg.isNull(), 100.0).otherwise(F.lit(100.0) * (F.lit(1.0) - _clamp(wobble_deg / unstable_deg, 0, 2) / 2))
    shaking = F.when(vibration.isNull(), 100.0).otherwise(F.lit(100.0) * (F.lit(1.0) - _clamp(vibration, 0, 1)))
    middle, half = (lo + hi) / 2, (hi - lo) / 2
    magnetic = F.when(field_ut.isNull(), 70.0).when((field_ut < lo) | (field_ut > hi), 0.0).otherwise(_clamp(F.lit(100.0) * (F.lit(1.0) - F.abs(field_ut - middle) / half), 0, 100))
    aligned = F.lit(100.0) * _clamp(F.coalesce(align_conf, F.lit(0.0)), 0, 1)
    overall = (steady + shaking + magnetic + aligned) / 4
    label = F.when((overall >= 65) & (aligned < 50), "fair").when(overall >= 85, "excellent").when(overall >= 65, "good").when(overall >= 40, "fair").otherwise("poor")
    return F.struct(
        steady.alias("stability"), shaking.alias("vibration"), magnetic.alias("magnetic"), aligned.alias("alignment"), overall.alias("overall"),
        label.alias("label"), (handling | F.coalesce(wobble_deg >= unstable_deg, F.lit(False))).alias("unstable"),
    )


def confidence_score(sigma_m: Column, ms_since_fix: Column, mode: Column) -> Column:
    """Struct ``score`` (0 to 100) and ``band``: 3 points a metre of sigma, 1.5 a second of dead reckoning, 10 if degraded."""
    lost = F.when(mode == "DEAD_RECKONING_ONLY", F.coalesce(ms_since_fix, F.lit(0)) / 1000.0 * 1.5).when(mode == "DEGRADED", 10.0).otherwise(0.0)
    score = _clamp(F.floor(F.lit(100.0) - sigma_m * 3 - lost + 0.5), 0, 100).cast("int")
    return F.struct(score.alias("score"), F.when(score >= 80, "reliable").when(score >= 50, "degraded").otherwise("unreliable").alias("band"))


def gnss_fix_quality(accuracy_m: Column) -> Column:
    """Struct ``score`` and ``class`` of a fix by its accuracy, piecewise linear."""
    line = lambda a, b, x0, x1: F.lit(a) + (F.lit(b) - F.lit(a)) * _clamp((accuracy_m - x0) / (x1 - x0), 0, 1)
    score = F.when(accuracy_m <= 8, 1.0).when(accuracy_m <= 20, line(1.0, 0.75, 8.0, 20.0)).when(accuracy_m <= 50, line(0.75, 0.45, 20.0, 50.0)).otherwise(line(0.45, 0.1, 50.0, 120.0))
    score = F.when(accuracy_m.isNotNull(), score)
    kind = F.when((score >= 0.9) & (accuracy_m <= 8), "excellent").when(score >= 0.7, "good").when(score >= 0.45, "degraded").when(score.isNotNull(), "poor")
    return F.struct(score.alias("score"), kind.alias("class"))
