"""Ellipsoids, vibration lines and fault flags: planted answers, plain versions, and odd rows."""

import math
import random

import numpy as np
import pytest

from drivespark.operators import ellipsoid, flags, vibration

FIX = "drive_id int, t_us long, lat double, lon double, bearing_deg double, speed_mps double, sigma_m double, usable boolean, yaw_deg double, p_lat double, p_lon double, p_sigma_m double, p_mps double, p_deg double, accel_bias double, bias_x double, bias_y double, bias_z double"


def test_planted_ellipsoids(spark):
    rng, rows = random.Random(1), []
    want = {1: ((3.0, -4.0, 5.0), (20.0, 30.0, 25.0)), 2: ((0.5, 0.1, -9.0), (9.8, 9.9, 9.7)), None: ((0.0, 0.0, 0.0), (1.0, 2.0, 1.5))}
    for key, (centre, radii) in want.items():
        for _ in range(300):
            v = [rng.gauss(0, 1) for _ in range(3)]
            n = math.hypot(*v)
            rows.append((key, *(c + r * x / n for c, r, x in zip(centre, radii, v, strict=True))))
    rows += [(1, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0), (1, float("inf"), 0.0, 0.0)]
    rows += [(3, *r[1:]) for r in rows[:39]] + [(4, float(i), float(2 * i), float(3 * i)) for i in range(100)] + [(5, math.cos(i), math.sin(i), 0.0) for i in range(100)] + [(6, 1.0, 1.0, 1.0)] * 90
    rows += [(7, 40 * a, b, c) for _ in range(200) for a, b, c in [[x / n for x in v] for v in [[rng.gauss(0, 1) for _ in range(3)]] for n in [math.hypot(*v)]]]
    rows += [(8, 2 + 10 * abs(a), 10 * abs(b), 10 * abs(c)) for _ in range(200) for a, b, c in [[x / n for x in v] for v in [[rng.gauss(0, 1) for _ in range(3)]] for n in [math.hypot(*v)]]]
    got = {r.sensor_id: r for r in ellipsoid.ellipsoid_fit(spark.createDataFrame(rows, "sensor_id int, x double, y double, z double")).collect()}
    assert set(got) == {1, 2, None, 8}
    for key, (centre, radii) in want.items():
        r = got[key]
        assert (r.n, r.coverage) == (300, 1.0) and r.rms < 1e-6
        assert [r.centre_x, r.centre_y, r.centre_z, r.radius_x, r.radius_y, r.radius_z] == pytest.approx([*centre, *radii], abs=1e-6)
    assert got[8].coverage < 1.0 and got[8].centre_x == pytest.approx(2, abs=1e-6)
    assert ellipsoid.ellipsoid_fit(spark.createDataFrame([], "sensor_id int, x double, y double, z double")).count() == 0


def test_lines_are_found_within_a_bin():
    rng = np.random.default_rng(2)
    for hz in (2.7, 5.31, 9.9, 17.2):
        for rate in (50.0, 100.0):
            t = np.arange(int(4 * rate) + 1) / rate
            peak, prominence, bin_hz = vibration.strongest_line(np.sin(2 * np.pi * hz * t) + rng.normal(0, 0.2, len(t)), rate)
            assert abs(peak - hz) < bin_hz / 2 and prominence >= vibration.PROMINENCE
    assert vibration.strongest_line(rng.normal(0, 1, 201), 50.0) is None
    assert vibration.strongest_line(np.zeros(201), 50.0) is None


def test_speed_from_planted_lines(spark):
    imu, fixes = [], []
    for drive, scale in ((1, 2.1), (None, 1.9)):
        for n in range(60 * 50):
            speed = 8.0 + (n // 1000) * 3
            imu.append((drive, n * 20_000, math.sin(2 * math.pi * n / 50 * speed / scale) + random.Random(n).gauss(0, 0.1)))
            if n % 50 == 0:
                fixes.append((drive, n * 20_000, speed))
    imu += [(1, None, 1.0), (1, 40, None), (1, 60, float("inf")), (1, 0, 9.0), (2, 0, 1.0), (2, 20_000, 1.0)] + [(3, n * 100_000, math.sin(n)) for n in range(200)]
    lines = vibration.vibration_lines(spark.createDataFrame(imu, "drive_id int, t_us long, z double"))
    got = vibration.vibration_scale(lines, spark.createDataFrame(fixes, "drive_id int, t_us long, speed_mps double")).collect()
    assert {r.drive_id for r in got} == {1, None} and all(r.t_us % 1_000_000 == 0 for r in got)
    late = [r for r in got if r.t_us >= 45_000_000]
    assert len(late) > 20 and all(r.trusted and r.scale == pytest.approx(2.1 if r.drive_id else 1.9, rel=0.01) and r.speed_mps == pytest.approx(14.0, rel=0.02) and r.sigma_mps >= 0.4 for r in late)
    assert not any(r.trusted for r in got if r.t_us < 14_000_000)
    assert vibration.vibration_lines(spark.createDataFrame([], "drive_id int, t_us long, z double")).count() == 0


def fix(k, s, **more):
    row = dict(drive_id=k, t_us=s * 1_000_000, lat=12 + s * 1e-4, lon=77.0, bearing_deg=0.0, speed_mps=10.0, sigma_m=4.0, usable=True, yaw_deg=0.0, p_lat=12 + s * 1e-4, p_lon=77.0, p_sigma_m=1.0, p_mps=10.0, p_deg=0.0, accel_bias=0.0, bias_x=0.0, bias_y=0.0, bias_z=0.0) | more
    return tuple(row.values())


def test_planted_faults(spark):
    north = lambda s, m: 12 + s * 1e-4 + m / 110_650
    rows = [fix(1, s) for s in range(60)]  # clean
    rows += [fix(2, s, yaw_deg=0.6 if s >= 10 else 0.0) for s in range(60)]
    rows += [fix(3, s, accel_bias=0.05 + (0.3 if s >= 20 else 0.0)) for s in range(60)]
    rows += [fix(4, s, p_lon=77 + (0.0001 if s >= 20 else 0.0)) for s in range(60)]  # 11 m aside: 2.6 sigmas, less a half
    rows += [fix(5, s, p_lat=north(s, 5.0), sigma_m=40.0) for s in range(60)]
    rows += [fix(6, s, bias_y=0.05 if s >= 30 else 0.0, usable=s < 5) for s in range(60)]
    rows += [fix(7, s, p_lat=None, bias_x=None) for s in range(60)] + [fix(None, s, accel_bias=0.0 if s < 1 else 1.0) for s in range(20)] + rows[:5]
    got = {(r.drive_id, r.mechanism): r.t_us // 1_000_000 for r in flags.fault_flags(spark.createDataFrame(rows, FIX).repartition(3)).collect()}
    assert got[2, "gyro_bias"] in range(20, 30) and got[3, "accel_bias"] in range(21, 30) and got[5, "delay"] == 9 and got[6, "bias_jump"] == 30 and got[None, "accel_bias"] in range(9, 12)
    assert got[4, "integrity"] == 20 + math.ceil(15 / (0.0001 * 111_320 * math.cos(math.radians(12)) / math.sqrt(17) - 0.5)) - 1
    assert set(got) == {(2, "gyro_bias"), (3, "accel_bias"), (4, "integrity"), (5, "delay"), (6, "bias_jump"), (None, "accel_bias")}
    assert flags.fault_flags(spark.createDataFrame([], FIX)).count() == 0


def test_yaw_between_fixes(spark):
    imu = spark.createDataFrame([(1, n * 100_000, 0.1) for n in range(1, 100)] + [(1, 9_990_000, None)], "drive_id int, t_us long, yaw_rad_s double")
    fixes = spark.createDataFrame([(1, 2_000_000, True), (1, 3_000_000, False), (1, 5_000_000, True), (2, 1, True)], "drive_id int, t_us long, usable boolean")
    got = {(r.drive_id, r.t_us): r.yaw_deg for r in flags.yaw_between_fixes(imu, fixes).collect()}
    assert got == {(1, 2_000_000): pytest.approx(math.degrees(0.19)), (1, 3_000_000): pytest.approx(math.degrees(0.1)), (1, 5_000_000): pytest.approx(math.degrees(0.3)), (2, 1): 0.0}
