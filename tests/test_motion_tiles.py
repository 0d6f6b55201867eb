"""Gravity and yaw in pieces and on planted turns; lines clipped to boxes against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from drivespark.operators import motion, tiles

IMU = "drive_id int, t_us long, ax double, ay double, az double, gx double, gy double, gz double"


def test_yaw_rate_of_a_phone_that_lies_any_way(spark):
    rng, rows = random.Random(1), []
    for drive in (1, 2, None):
        v = [rng.gauss(0, 1) for _ in range(3)]
        up = [x / math.hypot(*v) for x in v]
        rows += [(drive, n * 20_000, *(9.81 * u for u in up), *(-0.3 * u for u in up)) for n in range(120)]
    rows += [(3, n * 20_000, 9.81 * math.sin(n / 60), 0.0, 9.81 * math.cos(n / 60), 0.0, 0.0, 0.1) for n in range(200)]  # turned in the hand
    rows += [(1, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 5, None, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 6, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0), (4, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, IMU).where("NOT isnan(ax) OR ax IS NULL").repartition(3)
    got = motion.yaw_rate_invariant(frame).collect()
    assert len(got) == 3 * 120 + 200 + 1
    for r in got:
        if r.drive_id in (1, 2, None):
            assert r.yaw_rate == pytest.approx(0.3) and r.wobble_deg < 0.01 and not r.handling
    assert any(r.handling for r in got if r.drive_id == 3) and [r.yaw_rate for r in got if r.drive_id == 4] == [0.0]
    key = lambda df: sorted((str(r.drive_id), r.t_us, round(r.up_x, 9), round(r.wobble_deg, 6)) for r in df.collect())
    assert key(motion.yaw_rate_invariant(frame, piece=33)) == key(motion.yaw_rate_invariant(frame))
    assert motion.yaw_rate_invariant(frame.where("false")).count() == 0


def plain_clip(line, s, w, n, e):
    pieces, open_ = [], None
    pts = list(zip(line[::2], line[1::2], strict=True))
    for (y, x), (y2, x2) in zip(pts, pts[1:], strict=False):
        dy, dx, t0, t1, ok = y2 - y, x2 - x, 0.0, 1.0, True
        for p, q in ((-dx, x - w), (dx, e - x), (-dy, y - s), (dy, n - y)):
            if p == 0:
                ok = ok and q >= 0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if not ok or t0 > t1:
            open_ = None
            continue
        if t0 > 0 or open_ is None:
            open_ = [y + t0 * dy, x + t0 * dx]
            pieces.append(open_)
        open_ += [y + t1 * dy, x + t1 * dx]
        if t1 < 1:
            open_ = None
    return pieces


def test_clipping_equals_a_plain_version(spark):
    rng = random.Random(3)
    lines = {i: [float(rng.randrange(0, 11)) for _ in range(2 * rng.randint(2, 9))] for i in range(120)}
    lines |= {200: [1.0, 1.0, 2.0, 2.0], 201: [5.0, 5.0], 202: [0.0, 5.0, 10.0, 5.0, 10.0, 6.0, 0.0, 6.0], 203: [3.0, 0.0, 3.0, 10.0]}
    rows = [(i, v, 3.0) for i, v in lines.items()] + [(200, lines[200], 3.0), (None, lines[200], 3.0), (300, None, 3.0), (301, [1.0, None, 2.0, 3.0], 3.0)]
    frame = spark.createDataFrame(rows, "line_id int, polyline array<double>, s double").repartition(3)
    got = {(r.line_id, r.piece): r.polyline for r in tiles.clip_to_box(frame, F.col("s"), 3.0, 7, 8.0).collect()}
    want = {(i, k): p for i, v in lines.items() for k, p in enumerate(plain_clip(v, 3.0, 3.0, 7.0, 8.0))}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert len([k for k in got if k[0] == 202]) == 2 and max(k[1] for k in got) >= 2
    assert tiles.clip_to_box(frame.where("false"), 0.0, 0.0, 1.0, 1.0).count() == 0
