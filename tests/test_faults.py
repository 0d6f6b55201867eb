"""Planted answers for lag drift, place names and window scores."""

import numpy as np
import pandas as pd

from drivespark.operators.calibration import coarse_lag_drift, still_calibration
from drivespark.operators.faults import score_windows, stop_detection, stop_intervals
from drivespark.operators.graph import dedup_places


def test_lag_drift_finds_a_planted_line(spark):
    rng = np.random.default_rng(4)
    t = np.arange(6000)
    ref = np.convolve(rng.normal(size=7000), np.ones(5) / 5, "same")
    late = np.round(20 + t * 0.004).astype(int)
    d = spark.createDataFrame(pd.DataFrame({"trip_id": 1, "i": t, "a": ref[500 + t], "b": ref[500 + t - late]}))
    row = coarse_lag_drift(d, "a", "b", block=400, search=40, max_lag=60).first()
    # b is late by 20 samples at the start and by 44 at the end; a block's lag is by the later recorder's sample.
    assert abs(row["slope"] * 6000) - 24 < 3 and row["blocks"] >= 4


def test_lag_drift_of_nothing(spark):
    d = spark.createDataFrame([], "trip_id long, i long, a double, b double")
    assert coarse_lag_drift(d, "a", "b").count() == 0


def test_places_of_one_name(spark):
    rows = [(1, "Cafe", 12.0, 77.0, 1), (2, "CAFE", 12.002, 77.0, 3), (3, "cafe", 12.004, 77.0, 2), (4, "cafe", 12.02, 77.0, 3), (5, "bar", 12.0, 77.0, 1), (6, None, 12.0, 77.0, 1), (7, "cafe", None, 77.0, 9), (8, "cafe", 12.004, 77.0, None)]
    d = spark.createDataFrame(rows, "id long, name string, lat double, lon double, priority int")
    got = {r.id: (r.place_id, r.kept) for r in dedup_places(d).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (1, False), 8: (1, False), 4: (4, True), 5: (5, True), 6: (6, True), 7: (7, True)}
    assert dedup_places(d.limit(0)).count() == 0


def test_stops_wait_before_they_turn(spark):
    loud = [(0, i * 100_000, float(i % 2) * 5) for i in range(20)]
    quiet = [(0, 2_000_000 + i * 100_000, 9.81) for i in range(40)]
    d = spark.createDataFrame(loud + quiet + [(0, 6_000_000 + i * 100_000, float(i % 2) * 5) for i in range(10)], "drive int, t_us long, magnitude double")
    (stop,) = stop_intervals(stop_detection(d)).collect()
    # The last loud sample leaves the second's window at 3.0 s; quiet for 0.8 s since.
    assert stop.start_us == 3_800_000 and 6_000_000 < stop.end_us < 6_500_000


def test_windows_with_nulls_have_no_score(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [None, 2.0]), (3, None), (4, [1.0])] + [(5, [3.0, 4.0])], "k int, features array<double>").coalesce(1)
    got = {r.k: (r.speed_ms, r.sigma_ms, r.z_max) for r in score_windows(d, lambda x: (x.sum(axis=1), np.zeros(len(x)))).collect()}
    assert got == {1: (3.0, 1.0, 2.0), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3, 5: (7.0, 1.0, 4.0)}


def test_calibration_refuses_few_samples(spark):
    d = spark.createDataFrame([(1, i, 0.0, 0.0, 9.81, 0.01, 0.0, float("nan") if i == 7 else 0.0) for i in range(120)], "drive int, i long, ax double, ay double, az double, gx double, gy double, gz double")
    assert still_calibration(d).first().refused == "too_few"
    row = still_calibration(d, least=50).first()
    assert row.samples == 70 and abs(row.bias_x - 0.01) < 1e-12 and row.refused is None
