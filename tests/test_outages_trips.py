"""Trip files, the drive filter, the reports, and the cost of alignment on one long drive."""

import time

import numpy as np
from pyspark.sql import functions as F

from drivespark.operators import outages as O
from drivespark.operators import replay as R
from drivespark.operators.joins import align_streams
from drivespark.operators.series import repair_time, shift_channels
from drivespark.sources import trips as T


def test_trip_files(spark, tmp_path):
    folder = tmp_path / "Vta (Driver A)" / "V-Vta02"
    folder.mkdir(parents=True)
    phone = "GPS LATITUDE (\xb0),GPS SPEED (Kmh),GPS SATELLITES IN RANGE,DATE (YYYY-MO-DD),ACCELEROMETER X (m/s\xb2),NOTE\n52.1,3.5,18 / 19,2019-09-07 09:13:29:506,0.2,x\nbad,,7,never,1,y\n"
    (folder / "S-Vta02.csv").write_bytes(phone.encode("latin-1"))
    (folder / "V-Vta02.csv").write_bytes(b"TIME SINCE START OF DAY (s),LATITUDE (deg),YAW RATE (deg/s)\n33209.5,52.1,0.1\n")
    lone = tmp_path / "M (Driver B)"
    lone.mkdir()
    (lone / "S-M.csv").write_text("DATE\n")
    rows = T.read_trip_csvs(spark, str(folder / "S-Vta02.csv"), "phone").orderBy("_row").collect()
    assert (rows[0].gps_lat, rows[0].gps_speed_ms, rows[0].gps_sats, rows[0].wall_s, rows[0].wall_day, rows[0].acc_x) == (52.1, 3.5, 18.0, 33209.506, 20190907, 0.2)
    assert rows[1].gps_lat is None and rows[1].wall_s is None and "NOTE" not in rows[0].asDict()
    assert T.read_trip_csvs(spark, str(folder / "V-Vta02.csv"), "vehicle").first().v_yaw_dps == 0.1
    files = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*.csv")], "path string")
    pairs, errors = T.discover_trip_pairs(files)
    assert [(r.trip_id, r.category, r.driver) for r in pairs.collect()] == [("Vta02", "Vta", "A")]
    assert [(r.path.split("/")[-1], r.n) for r in errors.collect()] == [("S-M.csv", 0)]
    T.write_dataset(pairs.withColumn("split", F.lit("train")), str(tmp_path / "set"), ["trip_id"], "split")
    assert T.read_dataset(spark, str(tmp_path / "set")).first().split == "train"


def test_outage_report(spark):
    d = spark.createDataFrame([("a", 1, 10, 200.0, 5.0), ("a", 2, 30, None, None)], "drive string, start_us long, duration_s int, distance_m double, error_m double")
    assert [tuple(r)[1:] for r in T.outage_csv_report(d).orderBy("outage").collect()] == [(1, "10.0", "200.0", "5.0", "2.50", "yes"), (2, "30.0", "", "", "", "")]
    assert [tuple(r) for r in O.outage_log_summary(d).collect()] == [("a", 2, 1, 2.5, 2.5)]


def test_drive_filter_follows_a_straight_drive(spark):
    n = 300
    rows = [("d", i / 10, 0.0, 0.0, *((10.0 * i / 10, 0.0, 4.0, 10.0, 0.0) if i % 10 == 0 else (None,) * 5)) for i in range(n)]
    got = R.fuse_drive(spark.createDataFrame(rows, "drive string, t_s double, accel double, yaw double, fix_x double, fix_y double, fix_var double, fix_speed double, fix_heading double")).orderBy("t_s").toPandas()
    assert len(got) == n and abs(got.v.iloc[-1] - 10) < 1e-6 and abs(got.x.iloc[-1] - 10 * (n - 1) / 10) < 0.1 and abs(got.y.iloc[-1]) < 1e-9
    assert got.sigma.iloc[-1] < got.sigma.iloc[0]


def test_lag_is_found_by_brute_force():
    rng = np.random.default_rng(0)
    a = rng.normal(size=500)
    for lag in (-7, 0, 12):
        b = np.roll(a, lag) + 0.1 * rng.normal(size=500)
        assert R.best_lag(a, b, 20)[0] == lag
    assert R.best_lag(a[:40], a[:40], 5) == (0, 0.0, 40)


def test_alignment_and_repair_are_linear_in_a_drive(spark):
    """One long drive: rows that a growing frame handles in seconds and a shrinking one in hours."""
    n = 200_000
    grid = spark.range(n).select(F.lit("d").alias("k"), (F.col("id") * 0.1).alias("t"))
    stream = spark.range(n).select(F.lit("d").alias("k"), (F.col("id") * 0.1 + 0.03).alias("t"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("v"))
    began = time.time()
    r = align_streams(grid, stream, ["k"], "t", ["x"], ["v"]).agg(F.count("x"), F.max("x"), F.sum(F.abs(F.col("x") - (F.col("t") - 0.03) * 10))).first()
    assert r[0] == n and r[1] < n and r[2] < 1
    same = repair_time(spark.range(n).select(F.lit("d").alias("k"), "id", (F.floor(F.col("id") / 2) * 1.0).alias("c")), "c", ["k"], "id").where("id < 100").orderBy("id").collect()
    assert [round(x.c, 6) for x in same] == [i / 2 for i in range(100)]
    assert time.time() - began < 60


def test_shift_by_window_equals_join(spark):
    d = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * 1.5).alias("x"), ((F.col("id") % 3) * 2 - 2).cast("int").alias("lag"))
    rows = lambda **o: sorted(map(tuple, shift_channels(d, ["x"], ["k"], "o", "lag", **o).collect()), key=lambda r: r[1])
    assert rows() == rows(max_lag=2) and any(r[2] is None for r in rows())
