"""Stops of samples whose spread lies on the limit, against the SQL of the stop query."""

import duckdb

from drivespark.jobs.queries_faults import STOPS
from drivespark.operators import faults as X


def test_spreads_on_the_limit_are_decided_as_the_sql_does(spark):
    tenths = [8, 4, 15, 18, 6, 2, 16, 11, 13, 21, 18]  # any second holds all eleven: its spread is 0.6
    rows = [(1, i * 100_000, 9.81 + (tenths[i % 11] / 10.0 - 2.5)) for i in range(66)]
    found = X.stop_intervals(X.stop_detection(spark.createDataFrame(rows, "drive long, t_us long, magnitude double")))
    con = duckdb.connect()
    con.execute("CREATE TABLE s (drive BIGINT, t BIGINT, m DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?)", rows)
    want = con.execute("WITH q AS (" + STOPS.split("q AS (", 1)[1]).fetchall()
    assert len(want) == 1
    assert sorted(tuple(r) for r in found.select("drive", "start_us", "end_us", "samples").collect()) == sorted(want)
