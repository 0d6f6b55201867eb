"""Gates in pieces, the receiver's health as a batch, event by event and as a stream, ordered release over restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from drivespark.jobs import queries_gnss
from drivespark.operators import gnss
from drivespark.streaming import ordered
from drivespark.streaming.telemetry import write_and_publish

SF = "/root/testdata/sf0.001"
EVENT = "drive_id int, t_us long, kind string, reject string, accuracy_m double, visible int, used int, mean_cn0 double, cn0_range double, kinds int, low_share double, gain_db double, multipath int, clock_count int"


def events(seed=1, keys=5, n=150):
    rng, rows = random.Random(seed), []
    for key in range(keys):
        t, calm = 0, True
        for _ in range(n):
            t += rng.choice([200_000, 900_000, 1_000_000, 2_500_000, 7_000_000 if rng.random() < 0.3 else 400_000])
            calm = rng.random() < (0.97 if calm else 0.1)
            maybe = lambda x: None if rng.random() < 0.1 else x
            if rng.random() < 0.5:
                rows.append((key, t, "fix", None if calm else rng.choice([None, "none", "jump", "heading", "acceleration", "stale"]), maybe(5.0 if calm else rng.choice([5.0, 30.0])), *[None] * 9))
            else:
                rows.append((key, t, "sample", None, None, maybe(12), maybe(9 if calm else 4), maybe(40.0 if calm else rng.choice([15.0, 25.0, 38.0])), maybe(10.0 if calm else 40.0), maybe(3), maybe(0.2 if calm else 0.7), maybe(30.0 if calm else 20.0), maybe(0 if calm else 4), maybe(int(t / 60_000_000))))
    return rows


def replayed(rows):
    """The changes of each key, one event after the other, with the timer after the last one."""
    out = []
    for key in sorted({r[0] for r in rows}):
        own, shown = ordered.ReceiverState(None), None
        for r in [*sorted(x for x in rows if x[0] == key), None]:
            event = dict(zip(("kind", "reject", "accuracy_m", *gnss.SAMPLE), r[2:], strict=True)) if r else None
            for t, e in [(own.timer(), None)] * (own.timer() is not None and (r is None or own.timer() < r[1])) + ([(r[1], event)] if r else []):
                state, why, before = own.at(t, e)
                if state != shown:
                    out.append((key, t, state, before, tuple(why)))
                    shown = state
    return out


def changes(df):
    return sorted((r.drive_id, r.t_us, r.state, r.before, tuple(r.reasons)) for r in df.collect())


def test_health_as_a_batch_equals_event_by_event(spark):
    rows = events()
    frame = spark.createDataFrame(rows, EVENT).repartition(4)
    want = sorted(replayed(rows), key=lambda x: x[:2])
    assert changes(gnss.gnss_health(frame)) == want == changes(gnss.gnss_health(frame, piece=17))
    assert {x[2] for x in want} == set(gnss.SEVERITY) and len(want) > 60


def test_health_enters_fast_leaves_slowly_and_times_out(spark):
    fix, bad = (lambda s: (1, s * 1_000_000, "fix", None, 5.0, *[None] * 9)), (lambda s, cn0: (1, s * 1_000_000, "sample", None, None, 10, 8, cn0, 5.0, 3, 0.1, None, None, None))
    rows = [fix(0), bad(1, 40.0), fix(4), bad(5, 12.0), *(x for s in range(8, 24, 3) for x in (fix(s), bad(s + 1, 40.0))), (1, 40_000_000, "fix", "jump", 5.0, *[None] * 9)]
    got = changes(gnss.gnss_health(spark.createDataFrame(rows, EVENT)))
    # The weak sample is evidence until the one at 9 s; ten clean seconds later the next event is at 20 s.
    assert [(t, s) for _, t, s, _, _ in got] == [(0, "normal"), (5_000_000, "interference"), (20_000_000, "normal"), (29_000_001, "outage")]
    assert got[-1][1] == 23_000_000 + 6_000_001


def test_empty_null_and_repeated_events(spark):
    frame = spark.createDataFrame([(None, 1, "fix", None, 5.0, *[None] * 9), (None, 1, "fix", None, 5.0, *[None] * 9), (1, None, "fix", None, 5.0, *[None] * 9), (1, 5, None, None, 5.0, *[None] * 9), (2, 5, "sample", *[None] * 11)], EVENT)
    assert changes(gnss.gnss_health(frame.where("drive_id = 2"))) == [(2, 5, "waiting", None, ("no_fix_yet",))]
    assert [(r.t_us, r.state) for r in gnss.gnss_health(frame.where("drive_id IS NULL")).orderBy("t_us").collect()] == [(1, "normal"), (6_000_002, "outage")]
    assert gnss.gnss_health(frame.where("false")).count() == 0 == gnss.gnss_gates(queries_gnss._fixes(spark, SF).where("false")).count()


def test_receiver_columns(spark):
    one = "named_struct('constellation', 'gps', 'cn0', 30.0D, 'used', true, 'elevation', 10.0D)"
    two = "named_struct('constellation', 'galileo', 'cn0', 20.0D, 'used', false, 'elevation', 40.0D)"
    rows = spark.sql(f"SELECT array({one}, {two}) AS satellites UNION ALL SELECT filter(array({one}), x -> false)").select(*gnss.receiver_columns()).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(2, 1, 25.0, 10.0, 2, 0.5), (0, 0, None, None, 0, None)], key=str)


def test_gates_in_pieces(spark):
    fixes = queries_gnss._fixes(spark, SF)
    key = lambda df: sorted(map(str, df.select("fix_id", "reason", "score", "integrity", "sigma_m").collect()))
    whole = key(gnss.gnss_gates(fixes))
    assert whole == key(gnss.gnss_gates(fixes, piece=3)) and len(whole) == fixes.count()


def run(spark, tmp_path, name, rows_of, kernel, batches):
    """Streams each batch as a file of its own, with the query stopped and started again between them."""
    source, out = tmp_path / f"{name}-in", str(tmp_path / f"{name}-out")
    source.mkdir()
    for i, batch in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in batch))
        stream = kernel(spark.readStream.schema(rows_of).json(str(source)))
        write_and_publish(stream, out, str(tmp_path / f"{name}-cp"), once=True).awaitTermination(60)
    return spark.read.parquet(out)


def test_streams_equal_batches_over_restarts(spark, tmp_path):
    rows = events(3, keys=4, n=60)
    names = [f.name for f in spark.createDataFrame([], EVENT).schema]
    shuffled = sorted(rows, key=lambda r: r[1] + (hash((r[0], r[1])) % 1_900_000))  # at most two seconds out of order
    end = [(k, max(r[1] for r in rows if r[0] == k) + 30_000_000, "sample", *[None] * 11) for k in range(4)]
    parts = [[dict(zip(names, r, strict=True)) for r in part] for part in (shuffled[:90], shuffled[90:91], shuffled[91:200], [*shuffled[200:], *end])]
    got = run(spark, tmp_path, "health", EVENT, ordered.gnss_health_stream, parts)
    last = {k: t for k, t, *_ in end}
    want = [x for x in sorted(replayed(rows + end), key=lambda x: x[:2]) if x[1] <= last[x[0]] - 2_000_000]
    assert changes(got) == want

    late = [{"k": 1, "t": 10, "v": "a"}, {"k": 1, "t": 5_000_000, "v": "b"}, {"k": 1, "t": 4_900_000, "v": "c"}, {"k": 1, "t": 5_000_000, "v": "again"}, {"k": 2, "t": 7, "v": None}]
    more = [{"k": 1, "t": 20, "v": "late"}, {"k": 1, "t": 6_000_000, "v": "d"}, {"k": 1, "t": None, "v": "x"}, {"k": 2, "t": 900_000, "v": "e"}]
    out = run(spark, tmp_path, "order", "k int, t long, v string", lambda s: ordered.release_in_order(s, "k", "t", ["v"], quiet_ms=600_000), [late, more])
    assert sorted((r.k, r.t_us, r.status, r.v) for r in out.collect() if r.v) == [(1, 10, "released", "a"), (1, 20, "late", "late"), (1, 4_900_000, "released", "c"), (1, 5_000_000, "released", "b"), (1, 5_000_000, "repeated", "again")]
    assert [(r.t_us, r.status) for r in out.where("k = 2").collect()] == [(7, "released")]
    batches = out.where("status = 'released' AND k = 1").groupBy("batch_id").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b")).orderBy("batch_id").collect()
    assert all(x.b < y.a for x, y in zip(batches, batches[1:], strict=False))


def test_silent_keys_are_released_by_a_timer(spark, tmp_path):
    import time

    source = tmp_path / "in"
    source.mkdir()
    kernel = lambda s: ordered.release_in_order(s, "k", "t", ["v"], quiet_ms=1)
    for i, part in enumerate(([{"k": 1, "t": 10, "v": "a"}, {"k": 1, "t": 5, "v": "b"}], [{"k": 2, "t": 1, "v": "c"}])):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
        write_and_publish(kernel(spark.readStream.schema("k int, t long, v string").json(str(source))), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(60)
        time.sleep(0.1)
    assert sorted((r.t_us, r.v) for r in spark.read.parquet(str(tmp_path / "out")).where("k = 1").collect()) == [(5, "b"), (10, "a")]


@pytest.mark.parametrize("state", ["normal", "outage"])
def test_settle(state):
    assert gnss.settle(5, state, None) == [state, None]
    assert gnss.settle(10, "normal", ["outage", None]) == ["outage", 10]
    assert gnss.settle(10_000_010, "degraded", ["outage", 10]) == ["degraded", None]
