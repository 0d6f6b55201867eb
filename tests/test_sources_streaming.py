"""Logs, map exports, manifests and streams over small files."""

import hashlib
import json

from drivespark.sources import logs
from drivespark.streaming import telemetry as T


def test_drive_logs(spark, tmp_path):
    good = [{"t": "m", "u": 0, "sid": "s"}, {"t": "i", "u": 1, "a": [0, 0, 9.8], "g": [0, 0, 0]}, {"t": "g", "u": 2, "lat": 1.0, "lon": 2.0, "acc": 3.0}, {"t": "s", "u": 3, "sv": [[1, 2, 30.0, True, None]]}, {"t": "k", "u": 4, "l": "start"}, {"t": "a", "u": 5, "spd": 1.0, "sig": 0.1}]
    bad = [{"t": "i", "u": 6, "a": [0, 0], "g": [0, 0, 0]}, {"t": "q", "u": 7}, {"t": "k", "l": "no clock"}, {"t": "a", "u": 8, "spd": 1.0}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in good + bad) + '\n{"t": "i", "u"')
    records, rejects = logs.read_drive_logs(spark, str(tmp_path))
    assert sorted(r.u for r in records.collect()) == [0, 1, 2, 3, 4, 5]
    assert rejects.count() == 5
    assert records.where("t = 's'").first().satellites.startswith("[[1")


def test_osm_and_manifest(spark, tmp_path):
    (tmp_path / "osm.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "node", "id": 2}, {"type": "way", "id": 3, "nodes": [1, 2], "tags": {"highway": "road"}}]}))
    nodes, ways = logs.read_osm_elements(spark, str(tmp_path / "osm.json"))
    assert [tuple(r) for r in nodes.collect()] == [(1, 1.0, 2.0)] and ways.first().tags == {"highway": "road"}
    data = tmp_path / "data"
    data.mkdir()
    (data / "x.csv").write_bytes(b"abc")
    (data / "y.csv").write_bytes(b"abcd")
    sha = hashlib.sha256(b"abc").hexdigest()
    m = spark.createDataFrame([("x.csv", sha, 3), ("y.csv", sha, 4), ("z.csv", sha, 3)], "path string, sha256 string, size long")
    assert {r.path: r.status for r in logs.verify_manifest(spark, m, str(data)).collect()} == {"x.csv": "ok", "y.csv": "wrong content", "z.csv": "missing"}


def event(session, second, **more):
    return json.dumps({"session_id": session, "timestamp": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "latitude": 1.0, "longitude": 2.0, "speed": 3.0, "heading": 4.0, "confidence": 0.5, "mode": "GNSS_LOCKED"} | more)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join([event("a", s) for s in range(0, 40, 10)] + [event("a", 10), "{broken", event("b", 5, heading=360.0)]))
    (source / "2.json").write_text("\n".join(event("b", s) for s in range(50, 90, 10)))
    parsed = T.parse_telemetry(T.read_telemetry(spark, str(source), maxFilesPerTrigger="1"))
    published = []
    query = T.write_and_publish(T.deduplicated(T.accepted(parsed), delay="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, i: published.append(df.count()))
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 8 == sum(published)
    batch = T.accepted(T.parse_telemetry(spark.read.text(str(source)))).dropDuplicates(["session_id", "timestamp"])
    assert sorted(map(tuple, rows.select("session_id", "timestamp").collect())) == sorted(map(tuple, batch.select("session_id", "timestamp").collect()))
    failed = T.parse_telemetry(spark.read.text(str(source))).where("size(failed) > 0").collect()
    assert sorted(r.failed for r in failed) == [["heading"], ["json"]]
    sessions = T.session_windows(batch, "30 seconds")
    assert sorted((r.session_id, r.records) for r in sessions.collect()) == [("a", 4), ("b", 4)]
    assert T.live_session_metrics(batch, "60 seconds", "60 seconds").agg({"records": "sum"}).first()[0] == 8
