"""Nearest segments of many points at few places, two of them at one distance, against the SQL."""

import duckdb
import pytest

from drivespark.jobs import queries_relations as R


@pytest.mark.parametrize(("query", "sql"), [(R.nearby, R.NEARBY), (R.nearest, R.NEAREST)])
def test_segments_at_one_distance_rank_as_in_the_sql(spark, tmp_path, query, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT * FROM (VALUES (326::BIGINT, 7), (7699, 25), (10123, 29), (19920, 21)) v(p_partkey, p_size)")
    con.execute("""CREATE TABLE events AS SELECT 35 + i * 100 AS event_id, TIMESTAMP '2024-01-01' AS ts, i AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{"k": 23}' AS props FROM range(200) g(i)""")
    for t in ("part", "events"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    d = query(spark, str(tmp_path))
    names = [x[0] for x in con.execute(f"DESCRIBE {sql}").fetchall()]
    want = con.execute(sql).fetchall()
    assert len(want) >= 600
    assert sorted(tuple(r) for r in d.select(*names).collect()) == sorted(want)
