"""The pipeline's stages on clashing columns, nulls and repeats; the whole run against plain Python; SQL of the operators."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from drivespark.llm import catalog, common


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))


def corpus():
    """(rows, labels, benchmark, ids that should go)."""
    rng = random.Random(11)
    prose = lambda n: [word(rng) for _ in range(n)]
    rows = {i: prose(80) for i in range(40)}
    toxic = {i: [*prose(30), "vile", "nasty", "horrid.", *prose(30)] for i in range(40, 60)}
    rows |= toxic
    item, passage = prose(50), prose(45)
    rows[60], rows[61] = [*prose(20), *item, *prose(20)], list(rows[3])
    rows[62] = [*rows[4][:40], "changed", *rows[4][41:]]
    rows[63], rows[64] = [*prose(40), *passage, *prose(10)], [*prose(12), *passage, *prose(33)]
    labels = [(i, 0, int(i in toxic)) for i in range(60)]
    gone = {*toxic, 60, 61, 62}
    return rows, labels, item, passage, gone


def test_run_equals_plain_python(spark, tmp_path):
    rows, labels, item, passage, gone = corpus()
    made = [(i, " ".join(ws), "en", f"s{i % 2}", None, 1.0, "x", {"m": 1}) for i, ws in rows.items()]
    made += [(100, None, None, None, None, 1.0, "x", None), (101, "", None, None, None, 1.0, "x", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, __key string, sentences map<string,int>"
    docs = spark.createDataFrame(made, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, by_stage = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = common.staged(stage(spark, at, str(tmp_path)))
        by_stage[name] = {r.doc_id: r for r in at.collect()}
        if name != "mixing":
            assert at.columns == docs.columns
    kept = set(rows) - gone
    assert set(by_stage["toxicity"]) == set(rows) - set(range(40, 60)) | {100, 101}
    assert set(by_stage["simhash_near_dedup"]) == set(rows) - set(range(40, 63)) | {60, 100}
    assert set(by_stage["decontamination"]) == kept | {100} == set(by_stage["mixing"])
    texts = {i: r.text for i, r in by_stage["substring_dedup"].items()}
    for i in kept:
        want = [w for w in rows[i] if i not in (63, 64) or w not in passage]
        assert texts[i] == " ".join(want) and by_stage["substring_dedup"][i].score == 1.0
    assert texts[100] is None
    sizes = Counter()
    for r in by_stage["mixing"].values():
        sizes[r.source] += r["size"]
        assert r["size"] == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 3 * r["size"]
    assert all(r.source_size == sizes[r.source] for r in by_stage["mixing"].values())


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value if isinstance(value, int | None) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_operators_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, rel = catalog.QUERIES[name](spark, sf), con.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert sorted(rel.columns) == columns and got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
