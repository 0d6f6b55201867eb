"""Queries of the two exact deduplications (tested against brute force; op8 also has SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common
from .substrings import cut_repeated_words
from .suffixes import cut_repeated_bytes


def op5_suffixes(spark, sf_dir):
    d = cut_repeated_bytes(common.read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_substrings(spark, sf_dir):
    d = cut_repeated_words(common.read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as joined strings; a word goes if any of the 35 windows that may cover it repeats.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS s, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS h FROM d WHERE len(ws) >= 35),
h AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM w SEMI JOIN h USING (h)),
x AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT coalesce(list_contains(gone, i), false)), lambda i: ws[i]), ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""
