"""The query of importance resampling and its SQL."""

from __future__ import annotations

from . import common
from .resampling import resample


def op11_resample(spark, sf_dir):
    return resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


#: The same with every n-gram written out and its CRC taken byte by byte.
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::UINTEGER AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c::BIGINT ORDER BY byte) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, row_number() OVER () AS r, 's' AS side, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT NULL, row_number() OVER (), 't', regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS MATERIALIZED (
  SELECT side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram FROM d),
u AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM g)),
h AS MATERIALIZED (
  SELECT gram, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM u, tab),
f AS MATERIALIZED (SELECT side, r, bucket, count(*) AS n FROM g JOIN h USING (gram) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM f GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM c),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1) * (big_s + 10000)) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM c, z),
w AS (SELECT r, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM f JOIN gain USING (bucket) WHERE side = 's' GROUP BY r),
o AS (
  SELECT doc_id, r, coalesce(len(ws), 0) AS n_words, coalesce(w.n, 0) AS n_features,
         coalesce(w.total // w.n - CASE WHEN w.total % w.n < 0 THEN 1 ELSE 0 END, 0) AS weight,
         ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN w USING (r) WHERE side = 's'),
e AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM o),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 25 // 100 AS drawn FROM e WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= drawn THEN rank END AS rank
FROM e LEFT JOIN k USING (r)
"""
