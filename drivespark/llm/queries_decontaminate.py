"""The query of benchmark decontamination and its SQL."""

from __future__ import annotations

from . import common
from .decontaminate import find_contamination


def op6_decontaminate(spark, sf_dir):
    return find_contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


#: The windows of every document that start at a shared shingle, all compared with their items.
OP6_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
dk AS (SELECT row_number() OVER () AS r, doc_id, ws, len(ws) AS n FROM d WHERE len(ws) > 0),
i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
ik AS (SELECT item_id, ws, len(ws) AS n_words FROM i WHERE len(ws) > 0),
s AS (
  SELECT r, doc_id, n, unnest(range(0, greatest(n - 4, 1))) AS pos, unnest(list_transform(range(1, greatest(n - 4, 1) + 1), lambda k: array_to_string(ws[k:k + 4], ' '))) AS g FROM dk),
t AS (
  SELECT item_id, n_words, unnest(list_transform(range(1, greatest(n_words - 4, 1) + 1), lambda k: array_to_string(ws[k:k + 4], ' '))) AS g FROM ik),
tc AS (SELECT item_id, n_words, g, count(*) AS c FROM t GROUP BY ALL),
v AS (SELECT DISTINCT g, n_words FROM t),
w AS (SELECT DISTINCT r, doc_id, least(pos, n - n_words) AS start, n_words FROM s JOIN v USING (g) WHERE n >= n_words),
o AS (
  SELECT w.r, w.doc_id, w.start, w.n_words, s.g, count(*) AS own FROM w JOIN s ON s.r = w.r AND s.pos >= w.start AND s.pos < w.start + greatest(w.n_words - 4, 1) GROUP BY ALL),
p AS (
  SELECT o.r, o.doc_id, o.start, o.n_words, tc.item_id, sum(least(own, c))::DOUBLE AS l FROM o JOIN tc ON o.g = tc.g AND o.n_words = tc.n_words GROUP BY ALL),
q AS (SELECT *, l / (2 * greatest(n_words - 4, 1) - l) AS similarity FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, start) AS k FROM q WHERE similarity >= 0.8)
SELECT doc_id, item_id, start::INT AS start, n_words::INT AS n_words, similarity FROM b WHERE k = 1
"""
