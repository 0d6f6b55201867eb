"""The query of ranked lexical search and its SQL."""

from __future__ import annotations

from . import common
from .lexical import search


def op12_lexical(spark, sf_dir):
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


#: Every document that shares a term with an item, scored and ranked.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
c AS (SELECT count(*) AS big_n, sum(len(ws))::BIGINT AS big_l FROM d WHERE len(ws) > 0),
t AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
v AS (SELECT DISTINCT item_id, q, unnest(ws) AS term FROM i),
w AS (SELECT item_id, q, term, floor(1000.0::DOUBLE * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM v JOIN f USING (term), c),
s AS (
  SELECT item_id, q, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM w JOIN p USING (term), c GROUP BY item_id, q, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""
