"""The query of the mixing operator and its SQL."""

from __future__ import annotations

from . import common
from .mixing import mix_sources


def op4_mix(spark, sf_dir):
    return mix_sources(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by sorting each source's hashes.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 9) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3.0::DOUBLE AS cap FROM s),
o AS (
  SELECT *, row_number() OVER q AS pos, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total
  FROM w WINDOW q AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT min_by((total - before) / rest, pos) AS level FROM o WHERE (total - before) / rest * w <= cap),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM o CROSS JOIN f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
b AS (
  SELECT c.source, min(c.h) AS h, min_by(p.target - p.whole * p.source_size - (c.upto - c.words), c.h) * 2 > min_by(c.words, c.h) AS half
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
  WHERE c.upto > p.target - p.whole * p.source_size GROUP BY c.source)
SELECT d.doc_id, d.size::BIGINT AS size, p.source_size, p.target,
       (d.size * (p.whole + CASE WHEN d.h < b.h OR (b.half AND d.h = b.h) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
