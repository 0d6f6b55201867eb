"""The query of the licence scan and its SQL."""

from __future__ import annotations

from . import common
from .licenses import TEMPLATES, scan_licenses


def op1_licenses(spark, sf_dir):
    return scan_licenses(common.read(spark, sf_dir, "documents"))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
OP1_SQL = rf"""
WITH t0(license, text) AS (VALUES {_VALUES}),
norm AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM t0),
tg AS (SELECT license, len(ws) - 1 AS t_n, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bigram FROM norm),
t AS (SELECT license, t_n, bigram, count(*) AS t_c FROM tg GROUP BY ALL),
d0 AS (SELECT DISTINCT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
d AS (SELECT row_number() OVER () AS k, doc_id, low, list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM d0),
l0 AS (SELECT k, unnest(range(1, len(string_split(low, chr(10))) + 1)) AS line, unnest(string_split(low, chr(10))) AS part FROM d),
l1 AS (SELECT k, line, len(list_filter(regexp_split_to_array(part, '[^a-z0-9]+'), lambda w: w <> '')) AS size FROM l0),
l AS (SELECT k, size - 1 AS own, sum(size) OVER (PARTITION BY k ORDER BY line) - size AS start FROM l1),
g AS (SELECT k, doc_id, len(ws) - 1 AS n, unnest(range(0, len(ws) - 1)) AS pos, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bigram FROM d WHERE len(ws) >= 2),
h AS (SELECT k, n, pos, bigram, license, t_n, t_c FROM g JOIN t USING (bigram)),
few AS (SELECT k, license FROM h GROUP BY k, license, t_n HAVING count(*) >= 0.6 * t_n),
e AS (SELECT h.* FROM h SEMI JOIN few USING (k, license)),
spans AS (
  SELECT DISTINCT k, license, t_n, l.start, l.own FROM (SELECT DISTINCT k, license, t_n FROM e) JOIN l USING (k) WHERE own >= 1
  UNION SELECT k, license, t_n, 0, n FROM e
  UNION SELECT k, license, t_n, least(pos, n - t_n), t_n FROM e WHERE n > t_n),
c AS (
  SELECT s.k, s.license, s.t_n, s.start, s.own, e.bigram, e.t_c, count(*) AS c
  FROM spans s JOIN e ON s.k = e.k AND s.license = e.license AND e.pos >= s.start AND e.pos < s.start + s.own GROUP BY ALL),
r AS (SELECT k, license, start, own, sum(least(c, t_c)) * 2.0::DOUBLE / (own + t_n) AS dice FROM c GROUP BY k, license, t_n, start, own),
b AS (SELECT *, row_number() OVER (PARTITION BY k, license ORDER BY dice DESC, start, own) AS place FROM r WHERE dice >= 0.8)
SELECT doc_id, license, start::INT AS start, (own + 1)::INT AS n_words, dice FROM b JOIN d USING (k) WHERE place = 1
"""
