"""SQL of queries whose rows SQL can express, for DuckDB on the small tables."""

from __future__ import annotations

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARTS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x20\x09-\x0D]+"


def _split(pattern: str) -> str:
    return f"coalesce(regexp_extract_all({_ASCII_LOWER.format('text')}, '{pattern}'), [])"


OP1_SQL = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_split(_PARTS)} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(p) AS n, array_to_string(p, ' ') AS k
        FROM (SELECT item, unnest(CASE WHEN len(w) <= 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_split(_PARTS)} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
ahead AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS p FROM dw),
hit AS (SELECT DISTINCT x.r, x.i, win.n, win.item
        FROM (SELECT r, i, n, array_to_string(p[1:n], ' ') AS k FROM ahead JOIN (SELECT DISTINCT n FROM win) ON len(p) >= n) x JOIN win ON win.k = x.k AND win.n = x.n),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN found USING (r) LEFT JOIN covered USING (r)
"""

OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_split(_WORDS)} AS w FROM documents),
dw AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(p, ' ') AS k
      FROM (SELECT doc_id, size, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS p FROM dw)
      WHERE len(p) = 4 OR (size < 4 AND i = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
