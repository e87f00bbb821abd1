"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def _covered(n: int) -> str:
    """Words that lie in a window of n words found twice or more."""
    return f"""
    SELECT doc_id, sum(CASE WHEN c THEN 1 ELSE 0 END)::BIGINT AS words, sum(CASE WHEN c THEN length(w) ELSE 0 END)::BIGINT AS chars
    FROM (SELECT doc_id, w, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c
          FROM (SELECT doc_id, w, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS r
                FROM (SELECT doc_id, ws[i] AS w, i, CASE WHEN i + {n - 1} <= len(ws) THEN array_to_string(ws[i:i + {n - 1}], ' ') END AS g
                      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t))))
    GROUP BY doc_id"""


OP6 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
c3 AS ({_covered(3)}), c5 AS ({_covered(5)}), c9 AS ({_covered(9)}),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k
      FROM (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t)))
      WHERE regexp_matches(line, '{SPACED}')),
d AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM l WHERE k > 1 GROUP BY doc_id),
b AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0)::BIGINT AS n_repeat_words,
      coalesce(d.chars, 0)::DOUBLE / greatest(length(array_to_string(ws, '')), 1) AS dup_line_share,
      coalesce(c5.chars, 0)::DOUBLE / greatest(length(array_to_string(ws, '')), 1) AS dup_5gram_share,
      coalesce(c9.chars, 0)::DOUBLE / greatest(length(array_to_string(ws, '')), 1) AS dup_9gram_share
      FROM t LEFT JOIN d USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c9 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND dup_line_share <= 0.5 AND dup_5gram_share <= 0.45 AND dup_9gram_share <= 0.4 AS kept,
dup_line_share, dup_5gram_share, dup_9gram_share FROM b
"""

OP4 = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN}') AS ws FROM documents),
m AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PLAIN}') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(ws), 8) AS n, array_to_string(ws[i:i + least(len(ws), 8) - 1], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM m WHERE len(ws) > 0)),
w AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM t, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
h AS (SELECT w.doc_id, p.item_id, w.i, w.n FROM w JOIN p ON w.n = p.n AND w.g = p.g),
x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM t LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * c.k >= 80 * (x.n + y.n - c.k)),
r AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""

OP9 = """
WITH p AS (SELECT conv_id, max(coalesce(turn, -1)) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
u AS (SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, role, text, last FROM conversations JOIN p USING (conv_id) WHERE coalesce(turn, -1) <= last),
q AS (SELECT pair_id, 'chosen' AS part, turn, role, text FROM u
      UNION ALL SELECT pair_id, 'rejected', turn, role, CASE WHEN turn = last AND role = 'assistant' THEN substr(text, 1, length(text) // 2) ELSE text END FROM u),
r AS (SELECT pair_id, part, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) AS copies FROM q GROUP BY ALL),
d AS (SELECT pair_id, turn, list_sort(list(role || chr(1) || text || chr(1) || copies) FILTER (part = 'chosen')) AS c, list_sort(list(role || chr(1) || text || chr(1) || copies) FILTER (part = 'rejected')) AS j FROM r GROUP BY 1, 2),
f AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM j) AS fork FROM d GROUP BY 1),
l AS (SELECT d.pair_id, f.fork, count(*) FILTER (f.fork IS NULL OR d.turn < f.fork) AS prompt_turns FROM d JOIN f USING (pair_id) GROUP BY 1, 2)
SELECT r.pair_id, CASE WHEN fork IS NULL OR turn < fork THEN 'prompt' ELSE part END AS part, turn, role,
'<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered,
CASE WHEN NOT (fork IS NULL OR turn < fork) AND role = 'assistant' THEN 1 ELSE 0 END AS mask, copies, prompt_turns
FROM r JOIN l USING (pair_id) WHERE NOT (fork IS NULL OR turn < fork) OR part = 'chosen'
"""
