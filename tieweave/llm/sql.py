"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP10 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), coalesce(text, ''))) AS k
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM by_source),
marked AS (
  SELECT *, 2 * cap * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (
         ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped
  FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(weight * (3 * sum(source_size) OVER () - 2 * sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
    / CAST(2 * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM marked),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(size, floor(target) - start), 0)
          + greatest(least(size, floor(target) - start - source_size), 0) AS BIGINT) AS taken
FROM placed
"""

OP1 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

#: The table of the CRC-32 polynomial, as a list of 256.
CRC_TABLE = """list_transform(range(256), lambda n:
  list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))"""


def crc32(text: str, table: str = "crc_table") -> str:
    """CRC-32 of the UTF-8 of a SQL expression; ``table`` is a list as of ``CRC_TABLE``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    folded = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]))"
    return f"xor(4294967295, {folded})"


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS crc_table),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, {crc32("k")} % 20 AS h FROM keyed, crc),
damaged AS (
  SELECT coalesce('i' || CAST(conv_id AS VARCHAR), 'n') AS conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {BLANKS}) AS kept FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM placed),
judged AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before
  FROM seen),
follows(q, nxt, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts AS (
  SELECT q, q AS q2, 0 AS c, '' AS a, CAST([] AS VARCHAR[]) AS body FROM follows
  UNION ALL SELECT q, nxt, 3, 'I', [name || ':'] FROM follows
  UNION ALL SELECT f.q, g.nxt, 6, 'II', [f.name || ':', g.name || ':'] FROM follows f JOIN follows g ON g.q = f.nxt),
options AS (
  SELECT q, CAST(NULL AS VARCHAR) AS initial, 'D' AS letter, q AS nxt, 4 AS c, CAST(NULL AS VARCHAR) AS name FROM follows
  UNION ALL SELECT q, NULL, 'R', nxt, 3, name FROM follows
  UNION ALL SELECT * FROM (VALUES (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL),
    (3, 'u', 'K', 2, 0, NULL), (2, 'a', 'K', 3, 0, NULL))),
path(conv, i, q, best) AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT), 0, {{'c': CAST(0 AS BIGINT), 'a': '', 'body': CAST([] AS VARCHAR[])}} FROM judged
  UNION ALL
  SELECT p.conv, r.i, o.nxt, min({{'c': CAST(p.best.c + n.c + o.c + CASE WHEN r.fault = 'truncated' AND o.letter <> 'D' THEN 3 ELSE 0 END AS BIGINT),
    'a': p.best.a || n.a || o.letter,
    'body': p.best.body || n.body || CASE WHEN o.letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(o.name, r.role) || ':' || r.text] END}})
  FROM path p JOIN judged r ON r.conv = p.conv AND r.i = p.i + 1
  JOIN inserts n ON n.q = p.q
  JOIN options o ON o.q = n.q2 AND coalesce(o.initial = r.initial, true)
    AND (o.letter = 'D' OR r.fault IS NULL OR r.fault = 'truncated')
  GROUP BY p.conv, r.i, o.nxt),
ended AS (
  SELECT p.conv, min({{'c': CAST(p.best.c + n.c AS BIGINT), 'a': p.best.a || n.a, 'body': p.best.body || n.body}}) AS best
  FROM path p JOIN (SELECT conv, max(i) AS i FROM judged GROUP BY conv) USING (conv, i) JOIN inserts n ON n.q = p.q
  WHERE n.q2 IN (0, 3) GROUP BY p.conv),
counts AS (
  SELECT conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.c, 0) AS cost,
       coalesce(e.best.a, '') AS audit, sha256(coalesce(array_to_string(e.best.body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('i' || CAST(conv_id AS VARCHAR), 'n') AS conv FROM conversations) o
LEFT JOIN counts USING (conv) LEFT JOIN ended e USING (conv)
"""

OP12 = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS crc_table),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
-- Only runs that may stay long enough are hashed.
hashed AS (
  SELECT run, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc WHERE length(run) >= 7),
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
-- One edit: equal with one place left out of both, or of the longer one.
cuts AS (
  SELECT word, n, p, left(word, CAST(p AS INT)) || chr(1) || substr(word, CAST(p AS INT) + 2) AS masked,
         left(word, CAST(p AS INT)) || substr(word, CAST(p AS INT) + 2) AS shorter
  FROM words, unnest(range(length(word))) AS t(p)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.shorter = b.word),
best AS (
  SELECT word, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS best FROM near GROUP BY word),
formed AS (
  SELECT word, CASE WHEN -best.less >= 10 * n THEN best.other END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain(word, root, form) AS (
  SELECT word, word, form FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""

OP13 = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
sets AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM cut),
sized AS (SELECT doc_id, r, CAST(len(s) AS BIGINT) AS n_shingles, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM sets),
-- Equal sets are one node.
nodes AS (SELECT k, min(r) AS node, any_value(n_shingles) AS n, any_value(s) AS s FROM sized WHERE n_shingles > 0 GROUP BY k),
one AS (SELECT node, n, unnest(s) AS shingle FROM nodes),
common AS (
  SELECT a.node AS x, b.node AS y, count(*) AS c, any_value(a.n) AS xn, any_value(b.n) AS yn
  FROM one a JOIN one b ON a.shingle = b.shingle AND a.node < b.node GROUP BY a.node, b.node),
links AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (xn + yn - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT node, node FROM nodes),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
members AS (
  SELECT s.doc_id, s.r, s.n_shingles, n.node FROM sized s LEFT JOIN nodes n ON n.k = s.k AND s.n_shingles > 0),
roots AS (SELECT x AS node, min(m.doc_id) AS component_id FROM reach JOIN members m ON m.node = reach.y GROUP BY x)
SELECT m.doc_id, m.n_shingles, CASE WHEN m.node IS NULL THEN m.doc_id ELSE t.component_id END AS component_id,
       m.doc_id IS NOT DISTINCT FROM CASE WHEN m.node IS NULL THEN m.doc_id ELSE t.component_id END AS kept
FROM members m LEFT JOIN roots t USING (node)
"""

ORACLE = {
    "op1_exact_top_k": OP1,
    "op10_curriculum_mix": OP10,
    "op11_conversation_repair": OP11,
    "op12_spelling_variants": OP12,
    "op13_minhash_near_dedup": OP13,
}
