"""Conversation repair in plain SQL: one automaton state after another, row by row, with the texts carried along."""

from wardframe.llm.spelling_sql import CRC_TABLE_SQL, crc32_sql

_ENDS_IN = r"[\x20\x09-\x0D]"

DIALOGUE_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) twice(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    left(role, 1) AS x, regexp_replace(text, '{_ENDS_IN}+$', '') AS trimmed
  FROM numbered
),
faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
moves(p, x, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
names(x, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
-- Insertions: up to three in a row lead from any state to any state they can reach at least cost.
ins AS (
  SELECT p AS p0, p AS q, 0 AS cost, '' AS audit, [] :: VARCHAR[] AS lines, 0 AS k FROM (SELECT DISTINCT p FROM moves)
  UNION ALL
  SELECT p0, m.q, cost + 5, audit || 'I', list_append(lines, name || ':'), k + 1
  FROM ins JOIN moves m ON m.p = ins.q JOIN names USING (x) WHERE k < 3
),
more AS (SELECT p0 AS p, q, arg_min(ins, {{c: cost, a: audit}}) AS e FROM ins GROUP BY p0, q),
edit AS (
  SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cost, 'K' AS audit, [role || ':' || text] AS lines
  FROM faulty JOIN moves USING (x) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', [name || ':' || text]
  FROM faulty, moves JOIN names USING (x) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, p, p, 2, 'D', [] FROM faulty, (SELECT DISTINCT p FROM moves)
),
walk AS (
  SELECT conv_id, n, 0 :: BIGINT AS i, more.q, e.cost AS cost, e.audit AS audit, e.lines AS lines
  FROM counted, more WHERE more.p = 0
  UNION ALL
  SELECT conv_id, n, i, q, (best.s).cost, (best.s).audit, best.lines FROM (
    SELECT w.conv_id, w.n, w.i + 1 AS i, m.q,
      min({{cost: w.cost + d.cost + m.e.cost, audit: w.audit || d.audit || m.e.audit}}) AS s,
      arg_min(w.lines || d.lines || m.e.lines, {{cost: w.cost + d.cost + m.e.cost, audit: w.audit || d.audit || m.e.audit}}) AS lines
    FROM walk w JOIN edit d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i + 1 AND d.p = w.q JOIN more m ON m.p = d.q
    GROUP BY w.conv_id, w.n, w.i, m.q
  ) best
),
ends AS (
  SELECT conv_id, min({{cost: cost, audit: audit}}) AS s, arg_min(lines, {{cost: cost, audit: audit}}) AS lines
  FROM walk WHERE i = n AND q IN (0, 3) GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s.cost, 0) AS BIGINT) AS cost, coalesce(s.audit, '') AS audit,
  sha256(coalesce(array_to_string(ends.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""
