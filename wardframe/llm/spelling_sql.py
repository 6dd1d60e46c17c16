"""Spelling variants in plain SQL: near words by wildcard patterns and deletions instead of rotations."""

from wardframe.llm import spelling

#: The 256 remainders of the reflected polynomial of crc32, made by eight halvings each.
CRC_TABLE_SQL = """
SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of ``text``; the table ``crc`` must be in scope as ``crc.t``."""
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda k: CAST(('0x' || substr(hex({text}), 2 * k - 1, 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


SPELLING_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
r AS (
  SELECT d, r, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
      unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r
    FROM documents
  ) GROUP BY d, r
),
h AS (SELECT r, c, {crc32_sql("(d || ':' || r)")} AS h FROM r, crc),
w AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {spelling.TYPO} = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, c
    FROM h
  ) WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(c) >= {spelling.MIN_COUNT}
),
holes AS (
  SELECT word, n, left(word, i - 1) || '?' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w)
),
fewer AS (SELECT DISTINCT a.word AS long, w.word AS short, a.n AS long_n, w.n AS short_n FROM holes a JOIN w ON a.less = w.word),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL SELECT long, long_n, short, short_n FROM fewer
  UNION ALL SELECT short, short_n, long, long_n FROM fewer
),
best AS (
  SELECT word, n, n_near, CASE WHEN near_n >= {spelling.FORM_RATIO} * n THEN near END AS form, CASE WHEN near_n >= {spelling.FORM_RATIO} * n THEN near_n END AS form_n
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs) WHERE k = 1
),
chain AS (
  SELECT word, form AS tip, 1 AS step FROM best WHERE form IS NOT NULL
  UNION ALL
  SELECT chain.word, best.form, step + 1 FROM chain JOIN best ON best.word = chain.tip WHERE best.form IS NOT NULL
),
ends AS (SELECT word, arg_max(tip, step) AS root FROM chain GROUP BY word)
SELECT w.word, best.form, coalesce(ends.root, w.word) AS root, w.n, CAST(coalesce(best.n_near, 0) AS BIGINT) AS n_near, best.form_n
FROM w LEFT JOIN best ON best.word = w.word LEFT JOIN ends ON ends.word = w.word
"""
