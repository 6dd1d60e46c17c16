"""The same results in plain SQL, for the operators that SQL can express."""

from wardframe.llm import risk_rules, warc

WARC_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY 1
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


def _rules_sql() -> str:
    """The base rule and the certified cutoffs, with the binomial tail summed from logarithms of factorials."""
    share = risk_rules.MAX_LOSS / len(risk_rules.RULES)
    steps = max(len(r.ladder) for r in risk_rules.RULES)
    levels = " UNION ALL ".join(
        f"SELECT doc_id, stratum, base_failed, {i} AS rule, "
        + " + ".join(f"CASE WHEN {r.statistic} > {g} THEN 1 ELSE 0 END" for g in r.ladder) + " AS level FROM s WHERE n_words > 0"
        for i, r in enumerate(risk_rules.RULES)
    )
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '{risk_rules.STRATUM_NONE}') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY 1
), b AS (
  SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id
), s AS (
  SELECT *, n_words < {risk_rules.MIN_WORDS} OR 100 * n_repeat_words > {risk_rules.REPEAT_PERCENT} * n_words AS base_failed FROM b
), lv AS ({levels}),
good AS (
  SELECT lv.* FROM lv JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1) q
    ON lv.doc_id = q.doc_id WHERE NOT base_failed
), lost AS (
  SELECT stratum, rule, step, count(*) AS n, count(*) FILTER (level >= step) AS k
  FROM good, (SELECT unnest(generate_series(1, {steps})) AS step) GROUP BY ALL
), cut AS (
  SELECT stratum, rule, min(step) AS step FROM lost
  WHERE k < n * {share} AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))
    FROM (SELECT unnest(generate_series(0, k)) AS i)
  ) <= {risk_rules.ERROR} / ({len(risk_rules.RULES) * steps} * (SELECT count(DISTINCT stratum) FROM good)) GROUP BY 1, 2
), bad AS (
  SELECT DISTINCT doc_id FROM lv JOIN cut ON lv.stratum = cut.stratum AND lv.rule = cut.rule AND lv.level >= cut.step
)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.doc_id IS NULL AS kept
FROM s LEFT JOIN bad ON s.doc_id = bad.doc_id
"""


RULES_SQL = _rules_sql()
