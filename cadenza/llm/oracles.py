"""DuckDB SQL for the queries of this folder that SQL can express."""

_SPACE = r"[ \t\n\v\f\r]"

LINES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), pos AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5
), win AS (
  SELECT rid, i, ws[i:i + 4] AS g FROM pos
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), firsts AS (
  SELECT DISTINCT rid, unnest(ls) AS line FROM w
), bare AS (
  SELECT rid, line, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS b FROM firsts
), good AS (
  SELECT rid, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM bare
  WHERE right(b, 1) IN ('.', '!', '?', '…', ':', ';', '"', '''', '”', '’', '»', ')', '。', '！', '？')
    AND len(regexp_extract_all(b, '[#*$%&|<>]')) * 20 <= length(b)
    AND NOT (len(regexp_extract_all(b, '!')) >= 3 AND len(regexp_extract_all(b, '!')) * 20 > length(b))
    AND len(regexp_extract_all(b, '[|»›•]')) < 2
    AND NOT (length(b) <= 24 AND regexp_matches(b, '(?i)^\W*(home|menu|login|log in|sign in|sign up|register|search|contact( us)?|about( us)?|sitemap|next|previous|back|top|more|read more|share|print|help|faq|accueil|connexion|startseite|anmelden|inicio|buscar)\W*$'))
    AND NOT regexp_matches(b, '(?i)(licensed under|all rights reserved|copyright|terms of (use|service)|privacy policy|cookies? policy|uses? cookies|creative commons|general public license|subscribe to our|powered by|tous droits réservés|alle rechte vorbehalten|todos los derechos)')
  GROUP BY rid
), c AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(good.n, 0) AS n_kept_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN good USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND n_kept_words >= 10 AND 100 * n_kept_words >= 50 * n_words AS kept
FROM c
"""


def _share(source: str, parent: str, name: str) -> str:
    """A parent's budget shared among its children by weight, within their caps."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY CASE WHEN w > 0 THEN CAST(cap AS DOUBLE) / w ELSE 'infinity'::DOUBLE END, {name}"
    return f"""
      SELECT *, CASE WHEN filled THEN cap WHEN uw > 0 THEN (rest * w) // uw ELSE 0 END AS budget FROM (
        SELECT *, given - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}) AS rest,
               sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}) AS uw FROM (
          SELECT *, cap * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                    <= (given - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
                    AS filled FROM ({source})))"""


MIXING = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source,
         CASE WHEN regexp_matches(source, '[0-9]$') THEN
           list_extract(['web', 'books', 'forum', 'reference'],
                        least(CAST(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS INTEGER) // 5, 3) + 1)
         ELSE 'other' END AS l0,
         coalesce(lang, '') AS l1, coalesce(source, '') AS l2,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, md5(coalesce(text, '')) AS digest
  FROM documents
), leaf AS (
  SELECT l0, l1, l2, sum(n) AS tokens, 4 * sum(n) AS cap,
         CASE l0 WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END AS w0,
         CASE l1 WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w1, 1 AS w2
  FROM d WHERE n > 0 GROUP BY ALL
), n0 AS (
  SELECT l0, budget FROM ({_share(
    "SELECT l0, sum(cap) AS cap, max(w0) AS w, (SELECT least(sum(tokens) * 3 // 5, sum(cap)) FROM leaf) AS given FROM leaf GROUP BY l0",
    "", "l0")})
), n1 AS (
  SELECT l0, l1, budget FROM ({_share(
    "SELECT l0, l1, sum(cap) AS cap, max(w1) AS w, max(n0.budget) AS given FROM leaf JOIN n0 USING (l0) GROUP BY l0, l1",
    "l0", "l1")})
), n2 AS (
  SELECT l0, l1, l2, budget FROM ({_share(
    "SELECT l0, l1, l2, cap, w2 AS w, n1.budget AS given FROM leaf JOIN n1 USING (l0, l1)", "l0, l1", "l2")})
), plan AS (
  SELECT l0, l1, l2, budget // tokens AS whole, budget % tokens AS rest FROM n2 JOIN leaf USING (l0, l1, l2)
), k AS (
  SELECT d.*, whole, rest, md5(concat_ws(':', '2', whole, coalesce(CAST(doc_id AS VARCHAR), ''), digest)) AS key
  FROM d JOIN plan USING (l0, l1, l2) WHERE n > 0
), p AS (
  SELECT *, rest - coalesce(sum(n) OVER (PARTITION BY l0, l1, l2 ORDER BY key, rid
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k
), out AS (
  SELECT *, unnest(range(0, CAST(whole AS BIGINT))) AS epoch, n AS take FROM k
  UNION ALL BY NAME
  SELECT * EXCLUDE (room), CAST(whole AS BIGINT) AS epoch, least(n, room) AS take FROM p WHERE room > 0
)
SELECT doc_id, l0 AS domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens,
       CAST(take AS BIGINT) AS take_tokens FROM out
"""

NEGATIVES = """
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS MATERIALIZED (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike,
         CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.rid <> r.rid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT arid, anchor_id, vec_id AS positive_id, score,
         row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS pos
  FROM s WHERE alike QUALIFY pos <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.arid, p.pos ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.arid = p.arid AND NOT s.alike
 AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""

ORACLES: dict[str, str] = {
    "op12_negatives": NEGATIVES,
    "op2_mixing": MIXING,
    "op5_lines": LINES,
}
