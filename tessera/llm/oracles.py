"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

_OP8 = r"""
WITH w AS (
  SELECT doc_id, text, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), pos AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM pos) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), g AS (
  SELECT doc_id, source, base_failed, [base_failed, 20 * n_symbols > n_words, 10 * n_dup_lines > n_words, 100 * n_repeat_words > 10 * n_words, word_chars < 3 * n_words OR word_chars > 12 * n_words] AS fails FROM f
), h AS (
  SELECT source, k, count(*) AS n, sum(fails[k]::INT) AS bad FROM g, (SELECT unnest(range(1, 6)) AS k) GROUP BY source, k
), prior AS (
  SELECT k, avg(bad / n) AS mu, var_pop(bad / n) AS v FROM h GROUP BY k
), p AS (
  SELECT k, mu, v, CASE WHEN v <= 1e-12 THEN 1e9 ELSE greatest(mu * (1 - mu) / v - 1, 1.0) END AS s FROM prior
), shrunk AS (
  SELECT source, k, (bad + s * mu) / (n + s) AS rate, mu + 1.2815515655446004 * sqrt(mu * (1 - mu) / (s + 1)) AS high, v > 1e-12 AS varied FROM h JOIN p USING (k)
), verdict AS (
  SELECT source, bool_or(k = 1 AND rate > 0.5) AS rejected, bool_or(varied AND rate > high) AS watched FROM shrunk GROUP BY source
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f.base_failed, watched AS host_watched,
       NOT f.base_failed AND NOT rejected AND NOT (watched AND (20 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR 100 * n_repeat_words > 10 * n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words)) AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""

_OP2 = r"""
WITH RECURSIVE h AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), t AS (
  SELECT sum(n) AS total, sum(pow(n::DOUBLE, 0.7)) AS w FROM h
), r AS (
  SELECT source, t.total::DOUBLE * (pow(n::DOUBLE, 0.7) / t.w) / n AS rate FROM h, t
), d AS (
  SELECT source, greatest(1, ceil(rate / 16.0))::INT AS draws, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM r
), c AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM d
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c WHERE k < 79
), u AS (
  SELECT doc_id, documents.source, j,
         (CAST('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || j::VARCHAR), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT doc_id, documents.source, unnest(range(1, draws + 1)) AS j FROM documents JOIN d ON documents.source IS NOT DISTINCT FROM d.source) AS documents
), times AS (
  SELECT u.doc_id, count(*) AS times FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.c < u.u GROUP BY u.doc_id
)
SELECT documents.*, replica::INT AS replica, md5('shuffle7:' || coalesce(doc_id::VARCHAR, '') || ':' || replica::VARCHAR) AS shuffle_key
FROM documents JOIN (SELECT doc_id, unnest(range(0, times)) AS replica FROM times) USING (doc_id)
"""

_OP6 = r"""
WITH q AS (
  SELECT conv_id, turn, replace(coalesce(role, ''), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text,
         role IS NOT DISTINCT FROM 'assistant' AND turn IS NOT NULL AS said FROM conversations WHERE conv_id IS NOT NULL
), e AS (
  SELECT conv_id, turn AS last_turn, text AS last_text FROM q WHERE said QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1
), u AS (
  SELECT q.conv_id AS pair_id, true AS good, turn, role, text FROM q
  UNION ALL
  SELECT q.conv_id, false, turn, role, text FROM q LEFT JOIN e USING (conv_id) WHERE last_turn IS NULL OR turn IS NULL OR turn < last_turn
  UNION ALL
  SELECT a.conv_id, false, a.last_turn, 'assistant', b.last_text FROM e a JOIN e b ON b.conv_id = xor(a.conv_id, 1)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, good ORDER BY turn NULLS FIRST, role, text) AS k FROM u
), z AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (FROM t WHERE good) c FULL JOIN (FROM t WHERE NOT good) r ON c.pair_id = r.pair_id AND c.k = r.k
), n AS (
  SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k))::INT AS n_prompt FROM z GROUP BY pair_id
), p AS (
  SELECT t.*, n_prompt, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said FROM t JOIN n USING (pair_id)
), s AS (
  SELECT *, (sum(length(said)) OVER (PARTITION BY pair_id, good ORDER BY k))::INT AS stop FROM p WHERE k > n_prompt
), sides AS (
  SELECT pair_id, good, string_agg(said, '' ORDER BY k) AS said,
         string_agg((stop - length(text) - 11)::VARCHAR || '-' || stop::VARCHAR, ',' ORDER BY k) FILTER (role = 'assistant') AS mask
  FROM s GROUP BY pair_id, good
), prompts AS (
  SELECT pair_id, string_agg(said, '' ORDER BY k) AS prompt FROM p WHERE good AND k <= n_prompt GROUP BY pair_id
)
SELECT n.pair_id, n_prompt, coalesce(prompt, '') AS prompt, coalesce(c.said, '') AS chosen, coalesce(r.said, '') AS rejected,
       coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask, coalesce(c.mask, '') <> '' AND coalesce(r.mask, '') <> '' AS usable
FROM n LEFT JOIN prompts USING (pair_id)
LEFT JOIN sides c ON c.pair_id = n.pair_id AND c.good LEFT JOIN sides r ON r.pair_id = n.pair_id AND NOT r.good
"""

ORACLES = {"op2_source_mix": _OP2, "op6_preference_chat": _OP6, "op8_quality_rules": _OP8}
