"""SQL for the operations that it can express, over the registered tables."""

WORD = r"'[^\x20\x09-\x0D]+'"

OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.c = l.a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept FROM reach r LEFT JOIN counts USING (vec_id) GROUP BY r.vec_id
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
windows AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM d)),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS place FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, source, t, unnest(list_filter(string_split(t, chr(10)), lambda x: len(regexp_extract_all(x, {WORD})) > 0)) AS line FROM d),
normal AS (SELECT *, array_to_string(regexp_extract_all(regexp_replace(lower(line), '[0-9]', '0', 'g'), {WORD}), ' ') AS key, len(regexp_extract_all(line, {WORD})) AS n FROM lines),
hosts AS (SELECT source, greatest(3, 0.02 * count(DISTINCT t)) AS most FROM d GROUP BY source),
above AS (SELECT n.source, key FROM normal n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, key, most HAVING count(DISTINCT t) > most),
lost AS (SELECT doc_id, sum(n) AS n FROM normal x JOIN above a ON x.source IS NOT DISTINCT FROM a.source AND x.key = a.key GROUP BY doc_id),
twice AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(coalesce(twice.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS frequent_words FROM d LEFT JOIN twice USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND frequent_words <= 0.3 * n_words AS kept FROM f
"""

OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest FROM p LEFT JOIN f USING (digest)
"""
