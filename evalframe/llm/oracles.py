"""SQL for the queries that SQL can express, in DuckDB's dialect."""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
    ELSE list_distinct([ws[i:i + 3] FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
g AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(u, ' ')) AS k FROM (SELECT doc_id, sh, unnest(sh) AS u FROM s)),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s
JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) ON x = doc_id"""

CHAT = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '(\\\\|<s>|</s>|\\[/?(SYS|INST)\\]|\\[OUT\\]|\\[ROLE\\]|\\[TEXT\\]|\\[/ROLE\\])', '\\\\\\1', 'g') AS esc,
    CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

SEARCH = """
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id IS NOT NULL),
terms AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM texts),
tf AS (SELECT kind, id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT id, sum(tf)::BIGINT AS n FROM tf WHERE kind = 0 GROUP BY id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
m AS (SELECT id, 100 - 75 + (75 * n * docs) // words AS m FROM sizes, whole),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole WHERE kind = 0 GROUP BY term, docs),
scores AS (
  SELECT q.id AS item_id, d.id AS doc_id, sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m)))::BIGINT AS score
  FROM tf q JOIN tf d USING (term) JOIN w USING (term) JOIN m ON m.id = d.id
  WHERE q.kind = 1 AND d.kind = 0 GROUP BY q.id, d.id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10"""
