"""SQL for DuckDB that states the results of operators on the given tables by plain definition."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUFFIX_DEDUP = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, substr(x, 2 * i - 1, 2) AS b, CASE WHEN i <= n - 49 THEN substr(x, 2 * i - 1, 100) END AS s
      FROM (SELECT doc_id, x, length(x) // 2 AS n, unnest(range(1, length(x) // 2 + 1)) AS i FROM h)),
m AS (SELECT s, min(doc_id) AS d FROM p WHERE s IS NOT NULL GROUP BY s),
late AS (SELECT p.doc_id, p.i, p.b, coalesce(m.d < p.doc_id, false) AS late FROM p LEFT JOIN m ON m.s = p.s),
cov AS (SELECT *, max(CASE WHEN late THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM late),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM cov),
agg AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM edge GROUP BY doc_id)
SELECT h.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN agg USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i <= len(ws) - 34 THEN array_to_string(ws[i:i + 34], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
m AS (SELECT s, count(*) AS c FROM p WHERE s IS NOT NULL GROUP BY s),
rep AS (SELECT p.doc_id, p.i, p.word, coalesce(m.c > 1, false) AS rep FROM p LEFT JOIN m ON m.s = p.s),
cov AS (SELECT *, max(CASE WHEN rep THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM rep),
agg AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM cov GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN agg USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n n1 ON n1.doc_id = x JOIN n n2 ON n2.doc_id = y WHERE 100 * c >= 85 * (n1.n + n2.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node),
least_root AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.root AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least_root l ON l.node = d.doc_id
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
ok AS (SELECT * FROM u WHERE n > 0 AND isfinite(n)),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
c AS (SELECT x, count(*) AS n_links FROM p GROUP BY x),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.node),
least_root AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT vec_id, coalesce(n_links, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings LEFT JOIN c ON c.x = vec_id JOIN least_root ON node = vec_id
"""
