"""Reference SQL (DuckDB) of the operators that SQL can state; every pair and every window is looked at."""

SPACE = "[\\x20\\x09-\\x0D]+"
WORDS = f"list_filter(string_split_regex({{}}, '{SPACE}'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))
  WHEN len(w) = 1 THEN [w[1]] ELSE [] END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
least_of AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least_of ON id = doc_id"""

REPEATED_WINDOWS = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM w),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM spots),
least_of AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT win.doc_id, unnest(generate_series(i, i + 12)) AS p FROM win JOIN least_of USING (k) WHERE win.doc_id > m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id"""

NEAR_VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
least_of AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN least_of ON id = vec_id LEFT JOIN n ON a = vec_id"""
