"""Reference SQL (DuckDB) of operators whose own modules hold none."""

from __future__ import annotations

from thermograph.llm.embeddings import COSINE
from thermograph.llm.jaccard import SHINGLE, SIMILARITY
from thermograph.llm.substrings import WINDOW

_SPACE = r"[^\x20\x09-\x0D]+"

#: Words are joined by a blank, which none of them holds.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
h AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE m >= {SIMILARITY} * (a.n + b.n - m) - 1e-9),
l AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x),
k AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
SELECT r.doc_id, min(c) AS class_id, coalesce(any_value(n_links), 0) AS n_links, min(c) = r.doc_id AS kept FROM r LEFT JOIN k ON k.doc_id = r.doc_id GROUP BY r.doc_id"""

REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')))) AS h FROM d WHERE len(w) >= {WINDOW}),
m AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT k, i + j AS i FROM (SELECT k, i, unnest(range(0, {WINDOW})) AS j FROM m)),
w AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
t AS (SELECT w.k, CAST(count(*) AS BIGINT) AS n_words, CAST(count(c.i) AS BIGINT) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY w.i) FILTER (c.i IS NULL), '') AS kept FROM w LEFT JOIN c ON c.k = w.k AND c.i = w.i GROUP BY w.k)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (k)"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON r.vec_id = l.x),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT r.vec_id, coalesce(any_value(n_links), 0) AS n_links, min(c) AS component_id, min(c) = r.vec_id AS kept FROM r LEFT JOIN k ON k.vec_id = r.vec_id GROUP BY r.vec_id"""

SQL = {"op1_ngram_jaccard_join": JACCARD, "op7_substring_dedup": REPEATS, "op8_embedding_near_dedup": VECTORS}
