"""SQL of the corpus queries that SQL can express, for DuckDB over the whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS k FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, k, md5(array_to_string(words[k:k + 49], ' ')) AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM windows JOIN firsts USING (s) WHERE low < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

# A node's component is the least node that it reaches.
_NAMES = """
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT a, a FROM edges UNION SELECT b, y FROM reach JOIN edges ON a = x),
named AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x)
"""

NEAR = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS both_ FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 75 * (na + nb - both_)),
{_NAMES}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM sets LEFT JOIN named ON node = doc_id
"""

LATTICE = f"""
WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_NAMES},
degrees AS (SELECT a AS node, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM v LEFT JOIN named ON named.node = vec_id LEFT JOIN degrees ON degrees.node = vec_id
"""

# Bytes are pairs of hexadecimal digits; strings are compared by digest.
SUFFIX = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS k FROM b WHERE len(h) >= 800),
strings AS (SELECT doc_id, k, md5_number(substr(h, 2 * k + 1, 800)) AS s FROM starts),
again AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM strings SEMI JOIN again USING (s)),
runs AS (SELECT doc_id, k, count(*) FILTER (WHERE before IS NULL OR k > before + 400) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM hits),
spans AS (SELECT doc_id, run, min(k) AS low, max(k) + 400 AS high FROM runs GROUP BY ALL),
cut AS (SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS start, high FROM spans),
kept AS (
  SELECT b.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (low - start)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS t, sum(high - low) AS gone, count(*) AS n
  FROM b JOIN cut USING (doc_id) GROUP BY b.doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)
"""
