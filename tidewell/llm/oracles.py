"""DuckDB SQL that whole-table queries of this subpackage must equal, by definition rather than by method."""

#: Embeddings linked by cosine, and components by closure.
EMBEDDING_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
     r AS (SELECT vec_id AS i, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.i),
     c AS (SELECT i, min(low) AS low FROM r GROUP BY i),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN c ON c.i = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: Documents linked by four-word shingles, and components by closure.
SHINGLE_LINKS = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
     r AS (SELECT doc_id AS i, doc_id AS low FROM d UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.i),
     c AS (SELECT i, min(low) AS low FROM r GROUP BY i)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, low AS component_id FROM d JOIN c ON c.i = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: Bytes covered by 400-byte strings that start twice or more; text leaves out broken halves of characters.
REPEATED_BYTES = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
     g AS (SELECT doc_id, i, md5(array_slice(t, i, i + 399)) AS h FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 398)) AS i FROM d WHERE octet_length(t) >= 400)),
     m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
     f AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM m),
     a AS (SELECT doc_id, i AS first, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f WHERE p IS NULL OR i - p > 400),
     z AS (SELECT doc_id, i + 399 AS last, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f WHERE q IS NULL OR q - i > 400),
     s AS (SELECT doc_id, list(first ORDER BY k) AS f, list(last ORDER BY k) AS l, sum(last - first + 1) AS removed FROM a JOIN z USING (doc_id, k) GROUP BY doc_id),
     x AS (SELECT d.doc_id, t, coalesce(removed, 0) AS removed, coalesce(len(f), 0) AS spans, list_concat([1], [v + 1 FOR v IN coalesce(l, [])]) AS b, list_concat([v - 1 FOR v IN coalesce(f, [])], [octet_length(t)]) AS e FROM d LEFT JOIN s ON s.doc_id = d.doc_id),
     y AS (SELECT doc_id, any_value(t) AS t, any_value(removed) AS removed, any_value(spans) AS spans, string_agg(CASE WHEN b[k] <= e[k] THEN hex(array_slice(t, b[k], e[k])) ELSE '' END, '' ORDER BY k) AS kept
           FROM (SELECT *, unnest(range(1, len(b) + 1)) AS k FROM x) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256,
       decode(unhex(regexp_replace(kept, '((?:[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9ABCEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[123][89AB].[89AB].[89AB].|F48.[89AB].[89AB].)+)|..', '\1', 'g'))) AS text FROM y
"""
