"""DuckDB SQL of the queries that SQL can express."""

#: Integer inner products by position; components that a vector lacks count as zero.
OP2 = """
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
      FROM i q JOIN i c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Links by cosine, components by reachability.
OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

#: Scores by terms; div is the integer division of non-negative numbers.
OP12 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
u AS (SELECT row, doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY row) AS n FROM t GROUP BY row, doc_id, term),
c AS (SELECT count(DISTINCT row) AS docs, CAST(sum(tf) AS BIGINT) AS terms FROM u),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM u, c GROUP BY term, docs),
i AS (SELECT k, item_id, term, count(*) AS often FROM (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY k, item_id, term),
s AS (SELECT k, item_id, row, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * CAST(n AS BIGINT) * docs) // terms)))) AS BIGINT) AS score
      FROM i JOIN u USING (term) JOIN f USING (term), c GROUP BY k, item_id, row, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op2_topk": OP2, "op7_vector_dedup": OP7, "op12_lexical": OP12}
