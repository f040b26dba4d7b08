"""SQL of those queries that SQL can state, for DuckDB, by brute force."""

_ONE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) AS _r FROM chunks{where}) WHERE _r = 1)"

ORACLE: dict[str, str] = {
    "p2_found": f"""WITH v AS (SELECT chunk_id, scope, list_transform(vector::DOUBLE[], lambda x: x / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[]))) AS u
  FROM {_ONE.format(where=" WHERE vector IS NOT NULL")} WHERE list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.scope = b.scope AND a.chunk_id < b.chunk_id WHERE list_dot_product(a.u, b.u) >= 0.9""",
    "p3_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 800",
    "p5_found": r"""WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL),
  t AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM c),
  s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 30)),
  n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE shared / (x.n + y.n - shared) >= 0.7""",
    "p7_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
  e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items),
  dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
  eg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
