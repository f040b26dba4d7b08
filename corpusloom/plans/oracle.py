"""SQL of the registered queries for DuckDB, written from the rules, not from the plans."""

from corpusloom.config import Settings
from corpusloom.operators.embedding import HashingProvider

QUERY_TEXT = "where the merged window is rebuilt after a restart"
TOKEN = "[A-Za-zА-Яа-я0-9_./:-]+"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_BLANK = "[^" + BLANK[1:]

_FIRST = "(SELECT arg_min(embedding, vec_id) FROM embeddings)"
_COSINE = "list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])))"
_E = f"""e AS (SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS chunk_type, CASE WHEN label % 2 = 0 THEN 'code' ELSE 'docs' END AS scope, {_COSINE} AS s
  FROM embeddings, (SELECT {_FIRST} AS q))"""


def _shortlist(n: int) -> str:
    return f"WITH {_E}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY s DESC, chunk_id) AS r FROM e) WHERE r <= {n})"


_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_key, chunk_id ORDER BY indexed_at DESC) AS _r FROM chunks) WHERE _r = 1)"
_CURRENT = "files AS (SELECT repo_key, replace(relative_path, chr(92), '/') AS relative_path, max(mtime_ns) AS mtime_ns FROM source_files GROUP BY ALL)"
_INDEXED = "indexed AS (SELECT repo_key, relative_path, coalesce(min(source_mtime) FILTER (scope = 'code'), min(source_mtime)) AS source_mtime FROM latest GROUP BY ALL)"
_TOUCHED = """touched AS (SELECT coalesce(i.repo_key, f.repo_key) AS repo_key, coalesce(i.relative_path, f.relative_path) AS relative_path,
    CASE WHEN i.repo_key IS NULL THEN 'new' WHEN f.repo_key IS NULL THEN 'deleted' WHEN abs(i.source_mtime - f.mtime_ns / 1e9) > 1e-6 THEN 'changed' END AS op
  FROM indexed i FULL JOIN files f ON i.repo_key = f.repo_key AND i.relative_path = f.relative_path)"""


def _bm25(source: str, group: str = "1") -> str:
    """CTEs ending in `lex(g, id, raw, score)`; `source` gives (g, id, text)."""
    return f"""src AS ({source}),
  words AS (SELECT lower(w) AS term, count(*) AS times FROM (SELECT unnest(regexp_extract_all('{QUERY_TEXT}', '{TOKEN}')) AS w) GROUP BY 1),
  bag AS (SELECT g, id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS t FROM src),
  size AS (SELECT g, count(*) AS n, avg(len(t)) AS avgdl FROM bag GROUP BY 1),
  post AS (SELECT g, id, dl, term, count(*) AS tf FROM (SELECT g, id, len(t) AS dl, lower(unnest(t)) AS term FROM bag) GROUP BY ALL),
  voc AS (SELECT g, term, count(*) AS df FROM post GROUP BY ALL),
  raw AS (SELECT g, term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM voc JOIN size USING (g)),
  idf AS (SELECT g, term, CASE WHEN r >= 0 THEN r ELSE 0.25 * avg(r) OVER (PARTITION BY g) END AS idf FROM raw),
  hit AS (SELECT g, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM post JOIN words USING (term) JOIN idf USING (g, term) JOIN size USING (g) GROUP BY ALL),
  scored AS (SELECT b.g, b.id, coalesce(s, 0) AS raw FROM bag b LEFT JOIN hit h ON b.g = h.g AND b.id = h.id),
  lex AS (SELECT g, id, raw, CASE WHEN max(raw) OVER (PARTITION BY g) > 0 THEN raw / max(raw) OVER (PARTITION BY g) ELSE 0 END AS score FROM scored)"""


_PAIR = "SELECT CASE WHEN label % 2 = 0 THEN 'code' ELSE 'docs' END AS g, doc_id AS id, text FROM documents JOIN embeddings ON doc_id = vec_id"


def _hybrid(shortlist: int, kept: int) -> str:
    return f"""WITH {_bm25(_PAIR)}, {_E.replace("FROM embeddings,", "FROM embeddings JOIN documents ON doc_id = vec_id,")},
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY s DESC, chunk_id) AS r FROM e) WHERE r <= {shortlist}),
  dense AS (SELECT chunk_id, s FROM l ORDER BY s DESC, chunk_id LIMIT {kept})
SELECT coalesce(chunk_id, id) AS chunk_id, round(coalesce(s, 0), 6) AS dense_score, round(coalesce(lex.score, 0), 6) AS lexical_score,
  round(0.7 * coalesce(s, 0) + 0.3 * coalesce(lex.score, 0), 6) AS score
FROM dense FULL JOIN lex ON chunk_id = id"""

_NEAR = """u AS (SELECT repo_key || '/' || chunk_id AS chunk_id, scope, repo_key || '/' || replace(relative_path, chr(92), '/') AS relative_path, domain_tags, vector::DOUBLE[] AS embedding FROM latest WHERE vector IS NOT NULL),
  o AS (SELECT chunk_id AS own, scope AS own_scope, embedding AS q FROM u ORDER BY chunk_id LIMIT 1),
  near AS (SELECT u.*, own, own_scope, """ + _COSINE + """ AS s FROM u, o)"""

# The query's own vector by the local provider, as a literal.
_TOOL_VECTOR = "[" + ", ".join(map(repr, HashingProvider(Settings()).embed_query(QUERY_TEXT))) + "]"
_TOOL = f"""t AS (SELECT repo_key || '/' || chunk_id AS chunk_id, scope, repo_key || '/' || replace(relative_path, chr(92), '/') AS relative_path, chunk_type, domain_tags, text, vector::DOUBLE[] AS embedding FROM latest),
  ranked AS (SELECT * EXCLUDE (embedding, q, text), {_COSINE} AS s FROM t, (SELECT {_TOOL_VECTOR}::DOUBLE[] AS q) WHERE embedding IS NOT NULL),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY s DESC, chunk_id) AS r FROM ranked)"""
_TYPES, _TAGS = "chunk_type IN ('python_function', 'generic_window')", "list_has_any(domain_tags, ['docs', 'observability'])"


def _tool_dense(keep: str) -> str:
    return f"""WITH {_LATEST}, {_TOOL} WHERE r <= 120)
SELECT chunk_id, scope, relative_path, round(s, 6) AS score, round(s, 6) AS dense_score, NULL::DOUBLE AS lexical_score FROM l WHERE {keep} ORDER BY s DESC, chunk_id LIMIT 20"""


def _tool_hybrid(keep: str) -> str:
    return f"""WITH {_LATEST}, {_TOOL} WHERE r <= 600), dense AS (SELECT chunk_id, s FROM l WHERE {keep} ORDER BY s DESC, chunk_id LIMIT 100),
  {_bm25(f"SELECT scope AS g, chunk_id AS id, text FROM t WHERE {keep}")},
  f AS (SELECT coalesce(chunk_id, id) AS chunk_id, coalesce(s, 0) AS dense_score, coalesce(lex.score, 0) AS lexical_score, 0.7 * coalesce(s, 0) + 0.3 * coalesce(lex.score, 0) AS score FROM dense FULL JOIN lex ON chunk_id = id)
SELECT chunk_id, scope, relative_path, round(score, 6) AS score, round(dense_score, 6) AS dense_score, round(lexical_score, 6) AS lexical_score FROM f JOIN t USING (chunk_id) ORDER BY f.score DESC, chunk_id LIMIT 20"""


ORACLE: dict[str, str] = {
    "tool_semantic_search": _tool_dense("true"),
    "tool_semantic_search_code": _tool_dense(f"scope = 'code' AND {_TYPES}"),
    "tool_semantic_search_docs": _tool_dense(f"scope = 'docs' AND {_TAGS}"),
    "tool_hybrid_search": _tool_hybrid("true"),
    "tool_hybrid_search_code": _tool_hybrid(f"scope = 'code' AND {_TYPES}"),
    "tool_hybrid_search_docs": _tool_hybrid(f"scope = 'docs' AND {_TAGS}"),
    "tool_read_chunk": f"""WITH {_LATEST} SELECT repo_key || '/' || chunk_id AS chunk_id, scope, repo_key || '/' || replace(relative_path, chr(92), '/') AS relative_path, language, chunk_type, md5(text) AS text_md5,
  start_line, end_line, symbol_path, heading_path, array_to_string(domain_tags, ',') AS domain_tags FROM latest WHERE vector IS NOT NULL ORDER BY 1 LIMIT 1""",
    "dense_topk": f"WITH {_E} SELECT chunk_id, round(s, 6) AS dense_score FROM e ORDER BY s DESC, chunk_id LIMIT 10",
    "dense_topk_filtered": _shortlist(60) + " SELECT chunk_id, scope, chunk_type, round(s, 6) AS dense_score FROM l WHERE chunk_type IN ('1', '3', '4') ORDER BY s DESC, chunk_id LIMIT 10",
    "dense_topk_prefiltered": f"WITH {_E} SELECT chunk_id, scope, chunk_type, round(s, 6) AS dense_score FROM e WHERE chunk_type IN ('1', '3', '4') ORDER BY s DESC, chunk_id LIMIT 10",
    "dense_topk_by_scope": _shortlist(150) + " SELECT chunk_id, scope, round(s, 6) AS dense_score FROM l ORDER BY s DESC, chunk_id LIMIT 25",
    "batch_knn": """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)
SELECT query_id, id, round(s, 6) AS score, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rank
  FROM u a, u b WHERE a.vec_id % 50 = 0) WHERE rank <= 10""",
    "find_similar": """WITH own AS (SELECT vec_id AS i, embedding AS q, label % 2 AS p FROM embeddings ORDER BY vec_id DESC LIMIT 1)
SELECT vec_id AS chunk_id, CASE WHEN p = 0 THEN 'code' ELSE 'docs' END AS scope, round(s, 6) AS dense_score FROM (
  SELECT vec_id, i, p, """ + _COSINE + """ AS s FROM embeddings, own WHERE label % 2 = p ORDER BY s DESC, vec_id LIMIT 11) WHERE vec_id <> i ORDER BY s DESC, vec_id LIMIT 10""",
    "embed_mean": """SELECT a.vec_id, CAST(64 AS INT) AS dimension, round(list_sum(m), 6) AS total, round(sqrt(list_dot_product(m, m)), 6) AS norm FROM (
  SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] + x[2]) / 2) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""",
    "tokenize_stats": f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, coalesce(list_min(t), '') AS least_token FROM (
  SELECT doc_id, list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: lower(x)) AS t FROM documents)""",
    "bm25_scores": f"WITH {_bm25('SELECT 1 AS g, doc_id AS id, text FROM documents')} SELECT id AS chunk_id, round(raw, 6) AS lexical_raw, round(score, 6) AS lexical_score FROM lex",
    "bm25_filtered": "WITH " + _bm25("SELECT 1 AS g, doc_id AS id, text FROM documents WHERE lang = 'en'") + " SELECT id AS chunk_id, round(raw, 6) AS lexical_raw, round(score, 6) AS lexical_score FROM lex",
    "bm25_by_scope": f"WITH {_LATEST}, " + _bm25("SELECT scope AS g, repo_key || '/' || chunk_id AS id, text FROM latest") + " SELECT g AS scope, id AS chunk_id, round(raw, 6) AS lexical_raw, round(score, 6) AS lexical_score FROM lex",
    "postings_by_scope": f"""WITH {_LATEST} SELECT scope, term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM (
  SELECT scope, chunk_id, lower(unnest(regexp_extract_all(text, '{TOKEN}'))) AS term FROM latest) GROUP BY ALL""",
    "hybrid_topk": f"SELECT * FROM ({_hybrid(300, 50)}) ORDER BY score DESC, chunk_id LIMIT 10",
    "hybrid_fuse": _hybrid(300, 50),
    "snippets": f"""SELECT doc_id, CASE WHEN length(f) <= 280 THEN f ELSE regexp_replace(substring(f, 1, 277), '{BLANK}+$', '') || '...' END AS snippet FROM (
  SELECT doc_id, regexp_replace(regexp_replace(text, '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS f FROM documents)""",
    "path_features": r"""WITH p AS (SELECT DISTINCT repo_key, replace(relative_path, chr(92), '/') AS relative_path FROM source_files),
  s AS (SELECT *, lower(regexp_extract(relative_path, '[^/]+(\.[^./]+)$', 1)) AS suffix, regexp_extract(relative_path, '[^/]*$') AS name FROM p)
SELECT repo_key, relative_path,
  CASE WHEN relative_path LIKE 'docs/%' OR relative_path LIKE 'agent_context/%' OR suffix IN ('.md', '.txt', '.rst') THEN 'docs' ELSE 'code' END AS scope,
  coalesce(nullif(concat_ws(',',
    CASE WHEN contains(relative_path, 'telegram-bot') OR contains(relative_path, 'telegram_bot') THEN 'telegram_bot' END,
    CASE WHEN contains(relative_path, 'flow-01') OR contains(relative_path, '/user') OR contains(relative_path, 'user-api') THEN 'flow01' END,
    CASE WHEN contains(relative_path, 'maintenance') OR contains(relative_path, 'flow-02') THEN 'maintenance' END,
    CASE WHEN contains(relative_path, 'observability') THEN 'observability' END,
    CASE WHEN starts_with(relative_path, 'docs/') THEN 'docs' END,
    CASE WHEN starts_with(relative_path, 'agent_context/') THEN 'agent_context' END,
    CASE WHEN starts_with(relative_path, 'tools/testing/load/reports/') THEN 'load_reports' END), ''), 'general') AS domain_tags,
  CASE suffix WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.yml' THEN 'yaml' WHEN '.yaml' THEN 'yaml' WHEN '.json' THEN 'json'
    WHEN '.toml' THEN 'toml' WHEN '.sh' THEN 'bash' WHEN '.ps1' THEN 'powershell' WHEN '.sql' THEN 'sql' ELSE 'text' END AS language,
  suffix IN ('.py', '.md', '.txt', '.rst', '.yml', '.yaml', '.json', '.toml', '.ini', '.cfg', '.sh', '.ps1', '.sql') OR name IN ('AGENTS.md', 'CLAUDE.md', 'README', 'README.md', 'Dockerfile') AS is_text,
  regexp_matches(relative_path, '^(apps|services|libs|docs|deploy|scripts|tools|agent_context)/|^(AGENTS|CLAUDE|STRUCTURE)\.md$')
    AND NOT regexp_matches(relative_path, '^(\.git|\.venv|venv|node_modules|artifacts|tmp|temp)/|/__pycache__/|/[^/]*\.(png|jpg|jpeg|gif|webp|ico|svg|zip|gz|tar|7z|pdf|db|sqlite|pem|key|crt|pfx|kdbx)$|/\.env')
    AND NOT regexp_matches(relative_path, '^/|^[A-Za-z]:|(^|/)\.\.(/|$)') AS is_indexed
FROM s""",
    "chunk_identity": f"""WITH {_LATEST}, u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM latest WHERE NOT ends_with(chunk_type, '_part'))
SELECT repo_key, chunk_id, content_hash, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || lower(printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS storage_uuid FROM u""",
    "prompts": "SELECT name, 'query: ' || query AS query_prompt, 'passage: ' || query AS document_prompt FROM search_queries",
    "payload_bytes": f"""WITH {_LATEST} SELECT repo_key, scope, sum(strlen(text) + strlen(relative_path) + strlen(language) + strlen(chunk_type) + strlen(array_to_string(domain_tags, '')) + 16 * 64 + 2048)::BIGINT AS bytes, count(*) AS n
FROM latest GROUP BY ALL""",
    "collection_names": """SELECT repo_key, scope, 'corpusloom_' || s(repo_key) || '_' || s(profile_name) || '_' || s(embedding_model) || '_' || scope || '_v' || index_schema_version AS name
FROM repositories, (SELECT unnest(['code', 'docs']) AS scope)""",
    "chunk_current_files": f"""WITH {_CURRENT}, c AS (SELECT DISTINCT c.repo_key, chunk_id, scope, c.relative_path, language, chunk_type, text, start_line, end_line, content_hash, symbol_path, heading_path,
    array_to_string(domain_tags, ',') AS domain_tags, extra['locator'] AS locator, extra['split_part'] AS split_part
  FROM chunks c JOIN files f ON c.repo_key = f.repo_key AND c.relative_path = f.relative_path AND abs(c.source_mtime - f.mtime_ns / 1e9) < 1e-6) SELECT * FROM c""",
    "generic_windows": f"""WITH RECURSIVE l AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS lines FROM (SELECT doc_id, regexp_split_to_array(text, '{BREAK}') AS p FROM documents WHERE text IS NOT NULL)),
  n AS (SELECT doc_id, lines, len(lines) AS n FROM l WHERE len(lines) > 0),
  w(doc_id, lo, hi) AS (
    SELECT doc_id, 0, 0 FROM n
    UNION ALL
    SELECT w.doc_id, w.hi, (SELECT max(x) FROM (SELECT least(w.hi + 80, n.n) - 5 * k AS x FROM range(16) t(k))
        WHERE x > w.hi AND (x <= w.hi + 5 OR length(regexp_replace(regexp_replace(array_to_string(n.lines[w.hi + 1 : x], chr(10)), '^{BLANK}+', ''), '{BLANK}+$', '')) <= 2400))
    FROM w JOIN n ON w.doc_id = n.doc_id WHERE w.hi < n.n)
SELECT w.doc_id, (lo + 1)::INT AS start_line, hi::INT AS end_line, length(t)::INT AS n_chars FROM (
  SELECT w.doc_id, lo, hi, regexp_replace(regexp_replace(array_to_string(lines[lo + 1 : hi], chr(10)), '^{BLANK}+', ''), '{BLANK}+$', '') AS t FROM w JOIN n ON w.doc_id = n.doc_id WHERE hi > lo) w WHERE t <> ''""",
    "oversized_parts": f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS n FROM (
    SELECT doc_id, regexp_extract_all(text, '{BREAK.replace("[", "[^").split("|")[1]}*(?:{BREAK})|{BREAK.replace("[", "[^").split("|")[1]}+$') AS p FROM documents WHERE length(text) > 800)),
  seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i, substring(line, k * 800 + 1, 800) AS t, length(line) > 800 AS alone
    FROM (SELECT doc_id, n, line, unnest(range((length(line) + 799) // 800)) AS k FROM l)),
  pack(doc_id, i, part, acc, alone) AS (
    SELECT doc_id, i, 1, length(t), alone FROM seg WHERE i = 1
    UNION ALL
    SELECT s.doc_id, s.i, CASE WHEN s.alone OR p.alone OR p.acc + length(s.t) > 800 THEN p.part + 1 ELSE p.part END,
      CASE WHEN s.alone OR p.alone OR p.acc + length(s.t) > 800 THEN length(s.t) ELSE p.acc + length(s.t) END, s.alone
    FROM pack p JOIN seg s ON s.doc_id = p.doc_id AND s.i = p.i + 1),
  part AS (SELECT doc_id, part, string_agg(t, '' ORDER BY i) AS t FROM pack JOIN seg USING (doc_id, i) GROUP BY ALL),
  counted AS (SELECT *, length(t) - length(replace(t, chr(10), '')) AS b FROM part),
  placed AS (SELECT *, 1 + coalesce(sum(b) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM counted)
SELECT doc_id, part::INT AS part, length(t)::INT AS n_chars, lo::INT AS start_line, (lo + b - CASE WHEN ends_with(t, chr(10)) THEN 1 ELSE 0 END)::INT AS end_line FROM placed
UNION ALL SELECT doc_id, 1, length(text)::INT, 1, (length(text) - length(replace(text, chr(10), '')) + 1)::INT FROM documents WHERE length(text) <= 800""",
    "heading_paths": f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '{BREAK}') AS p FROM documents)),
  h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}}){BLANK}', 1)) AS level, regexp_extract(line, '^#{{1,6}}{BLANK}+(.*{NOT_BLANK}){BLANK}*$', 1) AS title FROM l WHERE regexp_matches(line, '^#{{1,6}}{BLANK}+.*{NOT_BLANK}')),
  up AS (SELECT a.doc_id, a.line_no, a.level, b.line_no AS place, b.title FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.line_no <= a.line_no
    WHERE (b.line_no = a.line_no OR b.level < a.level) AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.line_no > b.line_no AND c.line_no <= a.line_no AND c.level <= b.level))
SELECT doc_id, line_no::INT AS line_no, level::INT AS level, string_agg(title, ' / ' ORDER BY place) AS heading_path FROM up GROUP BY ALL""",
    "upsert_latest": f"WITH {_LATEST} SELECT repo_key, chunk_id, relative_path, start_line, end_line, md5(text) AS text_md5, indexed_at FROM latest",
    "delete_stale": f"""WITH {_LATEST}, {_CURRENT}, {_INDEXED}, {_TOUCHED}
SELECT repo_key, scope, count(*) AS n, count(DISTINCT relative_path) AS n_paths FROM latest l
WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE op IS NOT NULL AND t.repo_key = l.repo_key AND t.relative_path = l.relative_path) GROUP BY ALL""",
    "reconcile_diff": f"WITH {_LATEST}, {_CURRENT}, {_INDEXED}, {_TOUCHED} SELECT * FROM touched WHERE op IS NOT NULL",
    "snapshot_diff": """WITH r AS (SELECT repo_key, replace(relative_path, chr(92), '/') AS relative_path, mtime_ns, epoch_us(crawled_at) > (SELECT min(epoch_us(crawled_at)) + (max(epoch_us(crawled_at)) - min(epoch_us(crawled_at))) // 2 FROM source_files) AS late FROM source_files),
  a AS (SELECT repo_key, relative_path, max(mtime_ns) AS m FROM r WHERE NOT late GROUP BY ALL), b AS (SELECT repo_key, relative_path, max(mtime_ns) AS m FROM r WHERE late GROUP BY ALL)
SELECT * FROM (SELECT coalesce(a.repo_key, b.repo_key) AS repo_key, coalesce(a.relative_path, b.relative_path) AS relative_path,
  CASE WHEN a.m IS NULL THEN 'new' WHEN b.m IS NULL THEN 'deleted' WHEN a.m <> b.m THEN 'changed' END AS op
  FROM a FULL JOIN b ON a.repo_key = b.repo_key AND a.relative_path = b.relative_path) WHERE op IS NOT NULL""",
    "index_status": f"""WITH {_LATEST} SELECT l.*, profile_name, embedding_backend, index_schema_version, watch_enabled, last_full_build_at FROM (
  SELECT repo_key, scope, count(*) AS points, count(DISTINCT relative_path) AS paths, count(vector) AS embedded, max(indexed_at) AS last_indexed_at FROM latest GROUP BY ALL) l
JOIN repositories USING (repo_key)""",
    "read_chunks": f"""WITH {_LATEST} SELECT l.repo_key, l.scope, l.chunk_id, relative_path, chunk_type, start_line, end_line, md5(text) AS text_md5 FROM latest l
WHERE EXISTS (SELECT 1 FROM search_results r WHERE r.repo_key = l.repo_key AND r.scope = l.scope AND r.chunk_id = l.chunk_id)""",
    "store_scan": f"""WITH {_LATEST} SELECT repo_key || '/' || chunk_id AS chunk_id, scope, repo_key || '/' || replace(relative_path, chr(92), '/') AS relative_path, language, chunk_type, start_line, end_line,
  content_hash, symbol_path, heading_path, is_generated, embedding_backend, embedding_model, index_schema_version, md5(text) AS text_md5, array_to_string(domain_tags, ',') AS domain_tags,
  extra['locator'] AS locator, round(source_mtime, 3) AS source_mtime FROM latest""",
    "store_vectors": f"""WITH {_LATEST} SELECT scope, count(*) AS points, count(vector) AS embedded, round(sum(list_sum(vector::DOUBLE[])), 3) AS total FROM latest GROUP BY ALL""",
    "store_status": f"""WITH {_LATEST}, n AS (SELECT scope, count(*) AS points FROM latest GROUP BY ALL)
SELECT scope, 'corpusloom_all_cpu_e5_multilingual_e5_small_' || scope || '_v1' AS name, coalesce(points, 0) > 0 AS exists, coalesce(points, 0) AS points FROM (SELECT unnest(['code', 'docs']) AS scope) LEFT JOIN n USING (scope)""",
    "store_recreated": f"""WITH {_LATEST}, n AS (SELECT count(*) AS points FROM latest WHERE scope = 'docs')
SELECT 'docs' AS scope, points, points > 0 AS exists FROM n UNION ALL SELECT 'code', 0, false""",
    "store_deleted": f"""WITH {_LATEST}, {_CURRENT}, {_INDEXED}, {_TOUCHED}
SELECT scope, count(*) AS n, count(DISTINCT repo_key || '/' || relative_path) AS n_paths FROM latest l
WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE op IS NOT NULL AND t.repo_key = l.repo_key AND t.relative_path = l.relative_path) GROUP BY ALL""",
    "stored_bm25": f"WITH {_LATEST}, " + _bm25("SELECT scope AS g, repo_key || '/' || chunk_id AS id, text FROM latest") + " SELECT g AS scope, id AS chunk_id, round(raw, 6) AS lexical_raw, round(score, 6) AS lexical_score FROM lex",
    "find_similar_stored": f"WITH {_LATEST}, {_NEAR} SELECT chunk_id, scope, round(s, 6) AS score FROM near WHERE chunk_id <> own AND scope = own_scope ORDER BY s DESC, chunk_id LIMIT 10",
    "dense_by_path_and_tag": f"""WITH {_LATEST}, {_NEAR}, l AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY s DESC, chunk_id) AS r FROM near)
SELECT chunk_id, scope, round(s, 6) AS dense_score FROM l WHERE r <= 1000 AND starts_with(relative_path, regexp_extract(own, '^[^/]*/')) AND list_has_any(domain_tags, ['general', 'docs']) ORDER BY s DESC, chunk_id LIMIT 25""",
    "result_projection": f"""WITH {_LATEST}, best AS (SELECT repo_key || '/' || chunk_id AS chunk_id, scope, max(score) AS score FROM search_results GROUP BY ALL),
  c AS (SELECT repo_key || '/' || chunk_id AS chunk_id, scope, repo_key || '/' || replace(relative_path, chr(92), '/') AS relative_path, language, chunk_type, start_line, end_line, symbol_path, heading_path,
    array_to_string(domain_tags, ',') AS domain_tags, regexp_replace(regexp_replace(text, '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS f FROM latest)
SELECT chunk_id, scope, relative_path, language, chunk_type, CASE WHEN length(f) <= 280 THEN f ELSE regexp_replace(substring(f, 1, 277), '{BLANK}+$', '') || '...' END AS snippet,
  start_line, end_line, symbol_path, heading_path, score, domain_tags FROM c JOIN best USING (chunk_id, scope) ORDER BY score DESC NULLS LAST, chunk_id LIMIT 100""",
    "tracked_tree": """WITH f AS (SELECT repo_key, replace(relative_path, chr(92), '/') AS relative_path, mtime_ns FROM source_files),
  tree AS (SELECT relative_path, max(mtime_ns) AS mtime_ns, arg_max(repo_key, (mtime_ns, repo_key)) AS repo_key FROM f GROUP BY ALL)
SELECT c.relative_path, scope, count(DISTINCT extra['locator']) AS n_places, md5(string_agg(DISTINCT content_hash, ',' ORDER BY content_hash)) AS contents
FROM chunks c JOIN tree t ON c.repo_key = t.repo_key AND c.relative_path = t.relative_path AND abs(c.source_mtime - t.mtime_ns / 1e9) < 1e-6 GROUP BY ALL""",
    "query_set_file": "SELECT name, query, array_to_string(expected_any, '|') AS expected_any FROM search_queries",
    "index_profiles": "SELECT repo_key, trim(profile_name) AS profile, index_schema_version FROM repositories",
    "dedup_results": """SELECT run_label, query_name, repo_key, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY run_label, query_name, repo_key ORDER BY score DESC NULLS LAST, chunk_id) AS rank
FROM (SELECT run_label, query_name, repo_key, chunk_id, max(score) AS score FROM search_results GROUP BY ALL)""",
    "fused_results": """SELECT run_label, query_name, repo_key, served_at, position_no, chunk_id, 0.7::DOUBLE * coalesce(dense_score, 0) + 0.3::DOUBLE * coalesce(lexical_score, 0) AS fused FROM (
  SELECT *, row_number() OVER (PARTITION BY run_label, query_name, repo_key, served_at, position_no ORDER BY logged_at DESC) AS r FROM search_results) WHERE r = 1""",
    "hit_at_k": f"""WITH {_LATEST}, f AS (SELECT run_label, query_name AS name, relative_path, position_no FROM search_results r JOIN latest l ON r.repo_key = l.repo_key AND r.scope = l.scope AND r.chunk_id = l.chunk_id),
  top AS (SELECT run_label, name, list(DISTINCT relative_path) FILTER (position_no <= 3) AS p FROM f GROUP BY ALL)
SELECT run_label, name, CASE WHEN expected_any IS NOT NULL AND len(expected_any) > 0 THEN coalesce(list_has_any(p, expected_any), false) END AS hit_top_k FROM top JOIN search_queries USING (name)""",
    "compare_runs": """SELECT run_label, count(*) AS calls, count(DISTINCT query_name) AS queries, round(avg(e), 6) AS mean_ms, round(avg(CASE WHEN h THEN 1.0 WHEN NOT h THEN 0.0 END), 6) AS hit_rate FROM (
  SELECT run_label, query_name, served_at, max(elapsed_ms) AS e, bool_or(hit_top_k) AS h FROM search_results GROUP BY ALL) GROUP BY ALL""",
}
for _column in ("repo_key", "profile_name", "embedding_model"):
    _slug = f"coalesce(nullif(trim(regexp_replace(regexp_extract(lower(trim({_column})), '[^/]*$'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'model')"
    ORACLE["collection_names"] = ORACLE["collection_names"].replace(f"s({_column})", _slug)
