"""DuckDB SQL of the knowledge-model queries, over the driver's views."""

from __future__ import annotations

from quillmesh.operators.evaluation import REFUSALS

NL = "chr(10)"
SRC = f"""src AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || {NL}, {NL}), chr(13), {NL}), {NL}),
  lambda x: trim(regexp_replace(x, '[\\s\\x0B\\x{{A0}}]+', ' ', 'g'))), lambda x: x <> ''), {NL}) AS content_text FROM documents)"""


def _end(s: str) -> str:
    """Where a chunk of t that begins at s ends: behind the last of the best break in its later half."""
    half = f"substr(t, {s} + 501, 500)"
    whens = " ".join(f"WHEN contains({half}, {b}) THEN {s} + 1001 - strpos(reverse({half}), reverse({b}))" for b in (f"{NL} || {NL}", NL, "'. '", "'; '", "', '", "' '"))
    return f"CASE WHEN {s} + 1000 >= length(t) THEN length(t) {whens} ELSE {s} + 1000 END"


CHUNKS = f"""{SRC},
cut AS (
  SELECT doc_id, t, CAST(0 AS BIGINT) AS i, s, CAST({_end("s")} AS BIGINT) AS e FROM (SELECT doc_id, content_text AS t, CAST(0 AS BIGINT) AS s FROM src) WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, i, s, CAST({_end("s")} AS BIGINT) AS e FROM (
    SELECT doc_id, t, i + 1 AS i, e - 150 + length(substr(t, e - 149, 50)) - length(ltrim(substr(t, e - 149, 50), ' ' || {NL})) AS s FROM cut WHERE e < length(t))),
chunks AS (SELECT doc_id * 1000000 + i AS chunk_id, doc_id, i AS chunk_index, s AS start_char, s + length(content) AS end_char, content
  FROM (SELECT doc_id, i, s, rtrim(substr(t, s + 1, e - s), ' ' || {NL}) AS content FROM cut))"""
BATCHES = "batches AS (SELECT range AS batch_id, CASE WHEN range = 8 THEN 'old' ELSE 'active' END AS config_hash, CASE WHEN range = 9 THEN 'running' ELSE 'completed' END AS batch_status FROM range(10))"
EMBEDDED = f"""{CHUNKS}, {BATCHES},
nv AS (SELECT count(*) AS n FROM embeddings),
emb AS (SELECT c.*, CASE WHEN (doc_id + chunk_index) % 11 <> 0 THEN CAST(v.embedding AS DOUBLE[]) END AS embedding, CASE WHEN (doc_id + chunk_index) % 13 <> 0 THEN CAST(v.label AS BIGINT) END AS batch_id,
  CASE WHEN doc_id % 19 = 0 THEN 'failed' WHEN doc_id % 17 = 0 OR (doc_id + chunk_index) % 11 = 0 THEN 'pending' ELSE 'embedded' END AS embedding_status
  FROM chunks c CROSS JOIN nv LEFT JOIN embeddings v ON v.vec_id = (c.doc_id * 7 + c.chunk_index) % n),
usable AS (SELECT emb.* FROM emb JOIN batches USING (batch_id) WHERE embedding IS NOT NULL AND embedding_status = 'embedded' AND config_hash = 'active' AND batch_status = 'completed'),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"""
CATS = "cats AS (SELECT doc_id, lang AS category FROM documents UNION SELECT doc_id, 'curated' FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents) UNION SELECT doc_id, 'sensitive' FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents))"
PROJ = "proj AS (SELECT doc_id, doc_id % 5 AS project_id FROM documents WHERE doc_id % 3 = 0)"
NAMES = "names AS (SELECT range AS project_id, 'project-' || range AS name, CASE WHEN range = 4 THEN 'archived' ELSE 'active' END AS status FROM range(5))"
TEXT = """tok AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS t FROM chunks),
hits AS (SELECT chunk_id, t FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'that')),
occ AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS n FROM (SELECT chunk_id, pos, t[pos] AS term FROM hits, unnest(range(1, len(t) + 1)) AS u(pos)) WHERE term IN ('the', 'that')),
upto AS (SELECT *, max(CASE WHEN term = 'the' THEN pos END) OVER w AS a, max(CASE WHEN term = 'that' THEN pos END) OVER w AS b FROM occ WINDOW w AS (PARTITION BY chunk_id ORDER BY pos)),
cover AS (SELECT chunk_id, least(a, b) AS s, min(pos) AS e FROM upto WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
rk AS (SELECT c.chunk_id, round(sum(0.1::DOUBLE / (1 + (c.e - c.s) - (y.n - x.n))), 6) AS text_rank FROM cover c JOIN occ x ON x.chunk_id = c.chunk_id AND x.pos = c.s JOIN occ y ON y.chunk_id = c.chunk_id AND y.pos = c.e GROUP BY c.chunk_id),
texts AS (SELECT chunk_id, text_rank FROM rk ORDER BY text_rank DESC, chunk_id LIMIT 40)"""
HYBRID = f"""{EMBEDDED}, {TEXT},
near AS (SELECT chunk_id, round(list_cosine_similarity(embedding, v), 6) AS score FROM usable, q ORDER BY score DESC, chunk_id LIMIT 40),
one AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS vr FROM near), two AS (SELECT *, row_number() OVER (ORDER BY text_rank DESC, chunk_id) AS tr FROM texts),
fused AS (SELECT chunk_id, round(coalesce(1::DOUBLE / (60 + vr), 0) + coalesce(1::DOUBLE / (60 + tr), 0), 9) AS rrf, vr IS NOT NULL AND tr IS NOT NULL AS in_both, score, text_rank,
  array_to_string(list_filter([CASE WHEN vr IS NOT NULL THEN 'vector' END, CASE WHEN tr IS NOT NULL THEN 'text' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM one FULL JOIN two USING (chunk_id) WHERE vr IS NULL OR score >= 0.35),
top AS (SELECT chunk_id, CAST(row_number() OVER (ORDER BY rrf DESC, in_both DESC, score DESC NULLS LAST, text_rank DESC NULLS LAST, chunk_id) AS INTEGER) AS place, rrf, score, text_rank, reasons FROM fused QUALIFY place <= 10)"""
QUERY_SET = """qs AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, qs),
knn AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scored)"""
CASES = f"""{QUERY_SET},
want AS (SELECT query, id FROM (SELECT query, vec_id AS id, row_number() OVER (PARTITION BY query ORDER BY vec_id) AS r FROM qs JOIN embeddings e USING (label) WHERE vec_id > query) WHERE r <= 5)"""


def _graded(k: int) -> str:
    return f"SELECT w.query AS \"case\", count(k.rank)::DOUBLE / count(w.id) AS recall_at_k, coalesce(1::DOUBLE / min(k.rank), 0) AS reciprocal_rank FROM want w LEFT JOIN (SELECT * FROM knn WHERE rank <= {k}) k USING (query, id) GROUP BY w.query"


ANN = f"""{QUERY_SET},
seed AS (SELECT vec_id AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 <> 0 ORDER BY vec_id LIMIT 24),
near AS (SELECT c, e FROM (SELECT CAST(embedding AS DOUBLE[]) AS e, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) DESC, c) AS r FROM embeddings, seed) WHERE r = 1),
cent AS (SELECT c, list(x ORDER BY d) AS v FROM (SELECT c, d, round(avg(e[d]), 6) AS x FROM near, unnest(range(1, 65)) AS u(d) GROUP BY c, d) GROUP BY c),
list AS (SELECT id, c FROM (SELECT vec_id AS id, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) DESC, c) AS r FROM embeddings, cent) WHERE r = 1),
probe AS (SELECT query, c FROM (SELECT query, c, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(cent.v, qs.v), 6) DESC, c) AS r FROM cent, qs) WHERE r <= 20),
ann AS (SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored JOIN list USING (id) JOIN probe USING (query, c) QUALIFY rank <= 10)"""
REASON = """CASE WHEN config_hash IS NULL THEN CASE WHEN embedding IS NULL THEN 'missing_batch' ELSE 'unversioned' END WHEN embedding_status = 'failed' THEN 'failed' WHEN embedding_status <> 'embedded' THEN embedding_status
  WHEN batch_status <> 'completed' THEN 'batch_not_completed' WHEN config_hash <> 'active' THEN 'config_changed' ELSE 'pending' END"""
STALE = f"{EMBEDDED}, stale AS (SELECT chunk_id, doc_id, {REASON} AS reason FROM emb LEFT JOIN batches USING (batch_id) WHERE content <> '' AND (embedding IS NULL OR embedding_status <> 'embedded' OR config_hash IS NULL OR config_hash <> 'active' OR batch_status <> 'completed'))"
SAID = "replace(lower(trim(regexp_replace(%s, '[\\s\\x0B\\x{A0}]+', ' ', 'g'))), 'ß', 'ss')"  # as compared()
REFUSED = "(" + " OR ".join("contains({said}, '" + p.replace("'", "''") + "')" for p in REFUSALS) + ")"


def _with(tables: str, select: str) -> str:
    return f"WITH RECURSIVE {tables}\n{select}"


def oracle_sql() -> dict[str, str]:
    refused = REFUSED.replace("{said}", SAID % "text")
    words = "regexp_extract_all(lower(%s), '[\\p{L}\\p{N}]+')"
    return {
        "vector_topk": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT * FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10) WHERE score >= 0.35",
        "vector_topk_filtered": _with(f"{EMBEDDED}, {CATS}, {PROJ}", "SELECT chunk_id, round(list_cosine_similarity(embedding, v), 6) AS score FROM usable, q WHERE doc_id IN (SELECT doc_id FROM cats WHERE category IN ('en', 'curated')) AND doc_id IN (SELECT doc_id FROM proj WHERE project_id IN (0, 1, 4)) ORDER BY score DESC, chunk_id LIMIT 10"),
        "normalize_documents": _with(SRC, "SELECT doc_id, length(content_text) AS n_chars, sha256(content_text) AS content_hash FROM src"),
        "content_hash_dedupe": _with(SRC, "SELECT min(doc_id) AS doc_id, sha256(content_text) AS content_hash FROM src GROUP BY content_hash"),
        "chunk_documents": _with(CHUNKS, "SELECT chunk_id, doc_id, chunk_index, start_char, end_char, sha256(content) AS content_hash FROM chunks"),
        "sources_serialized": _with(f"{CATS}, {PROJ}, {NAMES}", "SELECT d.doc_id, 'doc-' || d.doc_id AS title, 'text:doc-' || d.doc_id AS uri, d.source AS tag, coalesce(c.x, '') AS categories, coalesce(p.x, '') AS projects FROM documents d LEFT JOIN (SELECT doc_id, string_agg(category, ',' ORDER BY category) AS x FROM cats GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(name || ':' || status, ',' ORDER BY name) AS x FROM proj JOIN names USING (project_id) GROUP BY doc_id) p USING (doc_id)"),
        "facets": _with(f"{CATS}, {PROJ}", "SELECT 'category' AS facet, category AS name, count(*) AS n_sources FROM cats GROUP BY ALL UNION ALL SELECT 'tag', source, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'project', 'project-' || project_id, count(*) FROM proj GROUP BY ALL"),
        "dashboard_metrics": _with(f"{NAMES}, {CATS}", "SELECT (SELECT count(DISTINCT category) FROM cats) AS n_categories, (SELECT count(doc_id) FROM documents) AS n_sources, (SELECT count(DISTINCT source) FROM documents) AS n_tags, count(*) FILTER (WHERE status = 'active') AS n_active, count(*) FILTER (WHERE status = 'archived') AS n_archived FROM names"),
        "recent_sources": "SELECT doc_id, 'doc-' || doc_id AS title, 1704067200 + doc_id * 60 AS created_s FROM documents ORDER BY created_s DESC, title, doc_id LIMIT 5",
        "library_all_filter": _with(CATS, "SELECT doc_id FROM cats WHERE category IN ('en', 'curated') GROUP BY doc_id HAVING count(DISTINCT category) = 2"),
        "library_title_search": _with(SRC, "SELECT doc_id, title FROM (SELECT doc_id, 'doc-' || doc_id || ' ' || substr(content_text, 1, 20) AS title FROM src) WHERE contains(lower(strip_accents(title)), 'e')"),
        "tag_autocomplete": "SELECT DISTINCT source AS name FROM documents WHERE lower(strip_accents(trim(source))) LIKE 'src1%' ORDER BY name LIMIT 10",
        "missing_filter_ids": _with(PROJ, "SELECT pos, project_id FROM (SELECT doc_id AS pos, doc_id // 100 % 8 AS project_id FROM documents WHERE doc_id % 100 = 0) WHERE project_id NOT IN (SELECT project_id FROM proj)"),
        "project_sources": _with(PROJ, "SELECT project_id, doc_id, 'doc-' || doc_id AS title FROM proj WHERE project_id = 4"),
        "deletable_categories": _with(CATS, "SELECT name FROM (VALUES ('en'), ('unused'), ('curated')) AS v(name) WHERE name NOT IN (SELECT category FROM cats WHERE category IS NOT NULL)"),
        "compatible_chunk_count": _with(EMBEDDED, "SELECT count(*) AS n_chunks FROM usable"),
        "reindex_candidates": _with(STALE, "SELECT * FROM stale"),
        "reindex_reason_counts": _with(STALE, "SELECT reason, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_sources FROM stale GROUP BY reason"),
        "reindex_slice": _with(STALE, "SELECT * FROM stale ORDER BY doc_id, chunk_id LIMIT 100"),
        "text_match": _with(f"{CHUNKS}, {TEXT}", "SELECT chunk_id, len(t) AS n_tokens FROM hits"),
        "text_rank_topk": _with(f"{CHUNKS}, {TEXT}", "SELECT * FROM texts"),
        "hybrid_search": _with(HYBRID, "SELECT * FROM top"),
        "exact_knn": _with(QUERY_SET, "SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank <= 10"),
        "recall_mrr": _with(CASES, f'SELECT "case", round(recall_at_k, 6) AS recall_at_k, round(reciprocal_rank, 6) AS reciprocal_rank FROM ({_graded(10)})'),
        "compare_reports": _with(CASES, f'SELECT "case", \'recall_at_k\' AS why FROM ({_graded(50)}) b JOIN ({_graded(5)}) a USING ("case") WHERE b.recall_at_k > a.recall_at_k'),
        "latency_percentiles": "SELECT event_type AS stage, list_sort(list(value))[greatest(1, least(count(*), CAST(round_even(0.95::DOUBLE * count(*) + 0.5, 0) AS BIGINT)))] AS p95_rounded, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
        "threshold_gate": _with(CASES, f"SELECT metric, value, 'minimum' AS mode, bound FROM (SELECT 'recall_at_k' AS metric, round(avg(recall_at_k), 6) AS value, 0.8::DOUBLE AS bound FROM ({_graded(10)}) UNION ALL SELECT 'mrr', round(avg(reciprocal_rank), 6), 0.7::DOUBLE FROM ({_graded(10)})) WHERE value < bound"),
        "refusal_grading": f"SELECT conv_id, turn, ({refused}) AS refused FROM conversations WHERE role = 'assistant'",
        "ann_search": _with(ANN, "SELECT query, id, score, rank FROM ann"),
        "ann_recall": _with(ANN, "SELECT k.query, round(count(ann.id)::DOUBLE / count(*), 4) AS recall FROM (SELECT * FROM knn WHERE rank <= 10) k LEFT JOIN ann USING (query, id) GROUP BY k.query"),
        "rag_context": _with(HYBRID, f"SELECT sha256(string_agg('[source_id=' || doc_id || '; chunk_id=' || chunk_id || '; titulo=doc-' || doc_id || '; localizacao=chunk ' || chunk_index || ']' || {NL} || content, {NL} || {NL} ORDER BY place)) AS context_hash, count(*) AS n_parts FROM top JOIN chunks USING (chunk_id)"),
        "privacy_gate": _with(CATS, "SELECT doc_id, doc_id IN (SELECT doc_id FROM cats WHERE category = 'sensitive') AS blocked FROM documents"),
        "category_inventory_match": _with(CATS, "SELECT conv_id, turn, list_has_any(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+'), (SELECT list(DISTINCT w) FROM (SELECT unnest(regexp_extract_all(lower(strip_accents(category)), '[a-z0-9]+')) AS w FROM cats))) AS matches FROM conversations WHERE role = 'user'"),
        "backfill_content": _with(CHUNKS, f"SELECT doc_id, sha256(string_agg(content, {NL} || {NL} ORDER BY chunk_id)) AS content_hash FROM chunks GROUP BY doc_id"),
        "safe_json": "SELECT event_type, CAST(sum(coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT), 0)) AS BIGINT) AS sum_k, count(*) AS n FROM events GROUP BY event_type",
        "expected_chunks": _with(f"{CHUNKS}, want AS (SELECT item_id, ' ' || array_to_string(t, ' ') || ' ' AS s FROM (SELECT item_id, {words % 'text'} AS t FROM benchmark) WHERE len(t) > 0)", f"SELECT item_id, chunk_id FROM (SELECT chunk_id, ' ' || array_to_string({words % 'content'}, ' ') || ' ' AS c FROM chunks) JOIN want ON contains(c, s)"),
    }
