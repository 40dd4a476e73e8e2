"""Queries of postings that follow changes, references, backfills, name lists and data sets, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import lifecycle, mutations, retrieval
from quillmesh.operators.posting_store import PostingStore
from quillmesh.plans.oracle import CHUNKS, EMBEDDED, PROJ, SRC
from quillmesh.plans.searches import BATCHED, batched_hybrid
from quillmesh.sources import knowledge as model
from quillmesh.sources import reports
from quillmesh.sources.shared import fresh_folder

LIMIT = 40
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"  # fixed value: the namespace of names in DNS form


def _with(tables: str, select: str) -> str:
    return f"WITH RECURSIVE {tables}\n{select}"


_STORES: dict[tuple[str, str], PostingStore] = {}


def _store(spark, sf_dir) -> PostingStore:
    """The postings after all sources came, a tenth of them changed, another tenth went, half of the changed ones changed again, and a few came back."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store, chunks = PostingStore(spark, fresh_folder(spark, "current")), model.chunks(spark, sf_dir).select("chunk_id", "doc_id", "content")
        for which, content in (("true", F.col("content")), ("doc_id % 10 = 3", F.concat("content", F.lit(" the that the"))), ("doc_id % 10 = 7", None), ("doc_id % 20 = 3", F.concat(F.lit("the new "), "content")), ("doc_id % 70 = 7", F.col("content"))):
            fresh = chunks.limit(0) if content is None else chunks.filter(which).withColumn("content", content)
            store.put(fresh, model.table(spark, sf_dir, "documents").filter(which).select("doc_id"))
        _STORES[key] = store
    return _STORES[key]


def updated_postings(spark, sf_dir):
    """Every term of the changed sources with its chunks and occurrences."""
    return _store(spark, sf_dir).postings().groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size("positions").cast("long")).alias("n_words"))


def updated_text_rank(spark, sf_dir):
    """The best chunks for two terms that changes added and took away."""
    return _store(spark, sf_dir).search(["the", "new"], LIMIT)


_CHANGED = f"""{CHUNKS},
now AS (SELECT chunk_id, CASE WHEN doc_id % 70 = 7 THEN content WHEN doc_id % 20 = 3 THEN 'the new ' || content WHEN doc_id % 10 = 3 THEN content || ' the that the' ELSE content END AS content FROM chunks WHERE doc_id % 10 <> 7 OR doc_id % 70 = 7),
tok AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM now)"""
#: A cover of two different terms ends at one of them and begins at the last of the other before it; of covers with one start the shortest counts.
_RANKED = f"""{_CHANGED},
occ AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS n FROM (SELECT chunk_id, pos, t[pos] AS term FROM tok, unnest(range(1, len(t) + 1)) AS u(pos) WHERE list_contains(t, 'the') AND list_contains(t, 'new')) WHERE term IN ('the', 'new')),
pair AS (SELECT *, lag(term) OVER w AS before, lag(pos) OVER w AS start FROM occ WINDOW w AS (PARTITION BY chunk_id ORDER BY pos)),
rk AS (SELECT chunk_id, round(sum(0.1::DOUBLE / (1 + (pos - start) - 1)), 6) AS text_rank FROM pair WHERE before <> term GROUP BY chunk_id)"""


def reference_texts(spark, sf_dir):
    """What a reader copies of each search of the query set: its chunks as references, in order."""
    rows = model.chunks(spark, sf_dir).join(batched_hybrid(spark, sf_dir).select("query", "place", "chunk_id"), "chunk_id")
    title = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    shown = rows.withColumns({"title": title, "page": F.when(F.col("doc_id") % 3 > 0, F.col("chunk_index")), "section": F.when(F.col("doc_id") % 2 == 0, title).when(F.col("doc_id") % 5 == 0, "")})
    found = retrieval.references(shown, "query", "place", title="title", page="page", section="section", chunk_index="chunk_index", content="content")
    return found.select("query", F.sha2("references", 256).alias("references_sha256"), F.length("references").cast("long").alias("n_chars"))


_REFERENCES = """SELECT query, sha256(said) AS references_sha256, length(said) AS n_chars FROM (SELECT query, string_agg('doc-' || doc_id || chr(10) || CASE WHEN doc_id % 3 > 0 AND chunk_index <> 0 THEN 'Página ' || chunk_index || ' · ' ELSE '' END
|| CASE WHEN doc_id % 2 = 0 THEN 'doc-' || doc_id || ' · ' ELSE '' END || 'Trecho ' || (chunk_index + 1) || chr(10) || content, chr(10) || chr(10) ORDER BY place) AS said FROM top JOIN chunks USING (chunk_id) GROUP BY query)"""


def status_backfill(spark, sf_dir):
    """Chunks of which some were stored before there were states, with the state of each."""
    old = model.embedded_chunks(spark, sf_dir).withColumn("embedding_status", F.when(F.col("doc_id") % 5 != 0, F.col("embedding_status")))
    return lifecycle.backfilled(old, {"embedding_status": lifecycle.status_of_vector()}).select("chunk_id", "embedding_status")


def source_backfill(spark, sf_dir):
    """Sources of which some were stored without text, time of change, or public id."""
    k = F.col("doc_id")
    old = model.sources(spark, sf_dir).select("doc_id", "title", "created_at", F.when(k % 9 != 0, F.col("content_text")).alias("content_text"), F.when(k % 4 == 0, F.timestamp_seconds(k)).alias("updated_at"), F.when(k % 2 == 0, F.concat(F.lit("id-"), k.cast("string"))).alias("public_id"))
    new = lifecycle.backfilled(old, {"content_text": F.lit(""), "updated_at": F.col("created_at"), "public_id": text.name_uuid(NAMESPACE, F.col("title"))})
    return new.select("doc_id", "public_id", F.unix_timestamp("updated_at").alias("updated_s"), F.sha2("content_text", 256).alias("content_hash"))


_UUID = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode('doc-' || doc_id))"
_BACKFILL = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'id-' || doc_id ELSE h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] END AS public_id,
CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE 1704067200 + doc_id * 60 END AS updated_s, sha256(CASE WHEN doc_id % 9 <> 0 THEN content_text ELSE '' END) AS content_hash FROM (SELECT *, {_UUID} AS h FROM src)"""


def unsupported_metadata(spark, sf_dir):
    """The metadata keys of each event that a chunk may not store."""
    each = model.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.to_json(F.create_map("event_type", F.col("user_id"), F.lit("client_id"), F.col("user_id"), F.lit("a"), F.col("user_id")))).alias("m"))
    return each.select("event_id", F.array_join(text.unsupported_keys("m"), ",").alias("unsupported"))


def unselected_tags(spark, sf_dir):
    """The tags that can still be chosen where those of the archived project's sources with an even id are."""
    docs = model.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"))
    chosen = docs.join(model.source_projects(spark, sf_dir).filter("project_id = 4 AND doc_id % 54 = 24"), "doc_id", "left_semi")
    return mutations.unselected(docs.select("name"), chosen, "name")


def upserted_names(spark, sf_dir):
    """The suppliers as a list of names after an upsert for each customer, in the order of a language."""
    rows = model.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))
    c = F.col("c_custkey").cast("long")
    items = model.table(spark, sf_dir, "customer").select(c.alias("request_id"), F.floor(c / 3).alias("id"), F.concat(F.lower("c_mktsegment"), F.lit(" "), "c_name").alias("name"))
    return mutations.upserted(rows, items)


GROUP = 20  # cases of a data set


def dataset_cases(spark, sf_dir):
    """The cases of data sets, which are written as JSON files from the benchmark and read back with all checks."""
    k, folder = F.col("item_id"), fresh_folder(spark, "datasets")
    open_ = k % GROUP == 0
    case = F.struct(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(open_, reports.UNANSWERED).otherwise("factual").alias("kind"), F.col("text").alias("question"), F.when(k % 3 == 0, k % 50 + 1).alias("limit"),
        F.when(~open_, F.array(F.struct(F.col("text").alias("snippet")))).alias("expected_chunks"), F.when(~open_, F.slice(text.tokens("text"), 1, 2)).alias("expected_answer_points"),
    )
    sets = model.table(spark, sf_dir, "benchmark").filter("trim(text) <> ''").groupBy(F.floor(k / GROUP).alias("g")).agg(F.collect_list(case).alias("cases"))
    whole = sets.filter(F.exists("cases", lambda c: c["kind"] == reports.UNANSWERED))
    body = F.to_json(F.struct(F.concat(F.lit("v"), F.col("g").cast("string")).alias("dataset_version"), F.struct(F.lit(7).alias("limit"), F.lit(0.25).alias("min_score")).alias("defaults"), "cases"))
    whole.select("g", body.alias("value")).write.partitionBy("g").text(folder)
    cases = reports.read_cases(spark, folder)
    return cases.select("dataset_version", "case", "kind", F.sha2("question", 256).alias("question_sha256"), "limit", "min_score", F.size("expected").cast("long").alias("n_expected"), F.array_join("points", ",").alias("points"), "expected_refusal")


_DATASETS = """SELECT 'v' || (item_id // 20) AS dataset_version, 'c' || item_id AS "case", CASE WHEN item_id % 20 = 0 THEN 'unanswered' ELSE 'factual' END AS kind, sha256(text) AS question_sha256, CASE WHEN item_id % 3 = 0 THEN item_id % 50 + 1 ELSE 7 END AS "limit", 0.25::DOUBLE AS min_score,
CASE WHEN item_id % 20 = 0 THEN 0 ELSE 1 END AS n_expected, CASE WHEN item_id % 20 = 0 THEN '' ELSE array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:2], ',') END AS points, CASE WHEN item_id % 20 = 0 THEN true END AS expected_refusal
FROM benchmark WHERE trim(text) <> '' AND item_id // 20 IN (SELECT item_id // 20 FROM benchmark WHERE item_id % 20 = 0 AND trim(text) <> '')"""

RECORDS = {
    "updated_postings": (updated_postings, _with(_CHANGED, "SELECT term, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_words FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY term")),
    "updated_text_rank": (updated_text_rank, _with(_RANKED, f"SELECT chunk_id, text_rank FROM rk ORDER BY text_rank DESC, chunk_id LIMIT {LIMIT}")),
    "reference_texts": (reference_texts, _with(BATCHED, _REFERENCES)),
    "status_backfill": (status_backfill, _with(EMBEDDED, "SELECT chunk_id, CASE WHEN doc_id % 5 <> 0 THEN embedding_status WHEN embedding IS NULL THEN 'pending' ELSE 'unversioned' END AS embedding_status FROM emb")),
    "source_backfill": (source_backfill, _with(SRC, _BACKFILL)),
    "unsupported_metadata": (unsupported_metadata, "SELECT event_id, CASE WHEN event_type = 'error' THEN 'k' ELSE 'a,' || event_type END AS unsupported FROM events"),
    "unselected_tags": (unselected_tags, _with(PROJ, "SELECT DISTINCT source AS name FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN proj USING (doc_id) WHERE project_id = 4 AND doc_id % 54 = 24)")),
    "upserted_names": (upserted_names, "WITH items AS (SELECT c_custkey // 3 AS id, max_by(lower(c_mktsegment) || ' ' || c_name, c_custkey) AS name FROM customer GROUP BY 1) SELECT id, name FROM items UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM items)"),
    "dataset_cases": (dataset_cases, _DATASETS),
}
