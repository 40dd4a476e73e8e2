"""Queries over stores that are written back: mutation batches, reindex runs and streaming ingestion, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import lifecycle, mutation_batches, reindex_store, snapshots
from quillmesh.plans.oracle import CATS, CHUNKS, PROJ, STALE
from quillmesh.sources import knowledge as model
from quillmesh.sources.shared import fresh_folder, written
from quillmesh.streaming import ingestion


def _with(tables: str, select: str) -> str:
    return f"WITH RECURSIVE {tables}\n{select}"


def _catalog(spark, sf_dir):
    """The suppliers as a catalog; those with an id divisible by four are in use."""
    rows = model.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("long").alias("id"), F.col("s_name").alias("name"))
    return rows.withColumn("key", text.project_key(F.col("name")))


def _requests(spark, sf_dir):
    """A request for each customer: to create, rename or delete a supplier, by names of its group of ten, some of them new."""
    c = F.col("c_custkey")
    n = model.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    rows = model.table(spark, sf_dir, "customer").select("c_custkey").crossJoin(F.broadcast(n))  # one row
    ident = (c * 13) % (F.col("n") + 5) + 1
    number = F.floor((ident - 1) / 10) * 10 + (c * 7) % 10
    name = F.concat(F.when(c % 3 == 0, "  NEW ").otherwise(""), F.lit("Supplier#"), F.lpad(number.cast("string"), 9, "0"))
    op = F.element_at(F.array(*map(F.lit, ("create", "rename", "delete", "rename", "create", "vanish", "rename"))), (c % 7 + 1).cast("int"))
    return rows.select(c.cast("long").alias("request_id"), op.alias("op"), ident.cast("long").alias("id"), F.when(c % 11 == 0, " ").when(op != "delete", name).alias("name"))


def mutation_batch(spark, sf_dir):
    """What comes of every request of a batch whose requests see each other."""
    catalog = _catalog(spark, sf_dir)
    found = mutation_batches.outcomes(catalog, _requests(spark, sf_dir), catalog.filter("id % 4 = 0").select("id"), lambda c: text.project_key(F.col(c)))
    return found.select("request_id", "op", F.when(F.col("status").isin("created", "updated", "deleted"), F.col("id")).alias("id"), "status")


def mutated_catalog(spark, sf_dir):
    """The catalog after that batch."""
    catalog = _catalog(spark, sf_dir)
    found = mutation_batches.outcomes(catalog, _requests(spark, sf_dir), catalog.filter("id % 4 = 0").select("id"), lambda c: text.project_key(F.col(c)))
    return mutation_batches.applied(catalog, found).select("id", "key")


#: One request after the other over a map from keys to ids.
_FOLD = """sup AS (SELECT s_suppkey + 1 AS id, lower(s_name) AS key FROM supplier), n AS (SELECT count(*) AS n, max(id) AS top FROM sup),
req AS (SELECT row_number() OVER (ORDER BY c) AS i, c AS request_id, op, id, CASE WHEN c % 11 = 0 THEN '' WHEN op <> 'delete' THEN CASE WHEN c % 3 = 0 THEN 'new ' ELSE '' END || 'supplier#' || lpad(CAST((id - 1) // 10 * 10 + (c * 7) % 10 AS VARCHAR), 9, '0') END AS key
  FROM (SELECT c_custkey AS c, ['create', 'rename', 'delete', 'rename', 'create', 'vanish', 'rename'][c_custkey % 7 + 1] AS op, (c_custkey * 13) % (n + 5) + 1 AS id FROM customer, n)),
fold AS (
  SELECT CAST(0 AS BIGINT) AS i, (SELECT map_from_entries(list((key, id))) FROM sup) AS owner, CAST(0 AS BIGINT) AS made, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS out_id
  UNION ALL
  SELECT i, CASE status WHEN 'created' THEN map_concat(owner, map_from_entries([(key, top + made + 1)])) WHEN 'deleted' THEN map_from_entries(list_filter(map_entries(owner), lambda e: e.value <> id))
    WHEN 'updated' THEN map_concat(map_from_entries(list_filter(map_entries(owner), lambda e: e.value <> id)), map_from_entries([(key, id)])) ELSE owner END,
    made + CASE WHEN status = 'created' THEN 1 ELSE 0 END, status, CASE status WHEN 'created' THEN top + made + 1 WHEN 'updated' THEN id WHEN 'deleted' THEN id END
  FROM (SELECT r.*, owner, made, top, CASE WHEN op = 'vanish' THEN 'invalid' WHEN op = 'create' THEN CASE WHEN r.key = '' THEN 'invalid' WHEN owner[r.key] IS NOT NULL THEN 'conflict' ELSE 'created' END
      WHEN id > top OR NOT list_contains(map_values(owner), id) THEN 'not_found' WHEN op = 'delete' THEN CASE WHEN id % 4 = 0 THEN 'in_use' ELSE 'deleted' END
      WHEN r.key = '' THEN 'invalid' WHEN owner[r.key] <> id THEN 'conflict' ELSE 'updated' END AS status
    FROM fold f JOIN req r ON r.i = f.i + 1, n))"""


def _store(spark, sf_dir):
    """Two runs over all stale chunks; in the first the sources divisible by three fail, and one slice is cut off between its two writes; in the second the odd ones of them fail again."""
    chunks = model.embedded_chunks(spark, sf_dir).join(F.broadcast(model.batches(spark)), "batch_id", "left")  # ten rows
    items = written(lifecycle.reindex_candidates(model.embedded_chunks(spark, sf_dir), model.batches(spark), model.ACTIVE), "items")
    texts = model.chunks(spark, sf_dir).select("chunk_id", "doc_id", "content")  # not those that were joined with vectors
    store = reindex_store.create(spark, fresh_folder(spark, "reindex"), chunks.select("chunk_id", "doc_id", "embedding", "embedding_status", "config_hash"), items, max(1, items.count() // 2), texts)

    def embed(lacks):
        return lambda rows: rows.select("chunk_id", F.when(~lacks, F.array(F.lit(1.0))).alias("vector"), F.when(lacks, F.lit("provider refused")).alias("error"))

    third = F.col("doc_id") % 3 == 0
    try:
        reindex_store.execute(store, reindex_store.slices(store)[0], embed(third), "next", cut="chunks")
    except reindex_store.Cut:
        pass
    for part in reindex_store.slices(store):
        reindex_store.execute(store, part, embed(third), "next")
    reindex_store.run(store, embed(third & (F.col("doc_id") % 2 == 1)), "next")
    return store


def reindex_writeback(spark, sf_dir):
    """Items and current chunks of a store after two runs of which the first was cut off and resumed: how many are in which state."""
    store = _store(spark, sf_dir)
    items = store.items().groupBy(F.col("status").alias("state"), F.col("attempts").cast("long").alias("attempts"), "error").agg(F.count(F.lit(1)).alias("n"))
    chunks = store.states().groupBy(F.col("embedding_status").alias("state"), "error", "config_hash").agg(F.count(F.lit(1)).alias("n"))
    return items.select(F.lit("item").alias("what"), "state", "attempts", "error", F.lit(None).cast("string").alias("config"), "n").unionByName(
        chunks.select(F.lit("chunk").alias("what"), "state", F.lit(None).cast("long").alias("attempts"), "error", F.col("config_hash").alias("config"), "n")
    )


_WRITTEN = f"""{STALE},
after AS (SELECT chunk_id, doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'failed_retryable' ELSE 'reindexed' END AS status, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM stale),
now AS (SELECT CASE WHEN a.status = 'reindexed' THEN 'embedded' WHEN a.status IS NOT NULL THEN 'failed' ELSE embedding_status END AS state, CASE WHEN a.status = 'failed_retryable' THEN 'provider refused' END AS error, CASE WHEN a.status = 'reindexed' THEN 'next' ELSE config_hash END AS config FROM emb LEFT JOIN batches USING (batch_id) LEFT JOIN after a USING (chunk_id))"""


ALL_FILES = 1_000_000  # more than arrive between two starts of the stream


def streamed_ingestion(spark, sf_dir):
    """The sources that a stream of four arrivals keeps, with the number of their chunks and postings; each holds the ids of a remainder of three, and the last one repeats the first."""
    arriving, folder = fresh_folder(spark, "arriving"), fresh_folder(spark, "ingested")
    docs = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    checkpoint = fresh_folder(spark, "checkpoint")
    for part in (0, 1, 2, 0):  # what has arrived since the last start is one micro-batch, in as many files as tasks wrote
        docs.filter(F.col("doc_id") % 3 == part).write.mode("append").parquet(arriving)
        ingestion.stream(spark, arriving, folder, checkpoint, ALL_FILES).awaitTermination()
    tables = ingestion.Tables(spark, folder)
    n = tables.chunks().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    words = tables.postings().groupBy("chunk_id").agg(F.sum(F.size("positions").cast("long")).alias("n_words"))  # added up where they lie
    terms = words.join(tables.chunks().select("chunk_id", "doc_id"), "chunk_id").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))
    return tables.sources().select("doc_id", "content_hash").join(n, "doc_id").join(terms, "doc_id", "left").select("doc_id", "content_hash", "n_chunks", F.coalesce("n_words", F.lit(0)).alias("n_words"))


_STREAMED = f"""{CHUNKS}, first AS (SELECT doc_id, content_text FROM (SELECT *, row_number() OVER (PARTITION BY content_text ORDER BY doc_id % 3, doc_id) AS r FROM src) WHERE r = 1 AND content_text <> '')"""


def restore_checks(spark, sf_dir):
    """What the checks find after a restore of the knowledge tables in which a source is lost, the texts of chunks are changed, and the links come back in another order."""
    tables = {"sources": model.sources(spark, sf_dir), "chunks": model.chunks(spark, sf_dir), "categories": model.source_categories(spark, sf_dir), "projects": model.source_projects(spark, sf_dir)}
    folder = fresh_folder(spark, "snapshot")
    manifest = snapshots.snapshot(spark, tables, folder)
    back = snapshots.restored(spark, folder)
    back["sources"] = back["sources"].filter("doc_id <> 1")
    back["chunks"] = back["chunks"].withColumn("content", F.when(F.col("doc_id") == 2, F.upper("content")).otherwise(F.col("content")))
    back["categories"] = back["categories"].repartition(3, "category")
    return snapshots.checks(manifest, back)


LIFECYCLES = {
    "restore_checks": (restore_checks, _with(f"{CHUNKS}, {CATS}, {PROJ}", """SELECT 'sources' AS "table", count(*) AS expected, count(*) FILTER (WHERE doc_id <> 1) AS found, CASE WHEN count(*) FILTER (WHERE doc_id = 1) > 0 THEN 'rows_differ' ELSE 'ok' END AS status FROM src
UNION ALL SELECT 'chunks', count(*), count(*), CASE WHEN count(*) FILTER (WHERE doc_id = 2 AND upper(content) <> content) > 0 THEN 'content_differs' ELSE 'ok' END FROM chunks UNION ALL SELECT 'categories', count(*), count(*), 'ok' FROM cats UNION ALL SELECT 'projects', count(*), count(*), 'ok' FROM proj""")),
    "streamed_ingestion": (streamed_ingestion, _with(_STREAMED, "SELECT f.doc_id, sha256(content_text) AS content_hash, count(*) AS n_chunks, CAST(sum(len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'))) AS BIGINT) AS n_words FROM first f JOIN chunks USING (doc_id) GROUP BY ALL")),
    "mutation_batch": (mutation_batch, _with(_FOLD, "SELECT request_id, op, out_id AS id, status FROM fold JOIN req USING (i)")),
    "mutated_catalog": (mutated_catalog, _with(_FOLD, "SELECT e.value AS id, e.key AS key FROM (SELECT unnest(map_entries(owner)) AS e FROM fold WHERE i = (SELECT max(i) FROM fold))")),
    "reindex_writeback": (reindex_writeback, _with(_WRITTEN, "SELECT 'item' AS what, status AS state, CAST(attempts AS BIGINT) AS attempts, CASE WHEN status = 'failed_retryable' THEN 'provider refused' END AS error, NULL::VARCHAR AS config, count(*) AS n FROM after GROUP BY ALL UNION ALL SELECT 'chunk', state, NULL, error, config, count(*) FROM now GROUP BY ALL")),
}
