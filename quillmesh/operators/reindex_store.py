"""Reindex runs that write back, as tables of a folder that resume after any cut.

``texts`` has what a run never changes, the text of each chunk and its hash, and is written once. ``chunks`` is partitioned by slice, batch and turn: a row is a
version of a chunk without its text, and the one of the latest batch and turn counts; a version that failed has no vector, and the last one there was stays. ``items`` is
partitioned by slice: what has come of each chunk that needs a vector. ``batches`` has the state of each execution. A chunk and its item are in the slice of
their source. Every write replaces whole partitions (dynamic partition overwrite, which moves files into place when all are written), so
one that is done again leaves the same table, and what it reads may lie in the partitions that it replaces.

An execution of a slice reads that slice alone: its items become ``processing`` with the execution's batch; the new versions of its chunks are written to
that batch's partition; the items get their outcome; the batch is completed. A slice that was cut off has items in processing: resuming it
goes on with the same batch in its next turn, and a chunk that the batch has already embedded is not embedded again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import redacted_error
from quillmesh.operators.lifecycle import RETRYABLE
from quillmesh.sources.shared import written

TEXT = "chunk_id long, doc_id long, content string, content_hash string, slice long"
VERSION = "chunk_id long, doc_id long, embedding array<float>, embedding_status string, config_hash string, error string, slice long, batch long, turn int"
ITEM = "chunk_id long, doc_id long, reason string, status string, attempts int, error string, item_batch long, slice long"
BATCH = "config_hash string, status string, n_chunks long, n_embedded long, batch long"
OPEN = (*RETRYABLE, "processing")
FIRST_BATCH = 0  # of the chunks as they were
FILES, FILE_ROWS = 8, 100_000  # files of a partition, or more where they would have more rows


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _put(self, df: DataFrame, name: str, schema: str, by: tuple[str, ...], rows: int = 0, dealt: bool = True) -> None:
        """Replaces the partitions of ``by`` that df has rows of, each of about ``rows``; where they are not ``dealt``, every task writes a file for each."""
        columns = _names(schema)
        held = df.select(*columns)
        if dealt:
            held = held.repartition(*by, F.pmod(F.xxhash64(columns[0]), F.lit(max(FILES, -(-rows // FILE_ROWS)))))
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def texts(self) -> DataFrame:
        return self._read("texts", TEXT)

    def versions(self) -> DataFrame:
        return self._read("chunks", VERSION)

    def items(self) -> DataFrame:
        return self._read("items", ITEM)

    def batches(self) -> DataFrame:
        return self._read("batches", BATCH)

    def states(self) -> DataFrame:
        """Each chunk as its latest version has it, with its last vector and without its text."""
        names = [c for c in _names(VERSION) if c not in ("chunk_id", "embedding")]
        when = F.struct("batch", "turn")
        last = self.versions().groupBy("chunk_id").agg(F.max_by(F.struct(*names), when).alias("v"), F.max_by("embedding", F.when(F.col("embedding").isNotNull(), when)).alias("embedding"))
        return last.select("chunk_id", "v.*", "embedding")

    def chunks(self) -> DataFrame:
        """Each chunk as its latest version has it."""
        met = self.states().join(self.texts().select("chunk_id", "content", "content_hash"), "chunk_id")
        return met.select("chunk_id", "doc_id", "content", "embedding", "embedding_status", "content_hash", "config_hash", "error", "batch")


def create(spark: SparkSession, folder: str, chunks: DataFrame, items: DataFrame, size: int, texts: DataFrame | None = None) -> Store:
    """A store of chunks (chunk_id, doc_id, content, embedding, embedding_status, config_hash) and items (chunk_id, doc_id, reason) in slices of about ``size``, by hash of the source, so that a source is in one slice.

    ``texts`` (chunk_id, doc_id, content), where the contents of the same chunks are at hand without a join; then those of ``chunks`` are not read.
    """
    store = Store(spark, folder)
    none = F.lit(None).cast("string")
    slices = max(1, -(-items.count() // size))
    own = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slices)).alias("slice")
    texts = chunks if texts is None else texts
    rows, dealt = texts.count() // slices, slices > FILES  # few slices are written where the rows lie
    store._put(texts.select("chunk_id", "doc_id", "content", F.sha2("content", 256).alias("content_hash"), own), "texts", TEXT, ("slice",), rows, dealt)
    old = chunks.select("chunk_id", "doc_id", F.col("embedding").cast("array<float>").alias("embedding"), "embedding_status", "config_hash", none.alias("error"), own, F.lit(FIRST_BATCH).cast("long").alias("batch"), F.lit(0).alias("turn"))
    store._put(old, "chunks", VERSION, ("slice", "batch", "turn"), rows, dealt)
    begun = items.select("chunk_id", "doc_id", "reason", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), none.alias("error"), F.lit(None).cast("long").alias("item_batch"), own)
    store._put(begun, "items", ITEM, ("slice",), size)
    store._put(spark.createDataFrame([("", "completed", None, None, FIRST_BATCH)], BATCH), "batches", BATCH, ("batch",))
    return store


def _latest(store: Store, part: int, active: str) -> DataFrame:
    """chunk_id, doc_id, state, config_hash, error, batch of the latest version of a slice's chunks, and whether it has a vector of the active configuration; vectors stay where they are."""
    fits = F.col("embedding").isNotNull() & (F.col("embedding_status") == "embedded") & F.col("config_hash").eqNullSafe(F.lit(active))
    kept = F.struct("doc_id", F.col("embedding_status").alias("state"), "config_hash", "error", "batch", "fits")
    rows = store.versions().filter(F.col("slice") == part).withColumn("fits", F.coalesce(fits, F.lit(False)))
    return rows.groupBy("chunk_id").agg(F.max_by(kept, F.struct("batch", "turn")).alias("v")).select("chunk_id", "v.*")


def slices(store: Store) -> list[int]:
    """The slices with items that are open; one row for each slice comes to the driver."""
    return [r.slice for r in store.items().filter(F.col("status").isin(*OPEN)).select("slice").distinct().orderBy("slice").collect()]


class Cut(Exception):
    """Ends an execution where a test asks for it."""


def execute(store: Store, part: int, embed: Callable[[DataFrame], DataFrame], active: str, cut: str | None = None) -> int:
    """Executes a slice, or resumes it -> its batch. embed: chunks (chunk_id, doc_id, content) -> chunk_id, vector, error.

    ``cut`` ends the execution after "processing", "chunks" or "items" were written, as a lost driver would.
    """
    spark = store.spark
    items = store.items().filter(F.col("slice") == part)
    going, rows = items.agg(F.max(F.when(F.col("status") == "processing", F.col("item_batch"))), F.count(F.lit(1))).first()
    turn = 0
    if going is None:
        batch = store.batches().agg(F.max("batch")).first()[0] + 1
        begun = items.withColumns({"item_batch": F.when(F.col("status").isin(*RETRYABLE), F.lit(batch)).otherwise(F.col("item_batch")), "attempts": F.col("attempts") + F.col("status").isin(*RETRYABLE).cast("int"), "status": F.when(F.col("status").isin(*RETRYABLE), "processing").otherwise(F.col("status"))})
        n = items.filter(F.col("status").isin(*RETRYABLE)).count()
        store._put(spark.createDataFrame([(active, "running", n, None, batch)], BATCH), "batches", BATCH, ("batch",))
        store._put(begun, "items", ITEM, ("slice",), rows)
        if cut == "processing":
            raise Cut
    else:
        batch = going
        past = store.versions().filter((F.col("slice") == part) & (F.col("batch") == batch)).agg(F.max("turn")).first()[0]  # of an execution that was cut off
        turn = 0 if past is None else past + 1
    mine = store.items().filter((F.col("slice") == part) & (F.col("status") == "processing")).select("chunk_id")
    usable = store.batches().filter((F.col("config_hash") == active) & (F.col("status") == "completed") | F.col("batch").isin(FIRST_BATCH, batch)).select("batch", F.lit(True).alias("usable"))
    now = _latest(store, part, active).join(mine, "chunk_id", "left_semi").join(F.broadcast(usable), "batch", "left")  # a row for each execution
    todo = written(now.filter(~(F.col("fits") & F.col("usable").isNotNull())).select("chunk_id", "doc_id", "config_hash"), "todo")
    texts = store.texts().filter(F.col("slice") == part).select("chunk_id", "doc_id", "content").join(todo.select("chunk_id"), "chunk_id", "left_semi")
    made = embed(texts).select("chunk_id", "vector", redacted_error(F.coalesce("error", F.when(F.col("vector").isNull(), "no vector"))).alias("error"))
    got = F.col("vector").isNotNull()
    fresh = todo.join(made, "chunk_id", "left").select(
        "chunk_id", "doc_id", F.col("vector").cast("array<float>").alias("embedding"), F.when(got, "embedded").otherwise("failed").alias("embedding_status"), F.when(got, F.lit(active)).otherwise(F.col("config_hash")).alias("config_hash"),
        F.when(~got, F.coalesce("error", F.lit("no vector"))).alias("error"), F.lit(part).cast("long").alias("slice"), F.lit(batch).cast("long").alias("batch"), F.lit(turn).alias("turn"),
    )
    store._put(fresh, "chunks", VERSION, ("slice", "batch", "turn"), rows)
    if cut == "chunks":
        raise Cut
    after = store.items().filter(F.col("slice") == part)
    met = after.join(_latest(store, part, active).select("chunk_id", "state", F.col("error").alias("new_error"), "batch"), "chunk_id", "left")
    busy = F.col("status") == "processing"
    failed = (F.col("batch") == batch) & (F.col("state") == "failed")
    status = F.when(F.col("batch").isNull() | failed, "failed_retryable").when(F.col("batch") != batch, "reused").otherwise("reindexed")
    error = F.when(F.col("batch").isNull(), "Chunk no longer exists.").when(failed, F.col("new_error"))
    store._put(met.withColumns({"error": F.when(busy, error).otherwise(F.col("error")), "status": F.when(busy, status).otherwise(F.col("status"))}), "items", ITEM, ("slice",), rows)
    if cut == "items":
        raise Cut
    finish(store, batch, active)
    return batch


def finish(store: Store, batch: int, active: str) -> None:
    """The batch is completed with the number of its vectors."""
    n = store.versions().filter(F.col("batch") == batch).groupBy("chunk_id").agg(F.max_by("embedding_status", "turn").alias("state")).filter("state = 'embedded'").count()
    asked = store.batches().filter(F.col("batch") == batch).first().n_chunks
    store._put(store.spark.createDataFrame([(active, "completed", asked, n, batch)], BATCH), "batches", BATCH, ("batch",))


def open_batches(store: Store) -> list[int]:
    """Batches whose items have all got their outcome, but which were cut off before they were completed."""
    busy = store.items().filter("status = 'processing'").select(F.col("item_batch").alias("batch")).distinct()
    return [r.batch for r in store.batches().filter("status = 'running'").join(busy, "batch", "left_anti").select("batch").collect()]


def run(store: Store, embed: Callable[[DataFrame], DataFrame], active: str) -> None:
    """Executes every open slice once, the ones that were cut off first in their own batch, and completes what was left open."""
    for batch in open_batches(store):
        finish(store, batch, active)
    for part in slices(store):
        execute(store, part, embed, active)


def counters(store: Store, batch: int) -> DataFrame:
    """One execution: chunks reindexed, reused, failed, and its status."""
    n = lambda s: F.count_if(F.col("status") == s)
    got = store.items().filter(F.col("item_batch") == batch).agg(n("reindexed").alias("chunks_reindexed"), n("reused").alias("chunks_reused"), n("failed_retryable").alias("chunks_failed"), n("processing").alias("chunks_left"))
    return got.withColumn("status", F.when(F.col("chunks_left") > 0, "processing").when(F.col("chunks_failed") > 0, "failed").otherwise("completed"))


def reasons(store: Store) -> DataFrame:
    """reason, n_chunks, n_sources of all items."""
    return store.items().groupBy("reason").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_sources"))


def compact(store: Store) -> None:
    """Only the latest version of each chunk stays; older versions go from their batches' partitions."""
    kept = written(store.states(), "compacted")
    by = ("slice", "batch", "turn")
    kept.select(*_names(VERSION)).repartition(*by, F.pmod(F.xxhash64("chunk_id"), F.lit(FILES))).write.mode("overwrite").partitionBy(*by).parquet(f"{store.folder}/chunks")
