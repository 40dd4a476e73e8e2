"""Embedding versions and reindexing."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import redacted_error


def config_hash(provider: str, model: str, dimension: int, version: str | None) -> str:
    """The identity of an embedding configuration."""
    named = {"provider": provider.strip().lower(), "model": model.strip(), "dimension": dimension, "version": (version or "").strip() or "default"}
    return hashlib.sha256(json.dumps(named, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def reindex_candidates(chunks: DataFrame, batches: DataFrame, active: str) -> DataFrame:
    """chunk_id, doc_id, reason of every chunk that needs a new embedding."""
    all_ = chunks.join(batches, "batch_id", "left")
    stale = F.col("embedding").isNull() | (F.col("embedding_status") != "embedded") | F.col("config_hash").isNull() | (F.col("config_hash") != active) | (F.col("batch_status") != "completed")
    reason = (
        F.when(F.col("config_hash").isNull(), F.when(F.col("embedding").isNull(), "missing_batch").otherwise("unversioned"))
        .when(F.col("embedding_status") == "failed", "failed")
        .when(F.coalesce("embedding_status", F.lit("pending")) != "embedded", F.coalesce("embedding_status", F.lit("pending")))
        .when(F.col("batch_status") != "completed", "batch_not_completed")
        .when(F.col("config_hash") != active, "config_changed")
        .otherwise("pending")
    )
    return all_.filter((F.col("content") != "") & F.coalesce(stale, F.lit(True))).select("chunk_id", "doc_id", reason.alias("reason"))


def backfilled(rows: DataFrame, defaults: dict) -> DataFrame:
    """rows whose nulls have the defaults {column: Column}, each from the row as it was; what is set stays."""
    return rows.withColumns({c: F.coalesce(F.col(c), default) for c, default in defaults.items()})


def status_of_vector(embedding: str = "embedding"):
    """The state of a chunk that was stored before states were."""
    return F.when(F.col(embedding).isNull(), "pending").otherwise("unversioned")


def first_by_hash(sources: DataFrame) -> DataFrame:
    """doc_id of the first source of each content hash: what a batch ingestion keeps."""
    return sources.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


def pending_chunks(chunks: DataFrame, batches: DataFrame, active: str) -> DataFrame:
    """Chunks that are not embedded, have no batch, or one of another configuration."""
    met = chunks.join(batches, "batch_id", "left")
    return met.filter(~F.col("embedding_status").eqNullSafe("embedded") | F.col("config_hash").isNull() | (F.col("config_hash") != active)).select("chunk_id", "doc_id")


def latest_batch(batches: DataFrame, active: str) -> DataFrame:
    """The completed batch of a configuration with the latest end, then id."""
    return batches.filter((F.col("config_hash") == active) & (F.col("batch_status") == "completed")).orderBy(F.col("completed_at").desc_nulls_last(), F.desc("batch_id")).limit(1)


def finish_batches(batches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Running batches after outcomes (batch_id, n_embedded, error): completed, or failed with the error; others stay."""
    met = batches.join(outcomes, "batch_id", "left")
    ends = (F.col("batch_status") == "running") & F.col("n_embedded").isNotNull()
    status = F.when(ends, F.when(F.col("error").isNull(), "completed").otherwise("failed")).otherwise(F.col("batch_status"))
    return met.select("batch_id", "config_hash", status.alias("batch_status"), F.when(ends, F.col("n_embedded")).alias("n_embedded"), F.when(ends, redacted_error(F.col("error"), 2000)).alias("error"))


def plan_items(candidates: DataFrame, dry_run: bool = False) -> DataFrame:
    """A reindex run's items (chunk_id, doc_id, reason, status, attempts, error): pending, or skipped in a dry run."""
    return candidates.select("chunk_id", "doc_id", "reason", F.lit("skipped" if dry_run else "pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))


RETRYABLE = ("pending", "failed_retryable")


def retryable(items: DataFrame, limit: int) -> DataFrame:
    """The next items of a run, or of a resumed one, in their order."""
    return items.filter(F.col("status").isin(*RETRYABLE)).orderBy("doc_id", "chunk_id").limit(limit)


def execute(items: DataFrame, chosen: DataFrame, chunks: DataFrame, batches: DataFrame, vectors: DataFrame, active: str) -> DataFrame:
    """The items after one execution of the chosen (chunk_id); the others are unchanged.

    An item is reused where its chunk has become compatible, reindexed where vectors (chunk_id, vector, error) has a
    vector for it, and else failed, to be tried again: with the vector's error, or as its chunk no longer exists.
    A row of ``chosen`` counts an attempt whatever comes of it.
    """
    usable = chunks.join(batches.filter((F.col("config_hash") == active) & (F.col("batch_status") == "completed")).select("batch_id"), "batch_id", "left_semi")
    usable = usable.filter("embedding IS NOT NULL AND embedding_status = 'embedded'").select("chunk_id", F.lit(True).alias("usable"))
    exists = chunks.select("chunk_id", F.lit(True).alias("exists"))
    new = vectors.select("chunk_id", F.col("vector").isNotNull().alias("embedded"), F.col("error").alias("new_error"))
    met = items.join(chosen.select("chunk_id", F.lit(True).alias("chosen")), "chunk_id", "left").join(exists, "chunk_id", "left").join(usable, "chunk_id", "left").join(new, "chunk_id", "left")
    done = F.when(F.col("exists").isNull(), "failed_retryable").when(F.col("usable"), "reused").when(F.col("embedded"), "reindexed").otherwise("failed_retryable")
    message = F.when(F.col("exists").isNull(), "Chunk no longer exists.").when(done == "failed_retryable", redacted_error(F.coalesce("new_error", F.lit("no vector"))))
    return met.select("chunk_id", "doc_id", "reason", F.when(F.col("chosen"), done).otherwise(F.col("status")).alias("status"), (F.col("attempts") + F.coalesce("chosen", F.lit(False)).cast("int")).alias("attempts"), F.when(F.col("chosen"), message).otherwise(F.col("error")).alias("error"))


def run_counters(items: DataFrame) -> DataFrame:
    """One row: reindexed, reused, failed, left, and the run's status."""
    n = lambda s: F.count_if(F.col("status") == s)
    got = items.agg(n("reindexed").alias("chunks_reindexed"), n("reused").alias("chunks_reused"), n("failed_retryable").alias("chunks_failed"), n("pending").alias("chunks_left"))
    return got.withColumn("status", F.when(F.col("chunks_failed") > 0, "failed").when(F.col("chunks_left") > 0, "running").otherwise("completed"))
