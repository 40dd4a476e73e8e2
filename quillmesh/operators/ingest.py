"""Ingestion: uploads, their validation, duplicate guard, sections and locations of chunks, chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.functions.text import location  # noqa: F401
from quillmesh.operators import spans

#: What may be uploaded.
EXTENSIONS = (".txt", ".md", ".pdf")
MOST_BYTES = 100 * 1024 * 1024


def extension(name) -> Column:
    """The last suffix of a file name, lower-cased, with its dot."""
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]*)$", 1))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """filename, content (bytes) of the files at some paths; their contents are read by the tasks."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def validated(uploads: DataFrame) -> DataFrame:
    """uploads (filename, content: bytes) with content_text (normalized) and error, the first rule that is broken, or null."""
    kind = extension(F.col("filename"))
    decoded = F.col("content").cast("string")
    value = F.when(F.is_valid_utf8(decoded), text.normalized(decoded))
    error = (
        F.when(~kind.isin(*EXTENSIONS), "unsupported_type")
        .when(F.octet_length("content") > MOST_BYTES, "too_large")
        .when(kind == ".pdf", "no_text_layer_reader")
        .when(~F.is_valid_utf8(decoded), "not_utf8")
        .when(F.coalesce(value, F.lit("")) == "", "empty")
    )
    return uploads.withColumns({"error": error, "content_text": value})


def file_sources(uploads: DataFrame) -> DataFrame:
    """Valid uploads as sources: title, source_type, uri, content_text, content_hash."""
    ok = validated(uploads).filter("error IS NULL")
    kind = F.when(extension(F.col("filename")) == ".md", "markdown").otherwise("text")
    return ok.select(F.col("filename").alias("title"), kind.alias("source_type"), F.concat(F.lit("upload:"), "filename").alias("uri"), "content_text", text.content_hash(F.col("content_text")).alias("content_hash"))


def already_ingested(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """requests (content_hash, excluded: an id that does not count, or null) with duplicate: whether a source has that content."""
    held = sources.groupBy("content_hash").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("least"))
    met = requests.join(held, "content_hash", "left")
    only_excluded = (F.col("n") == 1) & F.col("least").eqNullSafe(F.col("excluded"))
    return met.withColumn("duplicate", F.col("n").isNotNull() & ~only_excluded).drop("n", "least")


def with_sections(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, start_char, end_char) with section, the heading that most of a chunk is under, from documents (doc_id, content_text)."""
    return spans.best_span(chunks, spans.section_spans(documents), "section")


def with_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks with page, the one that most of a chunk is on, from pages (doc_id, page, text) that make the documents' texts."""
    return spans.best_span(chunks, spans.page_spans(pages), "page")


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """chunks (..., chunk_index, start_char, end_char, page, section, doc_id, title, note_type) with metadata_json, what a chunk row stores."""
    place = F.struct("chunk_index", "start_char", "end_char", "page", "section")
    meta = F.struct(F.col("doc_id").alias("source_id"), F.col("title").alias("source_title"), place.alias("location"), F.struct("note_type").alias("metadata"))
    return chunks.withColumn("metadata_json", F.to_json(meta))


def replaced_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk table after some sources' chunks are replaced: all of theirs go, the fresh ones come."""
    return chunks.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def zipped(contents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors by (doc_id, chunk_index); one without the other raises, as a bulk insert must not lose rows."""
    met = contents.join(vectors, ["doc_id", "chunk_index"], "full_outer")
    lacks = F.col("content").isNull() | F.col("embedding").isNull()
    return met.withColumn("embedding", F.when(lacks, F.raise_error(F.lit("a chunk and its vector do not match"))).otherwise(F.col("embedding")))
