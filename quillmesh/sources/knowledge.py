"""The knowledge model over the driver's tables: sources, catalog, chunks, embeddings, batches.

Ids are computed from a row's own keys, so no step numbers rows globally.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import retrieval
from quillmesh.sources.shared import fingerprint, fresh_folder

SIZE, OVERLAP = 1000, 150
CHUNKS_A_SOURCE = 1_000_000  # above the number of chunks of any source
ACTIVE = "active"  # config hash of the active embedding configuration
#: Where a chunk may end, the best first.
BREAKS = ("\n\n", "\n", ". ", "; ", ", ", " ")

_SPACE = re.compile(r"\s*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source table: doc_id, title, uri, lang, tag, content_text, content_hash, created_at; texts are normalized and hashed once."""
    return stored(spark, sf_dir, "sources", lambda *a: normalized_sources(*a).withColumn("content_hash", text.content_hash(F.col("content_text"))))


def normalized_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, uri, lang, tag, content_text, created_at (minutes after 2024-01-01), from the documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("text:doc-"), F.col("doc_id").cast("string")).alias("uri"),
        "lang",
        F.col("source").alias("tag"),
        text.normalized(F.col("text")).alias("content_text"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
    )


def source_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, category: the language, and what the labels say."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.select("doc_id", F.explode(F.filter(F.array(F.when(F.col("quality") == 1, F.lit("curated")), F.when(F.col("toxic") == 1, F.lit("sensitive"))), lambda x: x.isNotNull())).alias("category"))
    return docs.select("doc_id", F.col("lang").alias("category")).unionByName(marks.join(docs.select("doc_id"), "doc_id", "left_semi")).distinct()


def source_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, project_id: every third source has a project; number 4 is archived."""
    return table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 5).alias("project_id"))


def projects(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.col("id").alias("project_id"), F.concat(F.lit("project-"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 4, "archived").otherwise("active").alias("status"))


def spans(value: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Trimmed ranges of a text that overlap and end at the best break of their later half."""
    if size <= overlap:
        raise ValueError("the size must be greater than the overlap")
    at = 0
    while at < len(value):
        stop, end = at + size, len(value)
        if stop < end:
            half = at + max(size // 2, 1)
            places = ((value.rfind(b, half, stop), len(b)) for b in BREAKS)
            end = next((k + n for k, n in places if k >= 0), stop)
        low, high = _SPACE.match(value, at, end).end(), end
        while high > low and value[high - 1].isspace():
            high -= 1
        if low < high:
            yield low, high
        if end == len(value):
            return
        at = _SPACE.match(value, max(end - overlap, at + 1)).end()


def chunked(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_id, content_text) -> doc_id, chunk_index, start_char, end_char, content; a document at a time, no shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = []
                for ident, value in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns), strict=True):
                    rows += [(ident, k, a, b, value[a:b]) for k, (a, b) in enumerate(spans(value or "", size, overlap))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=["doc_id", "chunk_index", "start_char", "end_char", "content"])

    return docs.select("doc_id", "content_text").mapInArrow(cut, "doc_id long, chunk_index long, start_char long, end_char long, content string")


_STORED: dict[tuple[str, str, str, int], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table that ingestion makes once for a session and searches read: in the shared folder, written at its first use, and anew where a table of ``sf_dir`` has changed."""
    key = (spark.sparkContext.applicationId, sf_dir, name, fingerprint(spark, sf_dir))
    if key not in _STORED:
        path = fresh_folder(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table: the chunks of all sources with chunk_id."""
    return stored(spark, sf_dir, "chunks", _cut)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting lists of the chunk table, of some chunks after the other by term, so a search skips what it does not ask for and a common term is in many files."""
    return stored(spark, sf_dir, "postings", lambda *a: retrieval.posting_lists(chunks(*a)))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(sources(spark, sf_dir)).select((F.col("doc_id") * CHUNKS_A_SOURCE + F.col("chunk_index")).alias("chunk_id"), "*")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks with embedding, embedding_status, batch_id: some are pending, failed or without a batch."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding", F.col("label").cast("long").alias("batch_id"))
    n = vectors.count()  # from the file's footers
    place = F.col("doc_id") + F.col("chunk_index")
    found = chunks(spark, sf_dir).withColumn("vec_id", (F.col("doc_id") * 7 + F.col("chunk_index")) % max(n, 1)).join(vectors, "vec_id", "left").drop("vec_id")
    status = F.when(F.col("doc_id") % 19 == 0, "failed").when((F.col("doc_id") % 17 == 0) | (place % 11 == 0), "pending").otherwise("embedded")
    return found.withColumns({"embedding": F.when(place % 11 != 0, F.col("embedding")), "batch_id": F.when(place % 13 != 0, F.col("batch_id")), "embedding_status": status})


def batches(spark: SparkSession) -> DataFrame:
    """batch_id, config_hash, batch_status: 8 is of an old configuration, 9 not completed."""
    return spark.range(10).select(F.col("id").alias("batch_id"), F.when(F.col("id") == 8, "old").otherwise(ACTIVE).alias("config_hash"), F.when(F.col("id") == 9, "running").otherwise("completed").alias("batch_status"))
