"""Streaming ingestion: arriving sources are normalized, told apart by content, cut into chunks and posted, each exactly once.

Every micro-batch writes its own partition of the tables ``sources``, ``chunks`` and ``postings``, and replaces it where the
micro-batch is run again, so a restart after any cut leaves the same tables. The stream's own state is in the checkpoint, which
belongs in the folder that the cluster shares. Of equal contents the source of the first micro-batch stays, and within one that of the least id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.functions import text
from quillmesh.operators import retrieval
from quillmesh.sources import knowledge
from quillmesh.sources.shared import written

ARRIVING = "doc_id long, text string"
SOURCES = "doc_id long, content_text string, content_hash string, batch long"
CHUNKS = "chunk_id long, doc_id long, chunk_index long, start_char long, end_char long, content string, batch long"
POSTINGS = "term string, chunk_id long, positions array<int>, batch long"


@dataclass(frozen=True)
class Tables:
    """The tables that a stream fills."""

    spark: SparkSession
    folder: str

    def read(self, name: str, schema: str) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def sources(self) -> DataFrame:
        return self.read("sources", SOURCES)

    def chunks(self) -> DataFrame:
        return self.read("chunks", CHUNKS)

    def postings(self) -> DataFrame:
        return self.read("postings", POSTINGS)

    def put(self, df: DataFrame, name: str, batch: int) -> None:
        """Replaces a micro-batch's partition."""
        df.drop("batch").write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")


def new_sources(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """arrived (doc_id, text) -> doc_id, content_text, content_hash of the contents that known (doc_id, content_hash) lacks, and of ids that it lacks; each content and each id once."""
    rows = arrived.select("doc_id", text.normalized(F.col("text")).alias("content_text")).filter("content_text <> ''")
    hashed = rows.withColumn("content_hash", text.content_hash(F.col("content_text")))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    kept = hashed.join(first, ["content_hash", "doc_id"], "left_semi").dropDuplicates(["content_hash"]).dropDuplicates(["doc_id"])
    return kept.join(known.select("content_hash"), "content_hash", "left_anti").join(known.select("doc_id"), "doc_id", "left_anti").select("doc_id", "content_text", "content_hash")


def ingest_batch(tables: Tables, arrived: DataFrame, batch: int) -> None:
    """One micro-batch: what earlier ones hold is not taken again; its own earlier attempt does not count."""
    known = tables.sources().filter(F.col("batch") != batch)
    fresh = written(new_sources(arrived, known), "arrived")
    cut = knowledge.chunked(fresh).select((F.col("doc_id") * knowledge.CHUNKS_A_SOURCE + F.col("chunk_index")).alias("chunk_id"), "*")
    cut = written(cut, "cut")
    tables.put(cut, "chunks", batch)
    tables.put(retrieval.posting_lists(cut), "postings", batch)
    tables.put(fresh, "sources", batch)  # last: what is in sources is whole


def stream(spark: SparkSession, arriving: str, folder: str, checkpoint: str, files_at_once: int = 1) -> StreamingQuery:
    """Ingests the Parquet files (doc_id, text) that are in a folder now, ``files_at_once`` in each micro-batch, and those of a restart later on."""
    tables = Tables(spark, folder)
    found = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_at_once).parquet(arriving)
    return found.writeStream.foreachBatch(lambda df, batch: ingest_batch(tables, df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
