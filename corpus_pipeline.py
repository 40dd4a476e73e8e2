"""The corpus pipeline, five stages over documents, each written and reread as the next one's input.

toxicity            drops documents whose score is one half or more
near_duplicates     keeps one document of each class of near copies
decontamination     cuts benchmark passages out of the texts
personal_data       redacts entities and the terms that disclose them
pieces              encodes the texts, and decodes them again

All stages but the last return the columns of their input, whatever else it has and however it is named; n_chars
follows a changed text. A null text is an empty one and stays null; a null doc_id is a document like any other; of
repeated rows and equal texts the second stage keeps one, of the least doc_id (null last); texts are taken whole,
however long; empty tables pass through all stages. Each stage's table is in the shared folder, so a lost executor costs
its own tasks; a run that is cut off starts anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import dartminhash, fmindex, personal, pieces, toxicity
from quillmesh.llm.common import small_batches, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain model does not reject."""
    small_batches(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the least doc_id."""
    small_batches(spark)
    return dartminhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark."""
    small_batches(spark)
    cut = fmindex.remove_leaks(docs, table(spark, sf_dir, "benchmark"))
    return cut.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data redacted."""
    small_batches(spark)
    return personal.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the text, their number, and whether they decode to it."""
    small_batches(spark)
    import public_tokenizers

    found = pieces.with_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", private),
    ("pieces", encoded),
]

#: Models, signatures and indexes are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; each one's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
