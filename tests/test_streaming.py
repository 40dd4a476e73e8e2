"""Streaming ingestion: exactly once, whatever is repeated."""

from quillmesh.operators import retrieval
from quillmesh.sources import knowledge
from quillmesh.streaming import ingestion


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, ingestion.ARRIVING).coalesce(1).write.mode("append").parquet(folder)


def _state(tables):
    return (
        sorted((r.doc_id, r.content_text, r.content_hash) for r in tables.sources().collect()),
        sorted((r.chunk_id, r.content) for r in tables.chunks().collect()),
        sorted((r.term, r.chunk_id, tuple(r.positions)) for r in tables.postings().collect()),
    )


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    arriving, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    parts = [[(1, "One text. " * 300), (2, " same \n text"), (3, None)], [(4, "same\ntext"), (5, "five"), (6, "five ")], [(1, "another text of a known id"), (7, "seven seven")]]
    for rows in [parts[0], parts[1], parts[0]]:
        _arrive(spark, arriving, rows)
    ingestion.stream(spark, arriving, folder, checkpoint).awaitTermination()
    tables = ingestion.Tables(spark, folder)
    assert [r[0] for r in _state(tables)[0]] == [1, 2, 5]
    _arrive(spark, arriving, parts[2])
    ingestion.stream(spark, arriving, folder, checkpoint).awaitTermination()
    got = _state(tables)
    assert [r[0] for r in got[0]] == [1, 2, 5, 7] and got[0][3][1] == "seven seven"
    docs = tables.sources().select("doc_id", "content_text")
    cut = knowledge.chunked(docs).selectExpr(f"doc_id * {knowledge.CHUNKS_A_SOURCE} + chunk_index AS chunk_id", "content")
    assert got[1] == sorted((r.chunk_id, r.content) for r in cut.collect())
    assert got[2] == sorted((r.term, r.chunk_id, tuple(r.positions)) for r in retrieval.posting_lists(cut).collect())
    assert sorted(r.batch for r in tables.sources().select("batch").distinct().collect()) == [0, 1, 3]
    ingestion.ingest_batch(tables, spark.createDataFrame(parts[1], ingestion.ARRIVING), 1)  # as after a cut before the commit
    assert _state(tables) == got


def test_nothing_arrives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ingestion.stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert ingestion.Tables(spark, str(tmp_path / "out")).sources().isEmpty()
