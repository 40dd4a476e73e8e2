"""Reindex write-back: the same tables after any cut."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import reindex_store as rs

CHUNKS = "chunk_id long, doc_id long, content string, embedding array<float>, embedding_status string, config_hash string"


def _store(spark, folder, size=8):
    rows = [(k, k // 4, f"text {k}", [1.0] if k % 3 else None, "embedded" if k % 3 else "pending", "new" if k % 5 == 0 and k % 3 else "old") for k in range(24)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    items = chunks.select("chunk_id", "doc_id", F.lit("config_changed").alias("reason")).unionByName(spark.createDataFrame([(99, 50, "gone")], "chunk_id long, doc_id long, reason string"))
    return rs.create(spark, str(folder), chunks, items, size)


def _embed(fails):
    def embed(chunks):
        bad = F.col("chunk_id").isin(fails)
        return chunks.select("chunk_id", F.when(~bad, F.array(F.lit(7.0), F.col("chunk_id").cast("double"))).alias("vector"), F.when(bad, F.lit("refused: token=abc")).alias("error"))

    return embed


def _state(store):
    items = sorted((r.chunk_id, r.status, r.attempts, r.error) for r in store.items().collect())
    chunks = sorted((r.chunk_id, tuple(r.embedding or ()), r.embedding_status, r.config_hash, r.error) for r in store.chunks().collect())
    batches = sorted((r.batch, r.status, r.n_chunks, r.n_embedded) for r in store.batches().collect())
    return items, chunks, batches


def test_outcomes(spark, tmp_path):
    store = _store(spark, tmp_path / "a", 1000)
    rs.run(store, _embed([4, 8]), "new")
    items, chunks, batches = _state(store)
    by = {k: (s, n, e) for k, s, n, e in items}
    assert by[4] == ("failed_retryable", 1, "[redacted]") and by[99] == ("failed_retryable", 1, "Chunk no longer exists.")
    assert {k for k, v in by.items() if v[0] == "reused"} == {5, 10, 20} and by[1] == ("reindexed", 1, None)
    assert dict((k, v) for k, v, *_ in chunks)[1] == (7.0, 1.0) and (4, (1.0,), "failed", "old", "[redacted]") in chunks
    assert batches[-1] == (1, "completed", 25, 19)
    assert tuple(rs.counters(store, 1).first()) == (19, 3, 3, 0, "failed")
    rs.run(store, _embed([8]), "new")
    by = {k: (s, n) for k, s, n, _ in _state(store)[0]}
    assert by[4] == ("reindexed", 2) and by[8] == ("failed_retryable", 2) and by[1] == ("reindexed", 1)
    before = _state(store)[1]
    rs.compact(store)
    assert _state(store)[1] == before and store.versions().count() == 24


@pytest.mark.parametrize("cut", ["processing", "chunks", "items"])
def test_resumed_runs_end_in_the_same_tables(spark, tmp_path, cut):
    whole, broken = _store(spark, tmp_path / "a"), _store(spark, tmp_path / "b")
    rs.run(whole, _embed([4, 8]), "new")
    part = rs.slices(broken)[0]
    with pytest.raises(rs.Cut):
        rs.execute(broken, part, _embed([4, 8]), "new", cut=cut)
    left = {r.status for r in broken.items().filter(F.col("slice") == part).collect()}
    assert ("processing" in left) == (cut != "items")
    asked = []

    def embed(chunks):
        asked.append({r.chunk_id for r in chunks.collect()})
        return _embed([4, 8])(chunks)

    rs.run(broken, embed, "new")
    assert _state(broken) == _state(whole)
    if cut == "chunks":  # only what has failed is embedded again
        assert asked[0] <= {4, 8}


def _bytes(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


@pytest.mark.parametrize("few", [1, 8])
def test_texts_are_written_once(spark, tmp_path, monkeypatch, few):
    size = 20
    monkeypatch.setattr(rs, "FILES", few)  # two slices are dealt out, or written where they lie
    content = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.sha2(F.concat_ws(":", "id", i), 256)))
    chunks = spark.range(40).select(F.col("id").alias("chunk_id"), (F.col("id") / 4).cast("long").alias("doc_id"), content.alias("content"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("embedded").alias("embedding_status"), F.lit("old").alias("config_hash"))
    items = chunks.select("chunk_id", "doc_id", F.lit("config_changed").alias("reason"))
    store = rs.create(spark, str(tmp_path / "a"), chunks, items, size)
    before = _bytes(tmp_path / "a")
    rs.run(store, _embed([8]), "new")
    rs.run(store, _embed([8]), "new")
    texts = {r.chunk_id: r.content for r in chunks.collect()}
    got = {r.chunk_id: r for r in store.chunks().collect()}
    assert {k: r.content for k, r in got.items()} == texts and tuple(got[8].embedding) == (1.0,) and got[8].config_hash == "old"
    assert _bytes(tmp_path / "a") < before + sum(map(len, texts.values())) / 4  # before, every run wrote them again
    apart = rs.create(spark, str(tmp_path / "b"), chunks.drop("content"), items, size, chunks.select("chunk_id", "doc_id", "content"))
    assert {r.chunk_id: (r.content, r.batch) for r in apart.chunks().collect()} == {k: (v, 0) for k, v in texts.items()}
