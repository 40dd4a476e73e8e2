"""Postings after changes, against an index that is built anew."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from quillmesh.operators import posting_store, retrieval
from quillmesh.operators.posting_store import PostingStore

WORDS = "the that of a new old page note É 12".split()


def _chunks(spark, sources):
    rows = [(d * 100 + k, d, text) for d, texts in sources.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, content string")


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id long")


def _rows(df):
    return sorted((r["term"], r["chunk_id"], tuple(r["positions"])) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_changes_equal_a_rebuild(spark, tmp_path, seed):
    rng, store, held = random.Random(seed), PostingStore(spark, str(tmp_path / "store")), {}
    for turn in range(7):
        ids = range(30) if not turn else rng.sample(range(40), 4)
        fresh = {d: [" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(rng.randrange(3))] for d in ids}
        store.put(_chunks(spark, fresh), _ids(spark, [*ids, *list(ids)[:1]]))
        held |= fresh
    whole = retrieval.posting_lists(_chunks(spark, held))
    assert _rows(store.postings()) == _rows(whole)
    for query in (["the"], ["that", "the"], ["new", "é", "12"], ["absent"], []):
        assert store.search(query, 5).collect() == retrieval.posted_top(whole, query, 5).collect()
    assert len(store.state()[1]) < 7  # some are merged
    store.vacuum()
    assert _rows(store.postings()) == _rows(whole)
    assert len(glob.glob(f"{tmp_path}/store/postings/*")) == len(store.state()[1])


def test_a_cut_change_leaves_the_table(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "store"))
    store.put(_chunks(spark, {1: ["one two"], 2: ["two"]}), _ids(spark, [1, 2]))
    before = _rows(store.postings())
    with pytest.raises(posting_store.Cut):
        store.put(_chunks(spark, {1: ["three"]}), _ids(spark, [1]), cut=True)
    assert _rows(store.postings()) == before
    store.put(_chunks(spark, {1: ["four"]}), _ids(spark, [1]))
    assert _rows(store.postings()) == [("four", 100, (0,)), ("two", 200, (0,))]


def test_deletes_nulls_and_empty_changes(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "store"))
    assert store.postings().count() == 0 and store.search(["a"], 3).count() == 0
    none = spark.createDataFrame([(7, None, "null source"), (8, 5, None), (9, 5, "")], "chunk_id long, doc_id long, content string")
    store.put(none, _ids(spark, [None, 5]))
    assert _rows(store.postings()) == [("null", 7, (0,)), ("source", 7, (1,))]
    store.put(none.limit(0), _ids(spark, []))
    assert store.postings().count() == 2
    store.put(none.limit(0), _ids(spark, [None]))
    assert store.postings().count() == 0


def test_a_deleted_source_stays_away_after_merges(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "store"))
    store.put(_chunks(spark, {d: ["the " * 40 + f"w{d}x{k}" for k in range(20)] for d in range(20)}), _ids(spark, range(20)))
    store.put(_chunks(spark, {}), _ids(spark, [3]))
    for d in range(30, 34):
        store.put(_chunks(spark, {d: ["the"]}), _ids(spark, [d]))
    parts = store.state()[1]
    assert 1 < len(parts) <= posting_store.FANOUT  # the large part is not rewritten for small ones
    assert parts[0].name == 1
    assert not store.postings(["the"]).filter("doc_id = 3").count() and store.postings(["the"]).count() == 19 * 20 + 4


def test_a_common_term_is_in_many_files(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).selectExpr("id AS chunk_id", "id AS doc_id", "'the the the' AS content")
        store.put(rows, rows.select("doc_id"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/store/postings/1/*.parquet")]
    assert sum(sizes) == 4000 and max(sizes) < 2500
