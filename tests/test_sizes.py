"""What queries move and read, where that must not grow with what they do not need."""

import glob

from quillmesh.operators import batched, evaluation
from quillmesh.plans import lifecycles, searches
from quillmesh.sources import knowledge as model
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_searched_once(spark):
    found = searches.batched_hybrid(spark, SF)
    assert "Exchange" not in _plan(found) and found.count() > 0


def test_an_arrival_is_several_files(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 40}") for k in range(60)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(lifecycles, "fresh_folder", lambda _, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a file is a task
    try:
        got = {r.doc_id for r in lifecycles.streamed_ingestion(spark, f"{tmp_path}/in").collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {}
    for k in sorted(range(60), key=lambda k: (k % 3, k)):
        first.setdefault(k % 40, k)
    assert got == set(first.values())
    assert len(glob.glob(f"{tmp_path}/arriving/*.parquet")) == 12


def test_snippets_of_any_length(spark):
    chunks = spark.createDataFrame([(1, "a b c d e f g h"), (2, "b c"), (3, None), (4, "")], "chunk_id long, content string")
    snippets = spark.createDataFrame([(1, "b c d e f g h".split()), (2, ["c"]), (3, []), (4, "b c".split()), (None, ["b"]), (5, "a b c d e f h".split())], "item_id long, t array<string>")
    got = sorted(map(repr, map(tuple, evaluation.holding(chunks, snippets).collect())))
    assert got == sorted(map(repr, [(1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (None, 1), (None, 2)]))
    long = spark.createDataFrame([(1, "b c d e f g h".split())], "item_id long, t array<string>")
    assert [tuple(r) for r in evaluation.holding(chunks, long).collect()] == [(1, 1)]


def test_two_rarest_terms_leave_all_matches(spark):
    """Queries whose terms are one, two, repeated or absent."""
    texts = {1: "a b c", 2: "a b", 3: "c a", 4: "b", 5: "c b a a"}
    postings = spark.createDataFrame([(t, k, [i for i, w in enumerate(s.split()) if w == t]) for k, s in texts.items() for t in set(s.split())], "term string, chunk_id long, positions array<int>")
    chunks = spark.createDataFrame([(k, k) for k in texts], "chunk_id long, doc_id long")
    asked = [(1, ["a", "b", "c"]), (2, ["a", "a"]), (3, ["b", "c"]), (4, ["a", "zz", "b"]), (5, [])]
    queries = spark.createDataFrame([(q, t, "") for q, t in asked], "query long, terms array<string>, filter string")
    passed = spark.createDataFrame([], "filter string, doc_id long")
    got = {(r.query, r.chunk_id) for r in batched.text_candidates(postings, chunks, queries, passed).collect()}
    assert got == {(q, k) for q, t in asked for k, s in texts.items() if t and set(t) <= set(s.split())}
