"""Batched hybrid search against the single search of each query."""

from pyspark.sql import functions as F

from quillmesh.operators import batched, retrieval
from quillmesh.plans import searches
from quillmesh.sources import knowledge as model
from tests.conftest import SF


def test_batch_equals_single_searches(spark):
    usable, chunks, postings, bridge = searches.usable_chunks(spark, SF).cache(), model.chunks(spark, SF), model.postings(spark, SF), searches.bridge(spark, SF)
    vectors = [list(map(float, r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(3).collect()]
    category, project = {"kind": "category", "values": ["en", "curated"]}, {"kind": "project", "values": ["0", "1", "4"]}
    rows = [
        (1, ["the", "that"], vectors[0], 10, 0.35, None),
        (2, ["that", "the", "the"], vectors[1], 3, 0.1, [category]),
        (3, ["the"], vectors[2], 7, 0.0, [project, category]),
        (4, ["nosuchword", "the"], vectors[0], 5, 0.2, [category, project]),
        (5, [], vectors[1], 5, 0.2, [{"kind": "category", "values": []}]),
        (6, ["the"], None, 5, 0.2, [{"kind": "project", "values": None}]),
        (7, ["the", "of"], [0.0] * 64, 4, 0.2, []),
    ]
    kind = f"query long, terms array<string>, embedding array<double>, limit int, min_score double, filters {batched.FILTERS}"
    got = {}
    for r in batched.hybrid(spark.createDataFrame(rows, kind), usable, chunks, postings, bridge).collect():
        got.setdefault(r["query"], []).append((r.place, r.chunk_id, r.rrf, r.score, r.text_rank, r.reasons))
    for query, terms, vector, limit, least, filters in rows:
        mine, held = usable, chunks
        for f in filters or []:
            if f["values"] is not None:
                ok = bridge.filter((F.col("kind") == f["kind"]) & F.col("value").isin(f["values"])).select("doc_id").distinct()
                mine, held = mine.join(ok, "doc_id", "left_semi"), held.join(ok, "doc_id", "left_semi")
        k = retrieval.candidate_limit(limit)
        near = retrieval.nearest(mine, vector, k) if vector and any(vector) else spark.createDataFrame([], "chunk_id long, score double")
        want = retrieval.fused(near, retrieval.text_top(held, sorted(set(terms)), k), limit, least)
        assert sorted(got.get(query, [])) == sorted((r.place, r.chunk_id, r.rrf, r.score, r.text_rank, r.reasons) for r in want.collect()), query


def test_filters_share_a_name(spark):
    rows = [(1, [{"kind": "b", "values": ["2", "1", "2"]}, {"kind": "a", "values": ["x"]}]), (2, [{"kind": "a", "values": ["x"]}, {"kind": "b", "values": ["1", "2"]}]), (3, [{"kind": "a", "values": None}]), (4, None)]
    got = {r["query"]: r["filter"] for r in batched.with_filter_name(spark.createDataFrame(rows, f"query long, filters {batched.FILTERS}")).collect()}
    assert got[1] == got[2] != "" and got[3] == got[4] == ""
