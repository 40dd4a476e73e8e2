"""Stated cases of an evaluation run."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import batched, evaluation, evaluation_run

CASE = f"case string, question string, embedding array<double>, embedding_error string, limit int, min_score double, filters {batched.FILTERS}, expected {evaluation_run.EXPECTED}, points array<string>, expected_refusal boolean"
CHUNKS = "chunk_id long, source_id string, source_title string, chunk_index long, page long, section string, content string"


def _cases(spark):
    want = dict(source_id=None, source_title=" RUNBOOK ", chunk_index=0, page=None, section=None, content_hash=None, snippet="knowledge-hnsw  Create")
    rows = [
        ("known", "how?", [1.0, 0.0], None, 5, 0.3, None, [want], ["knowledge-hnsw create"], None),
        ("missing", "private data", [0.0, 1.0], None, 5, 0.3, None, [], [], True),
        ("short", "x", [1.0], None, 5, 0.3, None, [want], ["a"], None),
        ("away", "x", None, "RuntimeError: embedding unavailable", 5, 0.3, None, [], [], True),
        ("nan", "x", [1.0, float("nan")], None, 5, 0.3, None, [], [], None),
        ("blank", " ", [1.0, 0.0], None, 5, 0.3, None, [], [], None),
        ("silent", "y", [1.0, 0.0], None, 5, 0.3, None, [want], ["a"], False),
    ]
    return spark.createDataFrame(rows, CASE)


def _search(cases):
    found = cases.filter("case <> 'missing'")
    return found.select("query", F.lit(7).cast("long").alias("chunk_id"), F.lit(2).alias("place"), F.lit(0.9).alias("score")).unionByName(found.select("query", F.lit(8).cast("long").alias("chunk_id"), F.lit(1).alias("place"), F.lit(0.95).alias("score")))


def _chunks(spark):
    return spark.createDataFrame([(7, "s1", "Runbook", 0, None, None, "use knowledge-hnsw create now"), (8, "s2", "Other", 0, None, None, "nothing")], CHUNKS)


def _answer(contexts):
    said = F.when(F.col("case") == "missing", "Nao encontrei essa informacao.").when(F.col("case") == "known", "According to Runbook, use KNOWLEDGE-HNSW create.")
    return contexts.select("case", said.alias("answer"), F.lit(None).cast("string").alias("answer_error"))


def test_a_run_goes_on_after_errors(spark):
    got = {r.case: r for r in evaluation_run.run(_cases(spark), _search, _chunks(spark), _answer, 2).collect()}
    assert len(got) == 7
    r = got["known"]
    assert (r.recall_at_k, r.reciprocal_rank, r.answer_correct, r.refusal_correct, r.citations_correct, r.supported, r.citations, r.errors) == (1.0, 0.5, True, None, True, True, ["s1"], [])
    r = got["missing"]
    assert (r.recall_at_k, r.answer_correct, r.refusal_correct, r.citations_correct, r.errors) == (None, None, True, None, [])
    assert {c: got[c].errors[0].split(":")[0] for c in ("short", "away", "nan", "blank", "silent")} == {"short": "ValueError", "away": "RuntimeError", "nan": "ValueError", "blank": "ValueError", "silent": "RuntimeError"}
    assert all(got[c].answer_correct is got[c].recall_at_k is got[c].refusal_correct is None for c in ("short", "away", "nan", "blank", "silent"))


def test_search_only(spark):
    got = {r.case: r for r in evaluation_run.run(_cases(spark), _search, _chunks(spark), None, 2).collect()}
    assert got["known"].recall_at_k == 1.0 and got["known"].answer_correct is False and got["known"].citations_correct is None
    assert got["silent"].errors == [] and got["silent"].recall_at_k == 1.0


def test_failures_and_comparison(spark):
    results = evaluation_run.with_latencies(evaluation_run.run(_cases(spark), _search, _chunks(spark), _answer, 2))
    metrics = evaluation.metric_bundle(results)
    lines = {(r.what, r.detail) for r in evaluation_run.failures(results, metrics, [("mrr", "minimum", 0.7), ("recall_at_k", "minimum", 0.5)]).collect()}
    assert ("mrr", "minimum 0.7") in lines and len(lines) == 6
    nothing = evaluation_run.with_latencies(evaluation_run.run(_cases(spark), lambda c: _search(c).limit(0), _chunks(spark), _answer, 2))
    rows = evaluation_run.comparison(results, nothing, [("recall_at_k", "minimum", 0.5)], ("a", "a")).collect()
    assert {(r.name, r.why) for r in rows if r.kind == "regressed"} == {("known", "recall_at_k")}
    assert [r.name for r in rows if r.kind == "decision"] == ["failed"] and {r.name: r.value for r in rows if r.kind == "delta"}["mrr"] == -0.5
    with pytest.raises(ValueError, match="different data sets"):
        evaluation_run.comparison(results, results, [], ("a", "b"))


def test_times(spark):
    results = evaluation_run.run(_cases(spark), _search, _chunks(spark), _answer, 2)
    times = spark.createDataFrame([("known", 1.0, 2.0, 3.0, 6.0)], "case string, embedding_ms double, search_ms double, answer_ms double, total_ms double")
    got = {r.metric: r.value for r in evaluation.metric_bundle(evaluation_run.with_latencies(results, times)).collect()}
    assert got["total_latency_p95_ms"] == 6.0 and got["runtime_error_count"] == 5.0
