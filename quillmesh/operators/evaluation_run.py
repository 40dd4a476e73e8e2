"""A run of an evaluation: cases in, graded results, metrics, failures and a decision out, all cases in one plan.

A case that can't be searched, or whose answer failed, is a result with its error and without grades; the run goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import batched, evaluation
from quillmesh.sources.shared import written

EXPECTED = "array<struct<source_id:string,source_title:string,chunk_index:long,page:long,section:string,content_hash:string,snippet:string>>"
SOURCES = "array<struct<id:string,title:string,content:string,expected:boolean>>"


def broken(dimension: int) -> Column:
    """Why a case (question, embedding, embedding_error) can't be searched, or null."""
    v = F.col("embedding")
    return (
        F.when(F.col("embedding_error").isNotNull(), F.col("embedding_error"))
        .when(F.trim(F.coalesce("question", F.lit(""))) == "", "ValueError: the question must not be empty")
        .when(v.isNull(), "ValueError: the question has no vector")
        .when(F.size(v) != dimension, F.format_string("ValueError: expected %d dimensions, got %d", F.lit(dimension), F.size(v)))
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "ValueError: the vector must be finite")
    )


def retrieved_refs(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (case, chunk_id, place, score) -> case, rank, score, r: what a report keeps of a retrieved chunk, with its content.

    chunks: chunk_id, source_id, source_title, chunk_index, page, section, content.
    """
    r = F.struct("source_id", "source_title", "chunk_index", "page", "section", F.sha2("content", 256).alias("content_hash"), "content")
    return hits.join(chunks, "chunk_id").select("case", F.col("place").alias("rank"), "score", r.alias("r"))


def run(cases: DataFrame, search: Callable[[DataFrame], DataFrame], chunks: DataFrame, answer: Callable[[DataFrame], DataFrame] | None, dimension: int) -> DataFrame:
    """The result of every case.

    cases: case, question, embedding, embedding_error, limit, min_score, filters, expected, points, expected_refusal.
    search: queries (query and what ``batched.hybrid`` reads) -> query, chunk_id, place, score.
    answer: (case, question, sources by rank) -> case, answer, answer_error; None for a run that only searches.
    """
    named = cases.withColumn("query", F.xxhash64("case")).withColumn("error", broken(dimension))
    named = written(named, "cases")
    fine = named.filter("error IS NULL")
    hits = search(fine).join(fine.select("query", "case"), "query").select("case", "chunk_id", "place", "score")
    found = written(retrieved_refs(hits, chunks), "retrieved")  # read by every grade
    wanted = fine.select("case", F.posexplode("expected").alias("number", "e"))
    graded = evaluation.graded_retrieval(wanted, found)
    # whether a retrieved chunk is expected: of a case's few results each against its few locators
    fits = found.join(wanted, "case", "left").groupBy("case", "rank").agg(F.max(F.coalesce(evaluation.expected_match(), F.lit(False)) & F.col("e").isNotNull()).alias("expected"))
    source = F.struct(F.col("r.source_id").alias("id"), F.col("r.source_title").alias("title"), F.col("r.content").alias("content"), "expected")
    shown = found.join(fits, ["case", "rank"]).groupBy("case").agg(F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))).alias("s"))  # limit rows a case
    context = fine.select("case", "question", "points", (F.size("expected") > 0).alias("wants_sources")).join(shown, "case", "left")
    context = context.withColumn("sources", F.coalesce(F.transform("s", lambda x: x["s"]), F.array().cast(SOURCES))).drop("s")
    if answer is None:
        answered = context.withColumns({"answer": F.lit(None).cast("string"), "answer_error": F.lit(None).cast("string")})
    else:
        answered = context.join(answer(context.select("case", "question", "sources")), "case", "left")
        answered = answered.withColumn("answer_error", F.coalesce("answer_error", F.when(F.col("answer").isNull(), "RuntimeError: no answer")))
    judged = evaluation.grade_answers(answered)
    own = named.select("case", "error", "expected_refusal", F.size("expected").alias("n_expected"))
    both = own.join(judged.select("case", "answer", "answer_error", "missing", "citations", "mismatches", "answer_correct", "citations_correct", "supported"), "case", "left").join(graded, "case", "left")
    error = F.coalesce("error", "answer_error")
    ok, said = error.isNull(), error.isNull() & F.lit(answer is not None)
    none = F.array().cast("array<string>")
    return both.select(
        "case",
        F.when(ok & (F.col("n_expected") > 0), F.col("recall_at_k")).alias("recall_at_k"),
        F.when(ok & (F.col("n_expected") > 0), F.col("reciprocal_rank")).alias("reciprocal_rank"),
        F.when(ok, F.col("answer_correct")).alias("answer_correct"),
        F.when(said & F.col("expected_refusal").isNotNull(), evaluation.is_refusal(F.col("answer")) == F.col("expected_refusal")).alias("refusal_correct"),
        F.when(said, F.col("citations_correct")).alias("citations_correct"),
        F.when(ok, F.col("supported")).alias("supported"),
        F.when(ok, F.col("answer")).alias("answer"),
        F.when(ok, F.col("missing")).otherwise(none).alias("missing"),
        F.when(said, F.col("citations")).otherwise(none).alias("citations"),
        F.when(said, F.col("mismatches")).otherwise(none).alias("mismatches"),
        F.when(ok, none).otherwise(F.array(error)).alias("errors"),
    )


def hybrid_search(usable: DataFrame, chunks: DataFrame, postings: DataFrame, bridge: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A search for ``run``: the hybrid one, whose cases need ``terms`` as well."""
    return lambda cases: batched.hybrid(cases, usable, chunks, postings, bridge)


def with_latencies(results: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """results with embedding_ms, search_ms, answer_ms and total_ms from times (case, ..); null where none was measured."""
    names = list(evaluation.LATENCIES.values())
    if times is None:
        return results.withColumns({c: F.lit(None).cast("double") for c in names})
    return results.join(times.select("case", *names), "case", "left")


def failures(results: DataFrame, metrics: DataFrame, bounds: list[tuple[str, str, float]]) -> DataFrame:
    """what, detail: a row for each violated bound, and for each case with an error."""
    one = evaluation.gate(metrics, bounds).select(F.col("metric").alias("what"), F.format_string("%s %s", "mode", F.col("bound").cast("string")).alias("detail"))
    return one.unionByName(results.filter(F.size("errors") > 0).select(F.col("case").cast("string").alias("what"), F.col("errors")[0].alias("detail")))


def comparison(baseline: DataFrame, candidate: DataFrame, bounds: list[tuple[str, str, float]], hashes: tuple[str, str]) -> DataFrame:
    """One report of two runs' results, of the same data set: kind (delta, regressed, failure, decision), name, value, why."""
    if hashes[0] != hashes[1]:
        raise ValueError("the reports are of different data sets")
    old, new = evaluation.metric_bundle(baseline), evaluation.metric_bundle(candidate)
    nothing = F.lit(None).cast("double"), F.lit(None).cast("string")
    deltas = evaluation.metric_deltas(old, new).select(F.lit("delta").alias("kind"), F.col("metric").alias("name"), F.col("delta").alias("value"), nothing[1].alias("why"))
    fell = evaluation.regressed(baseline, candidate).select(F.lit("regressed").alias("kind"), F.col("case").cast("string").alias("name"), nothing[0].alias("value"), "why")
    failed = evaluation.gate(new, bounds)
    lines = failed.select(F.lit("failure").alias("kind"), F.col("metric").alias("name"), F.col("value").cast("double").alias("value"), F.format_string("%s %s", "mode", F.col("bound").cast("string")).alias("why"))
    decision = failed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("decision").alias("kind"), F.when(F.col("n") > 0, "failed").otherwise("passed").alias("name"), nothing[0].alias("value"), nothing[1].alias("why"))
    return deltas.unionByName(fell).unionByName(lines).unionByName(decision)
