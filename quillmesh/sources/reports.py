"""JSON data sets of evaluation cases, query sets of the index, and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 10
EXPECTED = "array<struct<source_id:string,source_title:string,chunk_index:long,page:long,section:string,content_hash:string,snippet:string>>"
CASES = f"dataset_version string, defaults struct<limit:long,min_score:double>, cases array<struct<id:string,kind:string,question:string,limit:long,min_score:double,expected_chunks:{EXPECTED},expected_answer_points:array<string>,expected_refusal:boolean>>"
QUERY = "array<struct<query:string,limit:long,category_ids:array<long>,tag_ids:array<long>,project_ids:array<long>>>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """data (text), hash of the raw bytes of each file."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("content").cast("string").alias("data"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("dataset_hash"))


UNANSWERED = "unanswered"  # the kind of a case that a corpus has no answer to


def _broken(d: str) -> Column:
    """The first rule that a data set breaks, or null."""
    cases = F.col(f"{d}.cases")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    asks = lambda c: some(c["expected_chunks"]) | some(c["expected_answer_points"])
    open_ = lambda c: F.coalesce(c["kind"], F.lit("")) == UNANSWERED
    outside = lambda c, low, high: F.coalesce((c < low) | (c > high), F.lit(False))
    each = lambda rule: F.exists(cases, rule)
    ids = F.transform(cases, lambda c: c["id"])
    return (
        F.when(F.coalesce(F.size(cases), F.lit(0)) < 1, "a data set needs cases")
        .when(blank(F.col(f"{d}.dataset_version")), "a data set needs a version")
        .when(each(lambda c: blank(c["id"]) | blank(c["question"]) | blank(c["kind"])), "a case needs an id, a kind and a question")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "the ids of cases must differ")
        .when(~each(open_), "a data set needs an unanswered case")
        .when(each(lambda c: open_(c) & asks(c)), "an unanswered case cannot expect chunks or points")
        .when(each(lambda c: open_(c) & ~F.coalesce(c["expected_refusal"], F.lit(True))), "an unanswered case expects a refusal")
        .when(each(lambda c: ~open_(c) & ~asks(c)), "an answered case expects chunks or points")
        .when(each(lambda c: outside(c["limit"], 1, 50) | outside(c["min_score"], 0, 1)), "limit must be from 1 to 50, min_score from 0 to 1")
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case: case, kind, question, limit and min_score (its own or the default), expected, points, expected_refusal, dataset_version, dataset_hash. A file that is no data set raises."""
    read = _files(spark, path).select("dataset_hash", F.from_json("data", CASES).alias("d"))
    broken = _broken("d")
    whole = F.when(broken.isNull(), F.col("d.cases")).otherwise(F.raise_error(broken))
    each = read.select("dataset_hash", "d.dataset_version", "d.defaults", F.explode(whole).alias("c"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return each.select(
        F.col("c.id").alias("case"), "c.kind", "c.question",
        F.coalesce("c.limit", "defaults.limit").alias("limit"), F.coalesce("c.min_score", "defaults.min_score").alias("min_score"),
        none(F.col("c.expected_chunks"), EXPECTED).alias("expected"), none(F.col("c.expected_answer_points"), "array<string>").alias("points"), F.when(F.col("c.kind") == UNANSWERED, F.lit(True)).otherwise(F.col("c.expected_refusal")).alias("expected_refusal"), "dataset_version", "dataset_hash",
    )


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """query, limit, category_ids, tag_ids, project_ids of a list, or of an object's list of queries; limits under 1 and ids that are not positive raise, as do an empty list and a blank query."""
    text = F.trim("data")
    found = F.when(text.startswith("["), F.from_json("data", QUERY)).otherwise(F.from_json("data", f"queries {QUERY}")["queries"])
    fine = (F.size(found) > 0) & F.forall(found, lambda q: F.trim(q["query"]) != "")
    found = F.when(fine, found).otherwise(F.raise_error(F.lit("a query set is a list of queries, none of them blank")))
    each = _files(spark, path).select(F.explode(found).alias("q")).select("q.*").withColumn("limit", F.coalesce("limit", F.lit(LIMIT)))
    limit = F.when(F.col("limit") >= 1, F.col("limit")).otherwise(F.raise_error(F.lit("limit must be 1 at least")))
    ids = {c: F.when(F.col(c).isNull() | F.forall(c, lambda x: x > 0), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be positive"))) for c in ("category_ids", "tag_ids", "project_ids")}
    return each.select(F.trim("query").alias("query"), limit.alias("limit"), *(v.alias(c) for c, v in ids.items()))


def report_json(report: dict) -> str:
    """A report as it is stored: sorted keys, indented by two, a line end at its end."""
    return json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """Writes a report, in its stored form, in a folder of its own; an earlier report there is replaced."""
    spark.createDataFrame([(report_json(report)[:-1],)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    """A report that was written; what is no JSON object raises."""
    found = [json.loads(r["value"]) for r in spark.read.text(path, wholetext=True).limit(2).collect()]
    if len(found) != 1 or not isinstance(found[0], dict):
        raise ValueError(f"no report: {path}")
    return found[0]
