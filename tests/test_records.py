"""Stated cases of references, names, backfills, data set files and the stored tables."""

import json
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import lifecycle, mutations, retrieval
from quillmesh.sources import knowledge, reports
from tests.conftest import SF


def _one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "page,section,where",
    [(3, "Intro", "Página 3 · Intro · Trecho 2"), (None, "Intro", "Intro · Trecho 2"), (0, "", "Trecho 2"), (None, None, "Trecho 2")],
)
def test_reference(spark, page, section, where):
    rows = spark.createDataFrame([("T", page, section, 1, "said\nso")], "title string, page long, section string, chunk_index long, content string")
    assert rows.select(text.reference(*rows.columns)).first()[0] == f"T\n{where}\nsaid\nso"


def test_references_in_order(spark):
    rows = spark.createDataFrame([(1, 2, "B", 0, "b"), (1, 1, "A", 4, "a"), (2, 1, "C", 0, "c")], "query long, place long, title string, chunk_index long, content string")
    rows = rows.withColumns({"page": F.lit(None).cast("long"), "section": F.lit(None).cast("string")})
    got = retrieval.references(rows, "query", "place", title="title", page="page", section="section", chunk_index="chunk_index", content="content")
    assert {r.query: r.references for r in got.collect()} == {1: "A\nTrecho 5\na\n\nB\nTrecho 1\nb", 2: "C\nTrecho 1\nc"}


@pytest.mark.parametrize("metadata,keys", [('{"z": 1, "client_id": "a", "b": {"c": 1}, "note_type": "x"}', ["b", "z"]), ("{}", []), ("no json", []), (None, []), ("[1]", [])])
def test_unsupported_keys(spark, metadata, keys):
    assert _one(spark, text.unsupported_keys("m"), m=metadata) == keys


@pytest.mark.parametrize("name", ["a", "", "Ação 12", "x" * 300])
def test_name_uuid(spark, name):
    namespace = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert _one(spark, text.name_uuid(namespace, F.col("n")), n=name) == str(uuid.uuid5(uuid.UUID(namespace), name))


def test_names_in_the_order_of_a_language(spark):
    names = ["zebra", "Água", "agua", "Érica", "erica", "Zé", "abc", "ção", "Coa"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in rows.orderBy(text.by_name("name")).collect()] == ["abc", "agua", "Água", "ção", "Coa", "erica", "Érica", "Zé", "zebra"]
    held = rows.filter(text.has_text("name", F.lit("ÁGU"))).collect()
    assert sorted(r.name for r in held) == ["agua", "Água"]


def test_upserted_list(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "Ä"), (3, "c")], "id long, name string")
    items = spark.createDataFrame([(1, 3, "x"), (2, 3, "a"), (3, 9, "aa")], "request_id long, id long, name string")
    assert [tuple(r) for r in mutations.upserted(rows, items).collect()] == [(3, "a"), (2, "Ä"), (9, "aa"), (1, "b")]
    assert [tuple(r) for r in mutations.upserted(rows.limit(0), items.limit(0)).collect()] == []
    left = mutations.unselected(rows.union(rows).union(spark.createDataFrame([(None, "n")], rows.schema)), rows.filter("id = 2"), "id")
    assert sorted(left.collect(), key=repr) == sorted(left.distinct().collect(), key=repr) and {r.id for r in left.collect()} == {1, 3, None}


def test_backfills(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, [1.0], None, "d"), (3, None, "failed", "")], "id long, embedding array<double>, status string, description string")
    got = lifecycle.backfilled(rows, {"status": lifecycle.status_of_vector(), "description": F.lit("none")}).orderBy("id")
    assert [(r.status, r.description) for r in got.collect()] == [("pending", "none"), ("unversioned", "d"), ("failed", "")]


ANSWERED = {"id": "a", "kind": "factual", "question": "q", "expected_answer_points": ["p"]}
OPEN = {"id": "b", "kind": "unanswered", "question": "r"}


@pytest.mark.parametrize(
    "cases,message",
    [
        ([], "needs cases"),
        ([ANSWERED], "needs an unanswered case"),
        ([ANSWERED, OPEN | {"id": "a"}], "must differ"),
        ([ANSWERED, OPEN | {"id": " "}], "needs an id"),
        ([ANSWERED | {"question": ""}, OPEN], "a question"),
        ([ANSWERED, OPEN | {"expected_answer_points": ["p"]}], "cannot expect"),
        ([ANSWERED, OPEN | {"expected_refusal": False}], "expects a refusal"),
        ([ANSWERED | {"expected_answer_points": []}, OPEN], "expects chunks or points"),
        ([ANSWERED | {"limit": 51}, OPEN], "limit"),
        ([ANSWERED | {"min_score": -0.1}, OPEN], "min_score"),
    ],
)
def test_data_sets_that_are_refused(spark, tmp_path, cases, message):
    (tmp_path / "d.json").write_text(json.dumps({"dataset_version": "1", "cases": cases}))
    with pytest.raises(Exception, match=message):
        reports.read_cases(spark, str(tmp_path / "d.json")).collect()


def test_what_is_no_data_set_or_query_set(spark, tmp_path):
    (tmp_path / "d.json").write_text("{no json")
    with pytest.raises(Exception, match="needs cases"):
        reports.read_cases(spark, str(tmp_path / "d.json")).collect()
    for body in ("[]", '{"queries": []}', '[{"query": " "}]', '[{"limit": 3}]', "no json", '{"other": 1}'):
        (tmp_path / "q.json").write_text(body)
        with pytest.raises(Exception, match="a query set is a list"):
            reports.read_query_set(spark, str(tmp_path / "q.json")).collect()


def test_reports_are_written_and_read(spark, tmp_path):
    at = str(tmp_path / "report")
    for report in ({"b": 1, "a": ["é", None]}, {"metrics": {"mrr": 0.5}}):
        reports.write_report(spark, at, report)
        assert reports.read_report(spark, at) == report
    written = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert written == reports.report_json({"metrics": {"mrr": 0.5}})
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "x.json").write_text("[1]")
    with pytest.raises(ValueError, match="no report"):
        reports.read_report(spark, str(tmp_path / "list"))


def test_stored_tables_follow_their_files(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.filter("doc_id < 5").write.parquet(f"{folder}/documents.parquet")
    assert knowledge.sources(spark, folder).count() == 5
    shutil.rmtree(f"{folder}/documents.parquet")
    docs.filter("doc_id < 8").write.parquet(f"{folder}/documents.parquet")
    assert knowledge.sources(spark, folder).count() == 8
