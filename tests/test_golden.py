"""Stated cases of the surveyed operators, apart from any SQL."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text, vector
from quillmesh.operators import evaluation, ingest, lifecycle, mutations, retrieval, spans
from quillmesh.sources import knowledge


def _one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("x")).first()[0]


def test_plain_text(spark):
    assert _one(spark, " Linha um. \n\n Linha dois. ", text.normalized) == "Linha um.\nLinha dois."
    assert _one(spark, None, text.normalized) == ""


def test_page_text(spark):
    page = "Uma quebra-\nda linha\ncontinua.\n 1 / 3 \nPowered by TCPDF (www.tcpdf.org)\n\n\n Outro   bloco \r\nfim"
    assert _one(spark, page, text.normalized_pages) == "Uma quebrada linha continua.\n\nOutro bloco fim"


def test_chunking():
    cut = lambda *a: [a[0][x:y] for x, y in knowledge.spans(*a)]
    assert cut("abcdefghij", 6, 2) == ["abcdef", "efghij"]
    parts = cut("Primeira frase. Segunda frase. Terceira frase.", 32, 0)
    assert parts == ["Primeira frase. Segunda frase.", "Terceira frase."]
    with pytest.raises(ValueError):
        list(knowledge.spans("abc", 5, 5))


@pytest.mark.parametrize("value, want", [("Bearer abc", "[redacted]"), ("x token=1", "[redacted]"), ("api_key=2", "[redacted]"), ("password=3", "[redacted]"), ("bearer x", "bearer x"), ("a\nb", "a b"), ("x" * 2000, "x" * 1000), (None, None)])
def test_error_messages(spark, value, want):
    assert _one(spark, value, text.redacted_error) == want


def test_keys(spark):
    assert _one(spark, "  Ações   DE Teste ", text.tag_key) == "acoes de teste"
    assert _one(spark, "Straße", text.privacy_key) == "strasse"
    assert _one(spark, "  Meu   Projeto ", text.project_key) == "meu projeto"
    assert _one(spark, " STRASSE  ", text.compared) == _one(spark, "straße", text.compared) == "strasse"
    assert _one(spark, "ΟΔΟΣ", text.compared) == "ΟΔΟΣ".casefold()
    assert _one(spark, "Überblick über ações 2", text.plain_terms) == ["uberblick", "uber", "acoes", "2"]
    assert _one(spark, " 7 ", text.optional_int) == 7 and _one(spark, "x", text.optional_int) is None
    assert _one(spark, "  ", text.optional_str) is None


def test_uris(spark):
    rows = [("file:///a/b/nota.md", "nota.md"), ("/srv/x/", "x"), ("upload:a.txt", None), ("/", "T")]
    got = spark.createDataFrame([(u, "text", "T") for u, _ in rows], "u string, k string, t string").select(text.safe_uri("u", "k", "t")).collect()
    assert [r[0] for r in got] == [u if w is None else f"text:{w}" for u, w in rows]


def test_public_metadata(spark):
    meta = '{"metadata": {"note_type": "memo", "client_id": 5, "unsafe": "x"}}'
    assert _one(spark, meta, text.public_metadata) == {"note_type": "memo"}


def test_locations(spark):
    rows = [('{"location":{"chunk_index":2,"start_char":5,"end_char":9,"page":3,"section":"S"}}', (2, 3, "S", 5, 9)), ('{"chunk_index":4}', (4, None, None, 0, 7)), ("broken", (0, None, None, 0, 7)), (None, (0, None, None, 0, 7))]
    got = spark.createDataFrame([(m, "content") for m, _ in rows], "m string, c string").select(ingest.location(F.col("m"), F.col("c")).alias("l")).collect()
    assert [tuple(r.l) for r in got] == [w for _, w in rows]


def test_sections(spark):
    rows = spark.createDataFrame([(1, "intro\n# One\ntext\n##Two\n#\nend"), (2, "no heading"), (3, None), (4, "")], "doc_id long, content_text string")
    got = sorted((r.doc_id, r.start_char, r.end_char, r.value) for r in spans.section_spans(rows).collect())
    assert got == [(1, 6, 17, "One"), (1, 17, 28, "Two")]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps(spark, monkeypatch, width):
    monkeypatch.setattr(spans, "BIN", width)
    rows = spark.createDataFrame([(1, 0, 10, 1), (1, 10, 20, 2), (1, 20, 21, 3), (2, 0, 3000, 1), (2, 3000, 3100, 2)], "doc_id long, start_char long, end_char long, value long")
    chunks = spark.createDataFrame([(1, 0, 5, 15), (1, 1, 8, 15), (1, 2, 30, 40), (2, 0, 2900, 3100), (2, 1, 100, 900), (3, 0, 0, 5)], "doc_id long, chunk_index long, start_char long, end_char long")
    got = {(r.doc_id, r.chunk_index): r.page for r in spans.best_span(chunks, rows, "page").collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): None, (2, 0): 1, (2, 1): 1, (3, 0): None}


def test_pages(spark):
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, " "), (1, 3, "three"), (1, 4, None), (1, 5, "x")], "doc_id long, page int, text string")
    assert spans.paged_texts(pages).first().content_text == "one\n\nthree\n\nx"
    assert sorted((r.start_char, r.end_char, r.value) for r in spans.page_spans(pages).collect()) == [(0, 3, 1), (5, 10, 3), (12, 13, 5)]


def test_files(spark, tmp_path):
    for name, data in (("a.txt", b"um \n\n dois"), ("b.MD", b"# t"), ("c.exe", b"x"), ("d.txt", b"\xff"), ("e.txt", b" \n")):
        (tmp_path / name).write_bytes(data)
    got = {r.filename: (r.error, r.content_text) for r in ingest.validated(ingest.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": (None, "um\ndois"), "b.MD": (None, "# t"), "c.exe": ("unsupported_type", "x"), "d.txt": ("not_utf8", None), "e.txt": ("empty", "")}
    made = {r.title: r for r in ingest.file_sources(ingest.read_files(spark, str(tmp_path))).collect()}
    assert made["b.MD"].source_type == "markdown" and made["a.txt"].uri == "upload:a.txt"
    assert made["a.txt"].content_hash == hashlib.sha256("um\ndois".encode()).hexdigest()


def test_thresholds(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (0.4,), (0.9,)], "s double")
    assert [r.s for r in rows.filter(vector.reaches("s", 0.5)).collect()] == [0.9]


def test_fusion(spark):
    near, found = spark.createDataFrame([(1, 0.91), (2, 0.7)], "chunk_id long, score double"), spark.createDataFrame([(2, 1.0), (3, 0.9)], "chunk_id long, text_rank double")
    assert [r.chunk_id for r in retrieval.fused(near, found, 5, 0.35).orderBy("place").collect()] == [2, 1, 3]
    near, found = spark.createDataFrame([(1, 0.2)], "chunk_id long, score double"), spark.createDataFrame([(2, 1.0)], "chunk_id long, text_rank double")
    assert [r.chunk_id for r in retrieval.fused(near, found, 5, 0.8).collect()] == [2]


def test_config_hash():
    one = lifecycle.config_hash(" OpenAI ", "m", 3, None)
    assert one == lifecycle.config_hash("openai", "m", 3, " default ") != lifecycle.config_hash("openai", "m", 4, None)


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert rows.select(retrieval.checked(F.col("v"), 2)).first()[0] == [1.0, 2.0]
    for bad in ([1.0], [1.0, float("nan")]):
        with pytest.raises(Exception, match="another size"):
            spark.createDataFrame([(bad,)], "v array<double>").select(retrieval.checked(F.col("v"), 2)).collect()
    assert retrieval.index_allowed(10_000) and not retrieval.index_allowed(9_999) and retrieval.index_allowed(1, force=True)
    cases = [(None, 2.0, 1.0, "inconclusive"), (0.9, 2.0, 1.0, "rejected"), (0.98, 2.0, 2.0, "rejected"), (0.98, 430.0, 95.0, "accepted")]
    got = spark.createDataFrame([c[:3] for c in cases], "r double, b double, i double").select(retrieval.decided(F.col("r"), 0.95, F.col("b"), F.col("i"))).collect()
    assert [r[0] for r in got] == [c[3] for c in cases]


@pytest.mark.parametrize("whole, shift", [(100_000, 0.0), (10, 0.0), (10, 0.3), (10, -0.3)])
def test_percentiles(spark, monkeypatch, whole, shift):
    """By all values, by brackets, and by brackets that lie beside the place."""
    import random

    rng = random.Random(1)
    values = {"a": [rng.randrange(50) / 2 for _ in range(333)], "b": [7.5], "c": [rng.random() for _ in range(2000)], "d": [1.0] * 500 + [2.0] * 20}
    rows = spark.createDataFrame([(g, v) for g, x in values.items() for v in [*x, None]], "g string, v double")
    monkeypatch.setattr(evaluation, "WHOLE", whole)
    places = {f"p{p}": (min(1.0, max(0.0, p / 100 + shift)), lambda n, p=p: evaluation.nearest_place(n, p / 100)) for p in (5, 50, 95)}
    got = {r.g: (r.p5, r.p50, r.p95) for r in evaluation.ranked_values(rows, "g", "v", places).collect()}
    assert got == {g: tuple(sorted(x)[max(0, -(-p * len(x) // 100) - 1)] for p in (5, 50, 95)) for g, x in values.items()}


def test_grading(spark):
    source = dict(id="s1", title="Guia", content="o valor e 10", expected=True), dict(id="s2", title="Outro", content="nada", expected=False)
    rows = [(1, "O VALOR e 10, veja Guia", ["valor e 10"], list(source), True), (2, "nao sei", ["valor"], list(source), True), (3, "Guia e Outro", [], list(source), True), (4, "x", [], [], False)]
    kind = "case long, answer string, points array<string>, sources array<struct<id:string,title:string,content:string,expected:boolean>>, wants_sources boolean"
    got = {r.case: r for r in evaluation.grade_answers(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1].answer_correct, got[1].citations, got[1].citations_correct, got[1].supported) == (True, ["s1"], True, True)
    assert (got[2].answer_correct, got[2].missing, got[2].citations_correct, got[2].supported) == (False, ["valor"], False, True)
    assert (got[3].answer_correct, got[3].citations, got[3].mismatches, got[3].citations_correct) == (None, ["s1", "s2"], ["s2"], False)
    assert (got[4].answer_correct, got[4].citations_correct, got[4].supported) == (None, None, None)


def test_creation_conflicts(spark):
    catalog = spark.createDataFrame([(3, "Old", "old")], "id long, name string, key string")
    asked = spark.createDataFrame([(1, " Új  Name"), (2, "uj name"), (3, "OLD"), (4, " ")], "request_id long, name string")
    got = [(r.request_id, r.id, r.status) for r in mutations.create_named(catalog, asked, text.tag_key("name")).orderBy("request_id").collect()]
    assert got == [(1, 4, "created"), (2, None, "conflict"), (3, None, "conflict"), (4, None, "invalid")]
    with pytest.raises(ValueError):
        mutations.delete_sources({}, catalog, confirm=False)


def test_two_renames_to_one_key(spark):
    catalog = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, "C", "c")], "id long, name string, key string")
    asked = spark.createDataFrame([(1, 1, " X  y"), (2, 2, "x Y"), (3, 3, "C"), (4, 9, "x y")], "request_id long, id long, name string")
    got = [(r.request_id, r.name, r.status) for r in mutations.rename_named(catalog, asked, text.tag_key("name")).orderBy("request_id").collect()]
    assert got == [(1, "X y", "updated"), (2, "x Y", "conflict"), (3, "C", "updated"), (4, "x y", "not_found")]


def test_bulk_insert_is_strict(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, chunk_index long, content string")
    vectors = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "doc_id long, chunk_index long, embedding array<double>")
    assert ingest.zipped(chunks, vectors).count() == 2
    with pytest.raises(Exception, match="do not match"):
        ingest.zipped(chunks, vectors.limit(1)).collect()


def test_reports_in_json(spark, tmp_path):
    from quillmesh.sources import reports

    (tmp_path / "d.json").write_text('{"dataset_version": "1", "defaults": {"limit": 5}, "cases": [{"id": "c1", "kind": "k", "question": "q", "expected_chunks": [{"snippet": "x", "page": 2}], "expected_answer_points": ["p"], "expected_refusal": false}, {"id": "c2", "kind": "unanswered", "question": "r"}]}')
    cases = reports.read_cases(spark, str(tmp_path / "d.json")).orderBy("case").collect()
    assert (cases[1].case, cases[1].expected_refusal, cases[1].expected) == ("c2", True, [])
    assert [(c.case, c.limit, c.points, c.expected_refusal, c.expected[0].snippet, c.expected[0].page) for c in cases[:1]] == [("c1", 5, ["p"], False, "x", 2)]
    assert cases[0].dataset_hash == "sha256:" + hashlib.sha256((tmp_path / "d.json").read_bytes()).hexdigest()
    for name, body in (("q.json", '{"queries": [{"query": "a", "limit": 3}, {"query": "b", "tag_ids": [1]}]}'), ("l.json", '[{"query": "a", "limit": 3}, {"query": "b", "tag_ids": [1]}]')):
        (tmp_path / name).write_text(body)
        assert [(r.query, r.limit, r.tag_ids) for r in reports.read_query_set(spark, str(tmp_path / name)).orderBy("query").collect()] == [("a", 3, None), ("b", 10, [1])]
    (tmp_path / "bad.json").write_text('[{"query": "a", "limit": 0}]')
    with pytest.raises(Exception, match="limit"):
        reports.read_query_set(spark, str(tmp_path / "bad.json")).collect()
    assert reports.report_json({"b": 1, "a": [1]}) == '{\n  "a": [\n    1\n  ],\n  "b": 1\n}\n'
