import corpus_pipeline
from quillmesh.llm import fmindex, personal

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [fmindex.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in bench for k in range(max(1, len(w) - 9))}
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r for r in after.collect()}
        assert rows.keys() <= before.keys() and len(rows) > 0.5 * len(before)
        if name != "pieces":
            assert after.columns == docs.columns
            assert all(r.n_chars == len(r.text) for r in rows.values())
        if name in ("toxicity", "near_duplicates"):
            assert all(r.text == before[d] for d, r in rows.items())
        if name == "near_duplicates":
            assert len({r.text for r in rows.values()}) == len(rows)
        if name == "decontamination":
            for d, r in rows.items():
                w = fmindex.words_of(before[d])
                hit = any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
                assert hit == (r.text != before[d])
        if name == "personal_data":
            for d, r in rows.items():
                assert not personal.base_spans(r.text)
                assert r.text == before[d] or personal.base_spans(before[d]) or len(r.text.split()) >= 0.9 * len(before[d].split())  # a disclosing term
        if name == "pieces":
            assert all(r.lossless and r.n_ids == len(r.ids) for r in rows.values())
        else:
            before, docs = {d: r.text for d, r in rows.items()}, after


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns with the stages' own names."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (3, "another text of this id"), (None, "no id here"), (None, "no id there at all"), (4, long), (5, long + " more"), (6, "write to jo@mail.org now")]
    names = ["score", "spans", "row", "hits", "items", "ids", "node", "label", "n_words", "telling", "part", "decoded"]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t or ""), *range(len(names))) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        if name != "pieces":
            assert kept.columns == docs.columns
        if name == "near_duplicates":
            got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
            want = [rows[0], rows[2], *rows[4:8], rows[9]]
            assert got == sorted(want, key=repr)
        if name == "personal_data":
            assert {r.text for r in kept.collect() if r.doc_id == 6} == {"write to [EMAIL] now"}
    assert kept.count() == 7 and all(r.lossless for r in kept.collect())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_ids", "ids", "lossless"]
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and 100 < len(ids) <= 200


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
