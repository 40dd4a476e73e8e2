import itertools
import random
import zlib

import numpy as np
import pytest

from quillmesh.llm import toxicity as t


def _brute_marginals(scores, pairs):
    n, total, out = len(scores), 0.0, np.zeros(len(scores))
    for path in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(s for s, y in zip(scores, path) if y) + sum(pairs[a, b] for a, b in zip(path, path[1:])))
        total += p
        out += p * np.array(path)
    return out / total


@pytest.mark.parametrize("seed", range(5))
def test_marginals(seed):
    rng = np.random.default_rng(seed)
    model = t.Model(words={}, weights=rng.normal(size=(3, 6)), bias=-0.3, pairs=rng.normal(size=(2, 2)))
    model.weights[:, 0] = 0
    documents = [rng.integers(0, 6, n) for n in (0, 1, 2, 7, 9, 3)]
    for d, p in zip(documents, t.marginals(model, documents)):
        if len(d):
            assert np.allclose(p, _brute_marginals(t.emissions(model, d), model.pairs))


def _corpus():
    rng = random.Random(3)
    words = ["w" + str(k) for k in range(300)]
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if bad:
            for w in rng.sample(["vile", "Filth", "SCUMBAG"], 2):
                text.insert(rng.randrange(len(text)), w)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_scores_and_spans(spark):
    rows, labels = _corpus()
    extra = [(1000, None), (1001, ""), (1002, "vile!"), (1002, "vile!"), (None, "w1 vile " * 8000), (1003, "w1 w2, w3")]
    docs = spark.createDataFrame([(d, x, 0.5, "s") for d, x in rows + extra], "doc_id long, text string, score double, spans string")
    marks = spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = t.fit(docs, marks)
    assert {"vile", "filth", "scumbag"} <= set(model.words)
    got = t.score(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    out = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((by[k].score >= 0.5) == (k % 4 == 0) for k in out) / len(out) > 0.97
    assert [tuple(x) for x in by[1002].spans] == [(0, 4)] and by[1002].score > 0.5 > by[1003].score
    assert by[1000].score == by[1001].score < 0.5 and by[None].score > 0.5
    kept = t.reject_toxic(docs, marks)
    assert kept.columns == docs.columns and {1003, 1000, 1001} <= {r.doc_id for r in kept.collect()} and 1002 not in {r.doc_id for r in kept.collect()}


def test_long_documents_do_not_end_the_sample(spark):
    rows, labels = _corpus()
    long = [(k, "w1 w2 " * 12_000) for k in range(5000, 5040)]
    docs = spark.createDataFrame(rows + long, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(k, 1, 0) for k, _ in long], "doc_id long, quality int, toxic int")
    model = t.fit(docs, marks, chars=60_000)
    assert model.constant is None and {"vile", "filth", "scumbag"} <= set(model.words)
    got = t.score(docs.filter("doc_id < 400"), model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got) / len(got) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flip = [(k, q, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, q, y in labels]
    a, b = (t.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert a.words == b.words and (a.weights == b.weights).all() and (a.document == b.document).all()


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in t.score(docs, t.fit(docs, none)).collect()] == [0.0]
    assert t.score(docs.limit(0), t.fit(docs, none)).count() == 0
