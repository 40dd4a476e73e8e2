import random
from collections import Counter

import numpy as np
import pytest

from quillmesh.llm import dartminhash as d


def _elements(text, weighted=False):
    w = (text or "").encode().lower().split()
    c = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return c if weighted else Counter(set(c))


def _similarity(a, b):
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 0.0


def _classes(rows, weighted=False):
    texts = sorted({t or "" for _, t in rows})
    sets = [_elements(t, weighted) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if _similarity(sets[i], sets[j]) >= 0.8:
                up[find(i)] = find(j)
    least = {}
    for k, t in rows:
        c = find(texts.index(t or ""))
        least[c] = k if least.get(c) is None else least[c] if k is None else min(least[c], k)
    return Counter((k, least[find(texts.index(t or ""))]) for k, t in rows)


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_similarity(weighted):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(300)]
    other = base[:150] + [rng.choice("abcdefgh") for _ in range(30)] + base[150:] + base[:20]
    texts = [" ".join(base), " ".join(other), "one", "", "a b c d e"]
    owner, element, times = d.elements(texts)
    weight = times.astype(float) if weighted else np.ones(len(times))
    got, some = d.signatures(owner, element, weight, len(texts))
    assert some.tolist() == [True, True, True, False, True]
    want = _similarity(_elements(texts[0], weighted), _elements(texts[1], weighted))
    assert abs((got[0] == got[1]).mean() - want) < 0.17
    alone, _ = d.signatures(owner[owner == 1] * 0, element[owner == 1], weight[owner == 1], 1)
    assert (alone[0] == got[1]).all()  # whatever else is in the batch


@pytest.mark.parametrize("weighted", [False, True])
def test_classes(spark, weighted):
    rng = random.Random(11)
    rows = []
    for g in range(8):
        w = [rng.choice("abcdefghijkl") + rng.choice("uvwxyz") + str(rng.randrange(9)) for _ in range(rng.choice([6, 30, 120, 300]))]
        for _ in range(rng.choice([1, 3, 12])):
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
    rows += [(900, ""), (901, None), (902, " "), (903, "one"), (904, "ONE"), (3, rows[7][1]), (905, rows[2][1]), (905, rows[2][1]), (None, rows[4][1]), (None, "lonely text"), (906, "r r " * 300), (907, "r r " * 290)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, node int, label int")
    got = d.near_classes(docs, weighted=weighted).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == _classes(rows, weighted)
    kept = d.keep_one(docs, weighted=weighted)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in _classes(rows, weighted)}


def test_keep_one_of_each_class(spark):
    a, b, c, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abce")
    rows = [(None, a, 1), (None, b, 2), (None, b + " more", 3), (5, c, 4), (5, e, 5), (6, c, 6), (8, "one text", 7), (8, "one text", 7), (8, "one text", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int").repartition(3)
    kept = d.keep_one(docs)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    near_b = next(t for _, t in got if t in (b, b + " more"))
    assert kept.columns == docs.columns
    assert got == sorted([(None, a), (None, near_b), (5, c), (5, e), (8, "one text")], key=repr)
    assert sorted(r.text for r in d.keep_one(docs.filter("doc_id = 5")).collect()) == [c, e]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.label for r in d.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_empty(spark):
    assert d.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_ids_have_classes_of_their_own(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (6, a + " more"), (None, "x"), (None, "y")]
    got = d.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.class_node for r in got}) == 4


def test_recall_on_the_tables(spark):
    """Every pair at the threshold, of ids divisible by ten against all rows, is in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: _elements(r.text, True) for r in docs.collect()}
    of = {r.doc_id: r.class_node for r in d.near_classes(docs).collect()}
    pairs = [(a, b) for a in sets if a % 10 == 0 for b in sets if a != b and _similarity(sets[a], sets[b]) >= 0.8]
    assert pairs and all(of[a] == of[b] for a, b in pairs)


def test_very_long_text(spark):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(["r"] * 100_000)), (4, " ".join(["r"] * 90_000)), (5, " ".join(["r"] * 50_000))]
    got = {r.doc_id: r.class_id for r in d.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
