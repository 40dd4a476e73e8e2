import random
import re

import numpy as np
import pytest

from quillmesh.llm import fmindex


def test_words():
    text = "AÀ b1-C\tßX_ÉÉ.\x80 z\x00q 漢字"
    assert [w.decode() for w in fmindex.words_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text))
    assert [m.lower() if m.isascii() else m for m in fmindex._WORD.findall("Ab-cD 1z")] == ["ab", "cd", "1z"]
    assert fmindex.words_of(None) == []


@pytest.mark.parametrize("seed", range(6))
def test_index_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    n, v = int(rng.integers(1, 900)), int(rng.integers(1, 6))
    s = rng.integers(1, 2 + v, n).astype(np.int32)
    if seed == 5:
        s = np.tile(s[:40], 30)
    n = len(s)
    full = [*s.tolist(), 0]
    assert fmindex.suffix_array(np.array(full)).tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    index = fmindex.FMIndex(s)
    sizes = rng.integers(1, 6, 60)
    rows = np.zeros((60, 6), np.int32)
    for k, m in enumerate(sizes):
        rows[k, 6 - m :] = rng.integers(2, 4 + v, m)
    row, low, high = index.search(rows, sizes)
    got = {int(r): sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(row, low, high)}
    for k, m in enumerate(sizes):
        want = [i for i in range(n - m + 1) if s[i : i + m].tolist() == rows[k, 6 - m :].tolist()]
        assert got.get(k, []) == want


def _brute(docs, items, window):
    phrases = []
    for i, t in items:
        w = fmindex.words_of(t)
        phrases += [(str(i), w[k : k + window]) for k in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for t in docs:
        w, hit, found = fmindex.words_of(t), set(), set()
        for i, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(i)
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_words": 20}, {"block_bytes": 40}])
def test_leaks(spark, options):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdef")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 5])))) for k in range(12)] + [(90, None), (91, "-"), (3, "zz zz"), (92, "E f, A-b")]
    texts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(30)] + ["", None, "zz, ZZ zz", "x" * 50000, "e f a b c", " ".join("abc" * 4000)]
    docs = spark.createDataFrame([(k % 30, t, k, "n") for k, t in enumerate(texts)], "doc_id long, text string, items int, row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = docs.withColumnRenamed("items", "k")
    got = fmindex.find_leaks(kept, bench, window=4, **options).orderBy("k").collect()
    want = _brute(texts, items, 4)
    assert [(r.n_words, sum(x["end"] - x["start"] for x in r.hits), r["items"]) for r in got] == want
    cut = fmindex.remove_leaks(kept, bench, window=4, **options)
    assert cut.columns == kept.columns
    for r, g in zip(cut.orderBy("k").collect(), got, strict=True):
        w = fmindex.words_of(texts[r.k])
        hit = {p for x in g.hits for p in range(x["start"], x["end"])}
        assert fmindex.words_of(r.text) == [x for p, x in enumerate(w) if p not in hit]
        assert hit or r.text == texts[r.k]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.find_leaks(docs, none).collect()[0]["items"] == []
    assert fmindex.find_leaks(docs.limit(0), none).count() == 0
