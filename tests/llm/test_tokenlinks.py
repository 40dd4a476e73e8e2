import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillmesh.llm import tokenlinks as t
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "Hello world", " hello  world ", "line one\nline two\n\nline three", "tabs\tand \r\n ends", "Thé naïve 漢字 😀 ﬁ", "a▁b", "▁", "<|endoftext|> x <s> </s> <0x0A>", "a<|endoftext|>b", "x" * 3000, "é" * 200, "\0 nul", "nbsp here　there",
    "über Straße, größer.", "é combining", "3.14159 2024-01-01 user@example.org 0xdeadbeef", "the of and " * 300, "\U0010ffff퟿", "\n", "word\n", "trailing space ", "a\n\n\nb", "😀😀😀 😀", "don't can't we'll", "a,\nb.\n\nc, d.,. e", ", . ,a .b", "ab,\n,\n.x\n5, 6.", "x²., y,", "\u2581a b",
]


def _plain(texts):
    """Brute force by the two libraries, byte by byte: (n_a, n_b, groups, links) of each text, and its row."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    bytes_a, bytes_b = t.a_bytes(a_model), t.b_bytes(b_model)
    found = []
    for x in texts:
        a = a_model.encode(" " + (x or ""), add_special_tokens=False).ids if x else []
        b = b_model.encode(x, num_threads=1) if x else []
        if not x or not b"".join(bytes_a[i] for i in a) == b" " + x.encode() == b"".join(bytes_b[i] for i in b):
            found.append(None)
            continue
        ends = []
        for ids, names in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, {}
            for k, i in enumerate(ids):
                at += len(names[i])
                out[at] = k
            ends.append(out)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            links.append((a[x], b[y]))
            i, j = x + 1, y + 1
        found.append((len(a), len(b), groups, links))
    pairs = Counter(p for f in found if f for p in f[3])
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            rows.append((n_a, n_b, len(groups), len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_links_equal_brute_force(spark):
    rows = [(k, x, "c", 0) for k, x in enumerate([*TEXTS, *TEXTS[4:8]])] + [(None, "Hello world", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, a int").repartition(3)
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in t.link(docs, A, B).collect())
    assert got == Counter((i, *w) for (i, *_), w in zip(rows, _plain([x for _, x, *_ in rows])))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in t.op13_token_links(spark, SF).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, _plain([d.text for d in docs]))}


def test_very_long_text(spark, monkeypatch):
    long = "many  words\n\n in a long text, " * 20_000
    want = _plain([long, long[:5000]])
    got = t.link(spark.createDataFrame([(1, long), (2, long[:5000])], "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == want
    one = t.aligner(A, B)
    whole = one.digests([long])
    monkeypatch.setattr(t, "BLOCK", 50)
    assert one.digests([long[:9000]]) == t.Aligner(A, B).digests([long[:9000]]) and one.digests([long]) == whole


def test_cache_starts_anew(monkeypatch):
    one = t.Aligner(A, B)
    want = one.digests(TEXTS)
    monkeypatch.setattr(t, "CACHE", 1)
    assert one.digests(TEXTS) == want and one.digests(TEXTS) == want and one.known == one.fixed


def test_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for shape in ((5, 7, 4), (1, 1, 1), (12, 3, 9), (4, 0, 3)):
        x, y = (rng.random(shape[:2]) < 0.4).astype(int), (rng.random(shape[1:]) < 0.4).astype(int)
        p, q = (np.concatenate([[0], np.cumsum(m.sum(axis=1))]) for m in (x, y))
        ptr, col, n = t.row_products(p, np.nonzero(x)[1], q, np.nonzero(y)[1])
        got = np.zeros((shape[0], shape[2]), int)
        got[np.repeat(np.arange(shape[0]), np.diff(ptr)), col] = n
        assert (got == x @ y).all()
        assert (t.row_sizes(p, np.nonzero(x)[1], q) == x @ y.sum(axis=1)).all()
        back = t.transposed(q, np.nonzero(y)[1], shape[2])
        assert (np.diff(back[0]) == y.sum(axis=0)).all() and back[1].tolist() == np.nonzero(y.T)[1].tolist()


def test_alignments(spark):
    texts = ["Hello wörld, it's 😀\n\n ok", "", "a▁b", "internationalization"]
    for r in t.alignments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect():
        one = t.aligner(A, B)
        starts = []
        for ids, names in ((r.a, one.bytes_a), (r.b, one.bytes_b)):
            ends = np.cumsum([len(names[i]) for i in ids]).tolist()
            starts.append([(e - len(names[i]), e) for i, e in zip(ids, ends)])
        overlap = {(i, j): min(x[1], y[1]) - max(x[0], y[0]) for i, x in enumerate(starts[0]) for j, y in enumerate(starts[1])}
        assert {(o.a, o.b): o.bytes for o in r.overlaps} == {k: n for k, n in overlap.items() if n > 0}
        assert all(o.together == (starts[0][o.a][1] == starts[1][o.b][1]) for o in r.overlaps)
        cuts = [g.bytes for g in r.groups]
        group = lambda x: sum(c < x[1] for c in cuts)
        assert {(s.a, s.b) for s in r.shared} == {(i, j) for i, x in enumerate(starts[0]) for j, y in enumerate(starts[1]) if group(x) == group(y)}


def test_pairs_are_bounded():
    one = t.aligner(A, B)
    assert t.possible_pairs([b"ab", b"b", b"c"], [b"b", b"ab", b"b"]) == 1 + 2 + 2 + 1
    assert t.possible_pairs(one.bytes_a, one.bytes_b) < 1_000_000


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    assert [r.n_links for r in t.link(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()] == [0] * len(rows)
