import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from quillmesh.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a", "a ", "hello  world", "Thé 漢字 😀 x\n\ty", " nbsp　", "<s> <0x0A> </s>", "x" * 3000, "the of and " * 50, "\x00\x01", "é" * 200, "é", "   deep   spaces   ", "\U0010ffff퟿", "a▁b"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load(PATH))


def _ids(x):
    return np.frombuffer(x, "<u2").tolist()


def test_round_trip(codec):
    for text, x in zip(TEXTS, codec.encode(TEXTS)):
        assert codec.decode(_ids(x)) == text.replace(pieces.MARK, " ")


def test_trie_holds_exactly_the_pieces(codec):
    v = codec.v
    ends = {}
    for key, i in ((p.encode(), i) for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == pieces.NORMAL):
        node = 0
        for c in key:
            child = int(v.base[node]) + c
            assert v.base[node] >= 0 and v.check[child] == node
            node = child
        ends[node] = i
        assert v.value[node] == i
    assert {k: int(v.value[k]) for k in np.flatnonzero(v.value >= 0)} == ends


def _brute(text, rows):
    """The plain dynamic program over the whole text's characters."""
    table = {p: (s, i) for i, (p, s, k) in enumerate(rows) if k == pieces.NORMAL}
    unknown = min(s for _, s, k in rows if k == pieces.NORMAL) - 10
    t = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    best = [(0.0, 0, None)] + [None] * len(t)
    for s in range(len(t)):
        options = [(s + n, *table[t[s : s + n]]) for n in range(1, min(20, len(t) - s) + 1) if t[s : s + n] in table]
        if not any(e == s + 1 for e, *_ in options):
            options.append((s + 1, unknown, None))
        for e, score, i in options:
            if best[e] is None or best[s][0] + score > best[e][0]:
                best[e] = (best[s][0] + score, s, i)
    out, e = [], len(t)
    while e:
        _, s, i = best[e]
        out = ([i] if i is not None else [3 + b for b in t[s:e].encode()]) + out
        e = s
    return out


def test_small_vocabulary_against_plain_program():
    rng = random.Random(8)
    rows = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)] + [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    seen = set()
    while len(seen) < 60:
        p = pieces.MARK * rng.randrange(3) + "".join(rng.choice("abé漢") for _ in range(rng.randrange(4)))
        if p:
            seen.add(p)
    rows += [(p, -rng.randrange(1, 40) / 4, pieces.NORMAL) for p in sorted(seen)]
    small = pieces.Codec(pieces.vocabulary(rows))
    texts = ["".join(rng.choice("abé漢 z😀") for _ in range(rng.randrange(30))) for _ in range(400)]
    for text, x in zip(texts, small.encode(texts)):
        assert _ids(x) == _brute(text, rows), text


def test_against_the_library_as_unigram(codec):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # a score of -1e9 leaves the library's 32-bit sums no room
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    v = codec.v
    mine = pieces.Codec(pieces.vocabulary([(p, max(s, -40000.0), k) for p, s, k in zip(v.pieces, v.scores.tolist(), v.kinds)]))
    rng = random.Random(1)
    texts = [t for t in TEXTS if len(t) < 100 and "<" not in t] + [" ".join(rng.choice(["the", "einschließlich", "tion", "é", "zzz9", "\n", "Québec."]) for _ in range(6)) for _ in range(60)]
    assert [_ids(x) for x in mine.encode(texts)] == [library.encode(t) for t in texts]


def test_columns(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*TEXTS, None, "a", "a"])], "doc_id long, text string, ids int")
    got = pieces.with_pieces(docs, PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == [*(t.replace(pieces.MARK, " ") for t in TEXTS), "", "a", "a"]
    assert pieces.with_pieces(docs.limit(0), PATH).count() == 0
