import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n", "a b", " a", "a ", "a  b", "a   b c", "a\nb c", "a \n b", "a\n\nb", "it's we'll 'tis x' s", "tab\there\tx y", "é ü ß 漢字 😀 z", "#", "a # b #",
    "<|endoftext|> a <|endoftext|>", "x\x1cy z", "x y z w", "x  y", "1 2 33 4.5 -6", "word " * 3000 + "end", "no-spaces" * 2000, "line\r\nends \r\n x", "a\n", "\na b", "!!! ??? ...",
]


def _library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library():
    t, e = _library(), tokenfiles.Encoder(PATH)
    got = e.encode(TEXTS)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in TEXTS]
    assert 50256 in t.encode("hello <|endoftext|> world", add_special_tokens=False).ids
    e.known = dict(e.fixed)
    assert e.encode(TEXTS[::-1]) == got[::-1]


@pytest.mark.parametrize("partitions", [1, 3])
def test_files_and_documents(spark, tmp_path, partitions):
    rows = [(i * 3 % 29, x, "k") for i, x in enumerate(TEXTS)] + [(None, "null id", "k"), (5, None, "k"), (5, None, "k"), (5, "b", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    manifest = tokenfiles.write_files(docs, str(tmp_path / "f"), PATH, partitions)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    got = tokenfiles.read_documents(manifest).orderBy("start").collect()
    t, at, want = _library(), 0, []
    for doc, text in sorted(((d, x or "") for d, x, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    for row in manifest.collect():
        found = tokenfiles.sequences(row.path)
        assert found.schema.field("ids").type.list_size == tokenfiles.SEQUENCE
        assert sum(map(sum, found["mask"].to_pylist())) == row.n_tokens
        assert tokenfiles.sequences(row.path, slice(0, 1)).num_rows == 1


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = tokenfiles.write_files(docs, str(tmp_path / "f"), PATH, 2)
    assert tokenfiles.read_documents(manifest).count() == 0


def test_words_that_differ_in_their_last_punctuation_are_encoded_once():
    t, e = _library(), tokenfiles.Encoder(PATH)
    asked = []
    ids = e._ids
    e._ids = lambda text: asked.append(text) or ids(text)
    marks = ["", ",", ".", "...", "&&&", ",%%%", "'", "'.", "!?", "\"", ")", "###", "'s", "'s.", "'", "-x", "1.", "1"]
    texts = [f"Tonesque{a} oueaule{b} é{a}\ntonesque{b} &&{a} {b}x" for a in marks for b in marks]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    lines = "\n".join(asked).split("\n")
    assert len(lines) == len(set(lines)) and sum(x.startswith("Tonesque") for x in lines) == 5  # alone, with 's, -x, 1. and 1


class _Counted(dict):
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_chunk_is_looked_up_once_for_all_its_occurrences():
    t, e = _library(), tokenfiles.Encoder(PATH)
    e.known = _Counted(e.fixed)
    texts = [f"one two{m} three,\nfour and one two{m}" * 50 + " end" for m in ("", ".", "***", "!?")] * 5
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert e.known.asked < 40  # of over 4000 chunks
    assert not {" two.", " two***", " two!?"} & set(e.known)  # the word is kept once, apart from what ends it


def test_cuts_keep_to_texts_and_to_letters():
    t, e = _library(), tokenfiles.Encoder(PATH)
    edges = ["", ".", "a", "a.", ".a", "..", "a'", "s b", "'s b", "é.", "×.", "÷...", "é", "漢。", "漢.", "x1.", "a.b.", "_", "a_ _b", "\n", "a.\nb", "ñ***\nñ", "\0", "a\0b", "\xa0", "a　b", "<|", "|>", "a <|endoftext|>"]
    for texts in (edges, edges[::-1], [], ["", ""], *([x] for x in edges), *([x, y] for x in edges for y in edges)):
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert e.plains(["a b\nc", "", "᠎", "a\n\nb"]) == [True] * 4
    assert not any(e.plains([" a", "a ", "a\n", "a  b", "a \nb", "a\n b", "a\n\n\nb", "a\tb", "a\x1cb", "a\x85b", "a b", "a\0b", "<|endoftext|>"]))
