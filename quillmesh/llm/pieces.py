"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A vocabulary file gives the pieces with their scores, which are taken as log scores. A
text's spaces become the marker U+2581 with one more in front. The segmentation is the
one of the greatest sum of scores; a character that no piece covers alone may be unknown,
at the least score less ten, and is then written as its bytes' pieces. Of equal sums the one whose last piece
starts first is taken, as its library does.

No piece of these vocabularies has a marker behind another character (else the file is
refused), so the best segmentation of a text is that of its chunks, a run of markers and what
follows up to the next. Each distinct chunk of a batch is segmented once, all of them at a time,
in numpy steps along the trie.

Defined cases: null is the empty text, which has no pieces; a marker character in a text decodes to a
space, any other text decodes to itself; control pieces decode to nothing and invalid
UTF-8 from byte pieces to U+FFFD; very long chunks are segmented whole; equal rows have
equal results; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.common import freeing

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN_PENALTY = 10.0
CACHE = 32 << 20  # bytes, ENTRY and its text for each, of the chunks that a worker keeps with their ids; above it, it starts anew
ENTRY = 200
CELLS = 1_000_000  # of a padded group of chunks
PART = 256  # texts that are encoded together

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # fixed values: the kinds of pieces


@dataclass
class Vocabulary:
    """Pieces by id, and the double array: the child of node x by byte c is base[x] + c where check of it is x."""

    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # the id of the piece that ends at a node, or -1

    @property
    def unknown_score(self) -> float:
        return float(min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0)) - UNKNOWN_PENALTY


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie of distinct keys; the root is 0."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, ident in keys:
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = ident
    size = 1 << 12
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = bytearray(size)
    used[0] = 1
    place, todo, free, roomy = {0: 0}, [0], 1, 1
    while todo:
        node = todo.pop()
        at = place[node]
        value[at] = ends[node]
        order = sorted(children[node])
        if not order:
            base[at] = -1
            continue
        low, slot, tries = order[0], free if len(order) == 1 else roomy, 0
        while True:
            slot = used.find(0, max(slot, low))  # where the first child may go
            if slot < 0 or slot + 256 >= size:
                base, check, value = (np.concatenate([x, np.full(size, f, np.int64)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                used += bytes(size)
                slot = size - 256 if slot < 0 else slot
                size *= 2
                continue
            if not any(used[slot - low + c] for c in order):
                break
            slot += 1
            tries += 1
        if len(order) == 1:
            free = max(free, slot - 256)
        elif tries > 32:
            roomy = slot  # below, the array is nearly full
        base[at] = slot - low
        for c in order:
            used[slot - low + c] = 1
            check[slot - low + c] = at
            place[children[node][c]] = slot - low + c
            todo.append(children[node][c])
    return base, check, value


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kind = lambda i: BYTE if model.is_byte(i) else CONTROL if model.is_control(i) else UNKNOWN if model.is_unknown(i) else UNUSED if model.is_unused(i) else NORMAL
    return vocabulary([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(n)])


def vocabulary(rows: list[tuple[str, float, int]]) -> Vocabulary:
    """rows (piece, score, kind) in id order."""
    if any(k == NORMAL and MARK in p.lstrip(MARK) for p, _, k in rows):
        raise ValueError("a piece has a marker behind another character")
    if len(rows) > 1 << 16:
        raise ValueError("ids must fit in 16 bits")
    if sum(k == BYTE for *_, k in rows) != 256:
        raise ValueError("byte fallback needs the 256 byte pieces")
    arrays = double_array([(p.encode(), i) for i, (p, _, k) in enumerate(rows) if k == NORMAL])
    return Vocabulary([p for p, *_ in rows], np.array([s for _, s, _ in rows]), [k for *_, k in rows], *arrays)


def _char_size(first: np.ndarray) -> np.ndarray:
    return 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)


class Codec:
    """Encodes and decodes with one vocabulary; keeps what it has segmented."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.v = vocab
        self.unknown = vocab.unknown_score
        by = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(vocab.pieces, vocab.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [by[b] for b in range(256)]
        surface = lambda p, k: bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
        self.surface = [surface(p, k) for p, k in zip(vocab.pieces, vocab.kinds, strict=True)]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def segment(self, chunks: list[bytes]) -> list[list[int]]:
        """The best segmentation of each chunk."""
        out: list[list[int]] = [[] for _ in chunks]
        order = sorted(range(len(chunks)), key=lambda k: len(chunks[k]))
        at = 0
        while at < len(order):
            high = at
            while high < len(order) and (high == at or (high + 1 - at) * (len(chunks[order[high]]) + 1) <= CELLS):
                high += 1
            part = order[at:high]
            for k, ids in zip(part, self._group([chunks[k] for k in part]), strict=True):
                out[k] = ids
            at = high
        return out

    def _group(self, chunks: list[bytes]) -> list[list[int]]:
        v, n = self.v, len(chunks)
        size = np.array([len(c) for c in chunks])
        width = int(size.max(initial=0))
        data = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8).reshape(n, width).astype(np.int64)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        start, ident = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        top = len(v.check) - 1

        def offer(row: np.ndarray, s: int, end: np.ndarray | int, score: np.ndarray, what: np.ndarray | int) -> None:
            better = score > best[row, end]
            row = row[better]
            end = end[better] if isinstance(end, np.ndarray) else end
            best[row, end], start[row, end] = score[better], s
            ident[row, end] = what[better] if isinstance(what, np.ndarray) else what

        for s in range(width):
            row = np.flatnonzero((s < size) & (best[:, s] > -np.inf))
            if not len(row):
                continue
            char = _char_size(data[row, s])
            alone, mine, node = np.zeros(len(row), bool), np.arange(len(row)), np.zeros(len(row), np.int64)
            for e in range(s, width):
                base = v.base[node]
                child = np.minimum(base + data[row[mine], e], top)
                on = (base >= 0) & (v.check[child] == node) & (e < size[row[mine]])
                mine, node = mine[on], child[on]
                if not len(mine):
                    break
                piece = v.value[node]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    at = mine[hit]
                    offer(row[at], s, e + 1, best[row[at], s] + v.scores[piece[hit]], piece[hit])
                    alone[at[char[at] == e + 1 - s]] = True
            lack = np.flatnonzero(~alone)
            if len(lack):
                offer(row[lack], s, np.minimum(s + char[lack], size[row[lack]]), best[row[lack], s] + self.unknown, -1)
        out = []
        for c, end, starts, ids in zip(chunks, size.tolist(), start, ident, strict=True):
            found: list[int] = []
            while end:
                s, i = int(starts[end]), int(ids[end])
                if i >= 0:
                    found.append(i)
                else:
                    found += [self.byte_ids[b] for b in reversed(c[s:end])]
                end = s
            out.append(found[::-1])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 16-bit integers."""
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = [c for c in {c for x in cut for c in x} if c not in self.known]
        for c, ids in zip(new, self.segment([c.encode() for c in new]), strict=True):
            self.known[c] = np.array(ids, dtype="<u2").tobytes()
            self.held += ENTRY + len(c)
        get = self.known.__getitem__
        out = [b"".join(map(get, x)) for x in cut]
        if self.held > CACHE:
            self.known, self.held = {}, 0
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " and ids and self.v.pieces[ids[0]][:1] == MARK else text


_CODECS: dict[object, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def with_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids, the pieces of each text, and decoded, the text that they decode to; a task holds a few hundred texts at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary of at most 65,536 pieces
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for whole in batches:
            for low in range(0, whole.num_rows, PART):
                batch = whole.slice(low, PART)
                found = codec.encode(batch.column(batch.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *(len(x) // 2 for x in found)]).astype(np.int32)
                flat = np.frombuffer(b"".join(found), "<u2").astype(np.int32)
                decoded = pa.array([codec.decode(np.frombuffer(x, "<u2").tolist()) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), decoded], names=schema.names)

    return docs.select(*kept, F.col(text).alias("_coded")).mapInArrow(freeing(run), schema)


DIGEST = "n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def op10_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces as digests, and whether they decode to the text."""
    import public_tokenizers

    from quillmesh.llm.common import table

    shared = spark.sparkContext.broadcast(load(public_tokenizers.path("piece_bpe_32k.model")))

    @F.pandas_udf(DIGEST)
    def digest(texts):
        import pandas as pd

        codec, values, rows = _codec(shared), texts.tolist(), []
        low, high = min(codec.byte_ids), max(codec.byte_ids)
        for at in range(0, len(values), PART):
            part = values[at : at + PART]
            for text, x in zip(part, codec.encode(part), strict=True):
                ids = np.frombuffer(x, "<u2")
                back = codec.decode(ids.tolist())
                rows.append((len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])

    return table(spark, sf_dir, "documents").select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
