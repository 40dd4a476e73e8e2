"""Alignment of two tokenizers over the same bytes by sparse incidence products.

A text's tokens by tokenizer A and by tokenizer B cover the same bytes. The incidence matrices of
tokens by bytes are kept as CSR arrays built here, and their product A·Bᵀ is formed row by row
(Gustavson): each byte of an A token brings in the B tokens of that byte, and equal columns add up to
the number of shared bytes. Its entries are the overlap links. Offsets where both
tokenizers end a token cut the text into groups; the product of the incidences of tokens by groups has the
shared-group links, and its row sizes alone (the symbolic phase) give their number.

The links that are counted over the corpus are the overlaps whose byte ranges end together. Of two such
tokens one is a suffix of the other, so there are no more id pairs than the vocabularies have suffixes that are
tokens (`possible_pairs`: fewer than a million for two of about 50,000), however large the corpus; only their counts
are broadcast.

Both tokenizers break before every single space and on both sides of a line end, and before a comma or full stop that
ends a word. So where spaces and line ends are a text's only white space (`tokenfiles.Encoder.plains`), it is
aligned by chunks that begin with one, each distinct one of a worker once; any other text is aligned whole, block
by block of about `BLOCK` bytes between two cuts.

Defined cases: null and empty texts have no tokens, nor have texts whose bytes a tokenizer does not give
back (such as ones that hold U+2581); strings of special tokens are plain text; equal rows have equal results; a
null doc_id is a document like any other; an empty table gives an empty result; very long texts are taken
whole; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm import tokenfiles
from quillmesh.llm.common import freeing, written

MARK = "▁"
BLOCK = 1 << 20  # bytes that are multiplied at once
CACHE = 128 << 20  # bytes, at about ENTRY each, of the chunks that a worker keeps with their links
ENTRY = 450
PART = 128  # texts that are encoded together
_FIELD = 40  # bits of a count in a chunk's packed counts
_MASK = (1 << _FIELD) - 1

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_shared long, links binary, groups_sha256 string"
FULL = "doc_id long, a array<int>, b array<int>, groups array<struct<a:int,b:int,bytes:int>>, overlaps array<struct<a:int,b:int,bytes:int,together:boolean>>, shared array<struct<a:int,b:int>>"


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, .. of size[k] each, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def row_sizes(p: np.ndarray, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many terms each row of P·Q adds up, from P (row starts p, columns x) and the row starts q of Q."""
    terms = np.concatenate([[0], np.cumsum(q[x + 1] - q[x])])
    return terms[p[1:]] - terms[p[:-1]]


def row_products(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P·Q of two 0/1 matrices in CSR, (row starts, columns) each -> row starts, columns in order and counts."""
    size = q[x + 1] - q[x]
    column = y[_ranges(q[x], size)]
    row = np.repeat(np.arange(len(p) - 1), row_sizes(p, x, q))
    if len(row) and not ((np.diff(row) > 0) | (np.diff(column) >= 0)).all():
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
    head = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(column) != 0))) if len(row) else np.zeros(0, int)
    return np.searchsorted(row[head], np.arange(len(p))), column[head], np.diff(np.append(head, len(row)))


def transposed(p: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The transpose, of n rows, of a matrix in CSR."""
    order = np.argsort(x, kind="stable")
    return np.searchsorted(x[order], np.arange(n + 1)), np.repeat(np.arange(len(p) - 1), np.diff(p))[order]


def by_bytes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of ``size`` bytes, one behind the other -> the CSR incidence of tokens by bytes."""
    p = np.concatenate([[0], np.cumsum(size)])
    return p, np.arange(int(p[-1]))


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: visible Latin-1 letters are themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def a_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    letters = byte_letters()
    out = [b""] * tokenizer.get_vocab_size()
    for piece, i in tokenizer.get_vocab().items():
        out[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


def b_bytes(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary with byte pieces."""
    ids = range(model.get_piece_size())
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in ids]


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids may end together: one's bytes are a suffix of the other's."""
    of: dict[bytes, list[int]] = {}
    for side, tokens in enumerate((a, b)):
        for t in tokens:
            of.setdefault(t, [0, 0])[side] += 1
    total = 0
    for t, (x, y) in of.items():
        total += x * y
        for k in range(1, len(t)):
            u, v = of.get(t[k:], (0, 0))
            total += x * v + y * u
    return total


class _Spaced(tokenfiles.Encoder):
    """Encodes with the strings of special tokens as plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = ()

    def lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without line ends, each with the space before it if it has one: flat, and how many each has."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(ids == self.newline[0]) if len(self.newline) == 1 else np.zeros(0, int)
        if len(cuts) == len(lines) - 1:
            ends = np.append(cuts, len(ids))
            return np.delete(ids, cuts), np.diff(ends - np.arange(len(ends)), prepend=0)
        found = [x.ids for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found])


class Aligner:
    """Aligns texts with two vocabularies; keeps the chunks that it has aligned."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = _Spaced(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = a_bytes(self.a.tokenizer), b_bytes(self.b)
        self.size_a, self.size_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        #: whether no piece goes on from a letter to a comma or full stop, and none holds a line end
        self.apart = not any(p[k - 1].isalpha() and p[k] in ",." for p in map(self.b.id_to_piece, range(len(self.bytes_b))) for k in range(1, len(p)))
        if any(b"\n" in x and len(x) > 1 for x in self.bytes_b):
            raise ValueError("a piece holds a line end and more")
        one, two = (np.array([self.a._ids(c)[0] for c in "\n,."]), np.array([self.b.encode("\n" + c)[-1] for c in ("", ",", ".")]))
        self.fixed: dict[str, tuple[str, bytes, int] | None] = dict(zip("\n,.", self._digests(one, two, np.arange(1, 4)), strict=True))
        self.known = dict(self.fixed)

    def _same(self, data: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b))

    def matrices(self, a: np.ndarray, b: np.ndarray):
        """(cuts, last A and last B token of each group, group of each A and B token, A·Bᵀ as CSR, which overlaps end together) of tokens that cover the same bytes."""
        size_a, size_b = self.size_a[a], self.size_b[b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        p, x = by_bytes(size_a)
        q, y = transposed(*by_bytes(size_b), int(p[-1]))
        ptr, col, n = row_products(p, x, q, y)
        together = np.repeat(end_a, np.diff(ptr)) == end_b[col]
        return cuts, np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts), np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), (ptr, col, n), together

    def _digests(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray) -> list[tuple[str, bytes, int]]:
        """(groups, links, packed counts) of the token sequences (a, b) whose last A tokens are before ``end_a``, all in one product."""
        cuts, last_a, last_b, in_a, in_b, (ptr, col, _), together = self.matrices(a, b)
        # groups by tokens, and how many A and B tokens share one
        shares = np.concatenate([[0], np.cumsum(row_sizes(np.arange(len(a) + 1), in_a, np.searchsorted(in_b, np.arange(len(cuts) + 1))))])
        row = np.repeat(np.arange(len(a)), np.diff(ptr))[together]
        links = ((b[col[together]].astype(np.uint32) << np.uint32(16)) | a[row].astype(np.uint32)).astype("<u4").tobytes()
        names = self.names
        text_a, text_b = [names[i] for i in a.tolist()], [names[i] for i in b.tolist()]
        groups, i, j = [], 0, 0
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            groups.append(f"{text_a[i]}|{text_b[j]}" if x - i == 1 == y - j else ",".join(text_a[i:x]) + "|" + ",".join(text_b[j:y]))
            i, j = x, y
        group = np.searchsorted(last_a, end_a - 1) + 1
        end_b = last_b[group - 1] + 1
        bounds = [np.concatenate([[0], x]) for x in (end_a, end_b, group, ptr[end_a], shares[end_a], 4 * np.searchsorted(row, end_a))]
        counts = [np.diff(x).tolist() for x in bounds[:5]]
        at, cut = bounds[2].tolist(), bounds[5].tolist()
        packed = [n | m << _FIELD | g << 2 * _FIELD | o << 3 * _FIELD | h << 4 * _FIELD for n, m, g, o, h in zip(*counts, strict=True)]
        return [(";".join(groups[at[k] : at[k + 1]]), links[cut[k] : cut[k + 1]], c) for k, c in enumerate(packed)]

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tokens in blocks of about BLOCK bytes, each up to a cut."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        i = j = 0
        while i < len(a):
            least = (int(end_a[i - 1]) if i else 0) + BLOCK
            cut = cuts[min(np.searchsorted(cuts, least), len(cuts) - 1)]
            x, y = int(np.searchsorted(end_a, cut)) + 1, int(np.searchsorted(end_b, cut)) + 1
            yield a[i:x], b[j:y]
            i, j = x, y

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each whole text by both, or None where they do not give its bytes back."""
        one = [x.ids for x in self.a.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        two = self.b.encode(texts, num_threads=1)
        fits = (self._same(b" " + t.encode(), a, b) if t else False for t, a, b in zip(texts, one, two, strict=True))
        return [(np.array(a, np.int64), np.array(b, np.int64)) if ok else None for ok, a, b in zip(fits, one, two, strict=True)]

    def _lines(self, lines: list[str], begin: str) -> list[tuple[str, bytes, int] | None]:
        """What `digests` has for words without line ends; for ``begin`` a line end they stand behind one, and it is not counted."""
        found: list[tuple[str, bytes, int] | None] = []
        for low in range(0, len(lines), 4096):
            part = lines[low : low + 4096]
            a, n = self.a.lines(part)
            skip = 2 if begin == "\n" else 0  # the marker that is put in front, and the line end
            two = self.b.encode([begin + c if skip else c[1:] for c in part], num_threads=1)
            b = np.array([i for x in two for i in x[skip:]], np.int64)
            m = np.array([len(x) - skip for x in two])
            data = [c.encode() for c in part]
            size = np.array([len(d) for d in data])
            ends = [np.concatenate([[0], np.cumsum(x)])[np.cumsum(k)] for x, k in ((self.size_a[a], n), (self.size_b[b], m))]
            if (ends[0] == np.cumsum(size)).all() and (ends[1] == ends[0]).all() and self._same(b"".join(data), a.tolist(), b.tolist()):
                found += self._digests(a, b, np.cumsum(n))
                continue
            i = j = 0
            for d, x, y in zip(data, n.tolist(), m.tolist(), strict=True):
                one, other = a[i : i + x], b[j : j + y]
                found.append(self._digests(one, other, np.array([x]))[0] if self._same(d, one.tolist(), other.tolist()) else None)
                i, j = i + x, j + y
        return found

    def _learn(self, chunks: set[str]) -> None:
        """Aligns the chunks that are not known: words behind a space or a line end, a last comma or full stop apart."""
        known = self.known
        new = [c for c in chunks if c not in known]
        stem = lambda c: c[:-1] if self.apart and c[-1] in ",." and c[-2:-1].isalpha() else c
        todo = {c for c in map(stem, new) if c not in known}
        for begin in (" ", "\n"):
            mine = [c for c in todo if c[0] == begin]
            found = self._lines(mine if begin == " " else [c[1:] for c in mine], begin)
            known.update(zip(mine, found if begin == " " else [self._joined([known["\n"], x]) for x in found], strict=True))
        for c in new:
            if c not in known:
                known[c] = self._joined([known[c[:-1]], known[c[-1]]])

    @staticmethod
    def _joined(parts: list[tuple[str, bytes, int] | None]) -> tuple[str, bytes, int] | None:
        if None in parts:
            return None
        groups, links, counts = zip(*parts, strict=True)
        return ";".join(groups), b"".join(links), sum(counts)

    def digests(self, texts: list[str | None]) -> list[tuple[str, bytes, int]]:
        """(sha256 of the groups or '', links as little-endian 32-bit b << 16 | a, packed counts) of each text."""
        plain = self.a.plains([t or "" for t in texts])
        cut = [(" " + t).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:] if t and ok else None for t, ok in zip(texts, plain, strict=True)]
        self._learn({c for x in cut if x is not None for c in x})
        out: list[tuple[str, bytes, int]] = [("", b"", 0)] * len(texts)
        get = self.known.__getitem__
        for k, (t, x) in enumerate(zip(texts, cut, strict=True)):
            found = self._joined(list(map(get, x))) if x is not None else None
            if found is None and t and (ids := self.tokens([t])[0]) is not None:
                found = self._joined([self._digests(a, b, np.array([len(a)]))[0] for a, b in self._blocks(*ids)])
            if found is not None:
                out[k] = (hashlib.sha256(found[0].encode()).hexdigest(), *found[1:])
        if len(self.known) * ENTRY > CACHE:
            self.known = dict(self.fixed)
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two vocabulary files."""
    if (path_a, path_b) not in _ALIGNERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) -> the ids of both, the last tokens and bytes of each group, the overlap links with their shared bytes, and the shared-group links; numbers of tokens count from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = aligner(path_a, path_b)
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = with_ids.tokens([text])[0] if text else None
                row = {"doc_id": ident, "a": [], "b": [], "groups": [], "overlaps": [], "shared": []}
                i = j = base = 0
                for a, b in with_ids._blocks(*ids) if ids is not None else ():
                    cuts, last_a, last_b, in_a, in_b, (ptr, col, n), together = with_ids.matrices(a, b)
                    row["a"] += a.tolist()
                    row["b"] += b.tolist()
                    row["groups"] += [{"a": x + i, "b": y + j, "bytes": z + base} for x, y, z in zip(last_a.tolist(), last_b.tolist(), cuts.tolist(), strict=True)]
                    rows = np.repeat(np.arange(len(a)), np.diff(ptr))
                    row["overlaps"] += [{"a": x + i, "b": y + j, "bytes": m, "together": e} for x, y, m, e in zip(rows.tolist(), col.tolist(), n.tolist(), together.tolist(), strict=True)]
                    ptr, col, _ = row_products(np.arange(len(a) + 1), in_a, *transposed(np.arange(len(b) + 1), in_b, len(cuts)))
                    rows = np.repeat(np.arange(len(a)), np.diff(ptr))
                    row["shared"] += [{"a": x + i, "b": y + j} for x, y in zip(rows.tolist(), col.tolist(), strict=True)]
                    i, j, base = i + len(a), j + len(b), base + int(cuts[-1])
                yield pa.RecordBatch.from_pylist([row], schema=_full_schema())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freeing(run), FULL)


def _full_schema() -> pa.Schema:
    s = [("a", pa.int32()), ("b", pa.int32())]
    return pa.schema(
        [("doc_id", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("groups", pa.list_(pa.struct([*s, ("bytes", pa.int32())]))), ("overlaps", pa.list_(pa.struct([*s, ("bytes", pa.int32()), ("together", pa.bool_())]))), ("shared", pa.list_(pa.struct(s)))]
    )


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) -> the counts, the links and the hash of the groups of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = aligner(path_a, path_b)
        for whole in batches:
            for low in range(0, whole.num_rows, PART):
                batch = whole.slice(low, PART)
                found = with_ids.digests(batch.column(1).to_pylist())
                counts = [pa.array([(c >> (_FIELD * f)) & _MASK for *_, c in found], pa.int64()) for f in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([x for _, x, _ in found], pa.binary()), pa.array([h for h, *_ in found], pa.string())], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freeing(run), ALIGNED)


def _keys(column) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), "<u4")


def pair_counts(rows: DataFrame) -> DataFrame:
    """rows (links) -> key (b << 16 | a), n: the links of each id pair, best: the most of any pair with that b. Each task adds up its own first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            key, at = np.unique(keys, return_inverse=True)
            return key, np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)

        for batch in batches:
            for low in range(0, batch.num_rows, PART):
                held.append(np.unique(_keys(batch.column(0).slice(low, PART)), return_counts=True))
                if sum(len(k) for k, _ in held) > 1 << 21:
                    held = [merged()]
        if held:
            key, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["key", "n"])

    parts = rows.select("links").mapInArrow(freeing(tally), "key long, n long")
    sums = parts.groupBy("key").agg(F.sum("n").alias("n"))
    return sums.withColumn("best", F.max("n").over(Window.partitionBy(F.shiftrightunsigned("key", 16))))


def with_counts(rows: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """rows with n_links, n_best and count_sum in place of the links; ``most`` is the proven number of pairs."""
    spark = rows.sparkSession
    found = pairs.select("key", "n", "best").orderBy("key").toArrow()
    if found.num_rows > most:
        raise ValueError("more pairs than the vocabularies allow")
    shared = spark.sparkContext.broadcast(tuple(found.column(k).to_numpy().astype(t) for k, t in enumerate((np.uint32, np.int64, np.int64))))
    kept = [c for c in rows.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, PART):
                batch = whole.slice(low, PART)
                links = batch.column(batch.num_columns - 1)
                size = np.array([len(x or b"") // 4 for x in links.to_pylist()], np.int64)
                at = np.searchsorted(key, _keys(links)) if len(key) else np.zeros(0, np.int64)
                ends = np.cumsum(size)
                count, top = (np.concatenate([[0], np.cumsum(x)]) for x in (n[at], (n[at] == best[at]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size), pa.array(top[ends] - top[ends - size]), pa.array(count[ends] - count[ends - size])], names=[*kept, "n_links", "n_best", "count_sum"])

    schema = rows.select(*kept).schema.add("n_links", "long").add("n_best", "long").add("count_sum", "long")
    return rows.select(*kept, "links").mapInArrow(freeing(run), schema)


def link(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) -> the counts of each row, scored by the counts of its id pairs over all rows."""
    with_ids = aligner(path_a, path_b)
    most = possible_pairs(with_ids.bytes_a, with_ids.bytes_b)
    _ALIGNERS.clear()  # the driver needs it no more
    rows = written(aligned(docs, path_a, path_b), "aligned")
    pairs = written(pair_counts(rows), "pairs")
    return with_counts(rows, pairs, most)


def op13_token_links(spark, sf_dir: str) -> DataFrame:
    """Every document's two tokenizations, aligned."""
    import public_tokenizers

    from quillmesh.llm.common import table

    found = link(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")
