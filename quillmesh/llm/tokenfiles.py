"""Token ids in Arrow's random-access file format, as batches of equal-length sequences.

Documents are ranged by id over partitions; each task encodes its texts in id order
and writes one Arrow file to a folder that all executors share. A row of a file is a
sequence: ``doc_id``, its number in the document, a fixed-size list of unsigned
16-bit ids, and a mask, a fixed-size list of booleans. Buffers are not compressed, so
a reader maps a file and slices any sequence without a copy (`sequences`).

A file is written under a temporary name and then moved into place, and its content
depends on its rows alone, so a task that runs again on another executor is harmless.

Defined cases: a null text is the empty text and an empty text gives the end id alone;
documents are in ascending id order with null ids first and equal ids by text; equal
rows each get their own sequences; an empty table gives no files and an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm import common

SEQUENCE = 256  # ids in a sequence
ROWS = 2048  # sequences in a record batch
END_ID = 2
MARKS = string.punctuation
LINES = 512  # chunks that are encoded together
CACHE = 192 << 20  # bytes, at about ENTRY each, of the chunks that a worker keeps with their ids; above it, it starts anew
ENTRY = 200
PART_BYTES = 64 << 20  # of the table's estimated size for each file

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("number", pa.int32()),
        ("ids", pa.list_(pa.uint16(), SEQUENCE)),
        ("mask", pa.list_(pa.bool_(), SEQUENCE)),
    ]
)
MANIFEST = "file int, path string, n_docs long, n_tokens long"

_OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: what a text that can be cut does not hold, for RE2
_UNCUT = rf"[\x00{_OTHER_SPACE}]|  | \n|\n |\n\n\n|\A[ \n]|[ \n]\z"
_IS_MARK, _IS_LETTER = (np.isin(np.arange(256), list(x.encode())) for x in (MARKS, string.ascii_letters))


def _chunks(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of plain texts one after the other, as a dictionary of the distinct ones, and where each text begins among them, with their number last."""
    encoded = [t.encode() for t in texts]
    joined = b"".join(encoded)
    data = np.frombuffer(joined, dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in encoded], dtype=np.int64)])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[:-1] = (data == 0x20) | (data == 0x0A)
    cut[1:] |= data == 0x0A
    cut[begins] = True
    mark = _IS_MARK[data]
    first, last = mark.copy(), mark.copy()
    first[1:] &= ~mark[:-1] | cut[1:-1]
    last[:-1] &= ~mark[1:] | cut[1:-1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1  # of each run of punctuation
    at = at[~cut[at] & cut[end]]
    before = data[at - 1]
    letter = _IS_LETTER[before] | ((data[at - 2] == 0xC3) & (before != 0x97) & (before != 0xB7))  # U+00C0 to U+00FF without their two signs
    cut[at[letter]] = True
    offsets = np.flatnonzero(cut).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(joined))
    return chunks.dictionary_encode(), np.searchsorted(offsets, begins)


class Encoder:
    """Encodes texts with the tokenizers library, each distinct chunk of a worker once.

    A byte-level vocabulary's pre-tokenizer breaks before every single space and around
    one or two line ends that stand between other characters, so where these are a text's
    only white space, what lies between the breaks can be encoded apart, and so can
    the punctuation that ends it behind a Latin letter. Any other text is encoded as a whole, and so is
    one that holds the string of a special token, which the library makes one id.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.newline = self._ids("\n")
        self.fixed = {c: self._bytes(c) for c in ("\n", *MARKS)}
        self.known: dict[str, bytes] = dict(self.fixed)
        self.held = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets, which nothing reads

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), dtype=np.uint16).tobytes()

    def plains(self, texts: list[str]) -> list[bool]:
        """Whether each text can be cut before its spaces and around its line ends."""
        pattern = "|".join([_UNCUT, *map(re.escape, self.special)])
        return pc.invert(pc.match_substring_regex(pa.array(texts, pa.large_string()), pattern)).to_pylist()

    def learn(self, chunks: list[str]) -> None:
        """Encodes what is not known yet, many chunks together, one a line."""
        new = [c for c in chunks if c not in self.known]
        for low in range(0, len(new), LINES):
            part = new[low : low + LINES]
            ids = np.array(self._ids("\n".join(part)), dtype=np.uint16)
            cuts = np.flatnonzero(ids == self.newline[0]) if len(self.newline) == 1 else np.zeros(0, int)
            if len(cuts) == len(part) - 1:
                begin = [0, *(2 * cuts + 2).tolist()]
                end = [*(2 * cuts).tolist(), 2 * len(ids)]
                data = ids.tobytes()
                self.known.update(zip(part, [data[a:b] for a, b in zip(begin, end, strict=True)], strict=True))
            else:
                self.known |= {c: self._bytes(c) for c in part}
        self.held += ENTRY * len(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 16-bit integers."""
        plain = self.plains(texts)
        coded, bounds = _chunks([t for t, ok in zip(texts, plain, strict=True) if ok])
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        ids = pa.array(list(map(self.known.__getitem__, words)), pa.large_binary()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])[bounds].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        cut = (bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False))
        whole = iter(self.tokenizer.encode_batch_fast([t for t, ok in zip(texts, plain, strict=True) if not ok], add_special_tokens=False))
        out = [next(cut) if ok else np.array(next(whole).ids, dtype=np.uint16).tobytes() for ok in plain]
        if self.held > CACHE:
            self.known, self.held = dict(self.fixed), 0
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sequences(ids: list[int | None], encoded: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(x) // 2 for x in encoded], dtype=np.int64)
    rows = -(-lengths // SEQUENCE)
    first = np.concatenate([[0], np.cumsum(rows)])
    flat = np.zeros(int(first[-1]) * SEQUENCE, dtype="<u2")
    mask = np.zeros(len(flat), dtype=bool)
    for x, at, n in zip(encoded, first.tolist(), lengths.tolist(), strict=False):
        flat[at * SEQUENCE : at * SEQUENCE + n] = np.frombuffer(x, dtype="<u2")
        mask[at * SEQUENCE : at * SEQUENCE + n] = True
    owner = np.repeat(np.arange(len(ids)), rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()).take(pa.array(owner)),
            pa.array((np.arange(len(owner)) - first[:-1][owner]).astype(np.int32)),
            pa.FixedSizeListArray.from_arrays(pa.array(flat), SEQUENCE),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE),
        ],
        schema=SCHEMA,
    )


def write_files(docs: DataFrame, folder: str, vocabulary: str, partitions: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) and writes their files into ``folder``.

    Returns the manifest, a row for each file in id order: file, path, n_docs, n_tokens.
    Its rows are as many as the files.
    """
    n = partitions or common.partitions(docs, PART_BYTES)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        name = f"{at}/part-{number:05d}.arrow"
        docs_n = tokens_n = 0
        end, sink, out = np.array([END_ID], dtype="<u2").tobytes(), None, None
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                encoded = [x + end for x in encoder(vocabulary).encode(part.column(1).to_pylist())]
                if sink is None:
                    sink = store.open_output_stream(f"{name}.{attempt}")
                    out = pa.ipc.new_file(sink, SCHEMA)
                rows = _sequences(part.column(0).to_pylist(), encoded)
                for k in range(0, rows.num_rows, ROWS):
                    out.write_batch(rows.slice(k, ROWS))
                docs_n += part.num_rows
                tokens_n += sum(map(len, encoded)) // 2
        if sink is not None:
            out.close()
            sink.close()
            store.move(f"{name}.{attempt}", name)
            path = f"{folder.rstrip('/')}/part-{number:05d}.arrow"
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), pa.array([docs_n]), pa.array([tokens_n])], names=["file", "path", "n_docs", "n_tokens"])

    return ordered.mapInArrow(common.freeing(write), MANIFEST)


def sequences(path: str, rows: slice | None = None) -> pa.Table:
    """A file's sequences, mapped and not copied where the file is local."""
    store, at = _store(path)
    local = store.type_name == "local"
    reader = pa.ipc.open_file(pa.memory_map(at) if local else store.open_input_file(at))
    found = reader.read_all()
    return found if rows is None else found.slice(rows.start or 0, (rows.stop or found.num_rows) - (rows.start or 0))


def _documents_of(path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, offset in the file, n_tokens and crc of each document, a record batch at a time."""
    store, at = _store(path)
    reader = pa.ipc.open_file(pa.memory_map(at) if store.type_name == "local" else store.open_input_file(at))
    doc, offset, size, crc, begun = None, 0, 0, 0, False
    found: list[list] = [[], [], [], []]

    def put() -> None:
        for column, value in zip(found, (doc, offset, size, crc), strict=True):
            column.append(value)

    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column(2).flatten().to_numpy().astype("<u4")
        used = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, SEQUENCE).sum(axis=1).tolist()
        for row, (owner, number) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if number == 0:
                if begun:
                    put()
                    offset += size
                doc, size, crc, begun = owner, 0, 0, True
            crc = zlib.crc32(ids[row * SEQUENCE : row * SEQUENCE + used[row]].tobytes(), crc)
            size += used[row]
        if len(found[0]) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), *(pa.array(x, pa.int64()) for x in found[1:])], names=["doc_id", "offset", "n_tokens", "ids_crc32"])
            found = [[], [], [], []]
    if begun:
        put()
    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), *(pa.array(x, pa.int64()) for x in found[1:])], names=["doc_id", "offset", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """manifest -> doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in _documents_of(path):
                    start = pc.add(found.column(1), before)
                    yield pa.RecordBatch.from_arrays([found.column(0), start, found.column(2), found.column(3)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.repartitionByRange(max(1, manifest.count()), "file").select("path", "before")
    return spread.mapInArrow(common.freeing(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded and written to the shared folder, then read back."""
    import public_tokenizers

    from quillmesh.llm.common import shared_path, table, written

    docs = table(spark, sf_dir, "documents")
    manifest = written(write_files(docs, shared_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")), "manifest")
    return read_documents(manifest)
