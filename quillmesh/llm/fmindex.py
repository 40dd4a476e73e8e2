"""Benchmark decontamination with an FM-index of each training shard.

A task gathers documents into shards of about `SHARD_WORDS` words, counted as `WORD_BYTES` each. A shard's text is
its words as symbols: a benchmark word is its number, and a run of other words, like
the end of a document, is one shared symbol, which no test phrase has. The shard's
suffixes are sorted, its Burrows-Wheeler transform goes into a wavelet matrix whose
ranks answer backward search for all test phrases at once, and occurrences are located
by walking back to sampled suffix positions. Their word ranges merge into removal spans.

Test phrases are all windows of `WINDOW` consecutive words of each item; an item with
fewer words, but not none, is one phrase. A benchmark of at most `BLOCK_BYTES` of text is
broadcast. A larger one is written to the shared folder in blocks of about that size, and
each shard is indexed for and searched with one block after the other, so what a task holds is
a shard and a block, however large the benchmark is. There is no shuffle of documents.

Defined cases: null and empty texts have no words and no hits; items with null or empty
texts have no phrases; items that share an id count once; a null item id is the text
"null"; equal rows each get their own result; a document is never divided, so a very
long one is a shard of its own; an empty table on either side gives no hits; further
columns are kept as they are, and those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.common import freeing, shared_path

WINDOW = 10
SHARD_WORDS = 750_000
BLOCK_BYTES = 2 << 20
WORD_BYTES = 6  # of a word and its space, about
SAMPLE = 32  # every so many text positions are stored
END, OTHER = 0, 1  # symbols below the words' numbers

_GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
_TO_SPACE = bytes(32 if _GAP.match(bytes([b])) else b for b in range(256))
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # in text that is not lower-cased

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().translate(_TO_SPACE).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; each round sorts only what is not yet told apart. s ends with its unique least symbol."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for i in range(depth):
        key <<= bits
        key[: n - i] |= s[i:] if i else s
    sa = np.argsort(key).astype(np.int32)
    head = np.empty(n, dtype=bool)
    key = key[sa]
    head[0], head[1:] = True, key[1:] != key[:-1]
    del key
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    while True:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return sa
        at = sa[slots]
        later = at + depth
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.append(True, np.diff(key) != 0)
        head[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        depth *= 2


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8)).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of any symbol, one bit of it a level, the highest first."""

    def __init__(self, s: np.ndarray) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(s.max()).bit_length()) - 1, -1, -1):
            bit = (s >> shift) & 1 == 1
            zeros = s[~bit]
            self.levels.append((shift, Bits(bit), len(zeros)))
            s = np.concatenate([zeros, s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before position i."""
        low = np.zeros(len(c), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one = (c >> shift) & 1 == 1
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        c, low = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(i) == 1
            a, b = bits.rank(low), bits.rank(i)
            c |= one.astype(np.int64) << shift
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return c, i - low


class FMIndex:
    """Backward search and location over a sequence of symbols that has no END of its own."""

    def __init__(self, symbols: np.ndarray) -> None:
        s = np.append(symbols, END).astype(np.int32)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.size = len(s)
        self.tree = WaveletMatrix(bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s))])
        sampled = sa % SAMPLE == 0
        self.marked, self.samples = Bits(sampled), sa[sampled]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: rows of symbols, each row's last ``sizes`` columns in use -> (row, low, high) of those that occur."""
        row = np.arange(len(phrases))
        low, high = np.zeros(len(row), np.int64), np.full(len(row), self.size, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero(sizes[row] >= back)
            c = phrases[row[on], -back].astype(np.int64)
            known = c < len(self.first) - 1
            on, c = on[known], c[known]
            dead = sizes[row] >= back
            dead[on] = False
            high[dead] = low[dead]
            low[on] = self.first[c] + self.tree.rank(c, low[on])
            high[on] = self.first[c] + self.tree.rank(c, high[on])
            alive = low < high
            row, low, high = row[alive], low[alive], high[alive]
        return row, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix row."""
        out, at, todo = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(todo):
            found = self.marked.get(at) == 1
            out[todo[found]] = self.samples[self.marked.rank(at[found])] + steps
            todo, at = todo[~found], at[~found]
            c, before = self.tree.access(at)
            at = self.first[c] + before
            steps += 1
        return out


class Phrases:
    """A block of the benchmark: the words' numbers, the distinct phrases and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).add("null" if item is None else str(item))
        self.rows = np.zeros((len(owners), window), dtype=np.int32)
        self.sizes = np.array([len(p) for p in owners], dtype=np.int64)
        for k, p in enumerate(owners):
            self.rows[k, window - len(p) :] = p
        self.names = sorted({x for o in owners.values() for x in o})
        place = {x: k for k, x in enumerate(self.names)}
        self.owner = np.array([place[x] for o in owners.values() for x in sorted(o)], dtype=np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners.values()])]).astype(np.int64)


def _expand(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's members one after another, and the range of each."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[owner], owner


def search_shard(phrases: Phrases, docs: list[np.ndarray]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """docs: each one's words as symbols -> each one's merged ranges of hit words, and its items."""
    hits: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[list[str]] = [[] for _ in docs]
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # a separator after each document
    text = np.full(int(begin[-1]), OTHER, dtype=np.int32)
    for d, at in zip(docs, begin.tolist(), strict=False):
        text[at : at + len(d)] = d
    kept = np.flatnonzero((text != OTHER) | np.append(True, text[:-1] != OTHER))
    if not len(phrases.sizes) or not (text != OTHER).any():
        return hits, items
    index = FMIndex(text[kept])
    row, low, high = index.search(phrases.rows, phrases.sizes)
    rows, which = _expand(low, high - low)
    start = kept[index.locate(rows)]
    phrase = row[which]
    change = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + phrases.sizes[phrase], -1)
    edge = np.flatnonzero(np.diff(np.cumsum(change[:-1]) > 0, prepend=False, append=False))
    doc = np.searchsorted(begin, edge[0::2], side="right") - 1
    for d, a, b in zip(doc.tolist(), (edge[0::2] - begin[doc]).tolist(), (edge[1::2] - begin[doc]).tolist(), strict=True):
        hits[d].append((a, b))
    met = np.unique((np.searchsorted(begin, start, side="right") - 1) * len(phrases.sizes) + phrase)  # a phrase counts once in a document
    owner, phrase = met // len(phrases.sizes), met % len(phrases.sizes)
    slots, which = _expand(phrases.owner_at[phrase], np.diff(phrases.owner_at)[phrase])
    pairs = np.unique(owner[which] * len(phrases.names) + phrases.owner[slots])
    for p in pairs.tolist():
        items[p // len(phrases.names)].append(phrases.names[p % len(phrases.names)])
    return hits, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted([*a, *b]):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _block_file(folder: str, block: int) -> str:
    return f"{folder}/block={block}"


def _blocks(folder: str, n: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items of each block of a benchmark in the shared folder, one block after the other."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for block in range(n):
        path = _block_file(folder, block)
        store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        if store.get_file_info(at).type == fs.FileType.Directory:  # a block may be empty
            yield [tuple(r.values()) for r in pq.read_table(at, filesystem=store, columns=["item_id", "text"]).to_pylist()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, hits (ranges of hit words, end exclusive) and items (ids as strings, sorted) to docs (text, ...)."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    kept = [c for c in docs.columns if c not in RESULT.names]
    schema = T.StructType([*docs.select(*kept).schema.fields, *RESULT.fields])
    if n_blocks == 1:
        held = spark.sparkContext.broadcast(Phrases([tuple(r) for r in items.collect()], window))  # of at most block_bytes
        each = lambda: iter([held.value])
    else:
        folder = shared_path(spark, "benchmark")
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int")
        items.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(folder)
        each = lambda: (Phrases(x, window) for x in _blocks(folder, n_blocks))
    return docs.select(*kept).mapInArrow(freeing(_search(each, shard_words)), schema)


def _search(each, shard_words: int):
    """each: gives the blocks of phrases, one after the other."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            n = sum(b.num_rows for b in held)
            sizes, hits, items = [0] * n, [[] for _ in range(n)], [set() for _ in range(n)]
            for phrases in each():
                get, symbols = phrases.numbers.get, []
                for batch in held:
                    for text in batch.column(batch.schema.names.index("text")).to_pylist():
                        w = words_of(text)
                        symbols.append(np.fromiter(map(get, w, repeat(OTHER)), dtype=np.int32, count=len(w)))
                sizes = list(map(len, symbols))
                for k, (spans, names) in enumerate(zip(*search_shard(phrases, symbols), strict=True)):
                    if spans:
                        hits[k] = _merged(hits[k], spans)
                        items[k].update(names)
            at = 0
            for batch in held:
                high = at + batch.num_rows
                new = [
                    pa.array(sizes[at:high], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in hits[at:high]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(x) for x in items[at:high]], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *RESULT.names])
                at = high

        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                held.append(batch)
                text = batch.column(batch.schema.names.index("text"))
                words += pa.compute.sum(pa.compute.binary_length(text)).as_py() or 0
                if words >= WORD_BYTES * shard_words:
                    yield from flush()
                    held.clear()
                    words = 0
        if held:
            yield from flush()

    return search


def without_spans(text: str | None, hits: list) -> str | None:
    """The text without each hit range, from its first word's start to its last word's end."""
    if not hits or text is None:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in hits:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with the found spans cut out of their texts; clean texts stay as they are."""

    @F.pandas_udf("string")
    def cut(texts, hits):
        import pandas as pd

        return pd.Series([without_spans(t, [(x["start"], x["end"]) for x in h]) for t, h in zip(texts, hits, strict=True)], dtype=object)

    work = docs.select(F.col("text"), F.struct(*docs.columns).alias("row"))
    found = find_leaks(work, benchmark, **options)
    return found.select(F.col("row"), F.when(F.size("hits") > 0, cut("text", "hits")).otherwise(F.col("text")).alias("text")).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op6_fm_index(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    from quillmesh.llm.common import table

    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


# DuckDB: a window's words joined by spaces are its key; a document's window starts are joined with the items' keys.
OP6_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS key FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
cand AS (SELECT rid, size, k, array_to_string(w[k : k + size - 1], ' ') AS key FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(k)),
hit AS (SELECT rid, cand.size, k, item FROM cand JOIN win ON cand.size = win.size AND cand.key = win.key),
places AS (SELECT DISTINCT rid, k + j AS p FROM hit, unnest(range(0, size)) AS u(j)),
n AS (SELECT rid, count(*) AS n_hit FROM places GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)"""
