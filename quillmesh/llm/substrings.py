"""Substring dedup by seed and extend: every word of a repeated passage but its first copy's.

A window is `LENGTH` consecutive words of one document. A window repeats where its words
also start earlier: in a document with a smaller id, or sooner in the same one.

Seeds are winnowed anchors: of the `SEED`-word runs in a window, the one with the least
hash (the last of equals), so equal windows have equal anchors at equal places. The
consecutive windows with one anchor are its stretch: the seed extended both ways as far
as its windows reach.

1. Each task finds its stretches and settles those it holds twice: all but the first of
   equal stretches repeat. So whatever is common reaches the shuffle once a task. Texts that
   share the first's id and start are no repeats of it and go with it as one row.
2. Anchors that occur once are dropped; documents meet on the others. All but the first of
   equal stretches repeat as a whole.
3. The first of each stretch may still share some windows with another stretch of its
   anchor. Only its windows are compared one by one, again settled in each task before
   they are shuffled.
4. Repeated windows that touch merge into maximal repeats, joined back to the documents.

Equality is that of 64-bit hashes. No step emits pairs.

Defined cases: null and empty texts and texts of fewer than `LENGTH` words have no windows;
a null doc_id sorts before all others; rows that share a doc_id are told apart by their
texts, and neither of two windows at the same id and start is earlier; equal rows have
equal results; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm import wordhash
from quillmesh.llm.common import written

LENGTH = 20
SEED = 6
BLOCK_ROWS = 1_500_000  # stretches or windows that a task settles at once

_NO_ID = -(1 << 63)
_INVERSE = np.uint64(pow(int(wordhash.BASE), -1, 1 << 64))
_ROW = "anchor long, key long, doc long, part long, start int, n int, known boolean, also array<long>"
_SPANS = "array<struct<start:int,end:int>>"


def _stretches(texts: list[str | None], length: int) -> tuple[np.ndarray, ...]:
    """(anchor, key, text number, start, number of windows) of every stretch of the texts."""
    hashes, begin = wordhash.text_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    starts = np.flatnonzero(np.arange(len(hashes)) + length <= begin[1:][owner])
    if not len(starts):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    seeds = wordhash.runs(hashes, SEED)
    width = length - SEED + 1
    views = np.lib.stride_tricks.sliding_window_view(seeds, width)
    anchor = np.empty(len(views), np.int64)
    for low in range(0, len(views), 1 << 18):
        part = views[low : low + (1 << 18), ::-1]
        anchor[low : low + len(part)] = np.arange(low, low + len(part)) + width - 1 - np.argmin(part, axis=1)
    at = anchor[starts]
    head = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(starts) != 1) | (np.diff(owner[starts]) != 0)))
    first, n = starts[head], np.diff(np.append(head, len(starts)))
    power = wordhash.powers(len(hashes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
    undo = np.cumprod(np.full(len(hashes), _INVERSE, np.uint64))
    words = (total[first + n + length - 1] - total[first]) * undo[first]
    key = wordhash.mix(wordhash.mix(words) + n.astype(np.uint64) * wordhash.MIX_A + (at[head] - first).astype(np.uint64) * wordhash.MIX_B)
    doc = owner[first]
    return seeds[at[head]], key, doc, first - begin[doc], n


def _settled(rows: list[np.ndarray]) -> pa.RecordBatch:
    """rows: (anchor, key, doc, part, start, n). The first of each key stays, with the other texts at its id and start; later ones become known repeats, merged where they touch."""
    anchor, key, doc, part, start, n = rows
    order = np.lexsort((part, start, doc, key))
    key_, doc_, start_, part_ = key[order], doc[order], start[order], part[order]
    head = np.append(True, np.diff(key_) != 0) if len(key_) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else np.zeros(0, int)
    later = (doc_ > doc_[group]) | ((doc_ == doc_[group]) & (start_ > start_[group]))
    tied = ~head & ~later & np.append(False, np.diff(part_) != 0)[: len(head)]
    others = np.bincount(np.cumsum(head)[tied] - 1, minlength=head.sum())
    firsts, known = order[head], order[later]
    known = known[np.lexsort((start[known], part[known], doc[known]))]
    d, p, s, e = doc[known], part[known], start[known], start[known] + n[known]
    cut = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (np.diff(p) != 0) | (s[1:] > e[:-1]))) if len(known) else np.zeros(0, int)
    # stretches and windows of one document have distinct starts in order, so the last of a run ends it
    last = np.append(cut[1:], len(known))[: len(cut)] - 1
    empty = wordhash.mix(d[cut].astype(np.uint64) * wordhash.MIX_A + s[cut].astype(np.uint64)).view(np.int64)
    flag = np.zeros(len(firsts) + len(cut), bool)
    flag[len(firsts) :] = True
    ends = np.concatenate([np.zeros(1, int), np.cumsum(others), np.full(len(cut), others.sum())])
    join = lambda a, b, t: pa.array(np.concatenate([a, b]).astype(t))
    return pa.RecordBatch.from_arrays(
        [
            join(anchor[firsts].view(np.int64), empty, np.int64),
            join(key[firsts].view(np.int64), empty, np.int64),
            join(doc[firsts], d[cut], np.int64),
            join(part[firsts], p[cut], np.int64),
            join(start[firsts], s[cut], np.int32),
            join(n[firsts], e[last] - s[cut], np.int32),
            pa.array(flag),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(part_[tied].astype(np.int64)), mask=pa.array(np.diff(ends) == 0)),  # null takes less room in a shuffle
        ],
        names=["anchor", "key", "doc", "part", "start", "n", "known", "also"],
    )


def _settling(pieces: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= BLOCK_ROWS:
            yield _settled([np.concatenate(x) for x in zip(*held, strict=True)])
            held, size = [], 0
    if size:
        yield _settled([np.concatenate(x) for x in zip(*held, strict=True)])


def _find_stretches(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                doc, part, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
                for low, high in wordhash.blocks(texts):
                    anchor, key, owner, start, n = _stretches(texts[low:high], length)
                    yield [anchor, key, doc[low:high][owner], part[low:high][owner], start, n]

        yield from _settling(pieces())

    return find


def _find_windows(length: int):
    """(doc, part, text, todo: ranges of window starts) -> the windows in them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                doc, part, texts, todo = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3)
                for low, high in wordhash.blocks(texts):
                    hashes, begin = wordhash.text_words(texts[low:high])
                    keys = wordhash.runs(hashes, length)
                    ranges = todo.slice(low, high - low)
                    owner = np.repeat(np.arange(high - low), ranges.value_lengths().to_numpy())
                    flat = ranges.flatten()
                    first, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
                    which = np.repeat(np.arange(len(n)), n)
                    start = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    owner = owner[which]
                    key = keys[begin[owner] + start]
                    yield [key, key, doc[low:high][owner], part[low:high][owner], start, np.ones(len(start), np.int64)]

        yield from _settling(pieces())

    return find


def _merged(starts: DataFrame) -> DataFrame:
    """(doc, part, start, n) -> each document's ranges in one row."""
    return starts.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "n")).alias("todo"))


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, repeats: the word ranges of maximal repeats, end exclusive, in order."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("part"), text.alias("text"))
    stretches = rows.mapInArrow(_find_stretches(length), _ROW)
    shared = stretches.filter(~F.col("known")).groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    met = stretches.join(shared, "anchor", "left").filter("known OR times IS NOT NULL")
    first = F.min(F.struct("doc", "start")).over(Window.partitionBy("key"))  # a row a task at most, so a small group
    later = F.col("known") | (F.struct("doc", "start") > F.col("first"))
    each = F.explode(F.concat(F.array("part"), F.coalesce("also", F.array().cast("array<long>")))).alias("part")
    settled = written(met.withColumn("first", first).select("doc", each, "start", "n", later.alias("later")), "stretches", clean=True)

    todo = _merged(settled.filter(~F.col("later")))
    windows = rows.join(todo, ["doc", "part"]).select("doc", "part", "text", "todo").mapInArrow(_find_windows(length), _ROW)
    again = windows.withColumn("first", first).filter(later).select("doc", each, "start", "n")
    ranges = _merged(settled.filter("later").select("doc", "part", "start", "n").unionByName(again))
    found = rows.join(ranges.withColumnRenamed("todo", "ranges"), ["doc", "part"], "left")

    @F.pandas_udf(_SPANS)
    def maximal(ranges):
        import pandas as pd

        return pd.Series([_maximal([(x["start"], x["n"]) for x in r], length) if r is not None else [] for r in ranges], dtype=object)

    ident = F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id")
    return found.select(ident, "text", F.coalesce(F.when(F.col("ranges").isNotNull(), maximal("ranges")), F.array().cast(_SPANS)).alias("repeats"))


def _maximal(ranges: list[tuple[int, int]], length: int) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, n in sorted(ranges):
        end = start + n - 1 + length
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def kept_words(text: str | None, repeats) -> tuple[int, int, bytes]:
    """(words, words removed, the kept words joined by one space)."""
    words = (text or "").encode().split()
    kept, at, removed = [], 0, 0
    for x in repeats:
        kept += words[at : x["start"]]
        at = x["end"]
        removed += x["end"] - x["start"]
    return len(words), removed, b" ".join(kept + words[at:])


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document against all others and itself."""
    from quillmesh.llm.common import table

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(texts, repeats):
        import pandas as pd

        rows = [(n, r, hashlib.sha256(k).hexdigest()) for n, r, k in map(kept_words, texts, repeats)]
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    found = find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", digest("text", "repeats").alias("d")).select("doc_id", "d.*")


OP4_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS key FROM d, unnest(range(1, len(w) - 18)) AS u(k)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY key ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS p FROM later, unnest(range(0, 20)) AS u(j)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
