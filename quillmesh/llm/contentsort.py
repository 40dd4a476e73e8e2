"""Exact dedup by a content sort, in DataFrame operations only.

Texts are equal when they are identical without the characters of `WHITE`. The normalised
texts are sorted as bytes over the whole cluster and equal ones end up adjacent:

1. Every row is normalised once and staged as a table, with the leading `HEAD` characters
   and a 64-bit hash of its normalised text.
2. Splitters are sampled over (leading characters, hash), which are bounded however long the
   texts are, and deal the texts out in ranges. Equal texts have equal keys and meet in one range.
3. Each range is sorted externally with the whole text as the last key. The aggregate over the
   sorted rows compares each text in full with its neighbour and keeps a row for each run
   of equal ones: the one of the most characters, then of the least doc_id.
4. The runs are joined back to all rows by the SHA-256 of their text.

A text of more rows than a fourth of an even range is hot: its rows are numbered over several
ranges by a third key, so that no task holds them all, and its few runs are merged after the
sort. There are at most four hot texts for each range, which bounds what is broadcast.

Defined cases: null is the empty text, and all texts of white space alone equal it; a null
doc_id comes last, and names a group only where all its ids are null; of rows that tie in
length and id one stays; equal rows each get their own result row; an empty table
gives an empty result; only doc_id and text are read, so further columns with any name are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import partitions, written

WHITE = r"[\x20\x09-\x0D]+"
HEAD = 32  # characters of a text that the splitters see, besides its hash
PART_BYTES = 32 << 20  # of the staged table's estimated size for each range
SHARES = 4  # a hot text has more rows than a range's even share divided by this


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def staged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> row (a number), doc_id, chars, norm, head, hash, text_sha256, as a written table: row numbers stay as they are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("norm"))
    keyed = rows.select("*", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("text_sha256"))
    return written(keyed.withColumn("row", F.monotonically_increasing_id()), "staged")


def runs(rows: DataFrame, ranges: int, limit: int) -> DataFrame:
    """staged rows -> text_sha256, size, best (shortness, no_id, id, row) of each run of equal texts in the sort, single rows apart.

    Texts of more than ``limit`` rows are cut into runs of about so many.
    """
    hot = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > limit).select("hash", F.ceil(F.col("times") / limit).alias("turns"))
    salted = rows.join(F.broadcast(hot), "hash", "left")  # at most one for each `limit` rows
    turn = F.coalesce(F.pmod(F.xxhash64("row"), F.col("turns")), F.lit(-1)).cast("int").alias("turn")
    ranged = salted.select("head", "hash", turn, "norm", "chars", "doc_id", "row").repartitionByRange(ranges, "head", "hash", "turn")
    best = F.min(F.struct((-F.col("chars")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row"))
    found = ranged.groupBy("head", "hash", "turn", "norm").agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
    return found.filter("size > 1 OR turn >= 0").select(F.sha2("norm", 256).alias("text_sha256"), "size", "best")


def groups(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = staged(docs)
    n = ranges or partitions(rows, PART_BYTES)
    limit = max(1, rows.count() // (SHARES * n))
    met = written(runs(rows, n, limit), "runs")
    whole = met.groupBy("text_sha256").agg(F.sum("size").alias("group_size"), F.min("best").alias("best"))
    whole = written(whole.select("text_sha256", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    lean = rows.select("row", "doc_id", "text_sha256")
    hot, rest = whole.filter(F.col("group_size") > limit), whole.filter(F.col("group_size") <= limit)
    common = lean.join(F.broadcast(hot), "text_sha256")
    others = lean.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(rest, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return common.unionByName(others).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The documents that stay: doc_id, with the size of their group and the hash of its text."""
    return groups(docs, ranges).filter("kept").select("doc_id", "group_size", "text_sha256")


def op11_content_sort(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    from quillmesh.llm.common import table

    return groups(table(spark, sf_dir, "documents"))


OP11_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, r)"""
