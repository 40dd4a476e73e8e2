"""Spans of documents, headings' sections and pages, and the one that a chunk lies in.

Spans are rows, and chunks meet them by document and bin of `BIN` characters, so neither is ever gathered for a whole document; a pair
counts in its first common bin only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1000
PAGE_BREAK = "\n\n"


def lines(documents: DataFrame) -> DataFrame:
    """documents (doc_id, content_text) -> doc_id, number, line, start_char, size (of the whole text): by the running lengths of the lines."""
    each = documents.select("doc_id", F.length("content_text").cast("long").alias("size"), F.posexplode(F.split("content_text", "\n")).alias("number", "line"))
    before = Window.partitionBy("doc_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one document
    return each.withColumn("start_char", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def section_spans(documents: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char, value: the title of each heading with the range from it to the next one."""
    bare = F.trim("line")
    title = F.trim(F.regexp_replace(bare, "^#+", ""))
    heads = lines(documents).select("doc_id", "start_char", "size", title.alias("value"), bare.startswith("#").alias("head")).filter(F.col("head") & (F.col("value") != ""))
    following = F.lead("start_char").over(Window.partitionBy("doc_id").orderBy("start_char"))
    return heads.select("doc_id", "start_char", F.coalesce(following, "size").alias("end_char"), "value")


def page_spans(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> doc_id, start_char, end_char, value: where each page that is not blank lies in the document's text."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # the pages of one document
    some = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", "page", F.length("text").cast("long").alias("size"))
    start = F.coalesce(F.sum(F.col("size") + len(PAGE_BREAK)).over(before), F.lit(0))
    return some.select("doc_id", start.alias("start_char"), (start + F.col("size")).alias("end_char"), F.col("page").alias("value"))


def paged_texts(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> doc_id, content_text: the pages that are not blank, in order."""
    some = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return some.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), PAGE_BREAK).alias("content_text"))


def _binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    low, high = F.floor(F.col(start) / BIN), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / BIN)
    return rows.withColumn("bin", F.explode(F.sequence(low, high)))


def best_span(chunks: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """chunks (doc_id, chunk_index, start_char, end_char, ..) with ``name``: the value of the span that shares most characters with the chunk, of equals the first; null where none shares any."""
    one = _binned(chunks.select("doc_id", "chunk_index", F.col("start_char").alias("a"), F.col("end_char").alias("b")), "a", "b")
    two = _binned(spans.filter("start_char < end_char").select("doc_id", F.col("start_char").alias("s"), F.col("end_char").alias("e"), "value"), "s", "e")
    first = F.floor(F.greatest("a", "s") / BIN) == F.col("bin")
    shared = F.least("b", "e") - F.greatest("a", "s")
    met = one.join(two, ["doc_id", "bin"]).filter(first & (shared > 0))
    best = met.groupBy("doc_id", "chunk_index").agg(F.max_by("value", F.struct(shared.alias("n"), (-F.col("s")).alias("first"))).alias(name))
    return chunks.join(best, ["doc_id", "chunk_index"], "left")
