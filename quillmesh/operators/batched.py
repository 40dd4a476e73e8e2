"""Hybrid search of many queries in one plan: each has its own text, vector, limit, threshold and filters.

queries: query (long), terms (array<string>), embedding (array<double>), limit (int), min_score (double) and
filters (array<struct<kind, values>>). A filter asks for a source with at least one of its values; the filters of a query
all hold; null values ask for nothing, and no values match nothing.

Queries of equal filters share one name of them, so sources are matched once for each different set of filters. Full-text search
starts from the chunks that hold both of a query's two rarest terms, and reads the other words of these alone, so postings
are joined where they lie as long as few chunks are left. Vectors are compared in blocks of rows and queries of the same filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.vector import reaches
from quillmesh.operators import retrieval, vector_index
from quillmesh.sources.shared import written

FILTERS = "array<struct<kind:string,values:array<string>>>"


def candidate_limit(limit: Column) -> Column:
    return F.greatest(4 * limit, F.lit(retrieval.LEAST_CANDIDATES))


def with_filter_name(queries: DataFrame) -> DataFrame:
    """queries with filter: the same text for the same filters, '' for none."""
    asked = F.filter(F.coalesce("filters", F.array().cast(FILTERS)), lambda f: f["values"].isNotNull())
    plain = F.array_sort(F.transform(asked, lambda f: F.struct(f["kind"].alias("kind"), F.array_sort(F.array_distinct(f["values"])).alias("values"))))
    return queries.withColumn("filter", F.when(F.size(plain) == 0, F.lit("")).otherwise(F.to_json(plain)))


def allowed(queries: DataFrame, bridge: DataFrame) -> DataFrame:
    """queries (filter), bridge (doc_id, kind, value) -> filter, doc_id: the sources that each different set of filters lets through."""
    names = queries.filter("filter <> ''").select("filter").distinct()
    each = names.select("filter", F.from_json("filter", FILTERS).alias("f")).select("filter", F.size("f").alias("wanted"), F.posexplode("f").alias("turn", "f"))
    values = each.select("filter", "wanted", "turn", F.col("f.kind").alias("kind"), F.explode("f.values").alias("value"))
    met = values.join(bridge, ["kind", "value"]).groupBy("filter", "wanted", "doc_id").agg(F.count_distinct("turn").alias("n"))
    return met.filter("n = wanted").select("filter", "doc_id")


def text_candidates(postings: DataFrame, chunks: DataFrame, queries: DataFrame, passed: DataFrame) -> DataFrame:
    """postings (term, chunk_id, positions), chunks (chunk_id, doc_id), queries (query, terms, filter) -> query, chunk_id, text_rank."""
    asked = queries.select("query", "filter", F.array_distinct("terms").alias("t")).select("query", "filter", F.size("t").alias("wanted"), F.explode("t").alias("term"))
    terms = written(asked.select("term").distinct(), "terms")  # known to be small where it is, and then broadcast
    often = postings.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    turn = Window.partitionBy("query").orderBy(F.coalesce("times", F.lit(0)), "term")
    turned = written(asked.join(often, "term", "left").withColumn("turn", F.row_number().over(turn)), "rarest")  # a query's terms, the rarest first
    lacks = turned.filter("times IS NULL").select("query").distinct()
    rare = turned.filter("turn <= 2").join(lacks, "query", "left_anti")  # the two rarest terms of each query leave few chunks of the others
    met = postings.select("term", "chunk_id").join(rare.select("term", "query", "filter", "wanted"), "term").groupBy("query", "filter", "wanted", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.least("wanted", F.lit(2))).drop("n")
    placed = met.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    fits = placed.filter("filter = ''").unionByName(placed.filter("filter <> ''").join(passed, ["filter", "doc_id"], "left_semi").select(*placed.columns)).select("query", "chunk_id", "wanted")
    fits = written(fits, "candidates")
    # only words of these chunks are read on
    held = postings.join(terms, "term", "left_semi").join(written(fits.select("chunk_id").distinct(), "candidate-chunks"), "chunk_id", "left_semi")
    each = held.join(fits.join(asked.select("query", "term"), "query"), ["term", "chunk_id"])
    whole = each.groupBy("query", "chunk_id", "wanted").agg(F.collect_list(F.struct("term", "positions")).alias("p")).filter(F.size("p") == F.col("wanted"))  # the words of a chunk
    places = whole.select("query", "chunk_id", "wanted", F.explode("p").alias("p")).select("query", "chunk_id", "wanted", "p.term", F.explode("p.positions").alias("pos"))
    return cover_density(places)


def cover_density(places: DataFrame) -> DataFrame:
    """places (query, chunk_id, wanted, term, pos) -> query, chunk_id, text_rank: the sum over minimal covers of all terms of 0.1 / (1 + words in them that are no terms)."""
    words = Window.partitionBy("query", "chunk_id")  # the term occurrences of one chunk
    numbered = places.withColumn("n", F.row_number().over(words.orderBy("pos"))).withColumn("terms", F.collect_set("term").over(words))
    at = Window.partitionBy("query", "chunk_id", "t").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = numbered.select("*", F.explode("terms").alias("t")).withColumn("last", F.max(F.when(F.col("term") == F.col("t"), F.struct("pos", "n"))).over(at))
    covers = last.groupBy("query", "chunk_id", "wanted", "pos", "n").agg(F.min("last").alias("s"), F.count("last").alias("got")).filter("got = wanted")
    first = covers.groupBy("query", "chunk_id", "s").agg(F.min(F.struct("pos", "n")).alias("e"))
    noise = (F.col("e.pos") - F.col("s.pos")) - (F.col("e.n") - F.col("s.n"))
    return first.groupBy("query", "chunk_id").agg(F.round(F.sum(F.lit(0.1) / (1 + noise)), 6).alias("text_rank"))


def vector_candidates(usable: DataFrame, queries: DataFrame, passed: DataFrame, most: int) -> DataFrame:
    """usable (chunk_id, doc_id, embedding), queries (query, filter, embedding) -> query, chunk_id, score of the ``most`` nearest chunks that each may see."""
    rows = usable.select("doc_id", F.col("chunk_id").alias("id"), "embedding")
    kept = rows.join(passed, "doc_id").select("filter", "id", "embedding").unionByName(rows.select(F.lit("").alias("filter"), "id", "embedding"))
    return vector_index.exact(kept, queries.filter("embedding IS NOT NULL").select("filter", "query", "embedding"), most, by="filter").select("query", F.col("id").alias("chunk_id"), "score")


def fused(near: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """near (query, chunk_id, score), found (query, chunk_id, text_rank), queries (query, limit, min_score) -> the fused results of each query in their places.

    The rules are those of ``retrieval.fused`` for one query.
    """
    own = queries.select("query", "limit", "min_score", candidate_limit(F.col("limit")).alias("most"))

    def ranked(rows: DataFrame, score: str, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(score), "chunk_id"))
        return rows.withColumn(name, place).join(own.select("query", "most"), "query").filter(F.col(name) <= F.col("most")).drop("most")

    both = ranked(near, "score", "vector_rank").join(ranked(found, "text_rank", "text_place"), ["query", "chunk_id"], "full_outer").join(own, "query")
    both = both.filter(F.col("vector_rank").isNull() | reaches("score", F.col("min_score")))
    part = lambda c: F.coalesce(1 / (F.lit(retrieval.RRF_K).cast("double") + F.col(c)), F.lit(0.0))
    in_both = F.col("vector_rank").isNotNull() & F.col("text_place").isNotNull()
    why = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), F.lit("vector")), F.when(F.col("text_place").isNotNull(), F.lit("text"))))
    scored = both.withColumns({"rrf": F.round(part("vector_rank") + part("text_place"), 9), "in_both": in_both, "reasons": F.array_join(why, ",")})
    order = Window.partitionBy("query").orderBy(F.desc("rrf"), F.desc("in_both"), F.desc_nulls_last("score"), F.desc_nulls_last("text_rank"), "chunk_id")
    return scored.withColumn("place", F.row_number().over(order)).filter("place <= limit").select("query", "chunk_id", "place", "rrf", "score", "text_rank", "reasons")


def hybrid(queries: DataFrame, usable: DataFrame, chunks: DataFrame, postings: DataFrame, bridge: DataFrame) -> DataFrame:
    """queries -> query, chunk_id, place, rrf, score, text_rank, reasons of all of them, as a table of the shared folder: readers search once, and know its size when they join.

    usable: chunk_id, doc_id, embedding of the chunks of the active configuration; chunks: chunk_id, doc_id of all; bridge: doc_id, kind, value.
    """
    named = written(with_filter_name(queries), "queries")
    passed = allowed(named, bridge)
    most = named.agg(F.max(candidate_limit(F.col("limit")))).first()[0]
    near = vector_candidates(usable, named, passed, int(most or 0))
    return written(fused(near, text_candidates(postings, chunks, named, passed), named), "hits")
