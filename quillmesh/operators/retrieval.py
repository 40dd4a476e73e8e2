"""Vector, full-text and hybrid retrieval of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.functions.vector import cosine, literal, reaches
from quillmesh.operators import topk

MIN_SCORE = 0.35
RRF_K = 60
LEAST_CANDIDATES = 20


def candidate_limit(limit: int) -> int:
    return max(4 * limit, LEAST_CANDIDATES)


def compatible(chunks: DataFrame, batches: DataFrame, active: str) -> DataFrame:
    """Chunks whose embedding is of a completed batch of the active configuration."""
    usable = batches.filter((F.col("config_hash") == active) & (F.col("batch_status") == "completed")).select("batch_id")
    return chunks.filter(F.col("embedding").isNotNull() & (F.col("embedding_status") == "embedded")).join(usable, "batch_id", "left_semi")


def any_of(rows: DataFrame, bridge: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose source has at least one of the values; several filters chain as AND."""
    return rows.join(bridge.filter(F.col(column).isin(values)).select("doc_id"), "doc_id", "left_semi")


def all_of(bridge: DataFrame, column: str, values: list) -> DataFrame:
    """doc_id of the sources that have every one of the values."""
    return bridge.filter(F.col(column).isin(values)).groupBy("doc_id").agg(F.count_distinct(column).alias("n")).filter(F.col("n") == len(set(values))).select("doc_id")


def nearest(rows: DataFrame, query: list[float], k: int, ident: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """ident, score of the k rows of greatest cosine similarity; equal scores by id. Zero vectors come last."""
    score = F.round(cosine(F.col(vector), literal(query)), 6)
    return rows.select(ident, score.alias("score")).filter("score IS NOT NULL").orderBy(F.isnan("score"), F.desc("score"), ident).limit(k)


def matching(chunks: DataFrame, query_terms: list[str]) -> DataFrame:
    """Chunks that hold every term, with their tokens; no terms match nothing."""
    if not query_terms:
        return chunks.withColumn("tokens", text.tokens("content")).limit(0)
    found = chunks.withColumn("tokens", text.tokens("content"))
    for term in query_terms:
        found = found.filter(F.array_contains("tokens", term))
    return found


def cover_density(matched: DataFrame, query_terms: list[str], ident: str = "chunk_id") -> DataFrame:
    """ident, text_rank: the sum over minimal covers of 0.1 / (1 + words in them that are no terms)."""
    return _covers(matched.select(ident, F.posexplode("tokens").alias("pos", "term")).filter(F.col("term").isin(query_terms)), query_terms, ident)


def _covers(each: DataFrame, query_terms: list[str], ident: str) -> DataFrame:
    """(ident, pos, term) of the query's terms -> ident, text_rank."""
    order = Window.partitionBy(ident).orderBy("pos")  # the term occurrences of one chunk
    each = each.withColumn("n", F.row_number().over(order))
    last = [F.max(F.when(F.col("term") == t, F.struct("pos", "n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)) for t in query_terms]
    covers = each.select(ident, "pos", "n", *(x.alias(f"l{k}") for k, x in enumerate(last)))
    for k in range(len(last)):
        covers = covers.filter(F.col(f"l{k}").isNotNull())
    least = F.least(*(F.col(f"l{k}") for k in range(len(last)))) if len(last) > 1 else F.col("l0")
    first = covers.withColumn("s", least).groupBy(ident, "s").agg(F.min(F.struct("pos", "n")).alias("e"))
    noise = (F.col("e.pos") - F.col("s.pos")) - (F.col("e.n") - F.col("s.n"))
    return first.groupBy(ident).agg(F.sum(F.lit(0.1) / (1 + noise)).alias("text_rank"))


def text_top(chunks: DataFrame, query: list[str], k: int, ident: str = "chunk_id") -> DataFrame:
    """The k best chunks by text rank, then id; no terms match nothing."""
    if not query:
        return chunks.select(ident, F.lit(0.0).alias("text_rank")).limit(0)
    found = cover_density(matching(chunks, query), query, ident).select(ident, F.round("text_rank", 6).alias("text_rank"))
    return found.orderBy(F.desc("text_rank"), ident).limit(k)


def ranked(rows: DataFrame, name: str, *order) -> DataFrame:
    """Ranks from 1 of at most a few hundred candidates."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fused(vector_rows: DataFrame, text_rows: DataFrame, limit: int, min_score: float = MIN_SCORE, ident: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of (ident, score) and (ident, text_rank).

    A candidate of the vector path must reach the threshold even where it matches the text;
    ties are broken by both paths, vector score, text score and id.
    """
    one = ranked(vector_rows, "vector_rank", F.desc("score"), ident)
    two = ranked(text_rows, "text_place", F.desc("text_rank"), ident)
    part = lambda c: F.coalesce(1 / (F.lit(RRF_K).cast("double") + F.col(c)), F.lit(0.0))
    both = one.join(two, ident, "full_outer").filter(F.col("vector_rank").isNull() | reaches("score", min_score))
    in_both = F.col("vector_rank").isNotNull() & F.col("text_place").isNotNull()
    reasons = F.array_join(F.filter(F.array(F.when(F.col("vector_rank").isNotNull(), F.lit("vector")), F.when(F.col("text_place").isNotNull(), F.lit("text"))), lambda x: x.isNotNull()), ",")
    scored = both.withColumns({"rrf": F.round(part("vector_rank") + part("text_place"), 9), "in_both": in_both, "reasons": reasons})
    order = [F.desc("rrf"), F.desc("in_both"), F.desc_nulls_last("score"), F.desc_nulls_last("text_rank"), F.asc(ident)]
    return ranked(scored.orderBy(*order).limit(limit), "place", *order).select(ident, "place", "rrf", "score", "text_rank", "reasons")


def top_by_query(pairs: DataFrame, k: int) -> DataFrame:
    """pairs (query, id, score) -> the k best of each query with their rank; tasks keep k rows a query before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scored(shared, k: int, probes=None):
    """Batches (id, embedding[, list_id]) -> the k best ids of each query; with probes only of the lists that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        best, every = topk.Best(names, k), np.arange(len(names))
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            ids, rows = batch.column(0).to_numpy(), topk.matrix(batch.column(1))
            if probes is None:
                topk.compare(best, every, vectors, ids, rows)
                continue
            lists = batch.column(2).to_numpy()
            for one in np.unique(lists):
                mine = lists == one
                topk.compare(best, probes.value.get(int(one), every[:0]), vectors, ids[mine], rows[mine])
        yield from best.batches()

    return run


def _packed(queries: list[tuple[int, list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([q for q, _ in queries], dtype=np.int64), np.array([v for _, v in queries], dtype=np.float64)


def exact_top(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """rows (id, embedding: no nulls) against a stated set of queries -> query, id, score, rank; zero vectors match nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(_packed(queries))
    return top_by_query(rows.select("id", "embedding").mapInArrow(_scored(shared, k), topk.FOUND), k)


def _nearest_centroid(rows: np.ndarray, centroids: list[tuple[int, list[float]]]) -> np.ndarray:
    """The centroid of the greatest cosine for each row, the least id of equals."""
    names, at = np.array([c for c, _ in centroids]), np.array([v for _, v in centroids], dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.nan_to_num(np.round(rows @ at.T / (np.sqrt((rows * rows).sum(axis=1))[:, None] * np.sqrt((at * at).sum(axis=1))), 6), nan=-2.0)
    order = np.argsort(names)
    return names[order][np.argmax(score[:, order], axis=1)]


def similarities(vector: list[float], centroids: list[tuple[int, list[float]]]) -> list[tuple[int, float]]:
    """(centroid, its cosine with a vector)."""
    v = np.array(vector, dtype=np.float64)
    return [(c, float(np.round(v @ np.array(x) / np.sqrt((v @ v) * (np.array(x) @ np.array(x))), 6))) for c, x in centroids]


def trained(rows: DataFrame, seeds: list[tuple[int, list[float]]]) -> list[tuple[int, list[float]]]:
    """Centroids: each seed moves to the mean of all rows (embedding) that are nearest to it, to six digits. Tasks add up their rows; the sums of a centroid are one row."""
    spark = rows.sparkSession
    if not seeds:
        return []
    shared, size = spark.sparkContext.broadcast(seeds), len(seeds[0][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([c for c, _ in shared.value])
        n, total = np.zeros(len(names), np.int64), np.zeros((len(names), size))
        for batch in batches:
            if batch.num_rows:
                x = topk.matrix(batch.column(0))
                near = _nearest_centroid(x, shared.value)
                for i, c in enumerate(names):
                    n[i], total[i] = n[i] + (near == c).sum(), total[i] + x[near == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": names[some].tolist(), "n": n[some].tolist(), "s": total[some].tolist()}, schema=pa.schema([("c", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

    added = rows.select("embedding").mapInArrow(run, "c long, n long, s array<double>").groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)))
    found = {r["c"]: np.round(np.array(r[2:]) / r["n"], 6).tolist() for r in added.collect()}
    return [(c, found[c]) for c, _ in seeds if c in found]


def clustered(rows: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """rows (id, embedding) with list_id, the nearest centroid: the index's inverted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest_centroid(topk.matrix(batch.column(1)), centroids) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64))], names=["id", "embedding", "list_id"])

    return rows.select("id", "embedding").mapInArrow(run, "id long, embedding array<float>, list_id long")


def probed_top(indexed: DataFrame, probes: dict[int, list[int]], queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """As exact_top, but a row counts only for the queries that probe its list; lists that no query probes are not read."""
    sc = indexed.sparkSession.sparkContext
    wanted = sorted({x for p in probes.values() for x in p})
    rows = indexed.filter(F.col("list_id").isin(wanted)).select("id", "embedding", "list_id")
    places = {q: i for i, (q, _) in enumerate(queries)}
    asked = {x: np.array([places[q] for q, p in probes.items() if x in p]) for x in wanted}
    return top_by_query(rows.mapInArrow(_scored(sc.broadcast(_packed(queries)), k, sc.broadcast(asked)), topk.FOUND), k)


LEAST_INDEXED = 10_000


def index_allowed(n: int, least: int = LEAST_INDEXED, force: bool = False) -> bool:
    """Whether a corpus is large enough for an approximate index."""
    return force or n >= least


def checked(vector: Column, dimension: int) -> Column:
    """The vector; one of another size, or with an element that is not finite, raises."""
    fine = (F.size(vector) == dimension) & F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, vector).otherwise(F.raise_error(F.lit("a vector has another size or elements that are not finite")))


def decided(recall, threshold: float, baseline_p95, index_p95) -> Column:
    """inconclusive without data, rejected under the recall or without a gain in latency, else accepted."""
    return F.when(recall.isNull() | baseline_p95.isNull(), "inconclusive").when((recall < threshold) | (index_p95 >= baseline_p95), "rejected").otherwise("accepted")


WORDS_AT_ONCE = 1 << 20  # words whose postings are sorted together, about


def posting_lists(chunks: DataFrame, *more: str) -> DataFrame:
    """chunks (chunk_id, content) -> term, chunk_id, positions: what full-text search reads; ``more`` columns of a chunk stay.

    Made where the chunks are, without a shuffle. A task sorts the postings of some chunks by term, then those of the next ones, so the pages of
    its files hold few terms each, a search skips the others, and a common term is in the files of all tasks.
    """
    rows = chunks.select("chunk_id", *more, text.tokens("content").alias("t"))
    kinds = dict(rows.dtypes)

    def posted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        words = pa.concat_arrays(table.column("t").chunks)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        flat = words.flatten().dictionary_encode()
        if not len(flat):
            return
        terms = np.empty(len(flat.dictionary), np.int64)  # the place of each term in their order
        terms[pc.array_sort_indices(flat.dictionary).to_numpy()] = np.arange(len(terms))
        code, chunk = terms[flat.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
        place = (np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        order = np.argsort(code, kind="stable")
        code, chunk, place = code[order], chunk[order], place[order]
        first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(chunk) != 0)))  # of each posting
        ends, at = np.append(first, len(code)).astype(np.int32), pa.array(chunk[first])
        own = [pa.concat_arrays(table.column(c).chunks).take(at) for c in ("chunk_id", *more)]
        named = flat.dictionary.take(pc.array_sort_indices(flat.dictionary)).take(pa.array(code[first]))
        made = pa.RecordBatch.from_arrays([named, *own, pa.ListArray.from_arrays(pa.array(ends), pa.array(place))], names=["term", "chunk_id", *more, "positions"])
        for low in range(0, made.num_rows, 1 << 15):
            yield made.slice(low, 1 << 15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held, n = [*held, batch], n + len(batch.column("t").flatten())
            if n >= WORDS_AT_ONCE:
                yield from posted(held)
                held, n = [], 0
        if held:
            yield from posted(held)

    return rows.mapInArrow(run, f"term string, chunk_id {kinds['chunk_id']}{''.join(f', {c} {kinds[c]}' for c in more)}, positions array<int>")


def posted_top(postings: DataFrame, query: list[str], k: int) -> DataFrame:
    """As text_top, from the posting lists of the query's terms alone."""
    terms = sorted(set(query))
    if not terms:
        return postings.select("chunk_id", F.lit(0.0).alias("text_rank")).limit(0)
    held = postings.filter(F.col("term").isin(terms))
    every = held.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(terms)).select("chunk_id")
    places = held.join(every, "chunk_id", "left_semi").select("chunk_id", F.explode("positions").alias("pos"), "term")
    found = _covers(places, terms, "chunk_id").select("chunk_id", F.round("text_rank", 6).alias("text_rank"))
    return found.orderBy(F.desc("text_rank"), "chunk_id").limit(k)


def chunk_rows(chunks: DataFrame, sources: DataFrame, batches: DataFrame) -> DataFrame:
    """What a search shows of chunks (chunk_id, doc_id, chunk_index, content, embedding_status, batch_id): title, safe uri, the state and batch of the
    embedding, and the line for the answer model. sources: doc_id, title, uri, kind."""
    met = chunks.join(sources, "doc_id").join(batches, "batch_id", "left")
    state = F.coalesce("embedding_status", F.lit("unversioned"))
    return met.select("chunk_id", "doc_id", "title", text.safe_uri("uri", "kind", "title").alias("uri"), "content", state.alias("embedding_state"), "config_hash", context_line().alias("line"))


def embedding_payload(embedding_status: str = "embedding_status") -> Column:
    """What a reader is told of a chunk's vector, from the columns of its batch; without a batch only the state and when."""
    known = F.col("batch_known").isNotNull()
    of = lambda c: F.when(known, F.col(c)).alias(c)
    return F.struct(F.coalesce(embedding_status, F.lit("unversioned")).alias("status"), of("provider"), of("model"), of("dimension"), of("version"), F.col("embedded_at").alias("embedded_at"))


def named_links(links: DataFrame, of: DataFrame, name: str, *fields: str) -> DataFrame:
    """links (doc_id, *fields) of the sources in ``of`` -> doc_id, name: their links as structs in the order of the first field."""
    mine = links.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    return mine.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias(name))  # the links of one source


def read_rows(hits: DataFrame, chunks: DataFrame, sources: DataFrame, links: dict[str, tuple[DataFrame, tuple[str, ...]]], batches: DataFrame) -> DataFrame:
    """hits (.., chunk_id, score) with all that a search returns of a chunk.

    chunks: chunk_id, doc_id, content, metadata_json, embedding_status, batch_id, embedded_at; sources: doc_id, public_id, title, kind, uri;
    links: name -> (doc_id and the fields, fields); batches: batch_id, provider, model, dimension, version. Of the tables only the rows of hits are joined on.
    A score that no vector gave is null.
    """
    found = hits.join(chunks, "chunk_id").join(sources, "doc_id").join(batches.withColumn("batch_known", F.lit(True)), "batch_id", "left")
    for name, (table, fields) in links.items():
        found = found.join(named_links(table, found, name, *fields), "doc_id", "left")
    none = {name: F.coalesce(name, F.expr(f"filter(array({name}[0]), x -> false)")) for name in links}
    return found.select(
        *hits.columns, F.col("public_id").alias("source_id"), F.col("title").alias("source_title"), F.col("kind").alias("source_type"), text.safe_uri("uri", "kind", "title").alias("uri"),
        *(v.alias(k) for k, v in none.items()), text.location(F.col("metadata_json"), F.col("content")).alias("location"), "content", text.public_metadata(F.col("metadata_json")).alias("metadata"), embedding_payload().alias("embedding"),
    )


def references(rows: DataFrame, by: str, place: str, **columns: str) -> DataFrame:
    """rows (by, place, ..) -> by, references: the cited chunks of each search, whose number its limit bounds, in order; ``columns`` name the fields of ``text.reference``."""
    each = rows.select(by, F.struct(F.col(place).alias("place"), text.reference(**columns).alias("said")).alias("r"))
    return each.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["said"]), "\n\n").alias("references"))


def context_line(page: Column | None = None, section: Column | None = None) -> Column:
    """A chunk as the answer model reads it; page and section only where they are known."""
    none = F.lit(None).cast("string")
    more = [F.concat(F.lit(f", {name} "), value.cast("string")) for name, value in (("pagina", none if page is None else page), ("secao", none if section is None else section))]
    where = F.concat(F.lit("chunk "), F.col("chunk_index").cast("string"), *(F.coalesce(x, F.lit("")) for x in more))
    return F.concat(F.lit("[source_id="), F.col("doc_id").cast("string"), F.lit("; chunk_id="), F.col("chunk_id").cast("string"), F.lit("; titulo="), F.col("title"), F.lit("; localizacao="), where, F.lit("]\n"), F.col("content"))
