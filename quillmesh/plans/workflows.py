"""Queries over ingestion, catalog mutations, grading, reindexing and index validation, each with its DuckDB SQL.

Requests and settings that a caller would give are derived from the tables by a stated rule, the same in both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import evaluation, ingest, lifecycle, mutations, retrieval, spans
from quillmesh.plans.oracle import CATS, CHUNKS, EMBEDDED, NAMES, NL, PROJ, REFUSED, SAID, SRC, STALE
from quillmesh.sources import knowledge as model


def _with(tables: str, select: str) -> str:
    return f"WITH RECURSIVE {tables}\n{select}"


# --- ingestion ---------------------------------------------------------------------------------------------

_NAMES = {0: ".txt", 1: ".MD", 2: ".pdf", 3: ".exe"}


def _uploads(spark, sf_dir):
    """Each document as a file: its extension by its id; every seventh has no text, every eleventh no UTF-8."""
    ident = F.col("doc_id")
    name = F.concat(F.lit("doc-"), ident.cast("string"), F.element_at(F.array(*map(F.lit, _NAMES.values())), (ident % 4 + 1).cast("int")))
    data = F.when(ident % 7 == 0, F.lit(b" \n ")).when(ident % 11 == 0, F.lit(b"\xff\xfe")).otherwise(F.col("text").cast("binary"))
    return model.table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"), data.alias("content"))


def upload_validation(spark, sf_dir):
    return ingest.validated(_uploads(spark, sf_dir)).select("doc_id", "filename", "error")


def file_sources(spark, sf_dir):
    return ingest.file_sources(_uploads(spark, sf_dir)).select("title", "source_type", "uri", "content_hash")


_UPLOADS = f"""{SRC}, up AS (SELECT doc_id, 'doc-' || doc_id || ['.txt', '.MD', '.pdf', '.exe'][doc_id % 4 + 1] AS filename, doc_id % 7 = 0 AS blank, doc_id % 11 = 0 AS broken, content_text FROM src),
judged AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN 'unsupported_type' WHEN doc_id % 4 = 2 THEN 'no_text_layer_reader' WHEN blank THEN 'empty' WHEN broken THEN 'not_utf8' WHEN content_text = '' THEN 'empty' END AS error FROM up)"""


def duplicate_guard(spark, sf_dir):
    """Whether each document's content is held by another source: an update of itself does not count."""
    src = model.sources(spark, sf_dir).select("doc_id", "content_hash")
    return ingest.already_ingested(src.withColumnRenamed("doc_id", "excluded"), src).select(F.col("excluded").alias("doc_id"), "duplicate")


def page_texts(spark, sf_dir):
    """Documents as page layouts: normalized, with counters and footers dropped."""
    noisy = F.concat(F.regexp_replace("text", "([a-z])s ", "$1-\ns "), F.lit("\n 3 / 12 \nPowered by TCPDF (www.tcpdf.org)\n\n\nlast  line"))
    clean = text.normalized_pages(noisy)
    return model.table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.sha2(clean, 256).alias("content_hash"))


_PAGES = f"""WITH p AS (SELECT doc_id, regexp_replace(replace(replace(replace(regexp_replace(text, '([a-z])s ', '\\1-' || {NL} || 's ', 'g') || {NL} || ' 3 / 12 ' || {NL} || 'Powered by TCPDF (www.tcpdf.org)' || {NL} || {NL} || {NL} || 'last' || chr(160) || ' line', chr(13) || {NL}, {NL}), chr(13), {NL}), chr(160), ' '), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS t FROM documents),
n AS (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\\n{{2,}}'), lambda q: array_to_string(list_filter(list_transform(list_filter(string_split(q, {NL}), lambda x: NOT regexp_matches(x, '^\\s*\\d+\\s*/\\s*\\d+\\s*$') AND NOT regexp_matches(x, '(?i)^\\s*powered\\s+by\\s+tcpdf')), lambda x: trim(regexp_replace(x, '[\\s\\x0B]+', ' ', 'g'))), lambda x: x <> ''), ' ')), lambda q: q <> ''), {NL} || {NL}) AS t FROM p)
SELECT doc_id, length(t) AS n_chars, sha256(t) AS content_hash FROM n"""


def _markdown(spark, sf_dir):
    """Sources whose lines that begin with S or D are headings."""
    lines = F.transform(F.split("content_text", "\n"), lambda x: F.when(F.substring(x, 1, 1).isin("S", "D"), F.concat(F.lit("## "), x)).otherwise(x))
    return model.sources(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("content_text"))


def chunk_sections(spark, sf_dir):
    """The chunks of markdown sources, each with the section that it shares most characters with."""
    docs = _markdown(spark, sf_dir)
    found = ingest.with_sections(model.chunked(docs), docs)
    return found.select("doc_id", "chunk_index", "start_char", "end_char", F.sha2("section", 256).alias("section_hash"))


_MARKDOWN = CHUNKS.replace(
    SRC,
    f"""{SRC.replace("src AS", "raw AS")},
src AS (SELECT doc_id, array_to_string(list_transform(string_split(content_text, {NL}), lambda x: CASE WHEN substr(x, 1, 1) IN ('S', 'D') THEN '## ' || x ELSE x END), {NL}) AS content_text FROM raw)""",
)
_SECTIONS = _with(
    f"""{_MARKDOWN},
lines AS (SELECT doc_id, i, string_split(content_text, {NL})[i] AS line, content_text FROM src, unnest(range(1, len(string_split(content_text, {NL})) + 1)) AS u(i)),
lined AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines),
heads AS (SELECT doc_id, s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), length(content_text)) AS e, trim(ltrim(trim(line), '#')) AS title FROM lined WHERE trim(line) LIKE '#%' AND trim(ltrim(trim(line), '#')) <> ''),
common AS (SELECT c.doc_id, chunk_index, title, least(e, end_char) - greatest(s, start_char) AS n, s FROM chunks c JOIN heads h ON h.doc_id = c.doc_id AND s < end_char AND e > start_char),
best AS (SELECT doc_id, chunk_index, title FROM common QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY n DESC, s) = 1)""",
    "SELECT doc_id, chunk_index, start_char, end_char, sha256(title) AS section_hash FROM chunks LEFT JOIN best USING (doc_id, chunk_index)",
)


def _paged(spark, sf_dir):
    """Sources as pages of three lines."""
    each = model.sources(spark, sf_dir).filter("content_text <> ''").select("doc_id", F.posexplode(F.split("content_text", "\n")).alias("n", "line"))
    rows = each.groupBy("doc_id", (F.floor(F.col("n") / 3) + 1).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))  # three lines
    return rows.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def chunk_pages(spark, sf_dir):
    """The chunks of paged sources, each with the page that it shares most characters with."""
    pages = _paged(spark, sf_dir)
    return ingest.with_pages(model.chunked(spans.paged_texts(pages)), pages).select("doc_id", "chunk_index", "start_char", "end_char", "page")


_PAGED = _with(
    CHUNKS.replace(
        SRC,
        f"""{SRC.replace("src AS", "raw AS")},
pages AS (SELECT doc_id, p, array_to_string(l[3 * p - 2 : 3 * p], {NL}) AS t FROM (SELECT doc_id, string_split(content_text, {NL}) AS l FROM raw WHERE content_text <> ''), unnest(range(1, (len(l) + 2) // 3 + 1)) AS u(p)),
src AS (SELECT doc_id, string_agg(t, {NL} || {NL} ORDER BY p) AS content_text FROM pages GROUP BY doc_id),
places AS (SELECT doc_id, p, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, length(t) AS n FROM pages)""",
    )
    + """,
best AS (SELECT c.doc_id, chunk_index, p FROM chunks c JOIN places x ON x.doc_id = c.doc_id AND s < end_char AND s + n > start_char QUALIFY row_number() OVER (PARTITION BY c.doc_id, chunk_index ORDER BY least(s + n, end_char) - greatest(s, start_char) DESC, s) = 1)""",
    "SELECT doc_id, chunk_index, start_char, end_char, p AS page FROM chunks LEFT JOIN best USING (doc_id, chunk_index)",
)


def chunk_locations(spark, sf_dir):
    """Stored metadata, some of it nested, flat, partial or broken, read back with its defaults; and what of it may be shown."""
    ident, index = F.col("doc_id") % 5, F.col("chunk_index").cast("string")
    nested = F.concat(F.lit('{"location":{"chunk_index":'), index, F.lit(',"page":"7","section":"  a b ","start_char":'), F.col("start_char").cast("string"), F.lit(',"end_char":0},"metadata":{"note_type":"memo","client_id":5,"unsafe":"x"}}'))
    flat = F.concat(F.lit('{"chunk_index":"'), index, F.lit('","location":{"page":"x","section":" "},"metadata":{"client_id":"c1"}}'))
    meta = F.when(ident == 0, nested).when(ident == 1, flat).when(ident == 2, "{}").when(ident == 3, "no json").cast("string")
    rows = model.chunks(spark, sf_dir).select("chunk_id", "content", meta.alias("meta"))
    at = rows.select("chunk_id", ingest.location(F.col("meta"), F.col("content")).alias("l"), text.public_metadata(F.col("meta")).alias("m"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(F.coalesce("m", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return at.select("chunk_id", "l.chunk_index", "l.page", "l.section", "l.start_char", "l.end_char", shown.alias("shown"))


_LOCATIONS = _with(CHUNKS, """SELECT chunk_id, CASE WHEN doc_id % 5 IN (0, 1) THEN chunk_index ELSE 0 END AS chunk_index, CASE WHEN doc_id % 5 = 0 THEN 7::BIGINT END AS page, CASE WHEN doc_id % 5 = 0 THEN 'a b' END AS section,
CASE WHEN doc_id % 5 = 0 THEN start_char ELSE 0 END AS start_char, length(content) AS end_char, CASE doc_id % 5 WHEN 0 THEN 'note_type=memo' WHEN 1 THEN 'client_id=c1' ELSE '' END AS shown FROM chunks""")


def chunk_rows(spark, sf_dir):
    """What a search returns for a chunk: source, location, safe uri, embedding state, and a line for the answer model."""
    local = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("file:///data/in/"), "title", F.lit(".txt"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/srv/"), "title", F.lit("/"))).otherwise(F.col("uri"))
    src = model.sources(spark, sf_dir).select("doc_id", "title", local.alias("uri"), F.lit("text").alias("kind"))
    rows = retrieval.chunk_rows(model.embedded_chunks(spark, sf_dir), src, model.batches(spark))
    return rows.select("chunk_id", "title", "uri", "embedding_state", "config_hash", F.sha2("line", 256).alias("line_hash"))


_ROWS = _with(EMBEDDED, f"""SELECT chunk_id, 'doc-' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN 'text:doc-' || doc_id || '.txt' WHEN 1 THEN 'text:doc-' || doc_id ELSE 'text:doc-' || doc_id END AS uri,
coalesce(embedding_status, 'unversioned') AS embedding_state, config_hash, sha256('[source_id=' || doc_id || '; chunk_id=' || chunk_id || '; titulo=doc-' || doc_id || '; localizacao=chunk ' || chunk_index || ']' || {NL} || content) AS line_hash FROM emb LEFT JOIN batches USING (batch_id)""")


# --- catalog and source mutations --------------------------------------------------------------------------


def _tags(spark, sf_dir):
    """The tag catalog: names by order of their text."""
    names = model.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    return retrieval.ranked(names, "id", "name").select(F.col("id").cast("long").alias("id"), "name", text.tag_key("name").alias("key"))


_NEW = [(1, "  Brand  New "), (2, "brand néw"), (3, " "), (4, "ÁRVORE"), (5, "arvore")]


def tag_mutations(spark, sf_dir):
    """The catalog after creating, renaming and deleting: duplicates by key conflict, tags in use stay."""
    tags = _tags(spark, sf_dir)
    used = model.table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("source").alias("name")).join(tags, "name").select("id")
    made = mutations.create_named(tags, spark.createDataFrame(_NEW, "request_id long, name string"), text.tag_key("name"))
    named = mutations.rename_named(tags, spark.createDataFrame([(1, 1, "Renamed"), (2, 2, " "), (3, 999, "x")], "request_id long, id long, name string"), text.tag_key("name"))
    gone = mutations.delete_unused(tags, tags.select("id").unionByName(spark.createDataFrame([(998,)], "id long")), used)
    outcome = lambda df, kind: df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(":", F.lit(kind), "status").alias("what"), "n")
    after = mutations.applied(tags, made, named, gone).agg(F.count(F.lit(1)).alias("n")).select(F.lit("catalog").alias("what"), "n")
    return outcome(made, "create").unionByName(outcome(named, "rename")).unionByName(outcome(gone, "delete")).unionByName(after)


_TAGS = """WITH t AS (SELECT DISTINCT source AS name FROM documents), used AS (SELECT count(DISTINCT source) AS n FROM documents WHERE doc_id % 2 = 0), n AS (SELECT count(*) AS n FROM t),
one AS (SELECT count(*) AS n FROM (SELECT name, row_number() OVER (ORDER BY name) AS id FROM t) WHERE id = 1 AND name NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0))
SELECT * FROM (SELECT 'create:created' AS what, 2::BIGINT AS n UNION ALL SELECT 'create:conflict', 2 UNION ALL SELECT 'create:invalid', 1 UNION ALL SELECT 'rename:updated', 1 UNION ALL SELECT 'rename:invalid', 1 UNION ALL SELECT 'rename:not_found', 1
UNION ALL SELECT 'delete:in_use', used.n FROM used UNION ALL SELECT 'delete:deleted', n.n - used.n FROM n, used UNION ALL SELECT 'delete:not_found', 1 UNION ALL SELECT 'catalog', used.n + 2 FROM used) WHERE n > 0"""


def project_mutations(spark, sf_dir):
    """Projects after archiving one, reactivating another and describing a third, with the sources of the active ones."""
    projects = model.projects(spark).withColumn("description", F.lit("old"))
    asked = spark.createDataFrame([(0, "archived", None), (4, "active", None), (2, None, "  about  two "), (3, None, "  ")], "project_id long, status string, description string")
    after = mutations.set_status(projects, asked)
    n = model.source_projects(spark, sf_dir).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_sources"))
    return after.join(n, "project_id", "left").select("project_id", "status", "description", F.when(F.col("status") == "active", F.coalesce("n_sources", F.lit(0))).alias("n_sources"))


_PROJECTS = _with(f"{NAMES}, {PROJ}", "SELECT project_id, s AS status, CASE project_id WHEN 2 THEN 'about  two' WHEN 3 THEN NULL ELSE 'old' END AS description, CASE WHEN s = 'active' THEN (SELECT count(*) FROM proj p WHERE p.project_id = x.project_id) END AS n_sources FROM (SELECT project_id, CASE project_id WHEN 0 THEN 'archived' WHEN 4 THEN 'active' ELSE status END AS s FROM names) x")


def source_delete_cascade(spark, sf_dir):
    """What is left of sources, chunks and links when every tenth source is deleted."""
    tables = {"sources": model.sources(spark, sf_dir), "chunks": model.chunks(spark, sf_dir), "categories": model.source_categories(spark, sf_dir), "projects": model.source_projects(spark, sf_dir)}
    gone = model.table(spark, sf_dir, "documents").filter("doc_id % 10 = 0").select("doc_id")
    out = None
    for name, df in mutations.delete_sources(tables, gone, confirm=True).items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_CASCADE = _with(f"{CHUNKS}, {CATS}, {PROJ}", "SELECT 'sources' AS name, count(*) AS n FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id % 10 <> 0 UNION ALL SELECT 'categories', count(*) FROM cats WHERE doc_id % 10 <> 0 UNION ALL SELECT 'projects', count(*) FROM proj WHERE doc_id % 10 <> 0")


def source_update(spark, sf_dir):
    """The chunk table after every eighth source is replaced by the upper case of its text."""
    fresh = model.chunked(model.sources(spark, sf_dir).filter("doc_id % 8 = 0").select("doc_id", F.upper("content_text").alias("content_text")))
    after = ingest.replaced_chunks(model.chunks(spark, sf_dir).drop("chunk_id"), fresh)
    return after.groupBy((F.col("doc_id") % 8 == 0).alias("replaced")).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("content") == F.upper("content")).alias("n_upper"))


_UPDATE = _with(
    CHUNKS.replace(SRC, SRC.replace("src AS", "raw AS") + ", src AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN upper(replace(content_text, 'ß', 'ss')) ELSE content_text END AS content_text FROM raw)"),
    "SELECT doc_id % 8 = 0 AS replaced, count(*) AS n_chunks, count(*) FILTER (WHERE content = upper(replace(content, 'ß', 'ss'))) AS n_upper FROM chunks GROUP BY ALL",
)


def link_backfill(spark, sf_dir):
    """Links from sources to categories by name, trimmed and in any case, added where they are lacking."""
    links = model.source_categories(spark, sf_dir).filter("category <> 'sensitive'")
    wanted = model.source_categories(spark, sf_dir).select("doc_id", F.concat(F.lit(" "), F.upper("category"), F.lit(" ")).alias("wanted"))
    catalog = model.source_categories(spark, sf_dir).select("category").distinct().withColumn("key", text.category_key(F.col("category")))
    found = wanted.join(catalog, text.category_key(F.col("wanted")) == F.col("key")).select("doc_id", "category")
    return mutations.new_links(links, found.unionByName(found)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def config_upsert(spark, sf_dir):
    """A key-value table made of region names after an upsert."""
    old = model.table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return mutations.upsert(old, spark.createDataFrame([("ASIA", "changed"), ("new key", "added")], "key string, value string"), "key")


def point_lookups(spark, sf_dir):
    """Sources by id, by title and by content hash, and names that a request states twice."""
    src = model.sources(spark, sf_dir)
    first = src.filter("doc_id = 3").select("content_hash")
    by = [("id", src.filter("doc_id = 3")), ("title", src.filter(F.col("title") == "doc-5")), ("hash", src.join(first, "content_hash", "left_semi"))]
    rows = [df.select(F.lit(k).alias("by"), "doc_id") for k, df in by]
    twice = mutations.duplicate_ids(spark.createDataFrame([(7,), (8,), (7,)], "doc_id long"), "doc_id").select(F.lit("twice").alias("by"), "doc_id")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(twice)


def projects_by_status(spark, sf_dir):
    """Archived projects, and reindex candidates whose source has a category by name in any case."""
    archived = model.projects(spark).filter("status = 'archived'").select(F.lit("archived").alias("what"), F.col("project_id").alias("n"))
    named = model.source_categories(spark, sf_dir).filter(F.lower("category").isin("curated")).select("doc_id")
    n = lifecycle.reindex_candidates(model.embedded_chunks(spark, sf_dir), model.batches(spark), model.ACTIVE).join(named, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return archived.unionByName(n.select(F.lit("curated candidates").alias("what"), "n"))


# --- grading -----------------------------------------------------------------------------------------------


def _graded(spark, sf_dir):
    """A case for each conversation: its first user turn asks, its last assistant turn answers, and the answer cites sources by a rule."""
    talk = model.table(spark, sf_dir, "conversations")
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    at = lambda role: F.when(F.col("role") == role, F.col("turn"))
    one = talk.groupBy("conv_id").agg(F.min_by(said("user"), at("user")).alias("q"), F.max_by(said("assistant"), at("assistant")).alias("a"))
    k, name = F.col("conv_id"), lambda i: F.concat(F.lit(" see doc-"), (F.col("conv_id") + i).cast("string"))
    words = text.tokens(F.coalesce("q", F.lit("")))
    points = F.when(k % 4 != 0, F.array_distinct(F.slice(words, 1, 2))).otherwise(F.array().cast("array<string>"))
    answer = F.concat(F.coalesce("a", F.lit("")), F.when(k % 3 == 0, name(0)).when(k % 3 == 1, F.concat(name(1), name(0))).otherwise(F.lit("")))
    each = one.select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank")).withColumn("doc_id", F.col("conv_id") + F.col("rank"))
    docs = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    place = F.struct("rank", F.struct(F.concat(F.lit("src-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), (F.col("rank") == 0).alias("expected")).alias("s"))
    sources = each.join(docs, "doc_id").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["s"]).alias("sources"))  # three a case
    none = F.array().cast("array<struct<id:string,title:string,content:string,expected:boolean>>")
    cases = one.select("conv_id", answer.alias("answer"), points.alias("points"), (k % 5 != 0).alias("wants_sources")).join(sources, "conv_id", "left")
    return evaluation.grade_answers(cases.select(F.col("conv_id").alias("case"), "answer", "points", "wants_sources", F.coalesce("sources", none).alias("sources")))


_GRADED = f"""one AS (SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS q, max_by(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id),
said AS (SELECT conv_id AS k, CASE WHEN conv_id % 4 <> 0 THEN list_distinct(regexp_extract_all(lower(coalesce(q, '')), '[\\p{{L}}\\p{{N}}]+')[1:2]) ELSE [] END AS points,
  coalesce(a, '') || CASE conv_id % 3 WHEN 0 THEN ' see doc-' || conv_id WHEN 1 THEN ' see doc-' || (conv_id + 1) || ' see doc-' || conv_id ELSE '' END AS answer FROM one),
low AS (SELECT k, list_transform(points, lambda p: {SAID % "p"}) AS points, {SAID % "answer"} AS answer, answer AS raw FROM said),
met AS (SELECT k, r, doc_id, text, contains(answer, 'doc-' || doc_id) OR contains(answer, 'src-' || doc_id) AS cited, r = 0 AS expected FROM low, unnest(range(0, 3)) AS u(r), documents WHERE doc_id = k + r),
src AS (SELECT k, list('src-' || doc_id ORDER BY r) FILTER (WHERE cited) AS cited, list('src-' || doc_id) FILTER (WHERE expected) AS expected, {SAID % "string_agg(text, ' ' ORDER BY r)"} AS context FROM met GROUP BY k),
all_ AS (SELECT low.k, points, answer, raw, coalesce(cited, []) AS cited, coalesce(expected, []) AS expected, coalesce(context, '') AS context FROM low LEFT JOIN src USING (k)),
graded AS (SELECT *, len(list_filter(points, lambda p: NOT contains(answer, p))) AS n_missing, list_filter(cited, lambda c: NOT list_contains(expected, c)) AS wrong FROM all_),
cases AS (SELECT k AS "case", raw, n_missing, array_to_string(cited, ',') AS citations, CASE WHEN k % 5 <> 0 THEN CASE WHEN len(cited) = 0 THEN 1 ELSE len(wrong) END ELSE 0 END AS n_mismatches, CASE WHEN len(points) > 0 THEN n_missing = 0 END AS answer_correct,
  CASE WHEN k % 5 <> 0 THEN len(cited) > 0 AND len(wrong) = 0 AND len(expected) > 0 END AS citations_correct, CASE WHEN len(points) > 0 THEN len(list_filter(points, lambda p: NOT contains(context, p))) = 0 END AS supported FROM graded)"""


def answer_grading(spark, sf_dir):
    return _graded(spark, sf_dir).select("case", F.size("missing").cast("long").alias("n_missing"), F.array_join("citations", ",").alias("citations"), F.size("mismatches").cast("long").alias("n_mismatches"), "answer_correct", "citations_correct", "supported")


def _results(spark, sf_dir, shift: int):
    """The results of a run; ``shift`` makes runs differ."""
    k = F.col("case")
    times = {c: ((k * m + shift) % 101) * 1.5 for c, m in (("embedding_ms", 37), ("search_ms", 53), ("answer_ms", 71), ("total_ms", 89))}
    return _graded(spark, sf_dir).select(
        "case",
        (((k + shift) % 4) / 4).alias("recall_at_k"),
        F.when(k % 7 != 0, 1 / (1 + (k + shift) % 3)).alias("reciprocal_rank"),
        F.when(F.lit(shift > 0) & (k % 6 == 0) & F.col("answer_correct").isNotNull(), F.lit(False)).otherwise(F.col("answer_correct")).alias("answer_correct"),
        F.when(k % 9 != 0, evaluation.is_refusal(F.col("answer")) == (k % 2 == 0)).alias("refusal_correct"),
        "citations_correct",
        F.when(k % 29 == shift, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        *(v.alias(c) for c, v in times.items()),
    )


def _results_sql(name: str, shift: int) -> str:
    times = ", ".join(f'(("case" * {m} + {shift}) % 101) * 1.5::DOUBLE AS {c}' for c, m in (("embedding_ms", 37), ("search_ms", 53), ("answer_ms", 71), ("total_ms", 89)))
    correct = 'CASE WHEN "case" % 6 = 0 AND answer_correct IS NOT NULL THEN false ELSE answer_correct END AS answer_correct' if shift else "answer_correct"
    refused = REFUSED.replace("{said}", SAID % "raw")
    return f'{name} AS (SELECT "case", (("case" + {shift}) % 4)::DOUBLE / 4 AS recall_at_k, CASE WHEN "case" % 7 <> 0 THEN 1::DOUBLE / (1 + ("case" + {shift}) % 3) END AS reciprocal_rank, {correct}, CASE WHEN "case" % 9 <> 0 THEN {refused} = ("case" % 2 = 0) END AS refusal_correct, citations_correct, "case" % 29 = {shift} AS failed, {times} FROM cases)'


def _metrics_sql(name: str, of: str) -> str:
    p95 = lambda c: f"list_sort(list({c}))[greatest(1, least(count(*), CAST(round_even(0.95::DOUBLE * count(*) + 0.5, 0) AS BIGINT)))]"
    rows = {m: f"avg({c})" for m, c in evaluation.AVERAGES.items()} | {m: f"avg(CAST({c} AS DOUBLE))" for m, c in evaluation.RATES.items()} | {m: p95(c) for m, c in evaluation.LATENCIES.items()}
    rows["runtime_error_count"] = "CAST(count(*) FILTER (WHERE failed) AS DOUBLE)"
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {e} AS value FROM {of}" for m, e in rows.items()) + ")"


_RUNS = f"{_GRADED}, {_results_sql('r0', 0)}, {_results_sql('r1', 1)}, {_metrics_sql('m0', 'r0')}, {_metrics_sql('m1', 'r1')}"
_BOUNDS = [("recall_at_k", "minimum", 0.8), ("mrr", "minimum", 0.2), ("search_latency_p95_ms", "maximum", 100.0), ("total_latency_p95_ms", "maximum", 5000.0)]


def metric_bundle(spark, sf_dir):
    return evaluation.metric_bundle(_results(spark, sf_dir, 0)).select("metric", F.round("value", 6).alias("value"))


def metric_deltas(spark, sf_dir):
    return evaluation.metric_deltas(evaluation.metric_bundle(_results(spark, sf_dir, 0)), evaluation.metric_bundle(_results(spark, sf_dir, 1)))


def regressed_cases(spark, sf_dir):
    return evaluation.regressed(_results(spark, sf_dir, 0), _results(spark, sf_dir, 1))


_REGRESSED = """SELECT "case", CASE WHEN a.recall_at_k > b.recall_at_k THEN 'recall_at_k' WHEN a.answer_correct AND NOT b.answer_correct THEN 'answer_correct' WHEN a.refusal_correct AND NOT b.refusal_correct THEN 'refusal_correct' WHEN a.citations_correct AND NOT b.citations_correct THEN 'citations_correct' END AS why FROM r0 a JOIN r1 b USING ("case") WHERE why IS NOT NULL"""


def report_summary(spark, sf_dir):
    results = _results(spark, sf_dir, 1)
    return evaluation.report_summary(results, evaluation.metric_bundle(results), _BOUNDS)


_SUMMARY = """SELECT n AS case_count, e AS error_count, f AS failures, CASE WHEN f > 0 OR e > 0 THEN 'failed' ELSE 'passed' END AS decision FROM (SELECT count(*) AS n, count(*) FILTER (WHERE failed) AS e FROM r1),
(SELECT count(*) FILTER (WHERE metric = 'recall_at_k' AND value < 0.8 OR metric = 'mrr' AND value < 0.2 OR metric = 'search_latency_p95_ms' AND value > 100 OR metric = 'total_latency_p95_ms' AND value > 5000) AS f FROM m1)"""


def expected_locators(spark, sf_dir):
    """Recall and rank by locators: each benchmark item expects a chunk that holds its text, and the first one of a source by its title."""
    bench = model.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case"), "text")
    none = {c: F.lit(None).cast("string").alias(c) for c in ("source_id", "source_title", "section", "content_hash", "snippet")} | {c: F.lit(None).cast("long").alias(c) for c in ("chunk_index", "page")}
    one = F.struct(*({**none, "snippet": F.substring("text", 1, 60).alias("snippet")}[c] for c in sorted(none)))
    two = F.struct(*({**none, "source_title": F.concat(F.lit(" DOC-"), F.col("case").cast("string")).alias("source_title"), "chunk_index": F.lit(0).cast("long").alias("chunk_index")}[c] for c in sorted(none)))
    expected = bench.select("case", F.posexplode(F.array(one, two)).alias("number", "e"))
    near = bench.select("case", F.explode(F.array(F.col("case") + 1, F.col("case"))).alias("doc_id"))
    r = F.struct(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_title"), "chunk_index", F.lit(None).cast("long").alias("page"), F.lit(None).cast("string").alias("section"), F.sha2("content", 256).alias("content_hash"), "content")
    retrieved = near.join(model.chunks(spark, sf_dir), "doc_id").select("case", ((F.col("case") + 1 - F.col("doc_id")) * 1000 + F.col("chunk_index") + 1).alias("rank"), r.alias("r"))
    return evaluation.graded_retrieval(expected, retrieved).select("case", "recall_at_k", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


_LOCATORS = _with(f"""{CHUNKS}, want AS (SELECT item_id AS k, {SAID % "substr(text, 1, 60)"} AS s FROM benchmark),
got AS (SELECT k, s, (k + 1 - doc_id) * 1000 + chunk_index + 1 AS rank, contains({SAID % "content"}, s) AS one, doc_id = k AND chunk_index = 0 AS two FROM want JOIN chunks ON doc_id IN (k, k + 1)),
hit AS (SELECT want.k, coalesce(bool_or(one), false) AS one, coalesce(bool_or(two), false) AS two, min(rank) FILTER (WHERE one OR two) AS r FROM want LEFT JOIN got USING (k) GROUP BY want.k)""", 'SELECT k AS "case", (one::INT + two::INT) / 2 AS recall_at_k, round(coalesce(1::DOUBLE / r, 0), 6) AS reciprocal_rank FROM hit')


# --- reindexing and the index ------------------------------------------------------------------------------


def _run(spark, sf_dir):
    """A run's items after a slice of 300 in which every third document has no vector, and its resume with all vectors."""
    chunks, batches = model.embedded_chunks(spark, sf_dir), model.batches(spark)
    items = lifecycle.plan_items(lifecycle.reindex_candidates(chunks, batches, model.ACTIVE))
    vectors = lambda lacks: chunks.select("chunk_id", F.when(~lacks, F.array(F.lit(1.0))).alias("vector"), F.when(lacks, F.lit("refused: token=abc")).alias("error"))
    for lacks in (F.col("doc_id") % 3 == 0, F.lit(False)):
        items = lifecycle.execute(items, lifecycle.retryable(items, 300), chunks, batches, vectors(lacks), model.ACTIVE)
    return items


def reindex_run(spark, sf_dir):
    return _run(spark, sf_dir).groupBy("status", "attempts", "error").agg(F.count(F.lit(1)).alias("n"))


def reindex_counters(spark, sf_dir):
    return lifecycle.run_counters(_run(spark, sf_dir))


_ITEMS = f"""{STALE}, turn AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_id) AS r FROM stale),
first AS (SELECT *, CASE WHEN r > 300 THEN 'pending' WHEN doc_id % 3 = 0 THEN 'failed_retryable' ELSE 'reindexed' END AS s FROM turn),
again AS (SELECT *, CASE WHEN s <> 'reindexed' THEN row_number() OVER (PARTITION BY s <> 'reindexed' ORDER BY doc_id, chunk_id) END AS r2 FROM first),
items AS (SELECT CASE WHEN r2 <= 300 THEN 'reindexed' ELSE s END AS status, CAST((r <= 300)::INT + coalesce(r2 <= 300, false)::INT AS INTEGER) AS attempts, CASE WHEN s = 'failed_retryable' AND r2 > 300 THEN '[redacted]' END AS error FROM again)"""


def pending_chunks(spark, sf_dir):
    return lifecycle.pending_chunks(model.embedded_chunks(spark, sf_dir), model.batches(spark), model.ACTIVE)


def batch_lifecycle(spark, sf_dir):
    """Orders as embedding batches, the open ones running: they end by their items, some with an error; and the latest completed one of the active configuration."""
    orders = model.table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    batches = orders.select(F.col("o_orderkey").alias("batch_id"), F.when(status == "P", "old").otherwise(model.ACTIVE).alias("config_hash"), F.when(status == "O", "running").otherwise("completed").alias("batch_status"), F.when(status != "O", F.col("o_orderdate")).alias("completed_at"))
    items = model.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_embedded"))
    ended = items.select("batch_id", "n_embedded", F.when(F.col("batch_id") % 5 == 0, F.lit("a\nb")).when(F.col("batch_id") % 7 == 0, F.lit("x token=1")).alias("error"))
    last = lifecycle.latest_batch(batches, model.ACTIVE).select("batch_id", F.lit(True).alias("latest"))
    return lifecycle.finish_batches(batches, ended).join(F.broadcast(last), "batch_id", "left").select("batch_id", "batch_status", "n_embedded", "error", F.coalesce("latest", F.lit(False)).alias("latest"))  # one row


_LIFECYCLE = """WITH b AS (SELECT o_orderkey AS batch_id, o_orderstatus, o_orderdate FROM orders), i AS (SELECT l_orderkey AS batch_id, count(*) AS n FROM lineitem GROUP BY l_orderkey),
last AS (SELECT batch_id FROM b WHERE o_orderstatus NOT IN ('O', 'P') ORDER BY o_orderdate DESC NULLS LAST, batch_id DESC LIMIT 1),
e AS (SELECT b.*, n, o_orderstatus = 'O' AND n IS NOT NULL AS ends, CASE WHEN batch_id % 5 = 0 THEN 'a b' WHEN batch_id % 7 = 0 THEN '[redacted]' END AS err FROM b LEFT JOIN i USING (batch_id))
SELECT batch_id, CASE WHEN ends THEN CASE WHEN err IS NULL THEN 'completed' ELSE 'failed' END WHEN o_orderstatus = 'O' THEN 'running' ELSE 'completed' END AS batch_status, CASE WHEN ends THEN n END AS n_embedded, CASE WHEN ends THEN err END AS error, batch_id IN (SELECT batch_id FROM last) AS latest FROM e"""


def index_validation(spark, sf_dir):
    """The recall of the approximate index, its latencies (of two event types) and the decision to use it."""
    from quillmesh.plans import catalog

    recall = catalog.ann_recall(spark, sf_dir).agg(F.round(F.avg("recall"), 4).alias("recall_at_k"))
    events = model.table(spark, sf_dir, "events")
    rows = events.select("event_type", F.col("value"))
    kinds = rows.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high"))
    p = lambda q, name: evaluation.ranked_value(rows, "event_type", "value", q, lambda n: evaluation.nearest_place(n, q), name)
    each = p(0.5, "p50").join(p(0.95, "p95"), "event_type").crossJoin(F.broadcast(kinds))  # one row
    times = each.agg(F.round(F.max(F.when(F.col("event_type") == F.col("high"), F.col("p95"))), 3).alias("baseline_p95"), F.round(F.max(F.when(F.col("event_type") == F.col("low"), F.col("p50"))), 3).alias("index_p50"), F.round(F.max(F.when(F.col("event_type") == F.col("low"), F.col("p95"))), 3).alias("index_p95"))
    n = model.table(spark, sf_dir, "embeddings").select(retrieval.checked(F.col("embedding"), 64).alias("e")).agg(F.count("e").alias("n"))
    decision = retrieval.decided(F.col("recall_at_k"), 0.95, F.col("baseline_p95"), F.col("index_p95"))
    return recall.crossJoin(times).crossJoin(n).select("recall_at_k", "baseline_p95", "index_p50", "index_p95", "n", F.lit(retrieval.LEAST_INDEXED).cast("long").alias("least"), (F.col("n") >= retrieval.LEAST_INDEXED).alias("large_enough"), decision.alias("decision"))  # a row each


def _validation() -> str:
    from quillmesh.plans import oracle

    return _with(
        f"""{oracle.ANN}, rec AS (SELECT round(avg(recall), 4) AS recall_at_k FROM (SELECT k.query, round(count(ann.id)::DOUBLE / count(*), 4) AS recall FROM (SELECT * FROM knn WHERE rank <= 10) k LEFT JOIN ann USING (query, id) GROUP BY k.query)),
kinds AS (SELECT min(event_type) AS low, max(event_type) AS high FROM events),
t AS (SELECT (SELECT round(quantile_disc(value, 0.95), 3) FROM events WHERE event_type = high) AS baseline_p95, (SELECT round(quantile_disc(value, 0.5), 3) FROM events WHERE event_type = low) AS index_p50, (SELECT round(quantile_disc(value, 0.95), 3) FROM events WHERE event_type = low) AS index_p95 FROM kinds),
n AS (SELECT count(*) AS n FROM embeddings)""",
        "SELECT recall_at_k, baseline_p95, index_p50, index_p95, n, 10000::BIGINT AS least, n >= 10000 AS large_enough, CASE WHEN recall_at_k < 0.95 OR index_p95 >= baseline_p95 THEN 'rejected' ELSE 'accepted' END AS decision FROM rec, t, n",
    )


def search_counts(spark, sf_dir):
    """What a search logs: candidates by path, results, and the range of the finite scores."""
    from quillmesh.plans import catalog

    k = retrieval.candidate_limit(catalog.LIMIT)
    near = retrieval.nearest(catalog._compatible(spark, sf_dir), catalog._query(spark, sf_dir), k)
    found = retrieval.posted_top(model.postings(spark, sf_dir), catalog.TERMS, k)
    one = near.agg(F.count(F.lit(1)).alias("n_vector"), F.min(F.when(~F.isnan("score"), F.col("score"))).alias("least"), F.max(F.when(~F.isnan("score"), F.col("score"))).alias("most"))
    two, three = (df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((found, "n_text"), (retrieval.fused(near, found, catalog.LIMIT), "n_final")))
    return one.crossJoin(two).crossJoin(three)  # a row each


def _counts() -> str:
    from quillmesh.plans import oracle

    return _with(oracle.HYBRID, "SELECT (SELECT count(*) FROM near) AS n_vector, (SELECT min(score) FROM near) AS least, (SELECT max(score) FROM near) AS most, (SELECT count(*) FROM texts) AS n_text, (SELECT count(*) FROM top) AS n_final")


WORKFLOWS = {
    "upload_validation": (upload_validation, _with(_UPLOADS, "SELECT doc_id, filename, error FROM judged")),
    "file_sources": (file_sources, _with(_UPLOADS, "SELECT filename AS title, CASE WHEN doc_id % 4 = 1 THEN 'markdown' ELSE 'text' END AS source_type, 'upload:' || filename AS uri, sha256(content_text) AS content_hash FROM judged WHERE error IS NULL")),
    "duplicate_guard": (duplicate_guard, _with(SRC, "SELECT doc_id, count(*) OVER (PARTITION BY content_text) > 1 AS duplicate FROM src")),
    "page_texts": (page_texts, _PAGES),
    "chunk_sections": (chunk_sections, _SECTIONS),
    "chunk_pages": (chunk_pages, _PAGED),
    "chunk_locations": (chunk_locations, _LOCATIONS),
    "chunk_rows": (chunk_rows, _ROWS),
    "tag_mutations": (tag_mutations, _TAGS),
    "project_mutations": (project_mutations, _PROJECTS),
    "source_delete_cascade": (source_delete_cascade, _CASCADE),
    "source_update": (source_update, _UPDATE),
    "link_backfill": (link_backfill, _with(CATS, "SELECT category, count(*) AS n FROM cats GROUP BY category")),
    "config_upsert": (config_upsert, "SELECT r_name AS key, CASE WHEN r_name = 'ASIA' THEN 'changed' ELSE CAST(r_regionkey AS VARCHAR) END AS value FROM region UNION ALL SELECT 'new key', 'added' UNION ALL SELECT 'ASIA', 'changed' WHERE 'ASIA' NOT IN (SELECT r_name FROM region)"),
    "point_lookups": (point_lookups, _with(SRC, "SELECT 'id' AS \"by\", doc_id FROM src WHERE doc_id = 3 UNION ALL SELECT 'title', doc_id FROM src WHERE doc_id = 5 UNION ALL SELECT 'hash', doc_id FROM src WHERE content_text IN (SELECT content_text FROM src WHERE doc_id = 3) UNION ALL SELECT 'twice', 7")),
    "projects_by_status": (projects_by_status, _with(f"{STALE}, {CATS}", "SELECT 'archived' AS what, 4::BIGINT AS n UNION ALL SELECT 'curated candidates', count(*) FROM stale WHERE doc_id IN (SELECT doc_id FROM cats WHERE category = 'curated')")),
    "answer_grading": (answer_grading, _with(_GRADED, 'SELECT "case", n_missing, citations, n_mismatches, answer_correct, citations_correct, supported FROM cases')),
    "metric_bundle": (metric_bundle, _with(_RUNS, "SELECT metric, round(value, 6) AS value FROM m0")),
    "metric_deltas": (metric_deltas, _with(_RUNS, "SELECT metric, round(m1.value - m0.value, 6) AS delta FROM m1 JOIN m0 USING (metric)")),
    "regressed_cases": (regressed_cases, _with(_RUNS, _REGRESSED)),
    "report_summary": (report_summary, _with(_RUNS, _SUMMARY)),
    "expected_locators": (expected_locators, _LOCATORS),
    "reindex_run": (reindex_run, _with(_ITEMS, "SELECT status, attempts, error, count(*) AS n FROM items GROUP BY ALL")),
    "reindex_counters": (reindex_counters, _with(_ITEMS, "SELECT a AS chunks_reindexed, 0::BIGINT AS chunks_reused, f AS chunks_failed, p AS chunks_left, CASE WHEN f > 0 THEN 'failed' WHEN p > 0 THEN 'running' ELSE 'completed' END AS status FROM (SELECT count(*) FILTER (WHERE status = 'reindexed') AS a, count(*) FILTER (WHERE status = 'failed_retryable') AS f, count(*) FILTER (WHERE status = 'pending') AS p FROM items)")),
    "pending_chunks": (pending_chunks, _with(EMBEDDED, "SELECT chunk_id, doc_id FROM emb LEFT JOIN batches USING (batch_id) WHERE embedding_status <> 'embedded' OR config_hash IS NULL OR config_hash <> 'active'")),
    "batch_lifecycle": (batch_lifecycle, _LIFECYCLE),
    "index_validation": (index_validation, _validation()),
    "search_counts": (search_counts, _counts()),
}
