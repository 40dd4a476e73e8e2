"""Retrieval evaluation: recall, rank, percentiles, gates and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import compared, tokens
from quillmesh.sources.shared import written

#: What marks an answer as a refusal.
REFUSALS = ("nao encontrei essa informacao", "nao encontrei esta informacao", "nao tenho informacao", "nao tenho essa informacao", "nao disponho de informacao", "i don't know", "cannot find", "not enough information")


def case_results(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """retrieved (case, id, rank), expected (case, id) -> case, recall_at_k, reciprocal_rank (0 without a hit)."""
    hit = expected.join(retrieved, ["case", "id"], "left")
    return hit.groupBy("case").agg((F.count("rank") / F.count("id")).alias("recall_at_k"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


RANGE = 1000  # ids of a range, whose rows of one label are sorted together


def next_ids(rows: DataFrame, asked: DataFrame, ident: str, label: str, n: int) -> DataFrame:
    """rows and asked (ident, label) -> ident, id: for each asked row the n rows of its label with the least ids above its own.

    Rows are held in ranges of ids. A range gives its n least ids of a label; those of the n next ranges with any are all that can be needed from beyond a row's own.
    """
    every = rows.select(F.col(label).alias("l"), F.col(ident).alias("id")).filter("l IS NOT NULL AND id IS NOT NULL").withColumn("range", F.floor(F.col("id") / RANGE))
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("l", "range").orderBy("id"))).filter(F.col("r") <= n)
    heads = first.groupBy("l", "range").agg(F.array_sort(F.collect_list("id")).alias("head"))  # n a range
    after = Window.partitionBy("l").orderBy("range").rowsBetween(1, n)
    beyond = heads.select("l", "range", F.slice(F.flatten(F.collect_list("head").over(after)), 1, n).alias("beyond"))
    wanted = asked.select(F.col(label).alias("l"), F.col(ident).alias("asked")).filter("l IS NOT NULL").withColumn("range", F.floor(F.col("asked") / RANGE))
    inside = wanted.join(every, ["l", "range"]).filter("id > asked").select("asked", "id")
    outside = wanted.join(beyond, ["l", "range"]).select("asked", F.explode("beyond").alias("id"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy("id"))
    return inside.unionByName(outside).withColumn("r", place).filter(F.col("r") <= n).select(F.col("asked").alias(ident), "id")


WHOLE = 100_000  # values of a group that are ranked without narrowing first
NARROW = 2e-4  # on either side of the asked share; the sketch is within 1e-4


def rounded_place(n, percent: int = 95) -> Column:
    """round(p * n + 0.5), half to even, within 1..n."""
    return F.greatest(F.lit(1), F.least(n, F.bround(F.lit(percent / 100) * n + 0.5).cast("long")))


def nearest_place(n, p: float) -> Column:
    """ceil(p * n), 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.lit(p) * n).cast("long"))


def ranked_values(rows: DataFrame, group: str, value: str, wanted: dict) -> DataFrame:
    """rows (group, value) -> group and a column for each name of ``wanted`` {name: (p, place)}: the group's value at place(n) of its n sorted ones, exactly.

    One sketch brackets all places; the values below and inside the brackets are counted, and only those inside are ranked. Where a place
    turns out to lie outside its bracket, what lies on that side of it is the bracket.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v IS NOT NULL")
    shares = [s for p, _ in wanted.values() for s in (max(p - NARROW, 0.0), min(p + NARROW, 1.0))]
    about = rows.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", shares, 10_000).alias("b"))
    few = F.col("n") <= WHOLE
    about = about.select("g", "least", "most", *(x for i, (_, place) in enumerate(wanted.values()) for x in (place(F.col("n")).alias(f"place{i}"), F.when(few, F.col("least")).otherwise(F.col("b")[2 * i]).alias(f"low{i}"), F.when(few, F.col("most")).otherwise(F.col("b")[2 * i + 1]).alias(f"high{i}"))))
    below = rows.join(about, "g").groupBy("g").agg(*(x for i in range(len(wanted)) for x in (F.count_if(F.col("v") < F.col(f"low{i}")).alias(f"below{i}"), F.count_if(F.col("v") < F.col(f"high{i}")).alias(f"under{i}"), F.count_if(F.col("v") <= F.col(f"high{i}")).alias(f"upto{i}"))))

    def bracket(i: int, name: str):
        place, low, high = F.col(f"place{i}"), F.col(f"low{i}"), F.col(f"high{i}")
        under, over = place <= F.col(f"below{i}"), place > F.col(f"upto{i}")
        start, end = F.when(under, F.col("least")).when(over, high).otherwise(low), F.when(under, low).when(over, F.col("most")).otherwise(high)
        base = F.when(under, F.lit(0)).when(over, F.col(f"under{i}")).otherwise(F.col(f"below{i}"))
        return F.struct(F.lit(name).alias("name"), place.alias("place"), start.alias("start"), end.alias("end"), base.cast("long").alias("base"))

    brackets = about.join(below, "g").select("g", F.array(*(bracket(i, name) for i, name in enumerate(wanted))).alias("k"))
    each = rows.join(brackets, "g").select("g", "v", F.explode(F.filter("k", lambda x: (x["start"] <= F.col("v")) & (F.col("v") <= x["end"]))).alias("k"))
    inside = each.groupBy("g", "k", "v").agg(F.count(F.lit(1)).alias("times"))
    placed = inside.withColumn("upto", F.col("k.base") + F.sum("times").over(Window.partitionBy("g", "k.name").orderBy("v")))
    hit = placed.filter((F.col("upto") >= F.col("k.place")) & (F.col("upto") - F.col("times") < F.col("k.place")))
    return hit.groupBy(F.col("g").alias(group)).agg(*(F.max(F.when(F.col("k.name") == name, F.col("v"))).alias(name) for name in wanted))


def ranked_value(rows: DataFrame, group: str, value: str, p: float, place, name: str) -> DataFrame:
    """``ranked_values`` of one place."""
    return ranked_values(rows, group, value, {name: (p, place)})


def is_refusal(answer) -> Column:
    said = compared(answer)
    return F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(said, p))


def gate(metrics: DataFrame, bounds: list[tuple[str, str, float]]) -> DataFrame:
    """metrics (metric, value) -> the violated bounds (metric, mode, bound); without a value none is violated."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(mode).alias("mode"), F.lit(float(b)).alias("bound")) for m, mode, b in bounds))).alias("x")
    failed = F.when(F.col("x.mode") == "minimum", F.col("value") < F.col("x.bound")).otherwise(F.col("value") > F.col("x.bound"))
    return metrics.select("metric", "value", each).filter((F.col("x.m") == F.col("metric")) & failed).select("metric", "value", "x.mode", "x.bound")


def holds(text, part) -> Column:
    """Whether a compared text holds another one."""
    return F.contains(text, compared(part))


#: Fixed value: what an answer without citations is told.
UNCITED = "answer does not cite a retrieved expected source"


def grade_answers(cases: DataFrame) -> DataFrame:
    """cases (case, answer, points, sources: array<struct<id, title, content, expected>> by rank, wants_sources) with its grades.

    missing: the points the answer lacks; answer_correct: none is missing; citations: the sources whose id or title
    the answer holds, by rank; citations_correct: some are cited, all of them expected; mismatches: the cited that are not, or `UNCITED`;
    supported: all points stand in what was retrieved. Where nothing is expected a grade is null.
    """
    said = compared(F.coalesce("answer", F.lit("")))
    asks = F.size("points") > 0
    missing = F.filter("points", lambda p: ~holds(said, p))
    cited = F.array_distinct(F.transform(F.filter("sources", lambda s: holds(said, s["id"]) | holds(said, s["title"])), lambda s: s["id"]))
    expected = F.transform(F.filter("sources", lambda s: s["expected"]), lambda s: s["id"])
    context = compared(F.array_join(F.transform("sources", lambda s: s["content"]), " "))
    graded = cases.withColumns({"missing": missing, "citations": cited, "mismatches": F.array_except(cited, expected)})
    correct = F.when(F.size("citations") == 0, F.lit(False)).otherwise((F.size("mismatches") == 0) & (F.size(expected) > 0))
    return graded.withColumns(
        {
            "answer_correct": F.when(asks, F.size("missing") == 0),
            "citations_correct": F.when(F.col("wants_sources"), correct),
            "mismatches": F.when(F.col("wants_sources"), F.when(F.size("citations") == 0, F.array(F.lit(UNCITED))).otherwise(F.col("mismatches"))).otherwise(F.array().cast("array<string>")),
            "supported": F.when(asks, F.forall("points", lambda p: holds(context, p))),
        }
    )


#: The metrics of a report, by how a column of the case results makes them.
AVERAGES = {"recall_at_k": "recall_at_k", "mrr": "reciprocal_rank"}
RATES = {"answer_correct_rate": "answer_correct", "refusal_correct_rate": "refusal_correct", "citation_correct_rate": "citations_correct"}
LATENCIES = {"embedding_latency_p95_ms": "embedding_ms", "search_latency_p95_ms": "search_ms", "answer_latency_p95_ms": "answer_ms", "total_latency_p95_ms": "total_ms"}


def metric_bundle(results: DataFrame) -> DataFrame:
    """Case results -> metric, value: means and rates over what is known, 95th percentiles, and the number of cases with errors."""
    means = {m: F.avg(F.col(c).cast("double")) for m, c in (AVERAGES | RATES).items()}
    one = results.agg(*(v.alias(m) for m, v in means.items()), F.sum((F.size("errors") > 0).cast("double")).alias("runtime_error_count"))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in one.columns))).alias("x")).select("x.*")
    times = results.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in LATENCIES.items()))).alias("x")).select("x.*")
    found = ranked_value(times, "metric", "v", 0.95, rounded_place, "value")
    names = results.sparkSession.createDataFrame([(m,) for m in LATENCIES], "metric string")
    return rows.unionByName(names.join(found, "metric", "left"))


def metric_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """metric, delta of the metrics that both reports have; null where a value is."""
    return candidate.join(baseline.select("metric", F.col("value").alias("old")), "metric").select("metric", F.round(F.col("value") - F.col("old"), 6).alias("delta"))


FLAGS = ("answer_correct", "refusal_correct", "citations_correct")


def regressed(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """The cases of both reports whose recall fell, or that have a flag which was true and is false, with why: the first of these."""
    old = baseline.select("case", *(F.col(c).alias(f"old_{c}") for c in ("recall_at_k", *FLAGS)))
    fell = F.when(F.coalesce("old_recall_at_k", F.lit(0.0)) > F.coalesce("recall_at_k", F.lit(0.0)), "recall_at_k")
    lost = [F.when(F.col(f"old_{c}") & ~F.col(c), c) for c in FLAGS]
    return candidate.join(old, "case").select("case", F.coalesce(fell, *lost).alias("why")).filter("why IS NOT NULL").distinct()


def report_summary(results: DataFrame, metrics: DataFrame, bounds: list[tuple[str, str, float]]) -> DataFrame:
    """One row: case_count, error_count, failures (violated bounds), decision: failed where a bound is violated or a case had an error."""
    counts = results.agg(F.count(F.lit(1)).alias("case_count"), F.count_if(F.size("errors") > 0).alias("error_count"))
    failed = gate(metrics, bounds).agg(F.count(F.lit(1)).alias("failures"))
    decision = F.when((F.col("failures") > 0) | (F.col("error_count") > 0), "failed").otherwise("passed")
    return counts.crossJoin(failed).select("*", decision.alias("decision"))  # a row each


#: The locators of an expected chunk, and whether they are compared as texts.
LOCATORS = {"source_id": False, "source_title": True, "chunk_index": False, "page": False, "section": True, "content_hash": False}


def expected_match(retrieved: str = "r", expected: str = "e") -> Column:
    """Whether a retrieved chunk fits every locator that an expected one gives, a snippet included; structs."""
    fits = F.lit(True)
    for name, as_text in LOCATORS.items():
        want, got = F.col(f"{expected}.{name}"), F.col(f"{retrieved}.{name}")
        same = compared(want) == compared(F.coalesce(got, F.lit(""))) if as_text else want == got
        fits = fits & F.when(want.isNull(), True).otherwise(F.coalesce(same, F.lit(False)))
    snippet = F.col(f"{expected}.snippet")
    return fits & F.when(snippet.isNull(), True).otherwise(holds(compared(F.col(f"{retrieved}.content")), snippet))


def graded_retrieval(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """expected (case, number, e), retrieved (case, rank, r) -> case, recall_at_k, reciprocal_rank, over the expected rows that each case states."""
    pairs = expected.join(retrieved, "case", "left").withColumn("hit", F.coalesce(expected_match(), F.lit(False)) & F.col("rank").isNotNull())
    each = pairs.groupBy("case", "number").agg(F.max("hit").alias("hit"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return each.groupBy("case").agg(F.avg(F.col("hit").cast("double")).alias("recall_at_k"), F.coalesce(1 / F.min("first"), F.lit(0.0)).alias("reciprocal_rank"))


SEED = 6  # words of the run by which chunks and snippets meet


def holding(chunks: DataFrame, snippets: DataFrame) -> DataFrame:
    """chunks (chunk_id, content), snippets (item_id, t: words) -> item_id, chunk_id where the chunk's words hold the snippet's in one run.

    They meet on the hash of a snippet's first words, `SEED` or one where it is shorter, and are then compared whole.
    """
    held = chunks.select("chunk_id", tokens("content").alias("c"))
    size = F.when(F.size("t") >= SEED, SEED).otherwise(1)
    first = lambda n: F.xxhash64(F.lit(n), *(F.get("t", F.lit(i)) for i in range(n)))
    wanted = snippets.filter(F.size("t") > 0).select("item_id", "t", size.alias("n")).withColumn("run", F.when(F.col("n") == SEED, first(SEED)).otherwise(first(1)))
    wanted = written(wanted, "snippets")  # known to be small where it is, and then broadcast
    used = [r.n for r in wanted.select("n").distinct().collect()]  # of two lengths

    def runs(n: int) -> Column:
        """The hashes of all runs of n words; the words are taken as they lie."""
        hashed = F.transform(F.sequence(F.lit(0), F.size("c") - n), lambda i: F.xxhash64(F.lit(n), *(F.get("c", i + k) for k in range(n))))
        return F.when(F.size("c") >= n, hashed).otherwise(F.array().cast("array<long>"))

    seeds = held.select("chunk_id", F.explode(F.concat(F.array().cast("array<long>"), *(runs(n) for n in used))).alias("run"))
    met = written(seeds.join(wanted, "run").select("chunk_id", "item_id", "t").distinct(), "candidates").join(chunks.select("chunk_id", tokens("content").alias("c")), "chunk_id")
    spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return met.filter(F.contains(spaced("c"), spaced("t"))).select("item_id", "chunk_id").distinct()
