"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

The elements of a text are its distinct runs of `SHINGLE` words (white space apart, A-Z
lower-cased; all words where there are fewer), each with a weight: its number of
occurrences, or 1 without ``weighted``. An element's region is its weight by all ranks;
darts fall on it as a Poisson process seeded by the element's hash alone, so texts that
share an element share its darts. A dart names one of `COORDINATES` coordinates, and each
coordinate keeps its earliest dart. The throw goes up to the rank where a text of its weight
has about k ln k + 2k darts, and twice as far for the few texts that still lack a coordinate.

Two texts agree in a coordinate with the probability of their (weighted) Jaccard similarity.
`BANDS` bands of `ROWS` coordinates are joined: at similarity 0.8 a pair is missed with
probability 3e-6. The classes are the connected components of all pairs that share
a band and whose exact similarity is `THRESHOLD` or more:

1. Equal texts are one node.
2. Each band's bucket is compared with one member of it, the one that meets the most others,
   so a large bucket costs its size.
3. Buckets whose members are still in several components are compared across these only,
   by classes of weight, and only where two nodes can be similar: what they have in common is
   at most what either shares with any other node, and at most what their `LEAST` least
   elements share and leave open. None of this loses a pair.

Before the exact check of a pair, its signatures must agree in `AGREE` coordinates; this
would lose a pair at the threshold with probability 2e-5.

Defined cases: null is the empty text; texts without words are equal to each other only
where they are the same text; equal rows are in one class; a null doc_id is a document
like any other and names a class only where all its ids are null; classes that share a
least id, as rows of one id but unlike texts do, differ in class_node; an empty table gives an
empty result; further columns are not read. Equality of texts is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import wordhash
from quillmesh.llm.common import freeing, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
SLACK = 1e-6  # of the bounds, so that no pair at the very threshold is lost to rounding
LEAST = 160  # elements of a text whose upper 32 bits are compared before the exact check
SOME = 0.35  # of all element hashes, by which most texts without a similar one are told before all of their elements are counted
FEW_NODES = 2_000_000  # texts in buckets whose ids (16 MB) are broadcast to the texts; where there are more, texts are shuffled to them
AGREE = 62  # of 96 four-bit coordinates, of which 78 agree on the average at a similarity of 0.8

_THROW = COORDINATES * np.log(COORDINATES) + 2 * COORDINATES
_TWO = np.float64(2.0**-53)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _TWO


def elements(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, element hash, occurrences) of all texts, by text and hash."""
    hashes, begin = wordhash.text_words(texts, lower=True)
    sizes = np.diff(begin)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(np.arange(len(hashes)) + SHINGLE <= begin[1:][owner])
    found, of = wordhash.runs(hashes, SHINGLE)[starts] if len(starts) else np.zeros(0, np.uint64), owner[starts]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    rest = np.array([wordhash.runs(hashes[begin[k] : begin[k + 1]], int(sizes[k]))[0] for k in short.tolist()], dtype=np.uint64)
    of, found = np.concatenate([of, short]), np.concatenate([found, rest])
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    head = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(found) != 0))) if len(of) else np.zeros(0, int)
    return of[head], found[head], np.diff(np.append(head, len(of)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The earliest dart in each coordinate of n texts, and whether a text has any."""
    out = np.zeros((n, COORDINATES), dtype=np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    todo, reach = total > 0, _THROW
    while todo.any():
        mine = todo[owner]
        if (strips := np.ceil(weight[mine]).astype(np.int64)).max() == 1:
            o, e, w, strip = owner[mine], element[mine], weight[mine], np.zeros(int(mine.sum()))
        else:
            which = np.repeat(np.flatnonzero(mine), strips)
            o, e, w = owner[which], element[which], weight[which]
            strip = (np.arange(len(which)) - np.repeat(np.cumsum(strips) - strips, strips)).astype(np.float64)
        state = wordhash.mix(e + strip.astype(np.uint64) * wordhash.MIX_A)
        rank, limit = np.zeros(len(o)), reach / total[o]
        best = np.full(n * COORDINATES, np.inf)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(o):
            state = wordhash.mix(state + wordhash.BASE)  # the next dart of each strip
            rank = rank - np.log(_uniform(state))
            near = rank <= limit
            o, w, strip, state, rank, limit = o[near], w[near], strip[near], state[near], rank[near], limit[near]
            dart = wordhash.mix(state ^ wordhash.MIX_B)
            inside = strip + _uniform(wordhash.mix(dart + np.uint64(1))) < w
            slot = o * COORDINATES + (wordhash.mix(dart + np.uint64(2)) % np.uint64(COORDINATES)).astype(np.int64)
            darts.append((slot[inside], rank[inside], dart[inside]))
        slot, rank, dart = (np.concatenate(x) for x in zip(*darts, strict=True))
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        flat = out.reshape(-1)
        flat[slot[first]] = dart[first]
        full = np.isfinite(best.reshape(n, COORDINATES)).all(axis=1)
        todo &= ~full
        reach *= 2
    return out, total > 0


def band_keys(signature: np.ndarray) -> np.ndarray:
    """The bands' hashes: a text's rows of coordinates, each with the band's number."""
    parts = signature.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = wordhash.mix(key + parts[:, :, k] * wordhash.BASE)
    return key.view(np.int64)


def _sign(weighted: bool):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for low, high in wordhash.blocks(texts, 2 << 20):
                owner, element, times = elements(texts[low:high])
                weight = times.astype(np.float64) if weighted else np.ones(len(times))
                signature, some = signatures(owner, element, weight, high - low)
                shifts = np.arange(0, 64, 4, dtype=np.uint64)
                sig = ((signature & np.uint64(15)).reshape(-1, COORDINATES // 16, 16) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)
                every = np.arange(0, sig.size + 1, COORDINATES // 16, dtype=np.int32)
                keys = band_keys(signature)
                rows = np.flatnonzero(some)
                at = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.ListArray.from_arrays(pa.array(every), pa.array(sig.ravel())), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[rows].ravel()))],
                    names=["node", "doc_id", "sig", "bands"],
                )

    return sign


def _element_lists(weighted: bool):
    """(node, text) -> node, elements: each once, or with ``weighted`` a number for each of its occurrences, so that sizes are weights."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in wordhash.blocks(texts):
                owner, element, times = elements(texts[low:high])
                if weighted:
                    which = np.repeat(np.arange(len(times)), times)
                    turn = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    owner, element = owner[which], element[which]
                    element = np.where(turn == 0, element, wordhash.mix(element + turn.astype(np.uint64) * wordhash.MIX_A))
                at = pa.array(np.searchsorted(owner, np.arange(high - low + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(at, pa.array(element.view(np.int64)))], names=["node", "elements"])

    return listed


def _similar(pairs: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) whose exact similarity reaches the threshold."""
    one = lists.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    wanted = lists.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    two = wanted.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    common = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(one, "a").join(two, "b").filter(common >= threshold * (F.size("ea") + F.size("eb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, label: the least node of its component. Each round joins tables in the shared folder."""
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").toDF("a", "b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        near = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        # and the label of that label, which halves a chain
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = written(near.join(jump, near["label"] == jump["at"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def _labelled(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> its rows (node, doc_id, text), and node, doc_id (its least), label (of its component) for every node."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    signed = rows.mapInArrow(freeing(_sign(weighted)), "node long, doc_id long, sig array<long>, bands array<long>")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")

    each = nodes.select("node", F.explode("bands").alias("key"))
    buckets = each.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    members = written(each.join(buckets, "key"), "members")
    # a bucket's pivot is its member that meets the most others over all bands, which in a class is the one they vary
    met = members.groupBy("node").agg(F.sum("times").alias("met"))
    pivots = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    met = written(met, "met")
    if met.count() <= FEW_NODES:  # only their texts are shuffled then
        texts = rows.select("node", "text").join(F.broadcast(met.select("node")), "node", "left_semi").dropDuplicates(["node"])
    else:
        texts = rows.select("node", "text").dropDuplicates(["node"]).join(met, "node", "left_semi")
    lists = written(texts.mapInArrow(freeing(_element_lists(weighted)), "node long, elements array<long>"), "elements")

    signs = nodes.select("node", "sig")
    star = members.join(pivots, "key").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    first = written(star, "pairs")
    agreed = written(_agreeing(first, signs, threshold), "pairs")
    links = written(_similar(agreed, lists, threshold), "links")
    labels = components(links)
    # buckets that still hold several components
    named = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    apart = written(named.join(split, "key"), "apart")
    # what two texts have in common is at most what either shares with any other, and neither's weight is far from the other's
    size = F.floor(F.log("total") / F.log(F.lit(1.01 / threshold)))
    near = _not_alone(lists.join(apart.select("node").distinct(), "node", "left_semi"), threshold)
    sized = apart.join(_shared_weight(near).filter(F.col("shared") >= threshold * F.col("total")).withColumn("size", size), "node").join(signs, "node")
    carried = ("node", "label", "total", "shared", "size", "sig", "least", "alike")
    one = sized.select("key", "size", *(F.col(c).alias(f"{c}_x") for c in carried))
    two = sized.select("key", F.explode(F.array("size", F.col("size") - 1)).alias("size"), *(F.col(c).alias(f"{c}_y") for c in carried))
    once = F.when(F.col("size_x") < F.col("size_y"), F.col("label_x") != F.col("label_y")).otherwise(F.col("label_x") < F.col("label_y"))
    possible = F.least("shared_x", "shared_y") * (1 + threshold) >= threshold * (F.col("total_x") + F.col("total_y")) - SLACK
    # signatures and least elements are compared within the join, so only pairs worth an exact check leave it
    across = one.join(two, ["key", "size"]).filter(once & possible & _agree("sig_x", "sig_y", threshold) & _may("x", "y", threshold))
    across = across.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    across = written(across, "pairs")
    more = written(_similar(across, lists, threshold), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    return rows, nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) -> doc_id, node (of its text), class_id (the least doc_id of its class), class_node (the class, whatever its ids) for every row."""
    rows, labelled = _labelled(docs, **options)
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = labelled.join(least, "label").select("node", "class_id", F.col("label").alias("class_node"))
    return rows.select("doc_id", "node").join(classes, "node").select("doc_id", "node", "class_id", "class_node")


def _not_alone(lists: DataFrame, threshold: float) -> DataFrame:
    """lists without the texts that have too many elements to themselves for any similar one, by `SOME` of all element hashes: what is not counted may be shared."""
    least = F.lit(int(((1 << 64) * SOME) - (1 << 63))).cast("long")
    each = lists.select("node", F.explode(F.filter("elements", lambda e: e < least)).alias("element"))
    own = each.groupBy("element").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node")).filter("nodes = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    met = lists.join(own, "node", "left")
    return written(met.filter(F.coalesce("own", F.lit(0)) <= (1 - threshold) * F.size("elements") + SLACK).select("node", "elements"), "elements")


def _shared_weight(lists: DataFrame) -> DataFrame:
    """node, total (its weight), shared (the weight of its elements that another of these nodes has too), least (the upper halves of its least elements, in order), alike (how many of these equal another)."""
    each = lists.select("node", F.explode("elements").alias("element"))
    own = each.groupBy("element").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node")).filter("nodes = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    total = F.size("elements").cast("long")
    least = F.transform(F.slice(F.array_sort("elements"), 1, LEAST), lambda e: F.shiftright(e, 32).cast("int"))
    found = lists.select("node", total.alias("total"), least.alias("least")).join(own, "node", "left")
    return found.select("node", "total", (F.col("total") - F.coalesce("own", F.lit(0))).alias("shared"), "least", (F.size("least") - F.size(F.array_distinct("least"))).cast("int").alias("alike"))


def _may(a: str, b: str, threshold: float):
    """Whether two texts may be similar by their least elements: below where both lists reach they are compared, and of the rest all that fits may be common.

    Of elements only the upper halves are compared: equal ones of one text count as common, and those at the end itself as rest. This loses no pair.
    """
    x, y = F.col(f"least_{a}"), F.col(f"least_{b}")
    whole = F.col(f"total_{a}") + F.col(f"total_{b}")
    common = F.size(F.array_intersect(x, y)) + F.col(f"alike_{a}")
    end = F.least(*(F.when(F.col(f"total_{k}") > LEAST, v[LEAST - 1]) for k, v in ((a, x), (b, y))))
    rest = F.least(*(F.col(f"total_{k}") - F.size(F.filter(v, lambda e: e < end)) for k, v in ((a, x), (b, y))))
    return (common + F.when(end.isNull(), 0).otherwise(rest)) * (1 + threshold) >= threshold * whole - SLACK


def _agree(a: str, b: str, threshold: float):
    """Whether two signatures agree in enough coordinates: the expected number less about four standard deviations."""
    least = AGREE - max(0.0, THRESHOLD - threshold) * COORDINATES
    differ = F.lit(0)
    for k in range(COORDINATES // 16):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return (F.lit(COORDINATES) - differ) >= least


def _agreeing(pairs: DataFrame, signs: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) that agree in enough coordinates to be worth an exact check."""
    one, two = signs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), signs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(one, "a").join(two, "b").filter(_agree("sig_a", "sig_b", threshold)).select("a", "b")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one row of each class: of the least doc_id (null last), then of one text, then one of equal rows."""
    _, labelled = _labelled(docs.select("doc_id", "text"), **options)
    names = {c.lower() for c in docs.columns}
    ident, node, row = (next(x for x in (f"_{c}", f"_{c}_", f"__{c}__") if x not in names) for c in ("id", "node", "row"))
    hashed = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    marked = docs.withColumns({ident: F.col("doc_id").cast("long"), node: F.xxhash64(F.coalesce("text", F.lit(""))), row: hashed})
    equal = marked.select(F.col(ident).alias("id"), F.col(node).alias("node"), F.col(row).alias("row")).groupBy("id", "node", "row").agg(F.count(F.lit(1)).alias("times"))
    # the best row of each text before that of each class, so neither a common text nor a large class meets in one task
    best = equal.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "times")).alias("b"))
    best = best.join(labelled.select("node", "label"), "node").groupBy("label").agg(F.min(F.struct("b.no_id", "b.id", "node", "b.row", "b.times")).alias("b"))
    keys = written(best.select(F.col("b.id").alias("kept_id"), F.col("b.node").alias("kept_node"), F.col("b.row").alias("kept_row"), F.col("b.times").alias("kept_times")), "kept")
    same = marked[ident].eqNullSafe(keys["kept_id"]) & (marked[node] == keys["kept_node"]) & (marked[row] == keys["kept_row"])
    if keys.filter("kept_times > 1").isEmpty():
        return marked.join(keys, same, "left_semi").select(*docs.columns)
    once = marked.join(keys.filter("kept_times = 1"), same, "left_semi")
    often = marked.join(keys.filter("kept_times > 1"), same, "left_semi").dropDuplicates([ident, node, row])
    return once.unionByName(often).select(*docs.columns)


def op5_dart_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    from quillmesh.llm.common import table

    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_node")
