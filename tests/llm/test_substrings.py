import random

import pytest

from quillmesh.llm import substrings


def _brute(rows, length):
    order = lambda d: (d is not None, d or 0)
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for k in range(len(w) - length + 1):
            key, at = tuple(w[k : k + length]), (order(d), k)
            first[key] = min(first.get(key, at), at)
    out = []
    for d, w in words:
        gone = {p for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < (order(d), k) for p in range(k, k + length)}
        out.append((d, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=lambda r: (order(r[0]), r[3]))


@pytest.mark.parametrize("seed,block", [(1, None), (2, 50), (3, 7)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    rng = random.Random(seed)
    make = lambda n: [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n)]
    passages = [make(rng.randrange(15, 90)) for _ in range(12)]
    rows = []
    for d in range(70):
        w = []
        for _ in range(rng.randrange(5)):
            w += make(rng.randrange(25))
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            w += p[a : rng.randrange(a, len(p)) + 1]
        rows.append((d, "\n".join(w) if d % 2 else " \t".join(w)))
    rows += [(100, None), (101, ""), (102, "aa " * 500), (103, "aa " * 19), (104, "bb cc " * 60), (None, " ".join(passages[0])), (105, rows[5][1]), (105, rows[5][1]), (106, "é 漢 " * 40), (105, " ".join(passages[3] * 2))]
    rng.shuffle(rows)
    if block:
        monkeypatch.setattr(substrings, "BLOCK_ROWS", block)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string").repartition(5)
    got = [(r.doc_id, *substrings.kept_words(r.text, r.repeats)) for r in substrings.find_repeats(docs).collect()]
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[3])) == _brute(rows, substrings.LENGTH)


@pytest.mark.parametrize("tasks", [1, 2])
def test_texts_that_share_an_id_and_a_start(spark, tasks):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, "short " + passage)] + [(d, f"{passage} tail{x}") for d in (None, 7) for x in range(4)]
    for here in (rows, [r for r in rows if r[0] is not None], [r for r in rows if r[0] is None]):
        late = [r for r in here if r[0] != 1]
        docs = spark.createDataFrame(late, "doc_id long, text string").coalesce(1)
        if len(late) < len(here):
            first = spark.createDataFrame([rows[0]], "doc_id long, text string").coalesce(1)
            docs = docs.union(first) if tasks == 2 else docs.union(first).coalesce(1)
        got = [(r.doc_id, *substrings.kept_words(r.text, r.repeats)) for r in substrings.find_repeats(docs).collect()]
        assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[3])) == _brute(here, substrings.LENGTH)


def test_empty(spark):
    assert substrings.find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_one_id_whose_short_hashes_collide(spark):
    """Texts under one id are told apart by 64 bits; these two share their 32-bit hash and differ in length."""
    from pyspark.sql import functions as F

    base = " ".join(f"w{k}" for k in range(30))
    made = spark.range(300_000).select(F.concat(F.lit(base + " "), F.repeat(F.lit("more "), (F.col("id") % 40).cast("int")), F.col("id").cast("string")).alias("text")).withColumn("h", F.hash("text"))
    pair = [r.t for r in made.groupBy("h").agg(F.collect_list("text").alias("t"), F.count_distinct(F.length("text")).alias("n")).filter("n > 1").limit(3).collect()]
    assert pair
    rows = [(1, t) for t in pair[0]] + [(None, t) for t in pair[1]] + [(2, pair[0][0])]
    got = substrings.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    words = {r.doc_id: r.repeats for r in got if r.doc_id == 2}
    assert [tuple(x) for x in words[2]] == [(0, len(pair[0][0].split()))]


def test_very_long_text(spark):
    words = [f"w{k}" for k in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[50_000:50_030])), (3, "x " * 200_000)]
    got = {r.doc_id: [tuple(x) for x in r.repeats] for r in substrings.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 30)], 3: [(1, 200_000)]}
