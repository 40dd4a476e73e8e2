"""Posting lists against a plain loop, and what making them moves."""

import random
import re

from quillmesh.operators import retrieval

WORDS = "the that of a new É 12 ßx _ -".split()


def test_lists_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "WORDS_AT_ONCE", 50)
    rng = random.Random(3)
    rows = [(k, k % 5, None if k % 9 == 0 else " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))) for k in range(60)]
    want = {}
    for k, d, content in rows:
        for pos, term in enumerate(re.findall(r"[^\W_]+", (content or "").lower())):
            want.setdefault((term, k, d), []).append(pos)
    found = retrieval.posting_lists(spark.createDataFrame(rows, "chunk_id long, doc_id long, content string").coalesce(1), "doc_id").collect()
    assert {(r.term, r.chunk_id, r.doc_id): list(r.positions) for r in found} == want and len(found) == len(want)
    assert not retrieval.posting_lists(spark.createDataFrame([(1, None), (2, " ")], "chunk_id long, content string")).collect()


def test_lists_are_made_without_a_shuffle(spark):
    rows = spark.range(10).selectExpr("id AS chunk_id", "'a b' AS content")
    assert "Exchange" not in retrieval.posting_lists(rows)._jdf.queryExecution().executedPlan().toString()
