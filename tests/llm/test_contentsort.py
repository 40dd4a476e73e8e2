import hashlib
import re
from collections import Counter, defaultdict

import pytest

from quillmesh.llm import contentsort as c


def _want(rows):
    """Brute force: (doc_id, keep_id, size, kept, hash) of each row."""
    of = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        of[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = Counter()
    for t, members in of.items():
        best = min(members)
        for m in members:
            i = rows[m[3]][0]
            out[(i, rows[best[3]][0], len(members), m == best, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def _got(spark, rows, ranges=None):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, norm string, row int").repartition(5)
    return Counter(tuple(r) for r in c.groups(docs, ranges).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


LONG = "long text " * 100_000


@pytest.mark.parametrize("ranges", [None, 1, 16])
def test_groups_equal_brute_force(spark, ranges):
    rows = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "a b"), (8, "A b"), (None, "a  b"), (None, "z"), (None, "z"), (9, LONG), (10, LONG + " "), (11, LONG[:-2] + "x"), (12, "é"), (12, "é"), (13, "é")]
    rows += [(100 + k, "hot text" + " " * (k % 7)) for k in range(400)] + [(1000 + k, f"same start of thirty-two characters and more {k // 3}") for k in range(90)]
    assert _got(spark, rows, ranges) == _want(rows)


def test_all_rows_equal_and_repeated(spark):
    rows = [(None, "one")] * 40 + [(3, "one")] * 3
    got = _got(spark, rows, 8)
    assert got == _want(rows) and sum(n for r, n in got.items() if r[3]) == 1


def test_kept_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in c.keep_first(docs).collect()) == [2, 3]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert c.groups(docs).count() == 0


def test_ranges_are_sorted_and_not_dealt_again(spark):
    rows = c.staged(spark.createDataFrame([(k, f"t{k % 9}") for k in range(99)], "doc_id long, text string"))
    plan = c.runs(rows, 4, 1000)._jdf.queryExecution().toString()
    assert "rangepartitioning(head" in plan and "SortAggregate" in plan and "PythonUDF" not in plan
    assert plan.split("== Physical Plan ==")[1].count("rangepartitioning") == 1
