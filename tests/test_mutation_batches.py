"""Mutation batches against a plain fold over the whole batch."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import mutation_batches as mb

CATALOG = "id long, name string, key string, description string, state string"
REQUEST = "request_id long, op string, id long, name string, description string"


def _plain(catalog, requests, used):
    """Every request after the other over one dictionary."""
    state = {i: [n, k, d, s] for i, n, k, d, s in catalog}
    top, out = max(state, default=0), {}
    for rid, op, i, name, about in sorted(requests):
        key = " ".join(name.split()).lower() if name is not None else None
        show = " ".join(name.split()) if name is not None else None
        about = about.strip() if about is not None else None
        owner = next((j for j, e in state.items() if e[1] == key), None)
        if op == "create":
            out[rid] = "invalid" if not key else "conflict" if owner is not None else "created"
            if out[rid] == "created":
                top += 1
                state[top] = [show, key, about or None, "active"]
        elif op not in mb.OPERATIONS:
            out[rid] = "invalid"
        elif i not in state:
            out[rid] = "not_found"
        elif op == "delete":
            out[rid] = "in_use" if i in used else "deleted"
            if i not in used:
                del state[i]
        elif op == "rename" and not key:
            out[rid] = "invalid"
        elif op == "rename" and owner not in (None, i):
            out[rid] = "conflict"
        else:
            out[rid] = "updated"
            if op == "rename":
                state[i][:2] = [show, key]
            if op in ("rename", "describe") and about is not None:
                state[i][2] = about or None
            if op in ("archive", "reactivate"):
                state[i][3] = "archived" if op == "archive" else "active"
    return out, {(i, *e) for i, e in state.items()}


def _run(spark, catalog, requests, used):
    held = spark.createDataFrame(catalog, CATALOG)
    found = mb.outcomes(held, spark.createDataFrame(requests, REQUEST), spark.createDataFrame([(i,) for i in used], "id long"), lambda c: text.project_key(F.col(c)))
    return {r.request_id: r.status for r in found.collect()}, {tuple(r) for r in mb.applied(held, found).collect()}


def test_requests_of_a_batch_see_each_other(spark):
    catalog = [(1, "A", "a", None, "active"), (2, "B", "b", "old", "active"), (3, "C", "c", None, "active")]
    requests = [
        (1, "rename", 1, " X ", None), (2, "rename", 2, "x", None), (3, "create", None, "A", " new "), (4, "delete", 3, None, None), (5, "create", None, "c", None), (6, "rename", 3, "d", None),
        (7, "create", None, " ", None), (8, "rename", 2, " b  b ", ""), (9, "create", None, "B", None), (10, "archive", 1, None, None), (11, "delete", 2, None, None), (12, "vanish", 1, None, None), (13, "describe", 1, None, " about "),
    ]
    status, after = _run(spark, catalog, requests, [2])
    assert status == {1: "updated", 2: "conflict", 3: "created", 4: "deleted", 5: "created", 6: "not_found", 7: "invalid", 8: "updated", 9: "created", 10: "updated", 11: "in_use", 12: "invalid", 13: "updated"}
    assert after == {(1, "X", "x", "about", "archived"), (2, "b b", "b b", None, "active"), (4, "A", "a", "new", "active"), (5, "c", "c", None, "active"), (6, "B", "b", None, "active")}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_equal_the_plain_fold(spark, seed):
    rng = random.Random(seed)
    catalog = [(k, f"N{k}", f"n{k}", None, "active") for k in range(1, 60)]
    requests = [(k * 7919 % 200_003, rng.choice([*mb.OPERATIONS, "rename", "rename", "odd"]), rng.choice([None, rng.randrange(1, 60), 1000 + k]), rng.choice([None, "", f" n{rng.randrange(1, 80)} "]), rng.choice([None, "", "text"])) for k in range(1, 250)]
    used = rng.sample(range(1, 60), 10)
    assert _run(spark, catalog, requests, used) == _plain(catalog, requests, used)


def test_empty(spark):
    assert _run(spark, [(1, "A", "a", None, "active")], [], []) == ({}, {(1, "A", "a", None, "active")})
