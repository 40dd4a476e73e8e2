import glob
import hashlib
import random

import duckdb
import numpy as np
import pytest

from quillmesh.llm import boundedmeans as b
from tests.conftest import SF


def _plain(rows, k, rounds, seed=2):
    """Brute force in Python's whole numbers: [(vec_id, cluster, distance)] and the centroids."""
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    c = [list(v) for _, v in first]
    gap = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w))
    for _ in range(rounds):
        near = [min((gap(v, w), j) for j, w in enumerate(c))[1] for _, v in rows]
        for j in range(len(c)):
            mine = [v for (_, v), x in zip(rows, near) if x == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *min((gap(v, w), j) for j, w in enumerate(c))[::-1]) for i, v in rows], c


@pytest.mark.parametrize("spread", [3, 300, 1 << 24])
def test_clusters_equal_brute_force(spark, spread):
    rng = random.Random(spread)
    rows = [(k, [rng.randrange(-spread, spread) for _ in range(4)]) for k in range(300)]
    rows += [(5, [0, 0, 0, 0]), (5, [1, 1, 1, 1]), (None, [2, 2, 2, 2]), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>").repartition(3)
    got, history = b.cluster(df, k=12, rounds=4)
    want, c = _plain(rows, 12, 4)
    assert history[-1].tolist() == c and len(history) == 5
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(4)
    centres = rng.integers(-300, 300, (20, 16))
    v = centres[rng.integers(0, 20, 2000)] + rng.integers(-9, 9, (2000, 16))
    history = [v[:20].copy()]
    own, low, seen = np.zeros(2000, int), np.zeros((2000, 20), np.float32), np.zeros((2000, 20), np.int8)
    evaluated = []
    for r in range(6):
        own, distance, low, seen, scanned = b.assign(v, own, low, seen, history)
        gaps = ((v[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (own == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()
        for t in range(r + 1):
            then = np.sqrt(((v[:, None] - history[t][None]) ** 2).sum(axis=2))
            assert (low <= then)[seen == t].all()
        evaluated.append(int(scanned.sum()))
        history.append(np.array([v[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else history[-1][j] for j in range(20)]))
    assert evaluated[0] == 2000 * 20 and evaluated[-1] < evaluated[0] / 5


def test_norm_of_the_sum_is_tighter_than_the_sum_of_norms():
    """A centroid that goes there and back loosens nothing."""
    v = np.array([[0, 0], [100, 0]])
    a, c = np.array([[0, 0], [60, 0]]), np.array([[0, 0], [90, 0]])
    own, _, low, seen, _ = b.assign(v, np.zeros(2, int), np.zeros((2, 2), np.float32), np.zeros((2, 2), np.int8), [a])
    own, _, low, seen, _ = b.assign(v, own, low, seen, [a, c])
    assert seen[0, 1] == 0
    *_, scanned = b.assign(v, own, low, seen, [a, c, a])
    assert scanned[0] == 1  # its drifts sum to 60, as much as the bound


def test_vectors_that_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [3e38, -3e38]), (8, []), (None, [0.0, 1.0]), (9, [1.0, 1.0, 1.0])]
    got = b.whole_vectors(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, v int"), size=2).collect()
    assert {r.vec_id: r.v for r in got} == {1: [128, -1], 7: [b.LARGEST, -b.LARGEST], None: [0, 256]}


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(1, [0, 0]), (2, [5, 5]), (3, [5, 5])], "vec_id long, v array<int>")
    got, history = b.cluster(few, k=40, rounds=2)
    assert len(history[-1]) == 3 and sorted(r.distance for r in got.collect()) == [0, 0, 0]
    assert b.with_inertia(got, history[-1]).count() == 3
    none, history = b.cluster(few.limit(0))
    assert history == [] and b.with_inertia(none, np.zeros((0, 2), int)).count() == 0
    extreme = spark.createDataFrame([(k, [b.LARGEST * (-1) ** k] * 64) for k in range(9)], "vec_id long, v array<int>")
    got, history = b.cluster(extreme, k=1, rounds=1)
    assert b.with_inertia(got, history[-1]).first().inertia == (1 << 63) - 1


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = b.op12_bounded_means(spark, SF).select(*columns).collect()
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({b.OP12_ORACLE})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and got
