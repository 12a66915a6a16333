"""Yinyang clustering against plain Lloyd rounds, and its defined cases."""

import hashlib

import numpy as np
import pytest
from oracle import DATA, duck, spark_rows

from corpusloom.llm import queries, yinyang

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance double"


def plain(rows, k, rounds, dim=64, scale=64):
    """(id, cluster, distance) sorted, and the centroids, by measuring everything in Python's integers."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, own, strict=True) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), c


@pytest.mark.parametrize("k,groups,rounds", [(16, None, 3), (5, 1, 4), (12, 12, 2), (30, 7, 6)])
def test_equals_plain_rounds(spark, k, groups, rounds):
    rng = np.random.default_rng(k)
    centers = rng.normal(0, 0.4, (6, 8))
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(0, 0.1, 8)]) for i in range(240)]
    rows += [(i, [0.25] * 8) for i in range(240, 330)]  # a hot vector
    df = spark.createDataFrame([(i, v, "own", 1.5) for i, v in rows], SCHEMA)
    got, c = yinyang.cluster(df, dim=8, k=k, rounds=rounds, groups=groups)
    want, means = plain(rows, k, rounds, dim=8)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    assert c.tolist() == means
    if groups != 1 and rounds > 3:
        assert got.agg({"scans": "sum"}).first()[0] < 0.7 * k * len(rows)  # the filters leave most centroids out


def test_ties_nulls_repeats_and_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.0]), (None, [0.5, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, []), (9, [-0.3, 1e5]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    for k in (2, 3, 16):
        got, c = yinyang.cluster(df, dim=2, k=k, rounds=3)
        want, means = plain(rows, k, 3, dim=2)
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
        assert c.tolist() == means
    far = spark.createDataFrame([(1, [3e38, 0.0], "", 0.0), (2, [-3e38, 0.0], "", 0.0)], SCHEMA)
    assert {r.distance for r in yinyang.cluster(far, dim=2, k=1, rounds=0)[0].collect()} == {0, (2 << 27) ** 2}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert yinyang.with_inertia(*yinyang.cluster(df)).collect() == []


def test_bounds_hold_after_every_round():
    """No centroid is nearer than its group's lower bound, none but the own within the upper one."""
    rng = np.random.default_rng(5)
    x, c = rng.integers(-60, 60, (300, 6)), rng.integers(-60, 60, (10, 6))
    of = yinyang.grouped(c, 3)
    a, upper, lower, _ = yinyang.first_assignment(x, c, of, 3)
    for _ in range(6):
        new = c + rng.integers(-4, 5, c.shape)
        moved = np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-12)
        c = new
        a, upper, lower, _ = yinyang.reassignment(x, c, of, moved, a, upper, lower)
        d = yinyang.squared(x, c)
        assert (a == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (root[np.arange(300), a] <= upper).all()
        for g in range(3):
            others = np.where((of == g) & (np.arange(10) != a[:, None]), root, np.inf)
            assert (others.min(1) >= lower[:, g]).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    assert spark_rows(queries.QUERIES["op11_centroid_clustering"](spark, f"{DATA}/{sf}")) == duck(f"{DATA}/{sf}", queries.SQL["op11_centroid_clustering"])
