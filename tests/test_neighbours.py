"""Neighbours and discriminants against brute force."""

import random

import numpy as np
import pytest
from bilateral.operators import neighbours
from pyspark.sql import functions as F


def rows_of(n, seed, copies=0):
    rng = random.Random(seed)
    rows = [(1000 * seed + i, i % 3, [rng.gauss(3 * (i % 3), 1), rng.gauss(0, 1), rng.gauss(i % 2, 0.5)]) for i in range(n)]
    return rows + [(1000 * seed + n + i, 2, [0.5, 0.5, 0.5]) for i in range(copies)]


@pytest.mark.parametrize("pivots,k", [(64, 5), (5, 1), (1, 7)])
def test_nearest(spark, monkeypatch, pivots, k):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "PACK", 16)
    train, test = rows_of(220, 1, copies=120), rows_of(60, 2) + [(9999, 0, [0.5, 0.5, 0.5]), (9998, 0, [900.0, 0.0, -5.0])]
    frame = lambda r: spark.createDataFrame(r, "id long, y int, x array<double>")
    near = neighbours.nearest(frame(train), frame(test).select("id", "x"), k, pivots)
    got = {r.id: r.near for r in near.collect()}
    assert len(got) == len(test)
    for i, _, x in test:
        want = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, t, strict=True)))), j, y) for j, y, t in train)[:k]
        assert [q.neighbour for q in got[i]] == [w[1] for w in want] and np.allclose([q.distance for q in got[i]], [w[0] for w in want])
    votes = {r.id: r.prediction for r in neighbours.vote(near).collect()}
    for i, _, _ in test:
        ys = [q.y for q in got[i]]
        assert votes[i] == min(y for y in ys if ys.count(y) == max(map(ys.count, ys)))


def test_few_and_none(spark):
    frame = lambda r: spark.createDataFrame(r, "id long, y int, x array<double>")
    test = frame([(5, 0, [0.0, 1.0])])
    assert [q.neighbour for q in neighbours.nearest(frame([(1, 0, [0.0, 0.0]), (2, 1, [0.0, 0.9])]), test, 5).first().near] == [2, 1]
    assert neighbours.nearest(test.limit(0), test).first().near is None and neighbours.nearest(test, test.limit(0)).count() == 0
    assert neighbours.discriminant(test.limit(0), test).first().prediction is None


@pytest.mark.parametrize("own", [False, True])
def test_discriminants(spark, own):
    train, test = rows_of(300, 3), rows_of(80, 4)
    frame = lambda r: spark.createDataFrame(r, "id long, y int, x array<double>")
    got = {r.id: r.prediction for r in neighbours.discriminant(frame(train).repartition(5), frame(test), own).collect()}
    x, y = np.array([r[2] for r in train]), np.array([r[1] for r in train])
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in range(3)) / len(x)
    for i, _, v in test:
        scores = []
        for c in range(3):
            cov = np.cov(x[y == c].T) if own else pooled
            d = np.array(v) - x[y == c].mean(0)
            scores.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d))
        assert got[i] == int(np.argmax(scores))
    one = neighbours.discriminant(frame([(1, 1, [2.0, 2.0]), (2, 1, [2.0, 2.0])]), frame([(3, 0, [5.0, 1.0])]), own).first()
    assert one.prediction == 1.0


def test_a_single_cell_is_many_tasks(spark, monkeypatch):
    """All vectors equal, so one cell: its packs and blocks meet in several tasks, and each pair of them once."""
    for name, v in (("BLOCK", 20), ("PACK", 10), ("ASIDE", 2), ("ABOVE", 1)):
        monkeypatch.setattr(neighbours, name, v)
    tasks = []
    pairs = neighbours._pairs

    def seen(*args):
        got = pairs(*args)
        tasks.append(got.select(F.spark_partition_id().alias("p"), "id", "neighbour").collect())
        return got

    monkeypatch.setattr(neighbours, "_pairs", seen)
    frame = lambda n, at: spark.createDataFrame([(at + i, 0, [1.0, 2.0]) for i in range(n)], "id long, y int, x array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        near = neighbours.nearest(frame(200, 0), frame(100, 1000).select("id", "x"), 3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in tasks[1]}) > 1
    assert len(tasks[1]) == len({(r.id, r.neighbour) for r in tasks[1]})
    assert len(near) == 100 and all([q.neighbour for q in r.near] == [0, 1, 2] for r in near)


def test_near_rows_are_exact():
    rng = np.random.default_rng(3)
    for far in (0.0, 1e6):  # the squares of far vectors lose the distances between them
        b = far + rng.normal(size=(300, 8))
        b[50:90] = b[7]
        a, ids = np.concatenate([b[:20], far + rng.normal(size=(20, 8))]), rng.permutation(300)
        of, at, d = neighbours.near_rows(a, b, ids, 5)
        every = neighbours.distances(a, b)
        for i in range(len(a)):
            want = np.lexsort((ids, every[i]))[:5]
            assert at[of == i].tolist() == want.tolist() and (d[of == i] == every[i][want]).all()
