"""Warping distances against the full dynamic programme and a plain coarse-to-fine version."""

import random

import pytest
from bilateral.operators import warping


def full(x, y, window=None):
    """Distance and path by the textbook recursion over cells (all, or those of a set)."""
    cost = {(-1, -1): (0.0, None)}
    for i in range(len(x)):
        for j in range(len(y)):
            if window is None or (i, j) in window:
                before = [(cost.get(q, (float("inf"),))[0], q) for q in ((i - 1, j), (i, j - 1), (i - 1, j - 1))]
                best = min(before, key=lambda b: b[0])
                cost[i, j] = (best[0] + abs(x[i] - y[j]), best[1])
    at, path = (len(x) - 1, len(y) - 1), []
    while at != (-1, -1):
        path.append(at)
        at = cost[at][1]
    return cost[len(x) - 1, len(y) - 1][0], path


def coarse(x, y, radius):
    if min(len(x), len(y)) < radius + 2:
        return full(x, y)
    half = lambda v: [(v[i] + v[i + 1]) / 2 for i in range(0, len(v) - len(v) % 2, 2)]
    _, path = coarse(half(x), half(y), radius)
    near = {(i + a, j + b) for i, j in path for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)}
    return full(x, y, {(2 * i + a, 2 * j + b) for i, j in near for a in (0, 1) for b in (0, 1)})


def walk(rng, n):
    out = [0.0]
    while len(out) < n:
        out.append(out[-1] + rng.choice([-1.0, 0.0, 0.5, 1.0]))
    return out


def frame(spark, pairs):
    rows = [(k, i, x[i] if i < len(x) else None, y[i] if i < len(y) else None) for k, (x, y) in pairs.items() for i in range(max(len(x), len(y)))]
    return spark.createDataFrame(rows, "usr long, pos long, x double, y double")


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    return {1: (walk(rng, 40), walk(rng, 31)), 2: (walk(rng, 9), walk(rng, 23)), 3: ([1.0], [2.0, 2.0, 5.0]), None: (walk(rng, 17), walk(rng, 17)), 5: ([], [1.0]), 6: ([4.0] * 20, [4.0] * 20)}


@pytest.mark.parametrize("tile", [1024, 7])
def test_exact(spark, pairs, tile):
    got = {r.usr: r for r in warping.dtw(frame(spark, pairs), ["usr"], tile=tile).collect()}
    assert set(got) == set(pairs)
    for k, (x, y) in pairs.items():
        assert got[k].n == max(len(x), len(y))
        assert got[k].distance is None if not x else abs(got[k].distance - full(x, y)[0] / got[k].n) < 1e-9


@pytest.mark.parametrize("radius,tile", [(1, 1024), (1, 8), (2, 6)])
def test_coarse_to_fine(spark, pairs, radius, tile):
    got = {r.usr: r.distance for r in warping.dtw(frame(spark, pairs), ["usr"], radius=radius, tile=tile).collect()}
    for k, (x, y) in pairs.items():
        want = coarse(x, y, radius)[0] / max(len(x), len(y)) if x else None
        assert got[k] == want or abs(got[k] - want) < 1e-9


def test_gaps_and_empty(spark):
    df = spark.createDataFrame([(1, 10**9, 1.0, None), (1, 3, 2.0, 4.0), (1, 5, None, 1.0)], "usr long, pos long, x double, y double")
    assert abs(warping.dtw(df, ["usr"]).first().distance - full([2.0, 1.0], [4.0, 1.0])[0] / 2) < 1e-12
    assert warping.dtw(df.limit(0), ["usr"]).count() == 0 and warping.dtw(df.limit(0), ["usr"], radius=1).count() == 0
    with pytest.raises(ValueError):
        warping.dtw(df, ["usr"], radius=0)
