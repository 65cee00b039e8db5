"""Prominences and distances of peaks against the definition."""

import random

import pytest
from bilateral.operators import peaks


def plain(x):
    """(place, prominence) of every peak: the definition, with runs of equal values."""
    out = []
    for i in range(len(x)):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if i == 0 or x[i - 1] >= x[i] or j + 1 == len(x) or x[j + 1] > x[i]:
            continue
        a, b = i, j
        while a > 0 and x[a - 1] <= x[i]:
            a -= 1
        while b + 1 < len(x) and x[b + 1] <= x[i]:
            b += 1
        out.append((i, x[i] - max(min(x[a : i + 1]), min(x[j : b + 1]))))
    return out


def thinned(x, at, distance):
    kept, open_ = [], sorted(at, key=lambda i: (x[i], i))
    while open_:
        top = open_.pop()
        kept.append(top)
        open_ = [i for i in open_ if abs(i - top) >= distance]
    return sorted(kept)


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(5)
    walk = [0.0]
    while len(walk) < 200:
        walk.append(walk[-1] + rng.choice([-1.0, 0.0, 0.0, 1.0]))
    return {1: [rng.random() for _ in range(150)], 2: walk, 3: [float(i) for i in range(60)], 4: [1.0] * 30, 5: [2.0], None: [0.0, *[3.0] * 25, 1.0, 3.0, 0.5], 7: [float(-abs(i - 40)) for i in range(90)]}


@pytest.mark.parametrize("size", [65536, 10, 3])
def test_prominences(spark, groups, size):
    df = spark.createDataFrame([(k, i - 20, v) for k, x in groups.items() for i, v in enumerate(x)], "usr long, pos long, value double")
    got = {(r.usr, r.pos + 20): r for r in peaks.prominences(df, ["usr"], size=size).collect()}
    want = {(k, i): (x[i], p) for k, x in groups.items() for i, p in plain(x)}
    assert set(got) == set(want)
    assert all(got[q].height == h and abs(got[q].prominence - p) < 1e-12 for q, (h, p) in want.items())


@pytest.mark.parametrize("distance", [1, 4, 30])
def test_distance(spark, groups, distance):
    df = spark.createDataFrame([(k, i, v) for k, x in groups.items() for i, v in enumerate(x)], "usr long, pos long, value double")
    got = sorted(((r.usr, r.pos) for r in peaks.apart(peaks.prominences(df, ["usr"]), ["usr"], distance).collect()), key=str)
    assert got == sorted(((k, i) for k, x in groups.items() for i in thinned(x, [i for i, _ in plain(x)], distance)), key=str)


def test_counts_nulls_and_empty(spark, groups):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, None), (1, 2, 5.0), (1, 9, 0.0), (1, 10, 0.2), (1, 11, 0.0), (2, 0, None)], "usr long, pos long, value double")
    got = {r.usr: (r.number_of_peaks, r.peaks_amplitude) for r in peaks.prominent_peaks(df, ["usr"]).collect()}
    assert got == {1: (1, 5.0), 2: (0, 0.0)}
    assert {r.usr: r.number_of_peaks for r in peaks.prominent_peaks(df, ["usr"], share=0.01).collect()}[1] == 2
    assert {r.usr: r.number_of_peaks for r in peaks.prominent_peaks(df, ["usr"], share=0.01, distance=20).collect()}[1] == 1
    assert peaks.prominent_peaks(df.limit(0), ["usr"], distance=3).count() == 0
