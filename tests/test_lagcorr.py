"""Detrended correlation in blocks against boxes that are fitted one by one."""

import random

import numpy as np
import pytest
from bilateral.operators import lagcorr


def plain(x, y, lag, n):
    t = np.arange(n + 1) - n / 2
    xy = xx = yy = boxes = 0
    for s in range(len(x) - n - lag):
        a, b = x[s : s + n + 1], y[s + lag : s + lag + n + 1]
        if np.isnan(a).any() or np.isnan(b).any():
            continue
        a, b = (v - v.mean() - t * (t @ v) / (t @ t) for v in (a, b))
        xy, xx, yy, boxes = xy + a @ b, xx + a @ a, yy + b @ b, boxes + 1
    return xy / np.sqrt(xx * yy) if boxes else None, boxes


@pytest.mark.parametrize("block", [4096, 40])
def test_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(lagcorr, "BLOCK", block)
    rng = random.Random(3)
    groups = {k: [1e6 + rng.gauss(0, 1) for _ in range(m)] for k, m in ((1, 300), (2, 41), (3, 20), (None, 130))}
    rows = []
    for k, x in groups.items():
        for i, v in enumerate(x):
            rows.append((k, i if k != 2 else i * 5000, v, None if k is None and i in (30, 31, 90) else 0.5 * x[max(0, i - 2)] + rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "usr long, pos long, x double, y double")
    got = {(r.usr, r.lag): r for r in lagcorr.detrended(df, ["usr"], 6, 20).collect()}
    for k, x in groups.items():
        y = np.array([np.nan if r[3] is None else r[3] for r in rows if r[0] == k])
        for lag in range(6):
            value, boxes = plain(np.array(x), y, lag, 20)
            assert ((k, lag) in got) == (boxes > 0)
            assert not boxes or got[k, lag].n_boxes == boxes and abs(got[k, lag].value - value) < 1e-7
    assert lagcorr.detrended(df.limit(0), ["usr"], 2, 5).count() == 0


def test_constant(spark):
    df = spark.createDataFrame([(1, i, 2.0, float(i)) for i in range(30)], "usr long, pos long, x double, y double")
    assert [r.value for r in lagcorr.detrended(df, ["usr"], 1, 9).collect()] == [None]
