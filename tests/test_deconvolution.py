"""Sparse deconvolution: planted drivers, a falling objective, and the same parts from blocks."""

import numpy as np
import pyarrow as pa
import pytest
from bilateral.functions import scan
from bilateral.operators import deconvolution as D

FS = 4.0


def planted(n=500, noise=0.005):
    rng = np.random.default_rng(0)
    k = D.response([D.RISE, D.DECAY], FS)
    driver = np.zeros(n)
    driver[[60, 140, 150, 300, 420]] = [3, 2, 1, 4, 2]
    t = np.arange(n)
    base = 5 + 0.002 * t + 0.5 * np.sin(2 * np.pi * t / 500)
    phasic = k.run(driver, np.zeros(2))[0]
    return phasic + base + rng.normal(0, noise, n), driver, phasic, base


def scaled(y):
    return (y - y.mean()) / y.std()


def test_response_is_a_transposed_pair():
    rng = np.random.default_rng(1)
    k = D.response([D.RISE, D.DECAY], FS)
    x, y = rng.normal(size=(2, 90))
    on = lambda v: k.run(v, np.zeros(2))[0]
    assert abs(on(x) @ y - x @ on(y[::-1])[::-1]) < 1e-12 and abs(on(np.ones(500))[-1] - 1) < 1e-12
    kernel = on(np.eye(1, 60)[0])
    a, b = np.exp(-1 / (D.RISE * FS)), np.exp(-1 / (D.DECAY * FS))
    want = (1 - a) * (1 - b) * np.array([sum(a**i * b ** (m - i) for i in range(m + 1)) for m in range(60)])
    assert np.allclose(kernel, want, atol=1e-14)


def test_objective_never_rises_and_reaches_the_optimum():
    y = scaled(planted()[0])
    k, g = D.response([D.RISE, D.DECAY], FS), D.response([D.SLOW, D.SLOW], FS)
    d, phasic, costs = D.solve(y, k, g, 0.02, 0.001, 1500)
    assert all(b <= a for a, b in zip(costs, costs[1:])) and costs[300] < 1.05 * costs[-1]
    assert (d >= 0).all()
    # at the optimum no driver can grow or shrink to advantage
    level, slope = D.line(0, len(y), len(y))
    _, _, longer = D.solve(y, k, g, 0.02, 0.001, 3000)
    assert costs[-1] - longer[-1] < 1e-4 * longer[-1]
    assert abs(level @ level - 1) < 1e-12 and abs(slope @ slope - 1) < 0.01


def test_planted_drivers_are_found(spark):
    y, driver, phasic, base = planted()
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "usr long, pos long, value double")
    got = D.tonic_phasic(df, ["usr"], FS, rounds=600).orderBy("pos").collect()
    found = np.array([r.driver for r in got])
    for at in (60, 140, 300, 420):
        assert found[at - 2 : at + 3].sum() > 0.5 * driver[at]
    near = np.zeros(len(y), bool)
    for at in np.flatnonzero(driver):
        near[at - 3 : at + 4] = True
    assert found[~near & (np.arange(len(y)) > 10)].sum() < 0.35 * found.sum()
    assert np.abs(np.array([r.tonic for r in got]) - base).max() < 0.15 and np.abs(np.array([r.phasic for r in got]) - phasic).max() < 0.15
    assert all(abs(r.tonic + r.phasic - r.value) < 1e-12 for r in got)


def test_blocks_do_the_same(spark):
    y = planted()[0][:120]
    df = spark.createDataFrame([(k, i, float(v) + k) for k in (1, 2) for i, v in enumerate(y[: 120 - 30 * k])], "usr long, pos long, value double")
    a, b = ({(r.usr, r.pos): r for r in D.tonic_phasic(df, ["usr"], FS, rounds=8, size=s).collect()} for s in (1000, 40))
    assert set(a) == set(b)
    assert max(abs(a[q].tonic - b[q].tonic) + abs(a[q].driver - b[q].driver) for q in a) < 1e-9


def test_odd_rows(spark):
    rows = [(1, 0, 2.0), (1, 1, 2.0), (1, 2, 2.0), (2, 0, None), (3, 5, 1.0), (None, 0, 1.0), (None, 1, 3.0), (None, 2, None), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "usr long, pos long, value double")
    got = {(r.usr, r.pos): (r.tonic, r.phasic) for r in D.tonic_phasic(df, ["usr"], FS, rounds=20).collect()}
    assert got[1, 0] == (2.0, 0.0) and got[2, 0] == (None, None) and got[3, 5] == (1.0, 0.0) and got[None, 2] == (None, None) and got[None, 1][0] is not None
    assert D.tonic_phasic(df.limit(0), ["usr"], FS).count() == 0


def test_series_of_one_length_are_solved_together(monkeypatch):
    """A batch takes as many runs of the recurrences as it has lengths, not as it has series."""
    y = scaled(planted()[0])
    parts = [y[i : i + n] for i in range(60) for n in (33, 40)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array([0] * 120), scan.listed(np.concatenate(parts), at)], names=["_k", "_b", "y"])
    k, g = D.response([D.RISE, D.DECAY], FS), D.response([D.SLOW, D.SLOW], FS)
    runs, run = [], scan.System.run_all
    monkeypatch.setattr(scan.System, "run_all", lambda *a: runs.append(1) or run(*a))
    (got,) = D._whole(k, g, 0.02, 0.001, 20)([batch])
    assert len(runs) == 2 * (4 * 20 + 1)
    for i, p in enumerate(parts):
        driver, phasic, _ = D.solve(p, k, g, 0.02, 0.001, 20)
        assert np.allclose(got.column("driver")[i].as_py(), driver, atol=1e-9) and np.allclose(got.column("phasic")[i].as_py(), phasic, atol=1e-9)
