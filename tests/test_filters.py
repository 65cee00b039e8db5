"""Recursive filters in blocks against the plain recursion."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from bilateral.functions import scan
from bilateral.operators import filters

EXACT = np.longdouble


def plain(x, cutoff, fs, degree, steady=False):
    """Sections one after another, sample by sample, in extended precision (coefficients as well: tiny cutoffs cancel)."""
    pi = EXACT("3.14159265358979323846")
    k = np.tan(pi * EXACT(str(cutoff)) / EXACT(str(fs)))
    y = [EXACT(v) for v in x]
    for i in range((degree + 1) // 2):
        if degree % 2 and not i:
            b0, b1, b2, a1, a2 = k / (1 + k), k / (1 + k), EXACT(0), (k - 1) / (1 + k), EXACT(0)
        else:
            d = 2 * np.sin(pi * (2 * (i - degree % 2) + 1) / (2 * degree))
            n = 1 + d * k + k * k
            b0, b1, b2, a1, a2 = k * k / n, 2 * k * k / n, k * k / n, 2 * (k * k - 1) / n, (1 - d * k + k * k) / n
        s, r = ((1 - b0) * y[0], (b2 - a2) * y[0]) if steady else (EXACT(0), EXACT(0))
        out = []
        for v in y:
            o = b0 * v + s
            s, r = b1 * v - a1 * o + r, b2 * v - a2 * o
            out.append(o)
        y = out
    return y


def zero_phase(x, cutoff, fs, degree):
    pad = 3 * (degree + 1)
    ext = [2 * x[0] - v for v in x[pad:0:-1]] + list(x) + [2 * x[-1] - v for v in x[-2 : -2 - pad : -1]]
    f = plain(ext, cutoff, fs, degree, True)
    return plain(f[::-1], cutoff, fs, degree, True)[::-1][pad:-pad]


def column(df, name="filtered"):
    return [r[name] for r in df.orderBy("pos").collect()]


def series(spark, x, usr=1):
    return spark.createDataFrame([(usr, i, v) for i, v in enumerate(x)], "usr long, pos long, value double")


@pytest.mark.parametrize("degree", [1, 2, 3, 4])
@pytest.mark.parametrize("cutoff,fs", [(0.01, 64.0), (0.4, 4.0)])
def test_any_degree_and_cutoff(spark, monkeypatch, degree, cutoff, fs):
    monkeypatch.setattr(scan, "FAN", 3)  # borders in lists of three
    rng = random.Random(degree)
    x = [3 + rng.random() for _ in range(1000)]
    blocks = scan.to_blocks(series(spark, x), ["usr"], "pos", "value", 70)
    for levels in (0, 1, 2):
        got = [v for r in scan.recur(blocks, filters.lowpass_system(cutoff, fs, degree), levels=levels).orderBy("_b").collect() for v in r._v]
        assert max(abs(p - float(q)) for p, q in zip(got, plain(x, cutoff, fs, degree), strict=True)) < 1e-11
    monkeypatch.setattr(scan, "BLOCK", 70)
    df = series(spark, x)
    assert max(abs(p - float(q)) for p, q in zip(column(filters.lowpass_causal(df, ["usr"], cutoff, fs, degree=degree)), plain(x, cutoff, fs, degree), strict=True)) < 1e-11
    assert max(abs(p - float(q)) for p, q in zip(column(filters.lowpass_zero_phase(df, ["usr"], cutoff, fs, degree=degree)), zero_phase(x, cutoff, fs, degree), strict=True)) < 1e-9


def test_response_has_no_end(spark):
    got = column(filters.lowpass_causal(series(spark, [1.0] * 60_000), ["usr"], 0.01, 64.0))
    assert abs(got[-1] - 1) < 1e-12 and abs(got[4000] - float(plain([1.0] * 4001, 0.01, 64.0, 1)[-1])) < 1e-12


def test_nulls_gaps_keys_and_empty(spark):
    rows = [(None, p, v) for p, v in ((0, 1.0), (1, None), (900_000, 2.0), (900_001, 4.0))] + [(7, 5, 3.0)]
    df = spark.createDataFrame(rows, "usr long, pos long, value double")
    got = {(r.usr, r.pos): r.filtered for r in filters.lowpass_causal(df, ["usr"], 0.4, 4.0, degree=2).collect()}
    want = [float(v) for v in plain([1.0, 2.0, 4.0], 0.4, 4.0, 2)]
    assert set(got) == {(None, 0), (None, 900_000), (None, 900_001), (7, 5)}
    assert all(math.isclose(got[k], v, rel_tol=1e-12) for k, v in zip([(None, 0), (None, 900_000), (None, 900_001)], want))
    assert filters.lowpass_causal(df.limit(0), ["usr"], 0.4, 4.0).count() == 0 and filters.lowpass_zero_phase(df.limit(0), ["usr"], 0.4, 4.0).count() == 0
    assert [r.filtered for r in filters.lowpass_zero_phase(df, ["usr"], 0.4, 4.0).collect()] == [None] * 4
    with pytest.raises(ValueError):
        filters.lowpass_causal(df, ["usr"], 3.0, 4.0)


def test_no_series_meets_in_one_task(spark):
    """The samples of a series are dealt by key and block."""
    plan = filters.lowpass_causal(series(spark, [1.0] * 10), ["usr"], 0.4, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(_k#" in plan and "_b#" in plan


def test_groups_of_one_block_are_filtered_where_they_are(spark, monkeypatch):
    """A batch of whole groups takes two runs for each length; groups of one block, of many and too short ones stand beside each other."""
    rng = random.Random(7)
    x = {u: [rng.random() for _ in range(n)] for u, n in ((1, 30), (2, 200), (3, 30), (4, 9), (5, 10), (6, 70))}
    whole = [u for u in x if len(x[u]) in (10, 30)]
    at = np.concatenate([[0], np.cumsum([len(x[u]) for u in whole])])
    batch = pa.RecordBatch.from_arrays([pa.array(whole), pa.array([0] * len(whole)), pa.nulls(len(whole), pa.list_(pa.int64())), scan.listed(np.concatenate([x[u] for u in whole]), at)], names=["_k", "_b", "_p", "_v"])
    with monkeypatch.context() as m:
        runs, run = [], scan.System.run_all
        m.setattr(scan.System, "run_all", lambda *a: runs.append(1) or run(*a))
        (got,) = filters._both_ways(filters.lowpass_system(0.2, 4.0, 2), 9)([batch])
        assert len(runs) == 4
    for i, u in enumerate(whole):
        assert np.allclose(got.column("_v")[i].as_py(), np.array(zero_phase(x[u], 0.2, 4.0, 2), float), atol=1e-11)
    monkeypatch.setattr(filters, "to_blocks", lambda *a: scan.to_blocks(*a, 70))
    df = spark.createDataFrame([(u, i, v) for u in x for i, v in enumerate(x[u])], "usr long, pos long, value double")
    rows = filters.lowpass_zero_phase(df, ["usr"], 0.2, 4.0, degree=2).orderBy("usr", "pos").collect()
    assert len(rows) == sum(map(len, x.values()))
    for u in x:
        mine = [r.filtered for r in rows if r.usr == u]
        want = [None] * 9 if u == 4 else [float(v) for v in zero_phase(x[u], 0.2, 4.0, 2)]
        assert mine == want if u == 4 else np.allclose(mine, want, atol=1e-11)
