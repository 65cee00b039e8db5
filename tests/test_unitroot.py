"""Chosen lags and statistics against plain least squares over every lag."""

import math
import random

import numpy as np
import pytest
from bilateral.operators import stationarity, unitroot


def design(y, lags, trend, break_at=None):
    """Rows t (from 0) of the regression with so many lags."""
    dy = np.diff(y)
    rows, out = [], []
    for t in range(lags + 1, len(y)):
        lead = {"n": [], "c": [1.0], "ct": [1.0, t + 1.0]}[trend]
        rows.append([*lead, y[t - 1], *(dy[t - 1 - j] for j in range(1, lags + 1)), *([] if break_at is None else [float(t + 1 > break_at)])])
        out.append(dy[t - 1])
    return np.array(rows), np.array(out)


def plain_t(x, y, k):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    s2 = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    return beta[k] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[k, k])


def plain_lags(y, trend, most):
    x, dy = design(y, most, trend)
    lead = len(trend.replace("n", "")) + 1
    best = []
    for lags in range(most + 1):
        part = x[:, : lead + lags]
        beta, *_ = np.linalg.lstsq(part, dy, rcond=None)
        best.append(len(dy) * math.log(((dy - part @ beta) ** 2).mean()) + 2 * lags)
    return int(np.argmin(best))


def series():
    rng = random.Random(2)
    out = {}
    for k, (n, rho, extra) in enumerate([(300, 1.0, 0.6), (120, 0.5, 0.0), (60, 0.9, -0.5), (25, 0.2, 0.0), (400, 0.97, 0.3)]):
        y, d = [1000.0], 0.0
        for _ in range(n - 1):
            d = extra * d + rng.gauss(0, 1)
            y.append(1000 + rho * (y[-1] - 1000) + d)
        out[k] = y
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = [(k, i, v) for k, y in series().items() for i, v in enumerate(y)] + [(8, i, 1.0) for i in range(50)] + [(9, i, float(i % 3)) for i in range(4)] + [(1, 500, None)]
    return spark.createDataFrame(rows, "usr long, pos long, value double")


@pytest.fixture(params=[8192, 64])
def block(request, monkeypatch):
    monkeypatch.setattr(unitroot, "BLOCK", request.param)
    monkeypatch.setattr(unitroot._Series.__init__, "__defaults__", (None, request.param))


def test_adf_and_dfgls(data, block):
    got, gls = ({r.usr: r for r in f(data, ["usr"]).collect()} for f in (unitroot.adf, unitroot.dfgls))
    for k, y in series().items():
        y, n = np.array(y), len(y)
        most = unitroot.most_lags(n, 1)
        lags = plain_lags(y, "c", most)
        assert got[k].lags == lags and abs(got[k].adf - plain_t(*design(y, lags, "c"), 1)) < 1e-6
        a = 1 - 7 / n
        qy, qx = np.concatenate([[y[0]], y[1:] - a * y[:-1]]), np.concatenate([[1.0], np.full(n - 1, 1 - a)])
        u = y - (qx @ qy) / (qx @ qx)
        lags = plain_lags(u, "n", most)
        assert gls[k].lags == lags and abs(gls[k].dfgls - plain_t(*design(u, lags, "n"), 0)) < 1e-6
    assert got[8].adf is None and gls[8].dfgls is None and 9 not in got


@pytest.mark.parametrize("lags", [None, 0, 2])
def test_zivot_andrews(data, block, lags):
    got = {r.usr: r for r in unitroot.zivot_andrews(data, ["usr"], lags=lags).collect()}
    for k, y in series().items():
        y, n = np.array(y) - 1000, len(y)
        p = plain_lags(y, "ct", unitroot.most_lags(n, 2)) if lags is None else lags
        want = [(plain_t(*design(y, p, "ct", b), 2), b / n) for b in range(max(math.floor(0.15 * n), p + 2), math.floor(0.85 * n) + 1)]
        assert got[k].lags == p and abs(got[k].za - min(want)[0]) < 1e-6 and abs(got[k].break_share - min(want)[1]) < 1e-9
    assert 8 not in got and 9 not in got


def test_kpss(data, block):
    got = {r.usr: r for r in unitroot.kpss_auto(data, ["usr"]).collect()}
    for k, y in series().items():
        e, n = np.array(y) - np.mean(y), len(y)
        cov = lambda j: (e[j:] @ e[: n - j]) / n  # noqa: B023, E731
        short = range(1, int(n ** (2 / 9)) + 1)
        s0, s1 = cov(0) + 2 * sum(cov(j) for j in short), 2 * sum(j * cov(j) for j in short)
        lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
        lam = cov(0) + 2 * sum((1 - j / (lags + 1)) * cov(j) for j in range(1, lags + 1))
        assert got[k].lags == lags and abs(got[k].kpss - (np.cumsum(e) ** 2).sum() / n**2 / lam) < 1e-8


def test_kpss_of_series_without_positive_variance(spark):
    """The truncated sum of autocovariances of an alternating series is negative: it has no bandwidth, as in the SQL."""
    rows = [(1, i, float((-1) ** i)) for i in range(20)] + [(2, i, float(i * i % 7)) for i in range(20)] + [(3, i, 5.0) for i in range(20)]
    got = unitroot.kpss_auto(spark.createDataFrame(rows, "usr long, pos long, value double"), ["usr"]).collect()
    assert [r.usr for r in got] == [2]


def test_empty(data):
    for f in (unitroot.adf, unitroot.dfgls, unitroot.zivot_andrews, unitroot.kpss_auto):
        assert f(data.limit(0), ["usr"]).count() == 0


def test_methods_share_the_blocks_of_a_series(spark, monkeypatch):
    """One numbering and one solution for all methods; series of one block and of several stand beside each other."""
    rng = np.random.default_rng(3)
    y = {1: rng.normal(size=40).cumsum(), 2: rng.normal(size=unitroot.BLOCK + 300).cumsum()}
    rows = {u: [(u, i, float(v)) for i, v in enumerate(y[u])] for u in y}
    frame = lambda *us: spark.createDataFrame([r for u in us for r in rows[u]], "usr long, pos long, value double")
    calls, number, solve = [], unitroot.numbered, unitroot._statistics
    with monkeypatch.context() as m:
        m.setattr(unitroot, "numbered", lambda *a: calls.append("numbered") or number(*a))
        m.setattr(unitroot, "_statistics", lambda *a: calls.append("solved") or solve(*a))
        got = {(r.usr, r.method): r.statistic for r in stationarity.stationarity(frame(1, 2), ["usr"]).collect()}
    assert sorted(calls) == ["numbered", "solved"] and len(got) == 10
    for u in y:
        for name, work in (("adf", unitroot.adf), ("dfgls", unitroot.dfgls), ("kpss", unitroot.kpss_auto), ("za", unitroot.zivot_andrews)):
            assert abs(got[u, name] - work(frame(u), ["usr"]).first()[name]) < 1e-9
