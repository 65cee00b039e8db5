"""Exact and approximate distributions against enumeration and published examples."""

import itertools
import math
import random
from statistics import NormalDist

import pytest
from bilateral.functions.columns import normal_quantile, normal_tail
from bilateral.operators import exact, stats


def test_normal_expressions(spark):
    zs = [-40.0, -8.0, -1.0, -0.3, 0.0, 1e-9, 0.3, 0.66, 0.67, 1.0, 2.5, 5.6, 5.7, 9.0, 20.0, 37.0, None]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_tail("z").alias("p")).collect()]
    for z, p in zip(zs, got, strict=True):
        assert p is None if z is None else math.isclose(p, 0.5 * math.erfc(z / math.sqrt(2)), rel_tol=2e-13)
    ps = [1e-300, 1e-20, 1e-5, 0.01, 0.07, 0.0749, 0.0751, 0.3, 0.5, 0.77, 0.93, 0.999999, 0.0, 1.0, None]
    got = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile("p").alias("z")).collect()]
    for p, z in zip(ps, got, strict=True):
        assert z is None if p in (None, 0.0, 1.0) else math.isclose(z, NormalDist().inv_cdf(p), rel_tol=1e-13, abs_tol=1e-15)


def test_signed_ranks_are_enumerated(spark):
    table = {(r.n, r.statistic): r.p for r in exact.signed_rank_table(spark, 10).collect()}
    for n in range(1, 11):
        sums = [sum(i + 1 for i in range(n) if bits >> i & 1) for bits in range(2**n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert math.isclose(table[n, w], min(1.0, 2 * sum(s <= w for s in sums) / 2**n), rel_tol=1e-12)


def test_inversions_are_enumerated(spark):
    table = {(r.n, r.statistic): r.p for r in exact.inversion_table(spark, 7).collect()}
    for n in range(2, 8):
        found = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        total = n * (n - 1) // 2
        for k in range(total // 2 + 1):
            want = 1.0 if 2 * k == total else min(1.0, 2 * sum(f <= k for f in found) / len(found))
            assert math.isclose(table[n, k], want, rel_tol=1e-12)


@pytest.fixture(scope="module")
def paired(spark):
    rng = random.Random(6)
    rows = [(1, rng.random(), rng.random()) for _ in range(9)] + [(2, float(rng.randint(0, 5)), float(rng.randint(0, 5))) for _ in range(40)] + [(3, rng.random(), rng.random()) for _ in range(70)]
    rows += [(4, 1.0, 1.0), (5, 1.0, 2.0), (6, 3.0, None), (None, 0.1, 0.5), (None, 0.3, 0.2)]
    return rows, spark.createDataFrame(rows, "k long, x double, y double")


def test_tests(paired):
    rows, df = paired
    w, t = ({r.k: r for r in f(df.where("k is not null"), ["k"], "x", "y").collect()} for f in (exact.wilcoxon_test, exact.kendall_test))
    assert [w[k].method for k in (1, 2, 3, 5)] == ["exact", "normal", "normal", "exact"] and 4 not in w and 6 not in w
    d = sorted((abs(x - y), x > y) for k, x, y in rows if k == 1)
    at = sum(i + 1 for i, (_, up) in enumerate(d) if up)
    at = min(at, 45 - at)
    assert w[1].w == at and math.isclose(w[1].p, min(1.0, 2 * sum(sum(i + 1 for i in range(9) if b >> i & 1) <= at for b in range(512)) / 512))
    assert [t[k].method for k in (1, 2, 3)] == ["exact", "normal", "normal"] and t[4].p is None and t[5].tau is None
    pts = [(x, y) for k, x, y in rows if k == 2]
    s = sum(((a[0] > b[0]) - (a[0] < b[0])) * ((a[1] > b[1]) - (a[1] < b[1])) for a, b in itertools.combinations(pts, 2))
    tie = lambda i, f: sum(f(sum(p[i] == v for p in pts)) for v in {p[i] for p in pts})
    n, m = 40, 40 * 39
    pair, triple, five = (lambda c: c * (c - 1) / 2), (lambda c: c * (c - 1) * (c - 2)), (lambda c: c * (c - 1) * (2 * c + 5))
    var = (m * (2 * n + 5) - tie(0, five) - tie(1, five)) / 18 + 2 * tie(0, pair) * tie(1, pair) / m + tie(0, triple) * tie(1, triple) / (9 * m * (n - 2))
    assert math.isclose(t[2].p, math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)), rel_tol=1e-12)


def test_shapiro_wilk_examples(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # a published example: W = 0.7888, p = 0.0067
    rows = [(1, float(v)) for v in weights] + [(2, v) for v in (1.0, 2.0, 4.0)] + [(3, 5.0)] * 10 + [(4, 1.0), (4, 2.0)] + [(5, None)] * 9
    rows += [(6, NormalDist().inv_cdf((i + 0.5) / 400)) for i in range(400)] + [(7, math.exp(NormalDist().inv_cdf((i + 0.5) / 60))) for i in range(60)]
    got = {r.k: r for r in stats.shapiro_wilk(spark.createDataFrame(rows, "k long, v double"), ["k"], "v").collect()}
    assert abs(got[1].w - 0.7888147) < 1e-5 and abs(got[1].p - 0.0067) < 1e-4
    assert abs(got[2].w - 4.5 / (14 / 3)) < 1e-12 and abs(got[2].p - 6 / math.pi * (math.asin(math.sqrt(got[2].w)) - math.asin(math.sqrt(0.75)))) < 1e-9
    assert got[3].w is None and got[3].p is None and 4 not in got and 5 not in got
    assert got[6].p > 0.99 and got[7].p < 1e-6
    assert stats.shapiro_wilk(spark.createDataFrame([], "k long, v double"), ["k"], "v").count() == 0


def test_shapiro_wilk_against_plain_sums(spark):
    rng = random.Random(1)
    for n in (4, 5, 6, 12, 50):
        x = sorted(rng.choice([1.0, 2.0, 2.5, rng.random()]) for _ in range(n))
        m = [NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)]
        mm, u = sum(v * v for v in m), n**-0.5
        last = m[-1] / mm**0.5 + sum(c * u**k for k, c in enumerate(stats.SHAPIRO_LAST))
        a = [0.0] * n
        if n > 5:
            following = m[-2] / mm**0.5 + sum(c * u**k for k, c in enumerate(stats.SHAPIRO_NEXT))
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * following**2)
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = [v / phi**0.5 for v in m]
        a[0], a[-1] = -last, last
        if n > 5:
            a[1], a[-2] = -following, following
        mean = sum(x) / n
        want = sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x)
        got = stats.shapiro_wilk(spark.createDataFrame([(1, v) for v in x], "k long, v double"), ["k"], "v").first()
        assert abs(got.w - want) < 1e-9
