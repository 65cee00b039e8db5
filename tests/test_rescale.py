"""The likeliest exponent of the power transformation against a fine search."""

import math
import random

from bilateral.operators import rescale


def psi(v, lam):
    if v >= 0:
        return math.log1p(v) if abs(lam) < 1e-9 else ((v + 1) ** lam - 1) / lam
    return -math.log1p(-v) if abs(2 - lam) < 1e-9 else -((1 - v) ** (2 - lam) - 1) / (2 - lam)


def likelihood(x, lam):
    y = [psi(v, lam) for v in x]
    mean = sum(y) / len(y)
    return -len(y) / 2 * math.log(sum((v - mean) ** 2 for v in y) / len(y)) + (lam - 1) * sum(math.copysign(math.log1p(abs(v)), v) for v in x)


def slope(x, lam):
    """Of the likelihood, by the plain sums."""

    def d(v):
        log, e = (math.log1p(v), lam) if v >= 0 else (math.log1p(-v), 2 - lam)
        return (math.exp(e * log) * (e * log - 1) + 1) / e**2

    y, g = [psi(v, lam) for v in x], [d(v) for v in x]
    my, mg = sum(y) / len(y), sum(g) / len(g)
    return sum(math.copysign(math.log1p(abs(v)), v) for v in x) - len(x) * sum((a - my) * (b - mg) for a, b in zip(y, g)) / sum((a - my) ** 2 for a in y)


def test_exponents(spark):
    rng = random.Random(2)
    groups = {
        1: [math.exp(rng.gauss(0, 1)) for _ in range(80)], 2: [rng.gauss(0, 1) for _ in range(80)], 3: [-math.exp(rng.gauss(0, 1)) for _ in range(80)],
        None: [(1 + 5 * rng.gauss(2, 0.3)) ** 0.2 for _ in range(80)], 5: [100 - math.exp(rng.gauss(0, 1)) for _ in range(60)],
    }
    rows = [(k, i, float(v)) for k, x in groups.items() for i, v in enumerate(x)] + [(8, 0, 1.0), (8, 1, 1.0), (9, 0, None)]
    df = spark.createDataFrame(rows, "usr long, pos long, value double")
    got = {r["_k"].usr: r["lambda"] for r in rescale.likeliest_exponents(df, ["usr"]).collect()}
    assert set(got) == set(groups)
    outside = 0
    for k, x in groups.items():
        lo, hi = got[k] - 3, got[k] + 3
        while hi - lo > 1e-8:  # the likelihood is concave
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (a, hi) if likelihood(x, a) < likelihood(x, b) else (lo, b)
        # (it is too flat to say the place of its top to more than some 1e-5)
        assert abs(got[k] - (lo + hi) / 2) < 1e-4 and likelihood(x, got[k]) >= likelihood(x, (lo + hi) / 2) - 1e-9
        assert slope(x, got[k] - 1e-6) > 0 > slope(x, got[k] + 1e-6)
        outside += abs(got[k]) > 2
    assert outside >= 1
    out = rescale.yeo_johnson(df, ["usr"], grid=None).where("usr = 1").agg({"scaled": "avg"}).first()[0]
    assert abs(out) < 1e-9 and rescale.yeo_johnson(df, ["usr"], grid=None).where("usr >= 8 and scaled is not null").count() == 0
    assert rescale.yeo_johnson(df.limit(0), ["usr"], grid=None).count() == 0
