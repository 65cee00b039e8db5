"""Unit-root and stationarity statistics per series.

KPSS and Phillips-Perron by a rule for the lags are windows and aggregates. The regressions of ADF and DF-GLS with given lags are
sums of products over a group; only those sums (a few numbers per group) reach the solver. ``unitroot`` chooses lags from the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import div, normal_tail
from . import unitroot

METHODS = ("adf", "dfgls", "kpss", "pp", "za")


# fixed values: published distributions of the statistics
KPSS_TABLE = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
ZA_TABLE = [(-5.34, 0.01), (-5.02, 0.025), (-4.80, 0.05), (-4.58, 0.10), (-3.75, 0.50), (-2.99, 0.90), (-2.77, 0.95), (-2.56, 0.975), (-2.32, 0.99)]
# (border, coefficients below it, coefficients above it): p is the normal probability of the polynomial
UNIT_ROOT_CONSTANT = (-1.61, [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368])
UNIT_ROOT_PLAIN = (-1.04, [0.6344, 1.2378, 0.032496], [0.4797, 0.93557, -0.06999, 0.033066])


def _lags(n, c: float = 4.0):
    return F.floor(c * F.pow(n / 100.0, F.lit(0.25))).cast("int")


def _most_lags(df: DataFrame, keys: list[str], value: str, c: float = 4.0) -> int:
    """The lag that the rule asks for in the largest group."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return max(1, int(c * (n / 100.0) ** 0.25))


def kpss(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos", max_lag: int | None = None) -> DataFrame:
    """Level-stationarity statistic with Bartlett weights over floor(4 (n / 100)^1/4) lags of each series."""
    max_lag = max_lag or _most_lags(df, keys, value)
    w, part = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    e = df.where(F.col(value).isNotNull()).withColumn("e", F.col(value) - F.avg(value).over(part))
    e = e.withColumn("s", F.sum("e").over(w.rowsBetween(W.unboundedPreceding, 0)))
    cols = [F.lag("e", k).over(w).alias(f"l{k}") for k in range(1, max_lag + 1)]
    g = e.select(*keys, "e", "s", *cols).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.sum(F.col("e") * F.col(f"l{k}")).alias(f"g{k}") for k in range(1, max_lag + 1)])
    lag = F.least(_lags(F.col("n")), F.lit(max_lag))
    cov = sum((F.when(lag >= k, 2 * (1 - k / (lag + 1.0)) * F.coalesce(f"g{k}", F.lit(0.0))).otherwise(0.0) for k in range(1, max_lag + 1)), F.lit(0.0))
    return g.select(*keys, div(F.col("ss") / (F.col("n") * F.col("n")), (F.col("g0") + cov) / F.col("n")).alias("kpss"), lag.alias("lags"), "n")


def phillips_perron(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos", max_lag: int | None = None) -> DataFrame:
    """Z-tau of y on its lag and a constant, with Newey-West variance over floor(12 (n / 100)^1/4) lags of each series."""
    max_lag = max_lag or _most_lags(df, keys, value, 12.0)
    w = W.partitionBy(*keys).orderBy(order)
    d = df.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("y"), F.lag(value).over(w).alias("x")).where("x is not null")
    fit = d.groupBy(*keys).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_sxx("y", "x").alias("sxx"), F.count("*").alias("n"))
    e = d.join(fit.select(*keys, "a", "b"), keys).withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    g = e.select(*keys, "e", *[F.lag("e", k).over(w).alias(f"l{k}") for k in range(1, max_lag + 1)]).groupBy(*keys).agg(F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.sum(F.col("e") * F.col(f"l{k}")).alias(f"g{k}") for k in range(1, max_lag + 1)])
    j = fit.where("n > 3").join(g, keys)
    n = F.col("n").cast("double")
    lag = F.least(_lags(F.col("n"), 12.0), F.lit(max_lag), F.col("n").cast("int") - 2)
    g0 = F.col("g0") / n
    lam = g0 + sum((F.when(lag >= k, 2 * (1 - k / (lag + 1.0)) * F.coalesce(f"g{k}", F.lit(0.0)) / n).otherwise(0.0) for k in range(1, max_lag + 1)), F.lit(0.0))
    s2 = F.col("g0") / (n - 2)
    se = F.sqrt(div(s2, F.col("sxx")))
    ok = F.when((lam > 0) & (s2 > 0), lam)
    tau = F.sqrt(g0 / ok) * div(F.col("b") - 1, se) - 0.5 * (ok - g0) / F.sqrt(ok) * n * se / F.sqrt(s2)
    return j.select(*keys, tau.alias("pp"), lag.alias("lags"), "n")


def _solve(xtx: np.ndarray, xty: np.ndarray, yty: float, n: int, k: int) -> float:
    """t value of coefficient k of a least-squares fit given by its sums."""
    try:
        beta = np.linalg.solve(xtx, xty)
        s2 = max(yty - beta @ xty, 0) / (n - len(xty))
        return float(beta[k] / np.sqrt(s2 * np.linalg.inv(xtx)[k, k])) if s2 > 0 else float("nan")
    except (np.linalg.LinAlgError, ZeroDivisionError, FloatingPointError):
        return float("nan")


def regression_t(df: DataFrame, keys: list[str], y: str, xs: list[str], name: str, k: int = 0) -> DataFrame:
    """t value of xs[k] in the regression of y on xs, per group, from sums of products."""
    cells = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    got = df.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(xs[i]) * F.col(xs[j])) for i, j in cells]).alias("xx"), F.array(*[F.sum(F.col(x) * F.col(y)) for x in xs]).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")
    )

    @F.pandas_udf(DoubleType())
    def t(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, c, m in zip(xx, xy, yy, n, strict=True):
            mat = np.zeros((len(xs), len(xs)))
            for (i, j), v in zip(cells, a, strict=True):
                mat[i, j] = mat[j, i] = v
            out.append(_solve(mat, np.asarray(b, float), float(c), int(m), k) if m > len(xs) else float("nan"))
        return pd.Series(out, dtype="float64")

    value = t("xx", "xy", "yy", "n")
    return got.select(*keys, value.alias("_t"), "n").select(*keys, F.when(~F.isnan("_t"), F.col("_t")).alias(name), "n")


def adf(df: DataFrame, keys: list[str], lags: int | None = None, value: str = "value", order: str = "pos", series=None) -> DataFrame:
    """Augmented Dickey-Fuller t: difference on the lagged level, ``lags`` lagged differences (None: chosen) and a constant."""
    if lags is None:
        return unitroot.adf(df, keys, value, order, series)
    w = W.partitionBy(*keys).orderBy(order)
    d = df.where(F.col(value).isNotNull()).withColumn("lev", F.lag(value).over(w)).withColumn("dy", F.col(value) - F.col("lev"))
    d = d.select(*keys, "lev", "dy", F.lit(1.0).alias("one"), *[F.lag("dy", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)]).dropna()
    return regression_t(d, keys, "dy", ["lev", "one", *[f"d{k}" for k in range(1, lags + 1)]], "adf")


def dfgls(df: DataFrame, keys: list[str], lags: int | None = None, value: str = "value", order: str = "pos", c: float = -7.0, series=None) -> DataFrame:
    """ADF t without constant on the series demeaned by generalised least squares at 1 + c / n (-7 where lags are chosen)."""
    if lags is None:
        return unitroot.dfgls(df, keys, value, order, series)
    w, part = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    a = 1 + c / F.count("*").over(part)
    d = df.where(F.col(value).isNotNull()).withColumn("a", a).withColumn("prev", F.lag(value).over(w))
    qy = F.when(F.col("prev").isNull(), F.col(value)).otherwise(F.col(value) - F.col("a") * F.col("prev"))
    qx = F.when(F.col("prev").isNull(), F.lit(1.0)).otherwise(1 - F.col("a"))
    d = d.withColumn("u", F.col(value) - div(F.sum(qx * qy).over(part), F.sum(qx * qx).over(part)))
    d = d.withColumn("lev", F.lag("u").over(w)).withColumn("dy", F.col("u") - F.col("lev"))
    d = d.select(*keys, "lev", "dy", *[F.lag("dy", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)]).dropna()
    return regression_t(d, keys, "dy", ["lev", *[f"d{k}" for k in range(1, lags + 1)]], "dfgls")


def _between(x, table: list[tuple[float, float]]):
    """Linear interpolation in a table, its ends beyond it; NULL for a missing value."""
    out = F.when(x <= table[0][0], table[0][1])
    for (a, p), (b, q) in zip(table, table[1:], strict=False):
        out = out.when(x <= b, p + (q - p) * (x - a) / (b - a))
    return out.when(x.isNotNull(), table[-1][1])


def _unit_root_p(x, rule: tuple):
    border, low, high = rule
    poly = lambda c: sum((F.lit(v) * F.pow(x, F.lit(float(k))) for k, v in enumerate(c)), F.lit(0.0))
    z = F.when(x <= border, poly(low)).when(x <= 2.7, poly(high)).when(x.isNotNull(), F.lit(10.0))
    return 1 - normal_tail(z)


def with_p(df: DataFrame, invert: bool = False) -> DataFrame:
    """Adds p (or 1 - p) to rows of (method, statistic): response surfaces for unit-root statistics, interpolation
    in the published tables for KPSS (0.01 to 0.10) and Zivot-Andrews (0.01 to 0.99)."""
    x, m = F.col("statistic"), F.col("method")
    p = (
        F.when(m == "kpss", _between(x, KPSS_TABLE)).when(m == "za", _between(x, ZA_TABLE))
        .when(m == "dfgls", _unit_root_p(x, UNIT_ROOT_PLAIN)).otherwise(_unit_root_p(x, UNIT_ROOT_CONSTANT))
    )
    return df.withColumn("p", 1 - p if invert else p)


def stationarity(df: DataFrame, keys: list[str], methods=METHODS, **names) -> DataFrame:
    """(keys, method, statistic) of the chosen methods, with lags and bandwidths chosen from the data.

    The blocks of the series and the regressions of their most lags are made once for all methods."""
    work = {"adf": adf, "dfgls": dfgls, "kpss": unitroot.kpss_auto, "pp": phillips_perron, "za": unitroot.zivot_andrews}
    series = unitroot.shared(df, keys, **names) if set(methods) - {"pp"} else None
    out = None
    for m in methods:
        one = work[m](df, keys, **names, **({} if m == "pp" else {"series": series})).select(*keys, F.lit(m).alias("method"), F.col(m).alias("statistic"))
        out = one if out is None else out.unionByName(one)
    return out
