"""Rescaling within groups (side, user, session, component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import average_rank, div
from ..functions.shared import SharedTables


def standardize(df: DataFrame, keys: list[str], value: str = "value", name: str = "scaled") -> DataFrame:
    """(v - mean) / population sd; NULL for constant groups."""
    w = W.partitionBy(*keys)
    return df.withColumn(name, div(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def min_max(df: DataFrame, keys: list[str], value: str = "value", name: str = "scaled") -> DataFrame:
    w = W.partitionBy(*keys)
    return df.withColumn(name, div(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)))


def robust(df: DataFrame, keys: list[str], value: str = "value", name: str = "scaled") -> DataFrame:
    """(v - median) / (q75 - q25), exact quantiles with linear interpolation."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return df.join(q, keys).withColumn(name, div(F.col(value) - F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0])).drop("_q")


def log1p(df: DataFrame, keys: list[str], value: str = "value", name: str = "scaled") -> DataFrame:
    return df.withColumn(name, F.log1p(value))


def identity(df: DataFrame, keys: list[str], value: str = "value", name: str = "scaled") -> DataFrame:
    return df.withColumn(name, F.col(value))


def _yeo(v, lam):
    up = F.when(F.abs(lam) > 1e-9, (F.pow(v + 1, lam) - 1) / F.nullif(lam, F.lit(0.0))).otherwise(F.log1p(F.greatest(v, F.lit(0.0))))
    rest = 2 - lam
    down = F.when(F.abs(rest) > 1e-9, -(F.pow(1 - v, rest) - 1) / F.nullif(rest, F.lit(0.0))).otherwise(-F.log1p(F.greatest(-v, F.lit(0.0))))
    return F.when(v >= 0, up).otherwise(down)


def _yeo_slope(v, lam):
    """How the transformed value changes with the exponent."""
    part = lambda log, e: F.when(F.abs(e) > 1e-5, (F.exp(e * log) * (e * log - 1) + 1) / F.nullif(e * e, F.lit(0.0))).otherwise(log * log / 2 + e * log * log * log / 3)
    return F.when(v >= 0, part(F.log1p(F.greatest(v, F.lit(0.0))), lam)).otherwise(part(F.log1p(F.greatest(-v, F.lit(0.0))), 2 - lam))


WIDEST = 64.0  # exponents are sought up to this size


def likeliest_exponents(df: DataFrame, keys: list[str], value: str = "value", close: float = 1e-9) -> DataFrame:
    """(_k: struct of keys, lambda): the maximum-likelihood exponent of each group with spread, in brackets that shrink together.

    The likelihood is concave in the exponent, so its slope has one root. A round is one aggregate of the slope at three exponents a
    group: outside the bracket until the slope changes its sign, then around the secant's root, as far apart as the square of the
    bracket's width. Groups whose bracket is narrow enough drop out."""
    tables = SharedTables(df.sparkSession)
    v = F.col("_v")
    slim = tables.put(df.where(F.col(value).isNotNull()).select(F.struct(*[F.col(k) for k in keys]).alias("_k"), F.col(value).cast("double").alias("_v")))
    base = slim.groupBy("_k").agg(F.count("*").alias("n"), F.sum(F.signum(v) * F.log1p(F.abs(v))).alias("s"), F.min(v).alias("a"), F.max(v).alias("b")).where("b > a")
    none = F.lit(None).cast("double")
    state = base.select("_k", "n", "s", none.alias("lo"), none.alias("hi"), none.alias("flo"), none.alias("fhi"), F.array(F.lit(-1.0), F.lit(0.5), F.lit(2.0)).alias("points"))
    state, done = tables.put(state), []
    while not state.isEmpty():
        each = state.select("_k", "n", "s", F.explode("points").alias("x"))
        sums = slim.join(each, "_k").groupBy("_k", "x", "n", "s").agg(F.covar_pop(_yeo(v, F.col("x")), _yeo_slope(v, F.col("x"))).alias("c"), F.var_pop(_yeo(v, F.col("x"))).alias("w"))
        f = sums.select("_k", "x", (F.col("s") - F.col("n") * F.col("c") / F.nullif(F.col("w"), F.lit(0.0))).alias("f")).where("f is not null and not isnan(f)")
        up, down = F.col("f") > 0, F.col("f") <= 0
        ends = f.groupBy("_k").agg(
            F.max(F.when(up, F.col("x"))).alias("lo2"), F.max_by("f", F.when(up, F.col("x"))).alias("flo2"), F.min(F.when(down, F.col("x"))).alias("hi2"), F.min_by("f", F.when(down, F.col("x"))).alias("fhi2")
        )
        new = state.join(ends, "_k", "left").select("_k", "n", "s", *[F.coalesce(f"{c}2", c).alias(c) for c in ("lo", "hi", "flo", "fhi")])
        width = F.col("hi") - F.col("lo")
        secant = F.coalesce(F.col("lo") + width * F.col("flo") / F.nullif(F.col("flo") - F.col("fhi"), F.lit(0.0)), (F.col("lo") + F.col("hi")) / 2)
        apart = F.greatest(F.least(0.1 * width * width, width / 4), F.lit(close / 4))
        inner = F.array(*[F.greatest(F.col("lo"), F.least(F.col("hi"), secant + k * apart)) for k in (-1, 0, 1)])
        wider = F.when(F.col("hi").isNull(), F.array(*[F.col("lo") * k for k in (2, 4, 8)])).otherwise(F.array(*[F.col("hi") * k for k in (2, 4, 8)]))
        step = tables.put(new.withColumn("points", F.when(width.isNull(), wider).otherwise(inner)))
        far = F.coalesce(F.abs(F.coalesce("lo", "hi")) > WIDEST, F.lit(True)) & width.isNull()
        end = F.coalesce(width <= close, F.lit(False)) | far
        done.append(step.where(end).select("_k", F.coalesce((F.col("lo") + F.col("hi")) / 2, "lo", "hi").alias("lambda")))
        state = step.where(~end)
    out = done[0] if done else base.select("_k", F.lit(1.0).alias("lambda")).limit(0)
    for d in done[1:]:
        out = out.union(d)
    return out


def yeo_johnson(df: DataFrame, keys: list[str], value: str = "value", name: str = "scaled", grid: tuple | None = (-2.0, 2.0, 0.25)) -> DataFrame:
    """Power transformation with the maximum-likelihood exponent (of a grid, or of all numbers if ``grid`` is None), then standardised.

    The likelihoods of all exponents of a grid are aggregates of one pass over the group."""
    v = F.col(value).cast("double")
    if grid is None:
        best = likeliest_exponents(df, keys, value)
        moved = df.withColumn("_k", F.struct(*[F.col(k) for k in keys])).join(best, "_k", "left").drop("_k").withColumn("_y", _yeo(v, F.col("lambda")))
        return standardize(moved, keys, "_y", name).drop("_y")
    low, high, step = grid
    lams = [low + step * i for i in range(int(round((high - low) / step)) + 1)]
    sums = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.sum(F.signum(v) * F.log1p(F.abs(v))).alias("_s"), *[F.var_pop(_yeo(v, F.lit(x))).alias(f"_v{i}") for i, x in enumerate(lams)])
    like = [F.struct((-F.col("_n") / 2 * F.log(F.nullif(F.col(f"_v{i}"), F.lit(0.0))) + (x - 1) * F.col("_s")).alias("l"), F.lit(x).alias("x")) for i, x in enumerate(lams)]
    best = sums.select(*keys, F.array_max(F.filter(F.array(*like), lambda s: s["l"].isNotNull()))["x"].alias("lambda"))
    moved = df.join(best, keys).withColumn("_y", _yeo(v, F.col("lambda")))
    return standardize(moved, keys, "_y", name).drop("_y")


def quantile(df: DataFrame, keys: list[str], value: str = "value", name: str = "scaled") -> DataFrame:
    """Uniform scores (mean rank - 1) / (n - 1)."""
    ranked = average_rank(df.where(F.col(value).isNotNull()), value, keys, "_r")
    return ranked.withColumn(name, div(F.col("_r") - 1, (F.count("*").over(W.partitionBy(*keys)) - 1).cast("double"))).drop("_r")


METHODS = {
    "standard": standardize, "min_max": min_max, "robust": robust, "log": log1p, "yeo_johnson": yeo_johnson, "quantile": quantile, "identity": identity,
}


def rescale(df: DataFrame, method: str, keys: list[str], value: str = "value", name: str = "scaled") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown rescaling method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](df, keys, value, name)
