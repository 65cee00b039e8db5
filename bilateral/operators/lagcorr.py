"""Lagged and detrended cross-correlation of two series per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import div


def lagged(pairs: DataFrame, keys: list[str], lags: int, x: str = "x", y: str = "y", order: str = "pos") -> DataFrame:
    """Rows (keys, lag, pos, x, y at pos + lag) for lags 0 .. lags - 1; y is NULL beyond the end.

    Both series are centred, which changes no result and keeps digits. The lags of a row come from one
    window over the group, not from a join with the table of lags."""
    w = W.partitionBy(*keys).orderBy(order)
    part = W.partitionBy(*keys)
    centred = pairs.select(*keys, (F.row_number().over(w) - 1).alias("pos"), (F.col(x) - F.avg(x).over(part)).alias("x"), (F.col(y) - F.avg(y).over(part)).alias("y"))
    w = W.partitionBy(*keys).orderBy("pos")
    ahead = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead("y", k).over(w) if k else F.col("y")).alias("y")) for k in range(lags)])
    return centred.select(*keys, "pos", "x", ahead.alias("a")).select(*keys, "pos", "x", F.explode("a").alias("a")).select(*keys, "a.lag", "pos", "x", "a.y")


def cross_correlation(pairs: DataFrame, keys: list[str], lags: int, **names) -> DataFrame:
    """sum x y_lag / sqrt(sum x^2 sum y^2) of the centred series, by lag."""
    rows = lagged(pairs, keys, lags, **names)
    base = rows.where("lag = 0").groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    xy = rows.where("y is not null").groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    return xy.join(base, keys).select(*keys, "lag", div(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("value"))


BLOCK = 4096


def _pair_blocks(pairs: DataFrame, keys: list[str], x: str, y: str, order: str, reach: int) -> DataFrame:
    """Series pairs, numbered without gaps, in blocks (_k, b, x, y) that also hold the first ``reach`` values after them (x_next, y_next).

    ``order`` is a whole number. Only the sizes of blocks of neighbouring positions meet in one task."""
    size = max(BLOCK, reach)
    row = F.struct(F.col(order).cast("long").alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    near = pairs.select(F.struct(*[F.col(c) for c in keys]).alias("_k"), F.floor(F.col(order) / size).cast("long").alias("b"), row.alias("r")).groupBy("_k", "b").agg(F.array_sort(F.collect_list("r")).alias("r"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = near.select("_k", "b", F.size("r").alias("n")).select("_k", "b", before.alias("base"))
    each = near.join(base, ["_k", "b"]).select("_k", "base", F.posexplode("r").alias("at", "r")).select("_k", (F.col("base") + F.col("at")).alias("i"), "r")
    whole = each.groupBy("_k", F.floor(F.col("i") / size).cast("long").alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("r")).select("_k", "b", F.col("r.r.x").alias("x"), F.col("r.r.y").alias("y"))
    heads = whole.select("_k", (F.col("b") - 1).alias("b"), F.slice("x", 1, reach).alias("x_next"), F.slice("y", 1, reach).alias("y_next"))
    return whole.join(heads, ["_k", "b"], "left")


def _box_sums(lags: int, n: int):
    """Sums of the products of residuals over all boxes that start in a block, by lag."""
    k, c = n + 1, n / 2
    stt = k * (k * k - 1) / 12

    def boxes(v: np.ndarray):
        """Sums, sums about the box's middle time, own products and whether all is there, of the boxes at every place."""
        there = np.isfinite(v)
        v = np.where(there, v - (v[there].mean() if there.any() else 0.0), 0.0)  # a shift changes no residual and keeps digits
        run = lambda a: (lambda q: q[k:] - q[:-k])(np.concatenate([[0.0], np.cumsum(a)]))
        if len(v) < k:
            return v, *(np.zeros(0),) * 3, np.zeros(0, bool)
        s = run(v)
        t = run(np.arange(len(v)) * v) - (np.arange(len(s)) + c) * s
        return v, s, t, run(v * v) - s * s / k - t * t / stt, run(there) > k - 0.5

    def work(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for i in range(b.num_rows):
                x, y, x_next, y_next = (np.array([np.nan if v is None else v for v in (b.column(q)[i].as_py() or [])], float) for q in ("x", "y", "x_next", "y_next"))
                own = len(x)
                (x, sx, tx, xx, okx), (y, sy, ty, yy, oky) = boxes(np.concatenate([x, x_next])), boxes(np.concatenate([y, y_next]))
                for lag in range(lags):
                    m = min(own, len(sy) - lag)
                    if m <= 0:
                        break
                    ok = okx[:m] & oky[lag : lag + m]
                    if not ok.any():
                        continue
                    q = np.concatenate([[0.0], np.cumsum(x[: m + n] * y[lag : lag + m + n])])
                    xy = q[k:] - q[:-k] - sx[:m] * sy[lag : lag + m] / k - tx[:m] * ty[lag : lag + m] / stt
                    for o, v in zip(out, (i, lag, xy[ok].sum(), xx[:m][ok].sum(), yy[lag : lag + m][ok].sum(), int(ok.sum())), strict=True):
                        o.append(v)
            cols = [b.column("_k").take(pa.array(out[0], pa.int64())), *(pa.array(o, pa.float64() if j in (1, 2, 3) else pa.int64()) for j, o in enumerate(out[1:]))]
            yield pa.RecordBatch.from_arrays(cols, names=["_k", "lag", "xy", "xx", "yy", "boxes"])

    return work


def detrended(pairs: DataFrame, keys: list[str], lags: int, n: int, x: str = "x", y: str = "y", order: str = "pos") -> DataFrame:
    """Detrended cross-correlation rho of boxes of n + 1 samples at every place, by lag.

    The product of residuals of a box follows from sums (k = n + 1 samples at t = 0..n, centre n / 2):
    sum ab - sum a sum b / k - (sum ta - c sum a)(sum tb - c sum b) / Stt, and each of them is a difference of two running sums of its
    block of the series, so the cost hangs neither on the size of the boxes nor on the length of a series in one task. All lags
    come from the same blocks. Boxes with a missing value don't count; groups with no full box have no row."""
    blocks = _pair_blocks(pairs, keys, x, y, order, n + lags)
    kind = StructType([blocks.schema["_k"], *StructType.fromDDL("lag long, xy double, xx double, yy double, boxes long")])
    f = blocks.mapInArrow(_box_sums(lags, n), kind).groupBy("_k", "lag").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy", "boxes")])
    return f.select("_k.*", F.col("lag").cast("int").alias("lag"), div(F.col("xy"), F.sqrt(F.when((F.col("xx") > 1e-12) & (F.col("yy") > 1e-12), F.col("xx") * F.col("yy")))).alias("value"), F.col("boxes").alias("n_boxes"))


def max_over_lags(lagcorr: DataFrame, keys: list[str]) -> DataFrame:
    """Largest value and its first lag."""
    best = lagcorr.where("value is not null").groupBy(*keys).agg(F.max(F.struct("value", (-F.col("lag")).alias("l"))).alias("b"))
    return best.select(*keys, F.col("b.value").alias("value"), (-F.col("b.l")).alias("lag"))


def event_summary(best: DataFrame, by: list[str], above: float = 0.4) -> DataFrame:
    """Share of values above a limit and their mean."""
    return best.groupBy(*by).agg(F.avg(F.when(F.col("value") > above, 1.0).otherwise(0.0)).alias("share_above"), F.avg("value").alias("mean_value"), F.count("*").alias("n"))
