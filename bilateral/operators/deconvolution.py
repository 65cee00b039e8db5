"""Tonic and phasic parts of a skin-conductance signal by sparse deconvolution.

The signal is modelled as the response (two exponentials) to a sparse, non-negative driver, plus a baseline: a line and a slow
second-order response to a free input. The parts minimise

    1/2 |K d + G e + line - y|^2 + sparsity * sum d + smoothness / 2 * |e|^2,  d >= 0,

by proximal gradient steps with momentum, which starts again whenever a step would raise the objective (so it never does). K and G
are linear recurrences (``functions.scan``) and their transposes the same recurrences backwards, so a step is four scans
and two sums over the series. Series of one block are solved where their block is, those of one length together; the steps of longer
ones are scans over blocks, all series together, with the same arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scan
from ..functions.scan import System, alike, flat, listed, recur, to_blocks
from ..functions.shared import SharedTables
from ..functions.ship import ship

RISE, DECAY, SLOW = 0.7, 2.0, 15.0  # seconds: of the response and of the baseline
STEP = 4.0  # bound of the squared norm of the model: K, G and the two columns of the line have norms of at most one


def response(times: list[float], fs: float) -> System:
    """Exponential decays one after another, each with unit gain for a constant."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for t in times:
        p = math.exp(-1 / (t * fs))
        m = len(b)
        a = np.block([[a, np.zeros((m, 1))], [c[None, :], np.array([[p]])]]) if m else np.array([[p]])
        b, c, d = np.append(b, d), np.append((1 - p) * c, (1 - p) * p), d * (1 - p)
    return System(a, b, c, d)


def line(first: int, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two columns of the line (level and slope, of unit norm) at ``count`` places from ``first`` of a series of n."""
    i = np.arange(first, first + count)
    return np.full(count, n**-0.5), (i / n - 0.5) * math.sqrt(12 / n)


def stepped(wd, we, gd, ge, sparsity: float, smoothness: float):
    """Driver and baseline input after a proximal gradient step."""
    return np.maximum(wd - (gd + sparsity) / STEP, 0), we - (ge + smoothness * we) / STEP


def cost(az, y, zd, ze, sparsity: float, smoothness: float):
    return 0.5 * ((az - y) ** 2).sum(-1) + sparsity * zd.sum(-1) + smoothness / 2 * (ze * ze).sum(-1)


def momentum(t):
    after = (1 + np.sqrt(1 + 4 * t * t)) / 2
    return (t - 1) / after, after


def solve_all(y: np.ndarray, k: System, g: System, sparsity: float, smoothness: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drivers and phasic parts of (scaled) series of one length (rows), and their objectives after each round (a row a round)."""
    m, n = y.shape
    level, slope = line(0, n, n)
    on = lambda s, v: s.run_all(v, np.zeros((m, len(s.b))))[0]
    back = lambda s, v: on(s, v[:, ::-1])[:, ::-1]
    none, nothing = np.zeros((m, n)), np.zeros((m, 1))
    x = [none, none, nothing, nothing, none]  # driver, baseline input, level, slope, model
    w, t, best = x, np.ones((m, 1)), cost(none, y, none, none, sparsity, smoothness)[:, None]
    costs = [best]
    for _ in range(rounds):
        r = w[4] - y
        zd, ze = stepped(w[0], w[1], back(k, r), back(g, r), sparsity, smoothness)
        a, b = w[2] - (r @ level)[:, None] / STEP, w[3] - (r @ slope)[:, None] / STEP
        z = [zd, ze, a, b, on(k, zd) + on(g, ze) + a * level + b * slope]
        f = cost(z[4], y, zd, ze, sparsity, smoothness)[:, None]
        better = f <= best
        ahead, after = momentum(t)
        w = [np.where(better, p + ahead * (p - q), q) for p, q in zip(z, x, strict=True)]
        x = [np.where(better, p, q) for p, q in zip(z, x, strict=True)]
        t, best = np.where(better, after, 1.0), np.where(better, f, best)
        costs.append(best)
    return x[0], on(k, x[0]), np.concatenate(costs, 1).T


def solve(y: np.ndarray, k: System, g: System, sparsity: float, smoothness: float, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Driver and phasic part of one series, and the objective after each round."""
    driver, phasic, costs = solve_all(y[None], k, g, sparsity, smoothness, rounds)
    return driver[0], phasic[0], costs[:, 0].tolist()


def _values(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in names]


def _lists(arrays) -> pa.Array:
    return pa.array(arrays, pa.list_(pa.float64()))


def _whole(k, g, sparsity, smoothness, rounds):
    def work(batches):
        for b in batches:
            y, at = flat(b.column("y"))
            driver, phasic = np.empty(len(y)), np.empty(len(y))
            for _, cells in alike(at):
                driver[cells], phasic[cells], _ = solve_all(y[cells], k, g, sparsity, smoothness, rounds)
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_b"), listed(driver, at), listed(phasic, at)], names=["_k", "_b", "driver", "phasic"])

    return work


def _mapped(df: DataFrame, keep: list[str], names: dict[str, str], work) -> DataFrame:
    """Rows with columns ``keep`` and new ones (name: type), made row by row from arrays and scalars by ``work(row) -> tuple``."""

    def run(batches):
        for b in batches:
            out = [work(b, i) for i in range(b.num_rows)]
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(_lists(c) if t == "array<double>" else pa.array(c, pa.float64()) for c, t in zip(cols, names.values(), strict=True))], names=[*keep, *names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(", ".join(f"{c} {t}" for c, t in names.items()))]))


ARRAY = "array<double>"
PLACE = ["_k", "_b", "first", "n", "y"]


def _scanned(df: DataFrame, column: str, system: System, name: str, backwards: bool = False) -> DataFrame:
    """(_k, _b, name): a column of blocks after a recurrence from rest, forwards or backwards."""
    sign = -1 if backwards else 1
    turn = (lambda c: F.reverse(c)) if backwards else (lambda c: F.col(c))
    out = recur(df.select("_k", (sign * F.col("_b")).alias("_b"), turn(column).alias("_v")), system)
    return out.select("_k", (sign * F.col("_b")).alias("_b"), turn("_v").alias(name))


def _together(tables: SharedTables, blocks: DataFrame, k: System, g: System, sparsity: float, smoothness: float, rounds: int) -> DataFrame:
    """(_k, _b, driver, phasic) of series of many blocks: every round is a few scans over the blocks of all of them."""
    zero = F.transform("y", lambda v: F.lit(0.0))
    arrays = ["xd", "xe", "ax", "wd", "we", "aw"]
    state = tables.put(blocks.select(*PLACE, *[zero.alias(c) for c in arrays]))
    start = state.groupBy("_k").agg(F.sum(F.aggregate("y", F.lit(0.0), lambda s, v: s + v * v / 2)).alias("best"))
    one = tables.put(start.select("_k", "best", F.lit(1.0).alias("t"), *[F.lit(0.0).alias(c) for c in ("xa", "xb", "wa", "wb")]))
    for _ in range(rounds):

        def residual(b, i):
            aw, y = _values(b, i, "aw", "y")
            level, slope = line(b.column("first")[i].as_py(), len(y), b.column("n")[i].as_py())
            return aw - y, float((aw - y) @ level), float((aw - y) @ slope)

        def prox(b, i):
            return stepped(*_values(b, i, "wd", "we", "gd", "ge"), sparsity, smoothness)

        def value(b, i):
            kd, ge, zd, ze, y = _values(b, i, "kd", "bl", "zd", "ze", "y")
            level, slope = line(b.column("first")[i].as_py(), len(y), b.column("n")[i].as_py())
            az = kd + ge + b.column("za")[i].as_py() * level + b.column("zb")[i].as_py() * slope
            return az, float(cost(az, y, zd, ze, sparsity, smoothness))

        def taken(b, i):
            xd, xe, ax, zd, ze, az = _values(b, i, "xd", "xe", "ax", "zd", "ze", "az")
            if not b.column("better")[i].as_py():
                return xd, xe, ax, xd, xe, ax
            ahead = b.column("ahead")[i].as_py()
            return zd, ze, az, *(p + ahead * (p - q) for p, q in ((zd, xd), (ze, xe), (az, ax)))

        r = tables.put(_mapped(state, ["_k", "_b"], {"r": ARRAY, "ga": "double", "gb": "double"}, residual))
        lines = r.groupBy("_k").agg(F.sum("ga").alias("ga"), F.sum("gb").alias("gb"))
        moved = tables.put(one.join(lines, "_k").select(*one.columns, (F.col("wa") - F.col("ga") / STEP).alias("za"), (F.col("wb") - F.col("gb") / STEP).alias("zb")))
        both = state.join(_scanned(r, "r", k, "gd", True), ["_k", "_b"]).join(_scanned(r, "r", g, "ge", True), ["_k", "_b"])
        z = tables.put(_mapped(both, [*PLACE, *arrays], {"zd": ARRAY, "ze": ARRAY}, prox))
        ready = z.join(_scanned(z, "zd", k, "kd"), ["_k", "_b"]).join(_scanned(z, "ze", g, "bl"), ["_k", "_b"]).join(moved.select("_k", "za", "zb"), "_k")
        tried = tables.put(_mapped(ready, [*PLACE, *arrays, "zd", "ze"], {"az": ARRAY, "f": "double"}, value))
        costs = tried.groupBy("_k").agg(F.sum("f").alias("f"))
        better = F.col("f") <= F.col("best")
        after = (1 + F.sqrt(1 + 4 * F.col("t") * F.col("t"))) / 2
        ahead = (F.col("t") - 1) / after
        chosen = tables.put(moved.join(costs, "_k").select("*", better.alias("better"), ahead.alias("ahead"), after.alias("after")))
        new = tables.put(_mapped(tried.join(chosen.select("_k", "better", "ahead"), "_k"), PLACE, dict.fromkeys(arrays, ARRAY), taken))
        pick = lambda z, x: F.when(F.col("better"), F.col(z)).otherwise(F.col(x))
        push = lambda z, x: F.when(F.col("better"), F.col(z) + F.col("ahead") * (F.col(z) - F.col(x))).otherwise(F.col(x))
        next_ = tables.put(chosen.select("_k", pick("f", "best").alias("best"), F.when(F.col("better"), F.col("after")).otherwise(1.0).alias("t"), pick("za", "xa").alias("xa"), pick("zb", "xb").alias("xb"), push("za", "xa").alias("wa"), push("zb", "xb").alias("wb")))
        tables.drop(state, one, r, moved, z, tried, chosen)
        state, one = new, next_
    return state.select("_k", "_b", F.col("xd").alias("driver")).join(_scanned(state, "xd", k, "phasic"), ["_k", "_b"])


def tonic_phasic(df: DataFrame, keys: list[str], fs: float, value: str = "value", order: str = "pos", sparsity: float = 0.02, smoothness: float = 0.001, rounds: int = 300, size: int | None = None) -> DataFrame:
    """df with tonic, phasic and driver of its values; tonic + phasic is the value.

    Series are scaled by their mean and deviation first. Missing values have no parts and are left out; so are those of series without
    spread, which are all tonic. The order is a whole number, evenly sampled; a series of more than ``size`` positions is solved over blocks."""
    ship(df.sparkSession)
    tables = SharedTables(df.sparkSession)
    size = size or scan.BLOCK
    k, g = response([RISE, DECAY], fs), response([SLOW, SLOW], fs)
    blocks = tables.put(to_blocks(df, keys, order, value, size))
    sums = blocks.select("_k", "_b", F.size("_v").alias("m"), F.aggregate("_v", F.lit(0.0), lambda s, v: s + v).alias("s"))
    means = sums.groupBy("_k").agg((F.sum("s") / F.sum("m")).alias("mean"), F.sum("m").alias("n"), F.count("*").alias("blocks"))
    spread = blocks.join(means, "_k").groupBy("_k").agg(F.sqrt(F.sum(F.aggregate("_v", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))) / F.first("n")).alias("sd"))
    first = F.coalesce(F.sum("m").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first")
    scaled = blocks.join(sums.select("_k", "_b", first), ["_k", "_b"]).join(means, "_k").join(spread, "_k").where(F.col("sd") > 1e-12 * F.greatest(F.abs("mean"), F.lit(1.0)))
    scaled = tables.put(scaled.withColumn("y", F.transform("_v", lambda v: (v - F.col("mean")) / F.col("sd"))))
    out = StructType([blocks.schema["_k"], *StructType.fromDDL("_b long, driver array<double>, phasic array<double>")])
    parts = scaled.where("blocks = 1").select("_k", "_b", "y").mapInArrow(_whole(k, g, sparsity, smoothness, rounds), out)
    many = scaled.where("blocks > 1")
    if not many.isEmpty():
        parts = parts.union(_together(tables, many, k, g, sparsity, smoothness, rounds).select("_k", "_b", "driver", "phasic"))
    rows = scaled.select("_k", "_b", "_p", "sd").join(parts, ["_k", "_b"]).select("_k", "sd", F.explode(F.arrays_zip("_p", "driver", "phasic")).alias("x"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k.{c}"))
    got = df.join(rows, same & (F.col(order).cast("long") == F.col("x._p")), "left")
    phasic, driver = F.col("x.phasic") * F.col("sd"), F.col("x.driver") * F.col("sd")
    there = F.when(F.col(value).isNotNull(), F.coalesce(phasic, F.lit(0.0)))
    return got.select(*[F.col(c) for c in df.columns if c not in ("tonic", "phasic", "driver")], (F.col(value) - there).alias("tonic"), there.alias("phasic"), F.when(F.col(value).isNotNull(), F.coalesce(driver, F.lit(0.0))).alias("driver"))
