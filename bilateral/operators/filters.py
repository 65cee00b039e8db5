"""Low-pass filters as blocked recurrences, smoothing, tonic/phasic split and artefact rules."""

from __future__ import annotations

import cmath
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import weighted_history
from ..functions.scan import System, alike, flat, listed, recur, to_blocks
from ..functions.shared import SharedTables
from ..functions.ship import ship


def sections(cutoff: float, fs: float, order: int = 1) -> list[tuple[float, ...]]:
    """Digital Butterworth low-pass as sections (b0, b1, b2, a1, a2), by the bilinear transformation with a warped cutoff."""
    if order < 1 or not 0 < cutoff < fs / 2:
        raise ValueError("the order is 1 or more, the cutoff between 0 and half the sampling rate")
    k = math.tan(math.pi * cutoff / fs)
    out = [(k / (1 + k), k / (1 + k), 0.0, (k - 1) / (1 + k), 0.0)] if order % 2 else []
    for i in range(order // 2):
        damp = 2 * math.sin(math.pi * (2 * i + 1) / (2 * order))
        n = 1 + damp * k + k * k
        out.append((k * k / n, 2 * k * k / n, k * k / n, 2 * (k * k - 1) / n, (1 - damp * k + k * k) / n))
    return out


def lowpass_system(cutoff: float, fs: float, order: int = 1) -> System:
    """The same sections one after another as one linear recurrence, each in the coordinates of its poles (a rotation and a shrinking),
    which keep their precision when the cutoff is a tiny part of the sampling rate."""
    sections(cutoff, fs, order)  # for its checks
    k = math.tan(math.pi * cutoff / fs)
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for i in range((order + 1) // 2):
        angle = math.pi / 2 + math.pi * (2 * i + 1) / (2 * order)
        left = -2 * k * cmath.rect(1, angle) / (1 - k * cmath.rect(1, angle))  # one minus the pole
        if i == order // 2:  # the real one of an odd order
            left = 2 * k / (1 + k)
            gain, own, into, out = left / 2, np.array([[1 - left]]), np.ones(1), np.array([left / 2 * (2 - left)])
        else:
            gain = abs(left) ** 2 / 4
            weight = gain * (2 - left) ** 2 / (-2j * left.imag)
            own, into, out = np.array([[1 - left.real, left.imag], [-left.imag, 1 - left.real]]), np.array([1.0, 0.0]), 2 * np.array([weight.real, -weight.imag])
        m, n = len(b), len(into)
        a = np.block([[a, np.zeros((m, n))], [np.outer(into, c), own]]) if m else own
        b, c, d = np.concatenate([b, into * d]), np.concatenate([gain * c, out]), d * gain
    return System(a, b, c, d)


def _back(blocks: DataFrame, df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Rows with the values of blocks in the column ``name``."""
    rows = blocks.select("_k", F.explode(F.arrays_zip("_p", "_v")).alias("_x"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k.{k}"))
    return df.join(rows.select("_k", F.col("_x._p").alias("_at"), F.col("_x._v").alias(name)), same & (F.col(order).cast("long") == F.col("_at")), "left").drop("_k", "_at")


def lowpass_causal(df: DataFrame, keys: list[str], cutoff: float, fs: float, value: str = "value", name: str = "filtered", order: str = "pos", degree: int = 1) -> DataFrame:
    """Causal Butterworth low-pass of any degree that starts from rest; NULL samples are dropped first.

    Positions are whole numbers, each one once in a series. The recurrence is run in blocks and is exact, whatever the cutoff."""
    got = df.where(F.col(value).isNotNull())
    return _back(recur(to_blocks(got, keys, order, value), lowpass_system(cutoff, fs, degree)), got, keys, order, name)


def apply_filter(df: DataFrame, keys: list[str], work, suffix: str = "filt", value: str = "value", **names) -> DataFrame:
    """df with the column <value>_<suffix> of ``work`` (a filter of this module) over its rows with a value.

    Rows without one are dropped, but groups in which all values are missing are returned as they are."""
    name = f"{value}_{suffix}"
    there = F.count(value).over(W.partitionBy(*keys))
    marked = df.withColumn("_there", there)
    done = work(marked.where(F.col(value).isNotNull()).drop("_there"), keys, value=value, name=name, **names)
    return done.unionByName(marked.where("_there = 0").drop("_there"), allowMissingColumns=True)


def _both_ways(system: System, pad: int):
    """Whole series (more than ``pad`` samples each) filtered forward and backward over their extensions."""

    def once(x):
        return system.run_all(x, x[:, :1] * system.steady())[0][:, ::-1]

    def work(batches):
        for b in batches:
            v, at = flat(b.column("_v"))
            y = np.empty(len(v))
            for _, cells in alike(at):
                x = v[cells]
                longer = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -2 - pad : -1]], 1)
                y[cells] = once(once(longer))[:, pad : pad + x.shape[1]]
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_b"), b.column("_p"), listed(y, at)], names=["_k", "_b", "_p", "_v"])

    return work


def lowpass_zero_phase(df: DataFrame, keys: list[str], cutoff: float, fs: float, value: str = "value", name: str = "filtered", order: str = "pos", pad: int | None = None, degree: int = 1) -> DataFrame:
    """Forward and backward low-pass with odd extension of ``pad`` samples (three times degree + 1) at both ends and steady start.

    Groups of at most ``pad`` samples give NULL. The extension is built from the first and last pad + 1 samples
    of each group, which its first and last blocks hold; nothing else is brought together. Groups of one block are filtered where it is."""
    pad = 3 * (degree + 1) if pad is None else pad
    system = lowpass_system(cutoff, fs, degree)
    ship(df.sparkSession)
    tables = SharedTables(df.sparkSession)
    got = df.where(F.col(value).isNotNull())
    blocks = tables.put(to_blocks(got, keys, order, value))
    sizes = blocks.select("_k", "_b", F.size("_v").alias("_n"))
    part = W.partitionBy("_k")
    upto = F.sum("_n").over(part.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    placed = sizes.select("_k", "_b", (upto - F.col("_n")).alias("_before"), (F.sum("_n").over(part) - upto).alias("_after"), F.sum("_n").over(part).alias("_all"))
    enough = tables.put(placed.where(F.col("_all") > pad))
    one = blocks.join(enough.where("_before + _after = 0"), ["_k", "_b"]).select("_k", "_b", "_p", "_v")
    done = one.mapInArrow(_both_ways(system, pad), one.schema)
    if enough.where("_before + _after > 0").isEmpty():
        return _back(done, got, keys, order, name)
    blocks = blocks.join(enough.where("_before + _after > 0"), ["_k", "_b"])
    head = blocks.where(F.col("_before") <= pad).groupBy("_k").agg(F.min("_b").alias("_b"), F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_v"))), lambda x: x["_v"])), 1, pad + 1).alias("_e"))
    tail = blocks.where(F.col("_after") <= pad).groupBy("_k").agg(F.max("_b").alias("_b"), F.slice(F.reverse(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_v"))), lambda x: x["_v"]))), 1, pad + 1).alias("_e"))
    mirror = lambda e: F.transform(F.slice(e, 2, pad), lambda v: 2 * e[0] - v)
    none = F.lit(None).cast("array<bigint>").alias("_p")
    before = head.select("_k", (F.col("_b") - 1).alias("_b"), none, F.reverse(mirror(F.col("_e"))).alias("_v"))
    behind = tail.select("_k", (F.col("_b") + 1).alias("_b"), none, mirror(F.col("_e")).alias("_v"))
    whole = blocks.select("_k", "_b", "_p", "_v").union(before).union(behind)
    turned = lambda d: d.select("_k", (-F.col("_b")).alias("_b"), F.reverse("_p").alias("_p"), F.reverse("_v").alias("_v"))
    both = recur(turned(recur(whole, system, steady=True)), system, steady=True)
    return _back(done.union(both.where("_p is not null").select(*done.columns)), got, keys, order, name)


def moving_acceleration(df: DataFrame, keys: list[str], window: int, axes=("x", "y", "z"), name: str = "smoothed", order: str = "pos", unit: float = 64.0, rate: float = 32.0, keep: float = 0.9) -> DataFrame:
    """Exponential average of the forward sum of largest axis changes; the first ``window`` rows are NULL."""
    w = W.partitionBy(*keys).orderBy(order)
    change = F.greatest(*[F.abs(F.col(a) / unit - F.lag(F.col(a) / unit).over(w)) for a in axes])
    moved = df.withColumn("_c", F.coalesce(change, F.lit(0.0)))
    summed = moved.withColumn("_s", F.sum("_c").over(w.rowsBetween(0, window - 1)) / rate)
    weights = [(1 - keep) * keep**k for k in range(400)]
    place = F.row_number().over(w)
    return summed.withColumn(name, F.when(place > window, weighted_history("_s", weights, w))).drop("_c", "_s")


def tonic_phasic(df: DataFrame, keys: list[str], half: int, value: str = "value", order: str = "pos") -> DataFrame:
    """Slow part (centred rolling median) and the rest of a signal."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumn("tonic", F.percentile(value, F.lit(0.5)).over(w)).withColumn("phasic", F.col(value) - F.col("tonic"))


def artefact_rules(df: DataFrame, keys: list[str], size: int, low: float, high: float, slope: float, value: str = "value", order: str = "pos") -> DataFrame:
    """Flag of each window of ``size`` samples: a value out of range, a step above ``slope`` or a flat line."""
    step = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(order)))
    stepped = df.withColumn("_d", step).withColumn("window_id", F.floor(F.col(order) / size))
    bad = (F.min(value) < low) | (F.max(value) > high) | (F.coalesce(F.max("_d"), F.lit(0.0)) > slope) | ((F.count("*") > 1) & (F.max(value) == F.min(value)))
    return stepped.groupBy(*keys, "window_id").agg(bad.cast("int").alias("artefact"), F.count("*").alias("n"))
