"""Peaks by prominence and distance.

A peak is a run of equal values with smaller ones on both sides (it counts once, at its first sample). Its prominence is its height above
the higher of two bases: the least values between it and the nearest greater value (or the end of the series) on either side.

A series is cut into blocks. A block finds the nearest greater values inside itself with a stack; for peaks that are greater than all of
their side of the block, the extremes of the other blocks (a few numbers each) name the block that holds the nearest greater
value, which is asked for the exact base. So no series is held in one task, only one entry for each of its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scan import to_blocks
from ..functions.shared import SharedTables
from ..functions.ship import ship

BLOCK = 65_536


def nearest_greater(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place ``at`` (ascending): whether a greater value stands before it, and the least value since then (or from the start)."""
    found, low = np.zeros(len(at), bool), np.empty(len(at))
    stack: list[tuple[float, float]] = []  # falling values, each with the least value since the one below it in the stack
    k = 0
    for i, x in enumerate(v.tolist()):
        least = x
        while stack and stack[-1][0] <= x:
            least = min(least, stack.pop()[1])
        if k < len(at) and at[k] == i:
            found[k], low[k] = bool(stack), least
            k += 1
        stack.append((x, least))
    return found, low


def _borders(batch: pa.RecordBatch, i: int) -> tuple[list[dict], int]:
    blocks = batch.column("all")[i].as_py()
    return blocks, next(j for j, x in enumerate(blocks) if x["b"] == batch.column("b")[i].as_py())


def _different(blocks: list[dict], j: int, value: float, step: int) -> float | None:
    """The next value on one side that isn't ``value``, from the ends of blocks j, j + step, ..."""
    edge, inner = ("last", "before_last") if step < 0 else ("first", "after_first")
    while 0 <= j < len(blocks):
        if blocks[j][edge] != value:
            return blocks[j][edge]
        if blocks[j][inner] is not None:
            return blocks[j][inner]
        j += step
    return None


def _found(batches):
    for batch in batches:
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            v = batch.column("_v")[i].values.to_numpy(zero_copy_only=False)
            p = batch.column("_p")[i].values.to_numpy(zero_copy_only=False)
            blocks, j = _borders(batch, i)
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))  # of runs
            x = v[start]
            left, right = np.concatenate([[np.nan], x[:-1]]), np.concatenate([x[1:], [np.nan]])
            before = _different(blocks, j - 1, x[0], -1)
            left[0] = np.nan if before is None or j and blocks[j - 1]["last"] == x[0] else before  # a run that began earlier counts there
            after = _different(blocks, j + 1, x[-1], 1)
            right[-1] = np.nan if after is None else after
            at = np.flatnonzero((x > left) & (x > right))
            if not len(at):
                continue
            maxima, minima = (np.array([q[c] for q in blocks]) for c in ("high", "low"))
            for side, values, places, near in ((-1, x, at, np.arange(j - 1, -1, -1)), (1, x[::-1], len(x) - 1 - at[::-1], np.arange(j + 1, len(blocks)))):
                inside, low = nearest_greater(values, places)
                for a, known, least in zip(at if side < 0 else at[::-1], inside, low, strict=True):
                    target = None
                    if not known:  # the nearest block with a greater value, and the least value before it
                        there = np.flatnonzero(maxima[near] > x[a])
                        between = near[: there[0]] if len(there) else near
                        least = min([least, *minima[between]])
                        target = blocks[near[there[0]]]["b"] if len(there) else None
                    rows.append((i, int(p[start[a]]), float(x[a]), side, float(least), target))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names=["_k", "p", "height", "side", "low", "target"])


def _asked(batches):
    """Least values between the nearest greater value of a block and the block's end towards the peak."""
    for batch in batches:
        of, cols = [], ([], [], [], [])
        for i in range(batch.num_rows):
            v = batch.column("_v")[i].values.to_numpy(zero_copy_only=False)
            for side, series in ((-1, v), (1, v[::-1])):
                top, least = np.maximum.accumulate(series[::-1])[::-1], np.minimum.accumulate(series[::-1])[::-1]  # of all from a place to the end
                for q in batch.column("asked")[i].as_py():
                    if q["side"] == side:
                        at = int(np.searchsorted(-top, -q["height"], "left"))  # places whose rest holds a greater value come first
                        of.append(i)
                        for c, value in zip(cols, (q["p"], q["height"], side, min(q["low"], least[at]) if at < len(least) else q["low"]), strict=True):
                            c.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(of, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["_k", "p", "height", "side", "low"])


def prominences(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos", size: int = BLOCK) -> DataFrame:
    """(keys, order, height, prominence) of every peak. Missing values are dropped; the order is a whole number."""
    ship(df.sparkSession)
    tables = SharedTables(df.sparkSession)
    blocks = tables.put(to_blocks(df, keys, order, value, size))
    v, n = F.col("_v"), F.size("_v")
    other = F.filter(v, lambda x: x != v[0])
    back = F.filter(v, lambda x: x != F.element_at(v, -1))
    ends = blocks.select(
        "_k", F.struct(F.col("_b").alias("b"), v[0].alias("first"), F.get(other, F.lit(0)).alias("after_first"), v[n - 1].alias("last"), F.get(back, F.size(back) - 1).alias("before_last"), F.array_max(v).alias("high"), F.array_min(v).alias("low")).alias("e")
    )
    every = ends.groupBy("_k").agg(F.array_sort(F.collect_list("e")).alias("all"))  # an entry a block
    kind = blocks.schema["_k"]
    out = "p long, height double, side long, low double"
    found = tables.put(blocks.withColumnRenamed("_b", "b").join(every, "_k").select("_k", "b", "_p", "_v", "all").mapInArrow(_found, StructType([kind, *StructType.fromDDL(out + ", target long")])))
    queries = found.where("target is not null").groupBy("_k", F.col("target").alias("_b")).agg(F.collect_list(F.struct("p", "height", "side", "low")).alias("asked"))
    answers = blocks.join(queries, ["_k", "_b"]).select("_k", "_v", "asked").mapInArrow(_asked, StructType([kind, *StructType.fromDDL(out)]))
    both = found.where("target is null").select("_k", "p", "height", "side", "low").union(answers)
    return both.groupBy("_k", "p").agg(F.max("height").alias("height"), (F.max("height") - F.max("low")).alias("prominence")).select("_k.*", F.col("p").alias(order), "height", "prominence")


def apart(peaks: DataFrame, keys: list[str], distance: int, height: str = "height", order: str = "pos") -> DataFrame:
    """Peaks that are ``distance`` or more apart: the highest stays (the later one of equals), those too near to it go, and so on.

    A round keeps every peak that is the highest of all undecided ones around it and removes its neighbours."""
    tables = SharedTables(peaks.sparkSession)
    k = F.struct(*[F.col(c) for c in keys])
    open_, kept = tables.put(peaks.withColumn("_k", k)), []
    near = W.partitionBy("_k").orderBy(order).rangeBetween(1 - distance, distance - 1)
    while not open_.isEmpty():
        best = F.max(F.struct(F.col(height), F.col(order))).over(near)
        marked = open_.withColumn("_top", best == F.struct(F.col(height), F.col(order)))
        marked = tables.put(marked.withColumn("_gone", F.max("_top").over(near)))
        kept.append(marked.where("_top").select(*peaks.columns))
        open_ = marked.where("not _gone").drop("_top", "_gone")
    out = kept[0] if kept else peaks.limit(0)
    for d in kept[1:]:
        out = out.union(d)
    return out


def prominent_peaks(df: DataFrame, keys: list[str], share: float = 0.1, distance: int = 1, value: str = "value", order: str = "pos") -> DataFrame:
    """(keys, number_of_peaks, peaks_amplitude): peaks whose prominence is at least ``share`` of the largest one of their group, and the sum
    of their heights; groups without a peak have zeros."""
    found = prominences(df, keys, value, order)
    k = F.struct(*[F.col(c) for c in keys]).alias("_k")
    largest = found.groupBy(k).agg(F.max("prominence").alias("_m"))
    kept = found.withColumn("_k", k).join(largest, "_k").where(F.col("prominence") >= share * F.col("_m")).drop("_k", "_m")
    if distance > 1:
        kept = apart(kept, keys, distance, order=order)
    counts = kept.groupBy(k).agg(F.count("*").alias("number_of_peaks"), F.sum("height").alias("peaks_amplitude"))
    return df.groupBy(k).agg(F.count(value).alias("_n")).join(counts, "_k", "left").select("_k.*", F.coalesce("number_of_peaks", F.lit(0)).cast("long").alias("number_of_peaks"), F.coalesce("peaks_amplitude", F.lit(0.0)).alias("peaks_amplitude"))
