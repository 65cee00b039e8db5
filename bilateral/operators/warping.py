"""Dynamic time warping of series pairs: the exact distance, and the coarse-to-fine approximation.

The cost matrix of a pair is cut into tiles. A round solves one anti-diagonal of tiles of all pairs and hands the lower and right
borders of each on as rows, so the work of one pair is spread over tasks, no task holds more than a tile, and lengths have no limit.
Within a tile, one anti-diagonal of cells is one vector operation.

The approximation halves both series again and again, solves the shortest, and lets the path found there, widened by a radius,
say which cells of the next longer pair are solved: tiles that the path doesn't touch are left out. Paths are followed
backwards through the tiles from their borders, a tile of every pair a round.
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

TILE = 1024


def solve(x: np.ndarray, y: np.ndarray, top: np.ndarray | None = None, left: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Accumulated costs with the borders before the first row (from its corner on) and column; None: nothing comes from there.

    ``low`` and ``high`` bound the columns of each row that may be used."""
    n, m = len(x), len(y)
    p = np.full((n + 1, m + 1), np.inf)
    if top is not None:
        p[0] = top
    if left is not None:
        p[1:, 0] = left
    cost = np.abs(x[:, None] - y[None, :])
    if low is not None:
        j = np.arange(m)
        cost[(j < low[:, None]) | (j > high[:, None])] = np.inf
    flat, c = p.ravel(), cost.ravel()
    for d in range(n + m - 1):
        i, k = max(0, d - m + 1), min(n - 1, d) + 1  # rows of this anti-diagonal
        at, many = (i + 1) * (m + 1) + d - i + 1, k - i
        cut = lambda a, start, step: a[start : start + (many - 1) * step + 1 : step] if step else a[start : start + 1]  # noqa: B023, E731
        best = np.minimum(np.minimum(cut(flat, at - m - 1, m), cut(flat, at - 1, m)), cut(flat, at - m - 2, m))
        best += cut(c, i * m + d - i, m - 1)
        cut(flat, at, m)[:] = best
    return p


def follow(p: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The path backwards from cell (i, j) of a tile: least and largest column of each row it visits (-1: none), and the cell
    before it (-1 is the border). Of equal costs, the row before goes first, then the column before."""
    n = len(p) - 1
    low, high = np.full(n, -1), np.full(n, -1)
    high[i] = j
    while i >= 0 and j >= 0:
        low[i] = j
        if high[i] < 0:
            high[i] = j
        up, back, both = p[i, j + 1], p[i + 1, j], p[i, j]
        if up <= back and up <= both:
            i -= 1
        elif back <= both:
            j -= 1
        else:
            i, j = i - 1, j - 1
    return low, high, i, j


def start_border(m: int) -> np.ndarray:
    """What stands before the first row of a whole matrix: its path begins in the corner."""
    return np.concatenate([[0.0], np.full(m, np.inf)])


def widened(low: np.ndarray, high: np.ndarray, radius: int, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each of n rows of a pair of twice the length, from the path's bounds."""
    c, last = np.arange(n) // 2, len(low) - 1
    return np.maximum(2 * (low[np.clip(c - radius, 0, last)] - radius), 0), np.minimum(2 * (high[np.minimum(c + radius, last)] + radius) + 1, m - 1)


def halved(x: np.ndarray) -> np.ndarray:
    even = len(x) - len(x) % 2
    return (x[:even:2] + x[1:even:2]) / 2


def approximate(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Distance and path bounds of a pair that fits into one tile."""
    low = high = None
    if min(len(x), len(y)) >= radius + 2:
        _, a, b = approximate(halved(x), halved(y), radius)
        low, high = widened(a, b, radius, len(x), len(y))
    p = solve(x, y, start_border(len(y)), None, low, high)
    a, b, *_ = follow(p, len(x) - 1, len(y) - 1)
    return float(p[-1, -1]), a, b


def _array(value) -> np.ndarray | None:
    return None if not value.is_valid else value.values.to_numpy(zero_copy_only=False)


def _cells(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The costs of row i's tile: columns x, y, top, left, low, high, first column of the tile."""
    x, y, top, left, low, high = (_array(batch.column(c)[i]) for c in ("x", "y", "top", "left", "low", "high"))
    if batch.column("I")[i].as_py() == 0 and batch.column("J")[i].as_py() == 0:
        top = start_border(len(y))
    at = batch.column("J")[i].as_py() * len_of_tile(batch, i)
    return solve(x, y, top, left, None if low is None else low - at, None if high is None else high - at)


def len_of_tile(batch: pa.RecordBatch, i: int) -> int:
    return batch.column("size")[i].as_py()


def _solved(batches):
    for b in batches:
        bottom, right = [], []
        for i in range(b.num_rows):
            p = _cells(b, i)
            bottom.append(p[-1])
            right.append(p[1:, -1])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_k", "I", "J")), pa.array(bottom, pa.list_(pa.float64())), pa.array(right, pa.list_(pa.float64()))], names=["_k", "I", "J", "bottom", "right"])


def _followed(batches):
    for b in batches:
        lows, highs, nexts = [], [], []
        for k in range(b.num_rows):
            p, size = _cells(b, k), len_of_tile(b, k)
            low, high, i, j = follow(p, b.column("at_row")[k].as_py() % size, b.column("at_column")[k].as_py() % size)
            at = b.column("J")[k].as_py() * size
            lows.append(np.where(low < 0, -1, low + at))
            highs.append(np.where(high < 0, -1, high + at))
            nexts.append((b.column("I")[k].as_py() * size + i, at + j))
        ints = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_k", "I")), pa.array(lows, ints), pa.array(highs, ints), pa.array([x[0] for x in nexts], pa.int64()), pa.array([x[1] for x in nexts], pa.int64())], names=["_k", "I", "low", "high", "at_row", "at_column"])


class _Waves:
    """Rounds of tiles over pairs: xs (_k, I, x, low, high: bounds or null) and ys (_k, J, y)."""

    def __init__(self, tables: SharedTables, xs: DataFrame, ys: DataFrame, size: int, keep: bool):
        self.tables, self.xs, self.ys, self.size, self.keep = tables, xs, ys, size, keep
        ends = xs.groupBy("_k").agg(F.max("I").alias("nI")).join(ys.groupBy("_k").agg(F.max("J").alias("nJ")), "_k")
        first, last = F.coalesce(F.floor(F.array_min("low") / size), F.lit(0)), F.coalesce(F.floor(F.array_max("high") / size), F.col("nJ"))
        self.tiles = tables.put(xs.join(ends, "_k").select("_k", "I", first.cast("long").alias("a"), last.cast("long").alias("b"), "nI", "nJ"))
        self.kind = xs.schema["_k"]

    def _with_series(self, tiles: DataFrame) -> DataFrame:
        return tiles.join(self.xs, ["_k", "I"]).join(self.ys, ["_k", "J"]).withColumn("size", F.lit(self.size))

    def run(self) -> DataFrame:
        """(_k, distance); the borders that each tile started from stay, if kept."""
        none = F.lit(None).cast("array<double>")
        came = self.tiles.where("I = 0 and a = 0").select("_k", "I", F.lit(0).cast("long").alias("J"), none.alias("top"), none.alias("left"))
        done, self.borders, old = None, [], None
        rounds = self.tiles.agg(F.max(F.col("nI") + F.col("nJ"))).first()[0]
        spark = self.xs.sparkSession
        if rounds is None:
            return spark.createDataFrame([], StructType([self.kind, *StructType.fromDDL("distance double")]))
        for d in range(rounds + 1):
            out = StructType([self.kind, *StructType.fromDDL("I long, J long, bottom array<double>, right array<double>")])
            if self.keep:
                came = self.tables.put(came)
                self.borders.append(came)
            new = self.tables.put(self._with_series(came).mapInArrow(_solved, out))
            ends = new.join(self.tiles.select("_k", "I", "nI", "nJ"), ["_k", "I"]).where("I = nI and J = nJ").select("_k", F.element_at("right", -1).alias("distance"))
            ends = self.tables.put(ends)
            done = ends if done is None else done.union(ends)
            down = new.select("_k", (F.col("I") + 1).alias("I"), "J", F.col("bottom").alias("top"), none.alias("left"))
            side = new.select("_k", "I", (F.col("J") + 1).alias("J"), none.alias("top"), F.col("right").alias("left"))
            met = down.union(side).groupBy("_k", "I", "J").agg(F.first("top", True).alias("top"), F.first("left", True).alias("left"))
            came = met.join(self.tiles.select("_k", "I", "a", "b", "nJ"), ["_k", "I"]).where("J between a and b and J <= nJ").select("_k", "I", "J", "top", "left")
            if old is not None:
                self.tables.drop(old)
            old = new
        return done

    def paths(self) -> DataFrame:
        """(_k, row, low, high): the columns of each row that the best path visits."""
        borders = self.borders[0]
        for b in self.borders[1:]:
            borders = borders.union(b)
        x_end = self.xs.groupBy("_k").agg((F.max(F.col("I") * self.size + F.size("x")) - 1).alias("at_row"))
        at = x_end.join(self.ys.groupBy("_k").agg((F.max(F.col("J") * self.size + F.size("y")) - 1).alias("at_column")), "_k")
        out = StructType([self.kind, *StructType.fromDDL("I long, low array<long>, high array<long>, at_row long, at_column long")])
        rows = None
        while True:
            here = at.withColumn("I", F.floor(F.col("at_row") / self.size)).withColumn("J", F.floor(F.col("at_column") / self.size))
            step = self.tables.put(self._with_series(here.join(borders, ["_k", "I", "J"])).mapInArrow(_followed, out))
            if step.isEmpty():
                break
            part = step.select("_k", "I", F.posexplode(F.arrays_zip("low", "high")).alias("p", "x")).where("x.low >= 0").select("_k", (F.col("I") * self.size + F.col("p")).alias("row"), "x.low", "x.high")
            rows = part if rows is None else rows.union(part)
            at = step.where("at_row >= 0 and at_column >= 0").select("_k", "at_row", "at_column")
        return rows.groupBy("_k", "row").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def numbered(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(_k, i, v): the values of each series, numbered from 0 without gaps. Only block sizes meet in one task."""
    blocks = to_blocks(df, keys, order, value)
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = blocks.select("_k", "_b", F.coalesce(F.sum(F.size("_v")).over(before), F.lit(0)).alias("base"))
    return blocks.join(base, ["_k", "_b"]).select("_k", "base", F.posexplode("_v").alias("i", "v")).select("_k", (F.col("base") + F.col("i")).cast("long").alias("i"), "v")


def _tiled(rows: DataFrame, size: int, index: str, name: str, bounds: DataFrame | None = None) -> DataFrame:
    got = rows.join(bounds, ["_k", "i"]) if bounds is not None else rows.select("*", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    lists = got.groupBy("_k", F.floor(F.col("i") / size).cast("long").alias(index)).agg(F.array_sort(F.collect_list(F.struct("i", "v", "low", "high"))).alias("_x"))
    out = lists.select("_k", index, F.col("_x.v").alias(name), F.when(F.col("_x")[0]["low"].isNotNull(), F.col("_x.low")).alias("low"), F.when(F.col("_x")[0]["low"].isNotNull(), F.col("_x.high")).alias("high"))
    return out if name == "x" else out.drop("low", "high")


def _whole_pairs(radius: int):
    def work(batches):
        for b in batches:
            got = [approximate(_array(b.column("x")[i]), _array(b.column("y")[i]), radius) for i in range(b.num_rows)]
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], ints), pa.array([g[2] for g in got], ints)], names=["_k", "distance", "low", "high"])

    return work


def _coarse_to_fine(tables: SharedTables, x: DataFrame, y: DataFrame, radius: int, size: int, paths: bool) -> tuple[DataFrame, DataFrame | None]:
    """(_k, distance) and the paths' bounds by row of all pairs; pairs of at most a tile are solved where they are."""
    kind = x.schema["_k"]
    lengths = tables.put(x.groupBy("_k").agg((F.max("i") + 1).alias("n")).join(y.groupBy("_k").agg((F.max("i") + 1).alias("m")), "_k"))
    small, large = lengths.where((F.col("n") <= size) & (F.col("m") <= size)).select("_k"), lengths.where((F.col("n") > size) | (F.col("m") > size))
    tiled = _tiled(x.join(small, "_k"), size, "I", "x").join(_tiled(y.join(small, "_k"), size, "J", "y"), "_k").select("_k", "x", "y")
    out = tables.put(tiled.mapInArrow(_whole_pairs(radius), StructType([kind, *StructType.fromDDL("distance double, low array<long>, high array<long>")])))
    distance = out.select("_k", "distance")
    path = out.select("_k", F.posexplode(F.arrays_zip("low", "high")).alias("row", "x")).select("_k", F.col("row").cast("long").alias("row"), "x.low", "x.high")
    if large.isEmpty():
        return distance, path
    half = lambda d, n: d.join(large, "_k").where(F.col("i") < F.col(n) - F.col(n) % 2).groupBy("_k", F.floor(F.col("i") / 2).cast("long").alias("i")).agg(F.avg("v").alias("v"))
    _, coarse = _coarse_to_fine(tables, tables.put(half(x, "n")), tables.put(half(y, "m")), radius, size, True)
    near = coarse.select("_k", F.explode(F.sequence(F.col("row") - radius, F.col("row") + radius)).alias("c"), "low", "high").groupBy("_k", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    fine = near.select("_k", F.explode(F.array(2 * F.col("c"), 2 * F.col("c") + 1)).alias("i"), "low", "high").join(large, "_k").where("i >= 0 and i < n")
    bounds = fine.select("_k", "i", F.greatest(2 * (F.col("low") - radius), F.lit(0)).alias("low"), F.least(2 * (F.col("high") + radius) + 1, F.col("m") - 1).alias("high"))
    keys = large.select("_k")
    waves = _Waves(tables, tables.put(_tiled(x.join(keys, "_k"), size, "I", "x", bounds)), tables.put(_tiled(y.join(keys, "_k"), size, "J", "y")), size, paths)
    distance = distance.union(waves.run())
    return distance, path.union(waves.paths()) if paths else None


def dtw(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", order: str = "pos", radius: int | None = None, tile: int = TILE) -> DataFrame:
    """(keys, distance, n): the warping distance of each pair over its longer length.

    Exact if ``radius`` is None, else approximated from coarse to fine within that radius (1 or more). Missing values are dropped from
    their series; a pair with an empty series has no distance; ``order`` is a whole number."""
    ship(pairs.sparkSession)
    if radius is not None and radius < 1:
        raise ValueError("the radius is 1 or more")
    tables = SharedTables(pairs.sparkSession)
    xs, ys = tables.put(numbered(pairs, keys, order, x)), tables.put(numbered(pairs, keys, order, y))
    if radius is None:
        got = _Waves(tables, tables.put(_tiled(xs, tile, "I", "x")), tables.put(_tiled(ys, tile, "J", "y")), tile, False).run()
    else:
        got, _ = _coarse_to_fine(tables, xs, ys, radius, tile, False)
    k = F.struct(*[F.col(c) for c in keys]).alias("_k")
    sizes = pairs.groupBy(k).agg(F.greatest(F.count(x), F.count(y)).alias("n"))
    return sizes.join(got, "_k", "left").select("_k.*", (F.col("distance") / F.col("n")).alias("distance"), "n")
