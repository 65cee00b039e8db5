"""Unit-root statistics with lags chosen by an information criterion, and KPSS with an automatic bandwidth.

A series is numbered without gaps and cut into blocks that know the last values before them. Each block adds up the products of all
columns of the regression with the most lags; their sums (one small matrix a series) hold every shorter regression as a leading part,
so one Cholesky factor gives the residuals of all lags. The chosen regression is then solved on all rows that it has.

Break dates (Zivot-Andrews) are one more column each: a block knows the column sums after its end, and all of its breaks are solved
from the inverse of the regression without a break. Series of one key are never brought into one task.
"""

from __future__ import annotations

import copy
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shared import SharedTables
from ..functions.ship import ship
from .warping import numbered

BLOCK = 8192
GLS = -7.0  # fixed value: the local alternative of the demeaned test
ALONE = "size(v) = n"  # a block that is all of its series
BANDWIDTH = 1.1447  # fixed value: of the Bartlett kernel


def most_lags(n: int, trends: int) -> int:
    """The lags that a series of n values is searched up to."""
    return max(min(math.ceil(12 * (n / 100) ** 0.25), max((n - 1) // 2 - 1, 0) - trends), 0)


def columns(y: np.ndarray, lags: int) -> np.ndarray:
    """Rows of the regression that have all lags: constant, level before, lagged differences, difference."""
    dy = np.diff(y)
    n = len(dy) - lags
    if n <= 0:
        return np.zeros((0, lags + 3))
    return np.stack([np.ones(n), y[lags:-1], *(dy[lags - j : len(dy) - j] for j in range(1, lags + 1)), dy[lags:]], 1)


_places = functools.lru_cache(256)(np.triu_indices)


def _upper(m: np.ndarray) -> np.ndarray:
    return m[_places(len(m))]


def _square(cells: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[_places(k)] = cells
    return m + np.triu(m, 1).T


def _lists(arrays) -> pa.Array:
    return pa.array([np.asarray(a, float) for a in arrays], pa.list_(pa.float64()))


def _array(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0)


def _regressors(batch: pa.RecordBatch, i: int, lags: int) -> np.ndarray:
    """Rows of a block: constant, trend (a share of the series), level, lagged differences, difference; the series is centred."""
    n, mean, first = (batch.column(c)[i].as_py() for c in ("n", "mean", "first"))
    before, v = _array(batch.column("before")[i])[-(lags + 1) :], _array(batch.column("v")[i])
    x = columns(np.concatenate([before, v]) - mean, lags)
    t = (first - len(before) + lags + 1 + np.arange(len(x))) / n
    return np.insert(x, 1, t, 1)


def _products(batches):
    for b in batches:
        out = []
        for i in range(b.num_rows):
            x = _regressors(b, i, most_lags(b.column("n")[i].as_py(), 1))
            out.append(_upper(x.T @ x))
        yield pa.RecordBatch.from_arrays([b.column("_k"), _lists(out)], names=["_k", "cells"])


def choose(m: np.ndarray, lead: list[int], lags: int, n: int) -> int:
    """The number of lags with the least Akaike criterion. m: products of columns (leading ones, all lags, the difference)."""
    at = [*lead, *range(3, 3 + lags), len(m) - 1]
    try:
        root = np.linalg.cholesky(m[np.ix_(at, at)])
    except np.linalg.LinAlgError:
        return 0
    z = root[-1]
    left = z[-1] ** 2 + np.concatenate([np.cumsum(z[len(lead) : -1][::-1] ** 2)[::-1], [0.0]])
    return int(np.argmin(n * np.log(np.maximum(left, 1e-300) / n) + 2 * np.arange(lags + 1)))


def t_value(m: np.ndarray, k: int, n: int) -> float:
    """t of coefficient k, from the products of the columns and (last) the explained one."""
    try:
        inverse = np.linalg.inv(m[:-1, :-1])
    except np.linalg.LinAlgError:
        return float("nan")
    beta = inverse @ m[:-1, -1]
    s2 = (m[-1, -1] - beta @ m[:-1, -1]) / (n - len(beta)) if n > len(beta) else 0
    return float(beta[k] / math.sqrt(s2 * inverse[k, k])) if s2 > 1e-12 * max(m[-1, -1], 1e-300) and inverse[k, k] > 0 else float("nan")


def _final(m: np.ndarray, head: np.ndarray, n: int, most: int, lags: int) -> np.ndarray:
    """Products of the regression with fewer lags, on all of its rows: those of the common sample and the early ones."""
    at = [*range(3 + lags), len(m) - 1]
    early = columns(head[: most + 1], lags)  # rows that lack some of the most lags
    early = np.insert(early, 1, (lags + 1 + np.arange(len(early))) / n, 1)
    return m[np.ix_(at, at)] + early.T @ early


def _solved(batches):
    """Statistics of a series from its products and its head."""
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            n, mean = b.column("n")[i].as_py(), b.column("mean")[i].as_py()
            most = most_lags(n, 1)
            m = _square(_array(b.column("cells")[i]), most + 4)
            head = _array(b.column("head")[i]) - mean
            common = n - 1 - most
            lags = choose(m, [0, 2], most, common)
            f = _final(m, head, n, most, lags)
            keep = [0, *range(2, len(f))]
            adf = t_value(f[np.ix_(keep, keep)], 1, n - 1 - lags)
            a = 1 + GLS / n
            first, last, total = head[0], b.column("last")[i].as_py() - mean, 0.0  # the centred values sum to nothing
            beta = (first + (1 - a) * ((total - first) - a * (total - last))) / (1 + (n - 1) * (1 - a) ** 2)
            g = m.copy()  # level less beta: a change of columns
            g[2] -= beta * m[0]
            g[:, 2] -= beta * g[:, 0]
            gls_lags = choose(g, [2], most, common)
            f = _final(g, head - beta, n, most, gls_lags)
            keep = list(range(2, len(f)))
            gls = t_value(f[np.ix_(keep, keep)], 0, n - 1 - gls_lags)
            fewer = most_lags(n, 2)
            za_lags = choose(_final(m, head, n, most, fewer), [0, 1, 2], fewer, n - 1 - fewer)
            rows.append((adf, lags, gls, gls_lags, za_lags))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("n"), *(pa.array(c, pa.float64() if j in (0, 2) else pa.int64()) for j, c in enumerate(cols))], names=["_k", "n", "adf", "adf_lags", "dfgls", "dfgls_lags", "za_lags"])


class _Series:
    """Blocks of all series, with n, mean and the last values before each block (``back`` of them)."""

    def __init__(self, df: DataFrame, keys: list[str], value: str, order: str, back: int | None = None, size: int = BLOCK):
        ship(df.sparkSession)
        self.tables = SharedTables(df.sparkSession)
        rows = self.tables.put(numbered(df, keys, order, value))
        self.sizes = rows.groupBy("_k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max_by("v", "i").alias("last"))
        lists = rows.groupBy("_k", F.floor(F.col("i") / size).cast("long").alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
        blocks = self.tables.put(lists.select("_k", "b", F.col("x.v").alias("v")))
        keep = F.least(F.size("v"), F.lit(back or size // 2))
        tails = blocks.select("_k", (F.col("b") + 1).alias("b"), F.slice("v", F.size("v") - keep + 1, keep).alias("before"))
        self.blocks = self.tables.put(blocks.join(tails, ["_k", "b"], "left").join(self.sizes, "_k").withColumn("first", F.col("b") * size))
        self.kind = rows.schema["_k"]
        self._solved = None

    def having(self, blocks: DataFrame) -> _Series:
        """The same series with other columns beside their blocks."""
        out = copy.copy(self)
        out.blocks = blocks
        return out

    def statistics(self) -> DataFrame:
        """The statistics of all series that have more than 8 values, solved once."""
        if self._solved is None:
            self._solved = _statistics(self)
        return self._solved

    def schema(self, ddl: str) -> StructType:
        return StructType([self.kind, *StructType.fromDDL(ddl)])

    def summed(self, work) -> DataFrame:
        """(_k, cells): element-wise sums of what each block yields. A block that is all of its series is its own sum."""
        yields = lambda blocks: blocks.mapInArrow(work, self.schema("cells array<double>"))
        whole = yields(self.blocks.where(ALONE))
        many = self.blocks.where(f"not ({ALONE})")
        if many.isEmpty():
            return whole
        each = yields(many).select("_k", F.posexplode("cells").alias("p", "c"))
        cells = each.groupBy("_k", "p").agg(F.sum("c").alias("c")).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("x"))
        return whole.union(cells.select("_k", F.col("x.c").alias("cells")))


def _statistics(s: _Series) -> DataFrame:
    head = s.blocks.where("b = 0").select("_k", "n", "mean", "last", F.slice("v", 1, BLOCK // 2).alias("head")).where("n > 8")
    got = head.join(s.summed(_products), "_k").mapInArrow(_solved, s.schema("n long, adf double, adf_lags long, dfgls double, dfgls_lags long, za_lags long"))
    return s.tables.put(got)


def _real(c: str):
    return F.when(~F.isnan(c), F.col(c)).alias(c)


def shared(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos") -> _Series:
    """The series of df in blocks, for several of the statistics below (``series``)."""
    return _Series(df, keys, value, order)


def adf(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos", series: _Series | None = None) -> DataFrame:
    """Augmented Dickey-Fuller t (constant) with lags by Akaike's criterion on the rows that have all lags; series of more than 8 values."""
    return (series or _Series(df, keys, value, order)).statistics().select("_k.*", _real("adf"), F.col("adf_lags").alias("lags"), "n")


def dfgls(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos", series: _Series | None = None) -> DataFrame:
    """The same without constant on the series demeaned by generalised least squares."""
    return (series or _Series(df, keys, value, order)).statistics().select("_k.*", _real("dfgls"), F.col("dfgls_lags").alias("lags"), "n")


def _column_sums(batches):
    for b in batches:
        out = [_regressors(b, i, b.column("lags")[i].as_py()).sum(0) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("b"), _lists(out)], names=["_k", "b", "sums"])


def _break_products(batches):
    for b in batches:
        out = []
        for i in range(b.num_rows):
            x = _regressors(b, i, b.column("lags")[i].as_py())
            out.append(_upper(x.T @ x))
        yield pa.RecordBatch.from_arrays([b.column("_k"), _lists(out)], names=["_k", "cells"])


def _breaks(trim: float):
    def work(batches):
        for b in batches:
            best, where = [], []
            for i in range(b.num_rows):
                n, lags = b.column("n")[i].as_py(), b.column("lags")[i].as_py()
                x = _regressors(b, i, lags)
                m = _square(_array(b.column("cells")[i]), lags + 4)
                after = x.sum(0) - x.cumsum(0)  # column sums of the rows after each row
                if b.column("after")[i].is_valid:
                    after += _array(b.column("after")[i])
                place = np.rint(x[:, 1] * n).astype(np.int64) + 1  # of the row in the series, from 1
                use = (place >= math.floor(trim * n)) & (place <= math.floor((1 - trim) * n))
                try:
                    inverse = np.linalg.inv(m[:-1, :-1])
                except np.linalg.LinAlgError:
                    use[:] = False
                if not use.any():
                    best.append(None)
                    where.append(None)
                    continue
                d, count, dy = after[use, :-1], after[use, 0], after[use, -1]
                beta = inverse @ m[:-1, -1]
                turned = d @ inverse
                own = count - (turned * d).sum(1)  # what the break column adds
                free = own > 1e-9 * np.maximum(count, 1)
                own = np.where(free, own, 1.0)
                shift = (dy - d @ beta) / own
                rest = m[-1, -1] - beta @ m[:-1, -1] - shift**2 * own
                rows = n - 1 - lags
                s2 = rest / (rows - len(beta) - 1) if rows > len(beta) + 1 else np.zeros(len(rest))
                level = beta[2] - turned[:, 2] * shift
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(free & (s2 > 1e-12 * m[-1, -1]), level / np.sqrt(s2 * (inverse[2, 2] + turned[:, 2] ** 2 / own)), np.nan)
                if np.isnan(t).all():
                    best.append(None)
                    where.append(None)
                else:
                    k = int(np.nanargmin(t))
                    best.append(float(t[k]))
                    where.append(float(place[use][k]) / n)
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(best, pa.float64()), pa.array(where, pa.float64())], names=["_k", "za", "break_share"])

    return work


def zivot_andrews(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos", trim: float = 0.15, lags: int | None = None, series: _Series | None = None) -> DataFrame:
    """Least Dickey-Fuller t (constant and trend) over all break dates within ``trim`` of the ends, with a shift of level.

    Lags (None) are those that Akaike's criterion chooses without a break."""
    s = series or _Series(df, keys, value, order)
    chosen = s.statistics().select("_k", "za_lags") if lags is None else s.sizes.where("n > 8").select("_k", F.lit(lags).cast("long").alias("za_lags"))
    own = s.having(s.tables.put(s.blocks.join(chosen.select("_k", F.coalesce("za_lags", F.lit(0)).alias("lags")), "_k")))
    several = own.blocks.where(f"not ({ALONE})")  # nothing stands after the block of a series that has one
    sums = own.tables.put(several.mapInArrow(_column_sums, own.schema("b long, sums array<double>")).select("_k", "b", F.posexplode("sums").alias("p", "c")))
    later = W.partitionBy("_k", "p").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    after = sums.select("_k", "b", "p", F.coalesce(F.sum("c").over(later), F.lit(0.0)).alias("c")).groupBy("_k", "b").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("x")).select("_k", "b", F.col("x.c").alias("after"))
    got = own.blocks.join(own.summed(_break_products), "_k").join(after, ["_k", "b"], "left").mapInArrow(_breaks(trim), own.schema("za double, break_share double"))
    best = got.where("za is not null").groupBy("_k").agg(F.min("za").alias("za"), F.min_by("break_share", "za").alias("break_share"))
    return best.join(own.blocks.where("b = 0").select("_k", "n", "lags"), "_k").select("_k.*", "za", "break_share", "lags", "n")


def _autocovariances(lags: str):
    """Products of residuals with those up to ``lags`` (a column) before, and the squared partial sums are left to others."""

    def work(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                mean, k = b.column("mean")[i].as_py(), b.column(lags)[i].as_py()
                v = _array(b.column("v")[i]) - mean
                before = _array(b.column("before")[i])[max(0, len(_array(b.column("before")[i])) - k) :] - mean
                e = np.concatenate([before, v])
                out.append([float(v[max(0, j - len(before)) :] @ e[max(0, len(before) - j) : len(e) - j]) if j < len(e) else 0.0 for j in range(k + 1)])
            yield pa.RecordBatch.from_arrays([b.column("_k"), _lists(out)], names=["_k", "cells"])

    return work


def kpss_auto(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos", series: _Series | None = None) -> DataFrame:
    """Level-stationarity statistic with Bartlett weights over an automatic bandwidth (from the first n^(2/9) autocovariances)."""
    s = series or _Series(df, keys, value, order)
    short = F.floor(F.pow(F.col("n").cast("double"), F.lit(2.0 / 9.0)) + 1e-12).cast("long")
    first = s.having(s.blocks.withColumn("k", short)).summed(_autocovariances("k")).join(s.sizes, "_k")
    g = lambda i: F.col("cells")[i]
    twice = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: 2 * c / F.col("n"))
    s0 = g(0) / F.col("n") + F.aggregate(twice, F.lit(0.0), lambda a, c: a + c)
    s1 = F.aggregate(F.transform(twice, lambda c, i: (i + 1) * c), F.lit(0.0), lambda a, c: a + c)
    third = F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))
    ratio = s1 / s0
    lags = F.least(F.col("n") - 1, F.floor(BANDWIDTH * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * third + 1e-9)).cast("long")
    width = s.tables.put(first.where(s0 > 0).select("_k", lags.alias("lags")))  # no bandwidth without a positive variance
    most = width.agg(F.max("lags")).first()[0]
    wide = s if most is None or most <= BLOCK // 2 else _Series(df, keys, value, order, most, most + 1)  # a block reaches back one block
    wide = wide.having(wide.blocks.join(width, "_k"))
    cov = wide.summed(_autocovariances("lags"))
    sums = wide.blocks.select("_k", "b", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("s"), "mean", F.size("v").alias("m"))
    before = W.partitionBy("_k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    start = sums.select("_k", "b", F.coalesce(F.sum(F.col("s") - F.col("m") * F.col("mean")).over(before), F.lit(0.0)).alias("start"))
    running = wide.blocks.join(start, ["_k", "b"])
    zero = F.struct(F.col("start").alias("at"), F.lit(0.0).alias("ss"))
    square = F.aggregate("v", zero, lambda a, x: F.struct((a["at"] + x - F.col("mean")).alias("at"), (a["ss"] + (a["at"] + x - F.col("mean")) * (a["at"] + x - F.col("mean"))).alias("ss")))["ss"]
    total = running.select("_k", square.alias("ss")).groupBy("_k").agg(F.sum("ss").alias("ss"))
    both = cov.join(total, "_k").join(s.sizes, "_k").join(width, "_k")
    weights = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c, i: 2 * (1 - (i + 1) / (F.col("lags") + 1.0)) * c)
    lam = (g(0) + F.aggregate(weights, F.lit(0.0), lambda a, c: a + c)) / F.col("n")
    return both.select("_k.*", (F.col("ss") / (F.col("n") * F.col("n")) / F.nullif(lam, F.lit(0.0))).alias("kpss"), "lags", "n")
