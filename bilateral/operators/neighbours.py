"""Nearest neighbours and discriminants of vectors.

Neighbours are exact. Training rows are dealt to the cells of a few pivots; a query's own cell gives a first bound of its k-th distance,
and the triangle inequality then says which cells can hold anything nearer. Cells are cut into blocks and the queries of a cell into
packs, and ``ASIDE`` packs meet ``ABOVE`` blocks of a cell in one task, so a cell of many rows (copies, a hot group) is many tasks'
work. A pack meets a block as one product of matrices, which bounds all distances; those of the rows that may be among the k least are
taken exactly, and only the k least a query go on.

Discriminants need the sums of vectors and of their products by class: one aggregate of small matrices, added up in each task first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shared import SharedTables
from ..functions.ship import ship

PIVOTS = 64
BLOCK = 1024  # training rows of a block
PACK = 256  # queries of a pack
ASIDE = 16  # packs of a cell that meet the same blocks in one task
ABOVE = 4  # blocks of a cell that meet the same packs in one task


def _matrix(column, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, from differences (the difference of large squares would lose small distances)."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i : i + 1] - b[None, :, i]
        out += d * d
    return np.sqrt(out)


def near_rows(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance): the k least of each row of a, of equal distances those with lower ids."""
    if len(b) <= k:
        d = distances(a, b)
        return np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)), d.ravel()
    middle = b.mean(0)
    p, q = a - middle, b - middle
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    square = pp[:, None] + qq - 2 * (p @ q.T)
    # rounding of centring, product and sums, far above their worst case
    slack = 1e-14 * (a.shape[1] + 16) * (pp + qq.max() + (a * a).sum(1) + (b * b).sum(1).max())
    least = np.partition(square, k - 1, axis=1)[:, k - 1]
    with np.errstate(invalid="ignore"):
        of, at = np.nonzero(~(square > (least + 2 * slack)[:, None]))
    total = np.zeros(len(of))
    for i in range(a.shape[1]):
        d = a[of, i] - b[at, i]
        total += d * d
    total = np.sqrt(total)
    order = np.lexsort((ids[at], total, of))
    of, at, total = of[order], at[order], total[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    return of[rank < k], at[rank < k], total[rank < k]


def _nearest(pivots: np.ndarray):
    def work(batches):
        for b in batches:
            d = distances(_matrix(b.column("x"), pivots.shape[1]), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "away"])

    return work


def _asked(pivots: np.ndarray, radius: np.ndarray):
    """The cells that may hold something within a query's bound."""

    def work(batches):
        for b in batches:
            d = distances(_matrix(b.column("x"), pivots.shape[1]), pivots)
            bound = b.column("bound").to_numpy(zero_copy_only=False).astype(float)
            bound = np.where(np.isnan(bound), np.inf, bound) * (1 + 1e-9)
            # a row of cell p is at least d(q, p) - radius(p) away, and by the bisecting plane of its pivot and the query's nearest (d(q, p) - d(q, nearest)) / 2
            near = (d - radius <= bound[:, None]) & ((d - d.min(1, keepdims=True)) / 2 <= bound[:, None]) & (radius >= 0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array([np.flatnonzero(r) for r in near], pa.list_(pa.int64()))], names=["id", "x", "cells"])

    return work


def _met(width: int, k: int):
    def work(batches):
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i in range(b.num_rows):
                q, t = b.column("queries")[i].values, b.column("rows")[i].values
                ids, labels, asked = t.field("id").to_numpy(), t.field("y").to_numpy(zero_copy_only=False), q.field("id").to_numpy()
                of, at, d = near_rows(_matrix(q.field("x"), width), _matrix(t.field("x"), width), ids, k)
                out.append((asked[of], d, ids[at], labels[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "distance", "neighbour", "y"])

    return work


def _pairs(queries: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """The k nearest of every met block for each (id, x, cell) of queries."""
    # packs are dealt to sides and blocks to floors: a task has one side and one floor of a cell
    each = queries.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PACK)).cast("long").alias("packs"))
    floors = F.floor(F.col("block") / ABOVE).cast("long")
    floor = blocks.select("cell", "block", "rows", floors.alias("floor"))
    high = floor.groupBy("cell").agg(F.max("floor").alias("high"))
    sides = each.select("cell", F.floor((F.col("packs") - 1) / ASIDE).cast("long").alias("wide"))  # at most a row a pivot, as all below that are broadcast
    packs = queries.join(F.broadcast(each), "cell").withColumn("pack", F.pmod(F.xxhash64("id"), "packs"))
    packs = packs.groupBy("cell", "pack").agg(F.collect_list(F.struct("id", "x")).alias("queries"))
    packs = packs.withColumn("side", F.floor(F.col("pack") / ASIDE).cast("long")).join(F.broadcast(high), "cell").withColumn("floor", F.explode(F.sequence(F.lit(0).cast("long"), "high")))
    floor = floor.join(F.broadcast(sides), "cell").withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), "wide")))
    met = packs.select("cell", "side", "floor", "queries").join(floor.select("cell", "side", "floor", "rows"), ["cell", "side", "floor"])
    return met.select("queries", "rows").mapInArrow(_met(width, k), "id long, distance double, neighbour long, y long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(id, near): the k nearest of each query; of equal distances those with lower ids."""
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour", "y"))).alias("near"))
    return listed.select("id", F.slice("near", 1, k).alias("near"))


def nearest(train: DataFrame, test: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(id, near): for each row of test (id, x) its k nearest of train (id, x, y) as structs (distance, neighbour, y), nearest first.

    Ids are whole numbers and differ; vectors have one length. Fewer training rows than k are all returned."""
    ship(train.sparkSession)
    tables = SharedTables(train.sparkSession)
    x = F.transform("x", lambda v: v.cast("double")).alias("x")
    train, test = train.select("id", x, F.col("y").cast("long").alias("y")), test.select("id", x)
    # pivots: the training rows with the least hashes
    chosen = train.orderBy(F.xxhash64("id"), "id").limit(pivots).select("x").toArrow()
    if not chosen.num_rows:
        return test.select("id", F.lit(None).cast("array<struct<distance: double, neighbour: bigint, y: bigint>>").alias("near"))
    width = len(chosen.column("x")[0])
    at = np.unique(_matrix(chosen.column("x"), width), axis=0)
    kind = lambda df, more: StructType([*df.schema, *StructType.fromDDL(more)])
    placed = tables.put(train.mapInArrow(_nearest(at), kind(train, "cell long, away double")))
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # at most a row a pivot
    radius = np.array([cells[c].radius if c in cells else -1.0 for c in range(len(at))])
    cuts = train.sparkSession.createDataFrame([(c, max(1, -(-r.n // BLOCK))) for c, r in cells.items()], "cell long, cuts long")
    cut = placed.join(F.broadcast(cuts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")))
    blocks = tables.put(cut.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "x", "y")).alias("rows")))
    near = tables.put(test.mapInArrow(_nearest(at), kind(test, "cell long, away double")).select("id", "x", "cell"))
    first = _best(_pairs(near, blocks.where("block = 0"), width, k), k)
    bound = first.select("id", F.when(F.size("near") == k, F.element_at("near", -1)["distance"]).alias("bound"))
    ready = near.join(bound, "id", "left").select("id", "x", "bound")
    asked = ready.mapInArrow(_asked(at, radius), "id long, x array<double>, cells array<long>")
    asked = tables.put(asked.select("id", "x", F.explode("cells").alias("cell")))
    return _best(_pairs(asked, blocks, width, k), k)


def vote(near: DataFrame) -> DataFrame:
    """(id, prediction): the most frequent label of the neighbours, the lowest of equals."""
    each = near.select("id", F.explode("near").alias("n")).groupBy("id", F.col("n.y").alias("y")).agg(F.count("*").alias("c"))
    return each.groupBy("id").agg(F.max(F.struct("c", (-F.col("y")).alias("y")))["y"].alias("y")).select("id", (-F.col("y")).cast("double").alias("prediction"))


def _moments(batches):
    held: dict[int, list] = {}
    for b in batches:
        if not b.num_rows:
            continue
        x, y = _matrix(b.column("x"), len(b.column("x")[0])), b.column("y").to_numpy()
        for c in np.unique(y):
            own = x[y == c]
            n, s, m = held.get(int(c), (0, 0.0, 0.0))
            held[int(c)] = [n + len(own), s + own.sum(0), m + own.T @ own]
    for c, (n, s, m) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([float(n)]), pa.array([np.concatenate([s, m.ravel()])], pa.list_(pa.float64()))], names=["y", "n", "sums"])


def moments(train: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By class: rows, mean and covariance (population) of the vectors x."""
    ship(train.sparkSession)
    parts = train.select("y", F.transform("x", lambda v: v.cast("double")).alias("x")).mapInArrow(_moments, "y long, n double, sums array<double>")
    sums = parts.select("y", "n", F.posexplode("sums").alias("p", "v")).groupBy("y", "p").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    out = {}
    for r in sums.groupBy("y").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "v"))).alias("s")).collect():  # a row a class
        v = np.array([q["v"] for q in r.s])
        d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
        mean = v[:d] / r.n
        out[r.y] = (r.n, mean, v[d:].reshape(d, d) / r.n - np.outer(mean, mean))
    return out


def discriminant(train: DataFrame, test: DataFrame, own: bool = False, ridge: float = 1e-9) -> DataFrame:
    """(id, prediction) by linear (pooled covariance) or, with ``own``, quadratic discriminants (a covariance for each class)."""
    found = moments(train)
    total = sum(n for n, _, _ in found.values())
    pooled = sum(n * c for n, _, c in found.values()) / total if found else 0
    rules = []
    for y, (n, mean, cov) in sorted(found.items()):
        c = cov * n / max(n - 1, 1) if own else pooled
        root = np.linalg.cholesky(c + ridge * max(np.trace(c) / len(c), 1e-300) * np.eye(len(c)))
        rules.append((y, mean, np.linalg.inv(root), 2 * np.log(n / total) - 2 * np.log(np.diag(root)).sum()))

    def work(batches):
        for b in batches:
            x = _matrix(b.column("x"), len(rules[0][1]))
            values = np.stack([const - (((x - mean) @ inverse.T) ** 2).sum(1) for _, mean, inverse, const in rules], 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array([float(r[0]) for r in rules])[values.argmax(1)])], names=["id", "prediction"])

    if not rules:
        return test.select("id", F.lit(None).cast("double").alias("prediction"))
    return test.select("id", F.transform("x", lambda v: v.cast("double")).alias("x")).mapInArrow(work, StructType([test.schema["id"], *StructType.fromDDL("prediction double")]))
