"""Linear recurrences over long series: s' = A s + B x, y = C s + D x.

A series is cut into blocks. Each block runs the recurrence once from rest, which gives its own part of the state at its end; the states
at the block borders are composed over blocks (a few numbers each, folded in lists of at most ``FAN``, lists of lists above them), and every
block then runs from its true state. Within a block, ``STEP`` samples at a time are one matrix product, of all blocks of a batch that
have the same length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = 8192
FAN = 4096
STEP = 32
CELLS = 1 << 17  # samples that are run at once


@dataclass
class System:
    """A linear recurrence of k states with the matrices of STEP samples at once."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    def __post_init__(self):
        k = len(self.b)
        powers = [np.eye(k)]
        for _ in range(STEP):
            powers.append(powers[-1] @ self.a)
        self.step = powers[STEP]
        h = np.array([self.d, *(self.c @ powers[i] @ self.b for i in range(STEP - 1))])
        lag = np.arange(STEP)[:, None] - np.arange(STEP)[None, :]
        self.response = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0)  # outputs from inputs
        self.seen = np.stack([self.c @ powers[i] for i in range(STEP)])  # outputs from the state before
        self.gathered = np.stack([powers[STEP - 1 - i] @ self.b for i in range(STEP)], 1)  # state from inputs
        self.powers = powers

    def power(self, n: int) -> np.ndarray:
        """A to the n-th."""
        return np.linalg.matrix_power(self.step, n // STEP) @ self.powers[n % STEP]

    def steady(self) -> np.ndarray:
        """The state that a constant input of one keeps."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def run(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of a series of inputs from state s, and the state after them."""
        y, s = self.run_all(x[None], s[None])
        return y[0], s[0]

    def run_all(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many series of one length: rows of inputs, of states, and of outputs."""
        y = np.empty(x.shape)
        for i in range(0, x.shape[1], STEP):
            part = x[:, i : i + STEP]
            n = part.shape[1]
            y[:, i : i + n] = part @ self.response[:n, :n].T + s @ self.seen[:n].T
            s = s @ self.powers[n].T + part @ self.gathered[:, STEP - n :].T
        return y, s


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), pa.float64()))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and where each list begins (and the last one ends)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def listed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.ravel(), pa.float64()))


def alike(at: np.ndarray):
    """Lists of one length at a time, at most ``CELLS`` numbers or one list: their rows, and the places of their numbers (a row each)."""
    lengths = np.diff(at)
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        n = int(lengths[rows[0]]) if len(rows) else 0
        many = max(1, CELLS // max(n, 1))
        for i in range(0, len(rows), many):
            yield rows[i : i + many], at[rows[i : i + many], None] + np.arange(n)


def _ends(system: System):
    def work(batches):
        for b in batches:
            v, at = flat(b.column("_v"))
            z = np.zeros((b.num_rows, len(system.b)))
            for rows, cells in alike(at):
                z[rows] = system.run_all(v[cells], z[rows])[1]
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_b"), pa.array(np.diff(at)), listed(z, np.arange(b.num_rows + 1) * len(system.b))], names=["_k", "_b", "_n", "_z"])

    return work


def _composed(system: System):
    """A list of blocks as one: its samples and its own part of the state at its end."""

    def work(batches):
        for b in batches:
            n, z = [], []
            for blocks in b.column("_l").to_pylist():
                s = np.zeros(len(system.b))
                for x in blocks:
                    s = system.power(x["_n"]) @ s + x["_z"]
                n.append(sum(x["_n"] for x in blocks))
                z.append(s)
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_b"), pa.array(n, pa.int64()), _lists(z)], names=["_k", "_b", "_n", "_z"])

    return work


def _unfolded(system: System):
    """The state before each block of a list, from the state before the list."""

    def work(batches):
        for b in batches:
            of, block, states = [], [], []
            for i, (blocks, s) in enumerate(zip(b.column("_l").to_pylist(), b.column("_s").to_pylist(), strict=True)):
                s = np.asarray(s, float)
                for x in blocks:
                    of.append(i)
                    block.append(x["_b"])
                    states.append(s)
                    s = system.power(x["_n"]) @ s + x["_z"]
            yield pa.RecordBatch.from_arrays([b.column("_k").take(pa.array(of, pa.int64())), pa.array(block, pa.int64()), _lists(states)], names=["_k", "_b", "_s"])

    return work


def _starts(blocks: DataFrame, first: DataFrame, system: System, levels: int) -> DataFrame:
    """(_k, _b, _s): the state before every block, from the state before each series."""
    kind = blocks.schema["_k"]
    listed = lambda by: blocks.groupBy("_k", by.alias("_b")).agg(F.array_sort(F.collect_list(F.struct(F.col("_b"), F.col("_n"), F.col("_z")))).alias("_l"))
    out = StructType([kind, *StructType.fromDDL("_b long, _s array<double>")])
    if not levels:
        return listed(F.lit(0)).join(first, "_k").select("_k", "_l", "_s").mapInArrow(_unfolded(system), out)
    lists = listed(F.floor(F.col("_b") / FAN))
    above = lists.mapInArrow(_composed(system), StructType([kind, *StructType.fromDDL("_b long, _n long, _z array<double>")]))
    return lists.join(_starts(above, first, system, levels - 1), ["_k", "_b"]).select("_k", "_l", "_s").mapInArrow(_unfolded(system), out)


def _outputs(system: System):
    def work(batches):
        for b in batches:
            (v, at), s = flat(b.column("_v")), flat(b.column("_s"))[0].reshape(b.num_rows, -1)
            y = np.empty(len(v))
            for rows, cells in alike(at):
                y[cells] = system.run_all(v[cells], s[rows])[0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c not in ("_v", "_s")), listed(y, at)], names=[*(c for c in b.schema.names if c not in ("_v", "_s")), "_v"])

    return work


def recur(series: DataFrame, system: System, steady: bool = False, levels: int = 1) -> DataFrame:
    """Series in blocks (_k: a struct of keys, _b: their order, _v: values, none of them null) after the recurrence.

    A series starts from rest, or, if ``steady``, as if its first value had always been there. With ``levels`` = 1 the lists
    of borders hold at most FAN blocks, of FAN * BLOCK samples; other columns stay."""
    ends = series.select("_k", "_b", "_v").mapInArrow(_ends(system), StructType([series.schema["_k"], *StructType.fromDDL("_b long, _n long, _z array<double>")]))
    x0 = F.min_by(F.col("_v")[0], "_b") if steady else F.lit(0.0)
    first = series.groupBy("_k").agg(x0.alias("_x")).select("_k", F.array(*[F.col("_x") * float(v) for v in system.steady()]).alias("_s"))
    joined = series.join(_starts(ends, first, system, levels), ["_k", "_b"])
    rest = [f for f in series.schema if f.name != "_v"]
    return joined.select(*[f.name for f in rest], "_v", "_s").mapInArrow(_outputs(system), StructType([*rest, series.schema["_v"]]))


def to_blocks(df: DataFrame, keys: list[str], order: str, value: str | Column, size: int = BLOCK) -> DataFrame:
    """Rows with a value as blocks of neighbouring positions: _k, _b, _p (positions) and _v (values), in order.

    ``order`` is a whole number; a block spans ``size`` positions, so no series is sorted in one task."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    k = F.struct(*[F.col(c) for c in keys]).alias("_k")
    got = df.select(k, F.floor(F.col(order) / size).cast("long").alias("_b"), F.struct(F.col(order).cast("long").alias("p"), v.alias("v")).alias("_x")).where("_x.v is not null and _x.p is not null")
    lists = got.groupBy("_k", "_b").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    return lists.select("_k", "_b", F.col("_x.p").alias("_p"), F.col("_x.v").alias("_v"))
