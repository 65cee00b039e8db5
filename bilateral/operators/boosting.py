"""Gradient-boosted trees for many fits at once: histograms by (fit, node, feature, bin).

A *fit* is one model to train: rows of one split (without one inner fold, perhaps), a point of the search space and a seed.
All fits of a rung grow together, so the number of jobs depends on rounds and depth, never on the number of fits.

* Rows are binned once and packed into blocks of at most ``BLOCK`` rows; a unit of work is a block and a chunk of fits, with the
  margins that these fits have given its rows so far.
* A level of all trees is one pass over the units: each task adds up gradients and Hessians of its rows by (fit, node, feature, bin),
  the sums of a node meet in one small group, which chooses its split. The splits (a few numbers a node) go through the driver to
  the next pass; margins are written at the end of each round, so no lineage grows.
* Up to ``WHOLE`` rows, fits are dealt instead: a task gets some fits of one cell (a split without an inner fold, a seed and a share) and
  the rows that these train and are scored on, no others, and grows their trees to the end. The rows of a node stay together, the
  smaller child of a split is counted and the larger is what remains, and large nodes count bins by pairs of features.
  Both ways make the same trees.

Trees are fitted to the logistic loss by second-order gains with a ridge of ``RIDGE``; missing values go to the highest bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import SharedTables
from ..functions.ship import ship

BLOCK = 4096
WHOLE = 1 << 20  # rows up to which the rows of a fit (a byte for each feature) may be one task's: a level of all trees need not be a job then
PAIRED = 1024  # rows of a node from which bins are counted by pairs of features
CHUNK = 64  # fits of a unit at most
BINS = 32
RIDGE = 1.0
CELLS = 1 << 21  # histogram entries that a task adds up at once
UNUSED, TEST = -2, -1  # parts of a split; 0 and up are its inner folds


@dataclass
class Fits:
    """Parameters of fits as columns: split, inner (fold left out for validation, -1: none), share of the training rows, seed, and the
    point searched. ``features`` may name the features that a split may use."""

    table: pd.DataFrame  # split, inner, share, seed, rounds, rate, depth, least_weight, subsample
    features: dict[int, list[int]] = field(default_factory=dict)

    def chunk(self, k: int, size: int) -> pd.DataFrame:
        return self.table.iloc[k * size : (k + 1) * size]


def unit_hash(ids: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) for each seed and id."""
    h = ids.astype(np.uint64)[None, :] + (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return (h ^ h >> np.uint64(31)).astype(np.float64) / 2.0**64


@dataclass
class Block:
    ids: np.ndarray
    bins: np.ndarray  # rows x features
    y: np.ndarray
    parts: np.ndarray  # rows x splits

    def used(self, fits: pd.DataFrame, training: bool) -> np.ndarray:
        """fits x rows: which rows a fit trains on, or (``training`` False) is scored on."""
        part, inner = self.parts[:, fits["split"].to_numpy()].T, fits["inner"].to_numpy()[:, None]
        if not training:
            return np.where(inner < 0, part == TEST, part == inner)
        chosen = unit_hash(self.ids, fits["seed"].to_numpy()) < fits["share"].to_numpy()[:, None]
        return (part >= 0) & (part != inner) & chosen


class Trees:
    """One tree of each fit of a chunk: split feature (-1: leaf), bin and value of the nodes of complete trees, and gains by feature."""

    def __init__(self, fits: int, depth: int):
        nodes = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature, self.bin, self.value = np.full((fits, nodes), -1, np.int16), np.zeros((fits, nodes), np.uint8), np.zeros((fits, nodes), np.float32)

    def walk(self, bins: np.ndarray, fit: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The node in which each (fit, row) stands."""
        node = np.zeros(len(fit), np.int64)
        for _ in range(self.depth):
            f = self.feature[fit, node]
            down = f >= 0
            if not down.any():
                break
            node = np.where(down, 2 * node + 1 + (bins[row, np.maximum(f, 0)] > self.bin[fit, node]), node)
        return node

    def apply(self, splits: dict[str, np.ndarray], rate: np.ndarray) -> None:
        """Enters the splits of a level, and the values of the nodes and their children."""
        f, n, good = splits["fit"], splits["node"], splits["feature"] >= 0
        self.value[f, n] = -rate[f] * splits["g"] / (splits["h"] + RIDGE)
        f, n = f[good], n[good]
        self.feature[f, n], self.bin[f, n] = splits["feature"][good], splits["bin"][good]
        for child, g, h in ((2 * n + 1, splits["gl"][good], splits["hl"][good]), (2 * n + 2, (splits["g"] - splits["gl"])[good], (splits["h"] - splits["hl"])[good])):
            self.value[f, child] = -rate[f] * g / (h + RIDGE)


def level_sums(block: Block, fits: pd.DataFrame, margins: np.ndarray, trees: Trees, level: int, rnd: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fit, node, gradients, Hessians) of the nodes of a level that hold rows; sums are by feature and bin."""
    use = block.used(fits, True)
    sub = fits["subsample"].to_numpy()
    if (sub < 1).any():
        use &= unit_hash(block.ids, fits["seed"].to_numpy() * 1_000_003 + rnd + 1) < sub[:, None]
    use &= ((fits["depth"].to_numpy() > level) & (fits["rounds"].to_numpy() > rnd))[:, None]
    fit, row = np.nonzero(use)
    node = trees.walk(block.bins, fit, row)
    at = node >= 2**level - 1
    fit, row, node = fit[at], row[at], node[at]
    p = 1 / (1 + np.exp(-margins[fit, row].astype(np.float64)))
    g, h = p - block.y[row], p * (1 - p)
    key, place = np.unique(fit * 2 ** (level + 1) + node, return_inverse=True)
    order = np.argsort(place, kind="stable")
    row, place, g, h = row[order], place[order], g[order], h[order]
    features = block.bins.shape[1]
    column = np.arange(features) * BINS
    width = features * BINS
    begin = np.searchsorted(place, np.arange(len(key) + 1))
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, min(int(np.searchsorted(begin, begin[lo] + CELLS // features, "right")) - 1, lo + 2 * CELLS // width))
        a, b = begin[lo], begin[hi]
        gs, hs = np.zeros((hi - lo) * width), np.zeros((hi - lo) * width)
        step = max(1, CELLS // features)
        for c in range(a, b, step):  # rows of one very large node come in steps
            d = min(b, c + step)
            cell = ((place[c:d] - lo)[:, None] * width + column + block.bins[row[c:d]]).ravel()
            gs += np.bincount(cell, np.repeat(g[c:d], features), len(gs))
            hs += np.bincount(cell, np.repeat(h[c:d], features), len(hs))
        yield key[lo:hi] // 2 ** (level + 1), key[lo:hi] % 2 ** (level + 1), gs.reshape(-1, features, BINS), hs.reshape(-1, features, BINS)
        lo = hi


def best_splits(fit: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, least: np.ndarray, allowed: np.ndarray | None) -> dict[str, np.ndarray]:
    """The split of each node with the largest gain (the first feature and bin among equals), feature -1 where none gains."""
    gl, hl = g.cumsum(2), h.cumsum(2)
    gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
    gr, hr = gt - gl, ht - hl
    gain = gl * gl / (hl + RIDGE)
    gr *= gr
    gr /= hr + RIDGE
    gain += gr
    gain -= gt * gt / (ht + RIDGE)
    gain *= np.minimum(hl, hr) >= least[:, None, None]
    if allowed is not None:
        gain *= allowed[:, :, None]
    flat = np.round(gain, 9, out=gain).reshape(len(fit), -1)
    best = flat.argmax(1)
    every = np.arange(len(fit))
    found = flat[every, best] > 0
    feature, cut = best // BINS, best % BINS
    return {
        "fit": fit, "node": node, "feature": np.where(found, feature, -1), "bin": cut, "gain": np.where(found, flat[every, best], 0.0),
        "g": gt[:, 0, 0], "h": ht[:, 0, 0], "gl": gl[every, feature, cut], "hl": hl[every, feature, cut],
    }


_SPLIT = "fit long, node long, feature long, bin long, gain double, g double, h double, gl double, hl double"


def _allowed(fits: pd.DataFrame, fit: np.ndarray, features: dict[int, list[int]], width: int) -> np.ndarray | None:
    if not features:
        return None
    out = np.ones((len(fits), width), bool)
    for i, split in enumerate(fits["split"].tolist()):
        if split in features:
            out[i] = np.isin(np.arange(width), features[split])
    return out[fit]


def _read(batch: pa.RecordBatch, i: int) -> Block:
    n, raw = batch.column("n")[i].as_py(), {c: np.frombuffer(batch.column(c)[i].as_buffer(), d) for c, d in (("ids", np.int64), ("bins", np.uint8), ("y", np.int8), ("parts", np.int8))}
    return Block(raw["ids"], raw["bins"].reshape(n, -1), raw["y"].astype(np.float64), raw["parts"].reshape(n, -1))


def edges_of(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each feature: values at equal shares of the rows. A feature of few values has a bin for each."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    value = lambda i: F.nanvl(F.col("x")[i].cast("double"), F.lit(None).cast("double"))
    got = rows.agg(*[F.percentile_approx(value(i), at, 10_000).alias(f"f{i}") for i in range(width)]).first()
    return [np.unique(np.asarray(e if e is not None else [], np.float64)) for e in got]


def pack_blocks(rows: DataFrame, edges: list[np.ndarray], splits: int, size: int = BLOCK) -> DataFrame:
    """rows (id, x, y, parts: an array with a part for each split) as blocks of binned rows."""

    def pack(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                n = b.num_rows
                x = np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], np.float64).reshape(n, len(edges))
                bins = np.stack([np.where(np.isnan(c), BINS - 1, np.searchsorted(e, c, "left")) for e, c in zip(edges, x.T, strict=True)], 1).astype(np.uint8)
                parts = b.column("parts").flatten().to_numpy(zero_copy_only=False).astype(np.int8).reshape(n, splits)
                ids, y = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64), b.column("y").to_numpy(zero_copy_only=False).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, bins, y, parts))], names=["n", "ids", "bins", "y", "parts"])

    return rows.select("id", "x", "y", "parts").mapInArrow(pack, "n long, ids binary, bins binary, y binary, parts binary")


def _counts(block: Block, fits: pd.DataFrame, margins: np.ndarray, first: int) -> pa.RecordBatch:
    """Counts of (truth, prediction) over the rows that each fit is scored on."""
    use = block.used(fits, False)
    said, true = margins > 0, block.y[None, :] == 1
    cols = [(use & said & true).sum(1), (use & said & ~true).sum(1), (use & ~said & true).sum(1), (use & ~said & ~true).sum(1)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits)) + first), *map(pa.array, cols)], names=["fit", "tp", "fp", "fn", "tn"])


class Cell:
    """The rows that some fits train on (the first ``n``) and those they are scored on."""

    def __init__(self, ids: np.ndarray, bins: np.ndarray, y: np.ndarray, n: int):
        self.ids, self.rows, self.y, self.n = ids, bins, y, n
        self.columns = np.ascontiguousarray(bins.T)
        features = bins.shape[1]
        even = self.columns[0::2, :n].astype(np.uint16) * np.uint16(BINS)
        even[: features // 2] += self.columns[1::2, :n]
        self.pairs = even

    def sums(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Gradients and Hessians of training rows by feature and bin (2 x features x bins)."""
        features = self.rows.shape[1]
        every = len(rows) == self.n
        if not every:
            g, h = g[rows], h[rows]
        if len(rows) < PAIRED:
            cell = (self.rows[rows] + np.arange(features) * BINS).ravel()
            return np.stack([np.bincount(cell, np.repeat(v, features), features * BINS) for v in (g, h)]).reshape(2, features, BINS)
        both = np.empty((2, len(self.pairs), BINS, BINS))
        for i, pair in enumerate(self.pairs):
            cell = (pair[: self.n] if every else pair.take(rows)).astype(np.intp)
            for k, v in enumerate((g, h)):
                both[k, i] = np.bincount(cell, v, BINS * BINS).reshape(BINS, BINS)
        return np.stack([both.sum(3), both.sum(2)], 2).reshape(2, -1, BINS)[:, :features]


def grow(cell: Cell, p: dict, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Margins of the rows of a cell by one fit (its parameters ``p``), and its gains by feature."""
    width, n, least, rate = cell.rows.shape[1], cell.n, float(p["least_weight"]), float(p["rate"])
    margins, gains = np.zeros(len(cell.y), np.float32), np.zeros(width)
    zero = np.zeros(1, np.int64)
    for rnd in range(int(p["rounds"]) if n else 0):
        prob = 1 / (1 + np.exp(-margins[:n].astype(np.float64)))
        g, h = prob - cell.y[:n], prob * (1 - prob)
        used, rest = np.arange(n), np.arange(n, len(cell.y))
        if p["subsample"] < 1:
            drawn = unit_hash(cell.ids[:n], np.array([p["seed"]]) * 1_000_003 + rnd + 1)[0] < p["subsample"]
            used, rest = np.flatnonzero(drawn), np.r_[np.flatnonzero(~drawn), rest]
        if not len(used):
            continue
        nodes = [(used, rest, cell.sums(used, g, h), None)]
        for level in range(int(p["depth"])):
            new = []
            for used, rest, sums, value in nodes:
                if sums is None:
                    new.append((used, rest, None, value))
                    continue
                s = {k: v[0] for k, v in best_splits(zero, zero, sums[:1], sums[1:], np.array([least]), allowed).items()}
                if s["feature"] < 0:
                    new.append((used, rest, None, (s["g"], s["h"])))
                    continue
                gains[s["feature"]] += s["gain"]
                column = cell.columns[s["feature"]]
                right, right_rest = column.take(used) > s["bin"], column.take(rest) > s["bin"]
                sides = [(used[~right], rest[~right_rest], (s["gl"], s["hl"])), (used[right], rest[right_rest], (s["g"] - s["gl"], s["h"] - s["hl"]))]
                # a child with less than twice the least weight can't be split
                large = [level + 1 < p["depth"] and v[1] >= 2 * least for *_, v in sides]
                below: list[np.ndarray | None] = [None, None]
                if any(large):
                    small = int(len(sides[1][0]) < len(sides[0][0]))
                    below[small] = cell.sums(sides[small][0], g, h)
                    if large[1 - small]:
                        below[1 - small] = sums - below[small]
                new += [(a, b, t if ok else None, v) for (a, b, v), t, ok in zip(sides, below, large, strict=True)]
            nodes = new
            if all(sums is None for _, _, sums, _ in nodes):
                break
        for used, rest, sums, value in nodes:
            a, b = value if sums is None else (sums[0, 0].sum(), sums[1, 0].sum())
            step = np.float32(-rate * a / (b + RIDGE))
            margins[used] += step
            margins[rest] += step
    return margins, gains


@dataclass
class Deal:
    """Fits of one cell that one task trains: which fits, and of which rows."""

    fits: list[int]
    cell: tuple[int, int, int, float]  # split, inner, seed, share
    cost: float
    place: int = 0  # the partition


def deal_fits(table: pd.DataFrame, tasks: int) -> tuple[list[Deal], int]:
    """The fits in deals of one cell each and of like cost, dealt to at most ``tasks`` partitions, the costliest first; how many these are."""
    cost = (table["share"] * table["rounds"] * (1 + 0.4 * table["depth"]) * table["subsample"]).to_numpy(float)
    aim = cost.sum() / tasks
    out = []
    for cell, at in table.groupby(["split", "inner", "seed", "share"]).indices.items():
        bins = [Deal([], tuple(c.item() if hasattr(c, "item") else c for c in cell), 0.0) for _ in range(min(len(at), max(1, round(cost[at].sum() / aim))))]
        for i in at[np.argsort(-cost[at], kind="stable")].tolist():
            least = min(bins, key=lambda d: d.cost)
            least.fits.append(i)
            least.cost += cost[i]
        out += bins
    out.sort(key=lambda d: -d.cost)
    load = [(0.0, k) for k in range(min(len(out), 2 * tasks))]
    for d in out:
        held, d.place = heappop(load)
        heappush(load, (held + d.cost, d.place))
    return out, len(load)


def _cut(deals: list[Deal]):
    """The rows of a block that each deal needs."""
    cells: dict[tuple, list[int]] = {}
    for k, d in enumerate(deals):
        cells.setdefault(d.cell, []).append(k)

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = _read(batch, i)
                for cell, wanted in cells.items():
                    split, inner, seed, share = cell
                    part = block.parts[:, split]
                    train = np.flatnonzero((part >= 0) & (part != inner) & (unit_hash(block.ids, np.array([seed]))[0] < share))
                    rows = np.r_[train, np.flatnonzero(part == (TEST if inner < 0 else inner))]
                    if not len(rows):
                        continue
                    raw = [v[rows].tobytes() for v in (block.ids, block.bins, block.y.astype(np.int8))]
                    for k in wanted:
                        yield pa.RecordBatch.from_arrays([pa.array([deals[k].place], pa.int32()), pa.array([k], pa.int32()), pa.array([len(train)]), *(pa.array([v], pa.binary()) for v in raw)], names=["place", "deal", "n", "ids", "bins", "y"])

    return work


def _grown(deals: list[Deal], fits: Fits, width: int):
    """Trains the fits of each deal (its rows come together). Yields counts and the gains by feature of refits."""

    def train(k, held):
        ids, y, bins = (np.concatenate([p[c] for p in held]) for c in ("ids", "y", "bins"))
        test = np.concatenate([np.arange(len(p["ids"])) >= p["n"] for p in held])
        order = np.lexsort((ids, test))
        cell = Cell(ids[order], bins[order], y[order].astype(np.float64), int(np.count_nonzero(~test)))
        table = fits.table.iloc[deals[k].fits]
        allowed = _allowed(table, np.array([0]), fits.features, width)  # they have one split
        true = cell.y[cell.n :] == 1
        for f, p in zip(deals[k].fits, table.to_dict("records"), strict=True):
            margins, gains = grow(cell, p, allowed)
            said = margins[cell.n :] > 0
            counts = [int(np.count_nonzero(v)) for v in (said & true, said & ~true, ~said & true, ~said & ~true)]
            yield pa.RecordBatch.from_arrays([*(pa.array([v]) for v in (f, *counts)), pa.array([gains.tolist() if p["inner"] < 0 else None], pa.list_(pa.float64()))], names=["fit", "tp", "fp", "fn", "tn", "gains"])

    def work(batches):
        held, now = [], None
        for batch in batches:
            for i, k in enumerate(batch.column("deal").to_pylist()):
                if k != now and held:
                    yield from train(now, held)
                    held = []
                now = k
                raw = {c: np.frombuffer(batch.column(c)[i].as_buffer(), d) for c, d in (("ids", np.int64), ("bins", np.uint8), ("y", np.int8))}
                held.append({"n": batch.column("n")[i].as_py(), **raw, "bins": raw["bins"].reshape(-1, width)})
        if held:
            yield from train(now, held)

    return work


_COUNTS = "fit long, tp long, fp long, fn long, tn long"


def _sums(state, size):
    fits, trees, level, rnd = state.value["fits"], state.value["trees"], state.value["level"], state.value["round"]

    def work(batches):
        held: dict[tuple[int, int], list[np.ndarray]] = {}  # nodes of this task's units, added up before they are sent
        for batch in batches:
            for i in range(batch.num_rows):
                block, k = _read(batch, i), batch.column("chunk")[i].as_py()
                mine = fits.chunk(k, size)
                margins = np.frombuffer(batch.column("margins")[i].as_buffer(), np.float32).reshape(len(mine), -1)
                for f, n, g, h in level_sums(block, mine, margins, trees[k], level, rnd):
                    for j in range(len(f)):
                        at = held.setdefault((k * size + int(f[j]), int(n[j])), [np.zeros(g.shape[1:]), np.zeros(g.shape[1:])])
                        at[0] += g[j]
                        at[1] += h[j]
                if len(held) * block.bins.shape[1] * BINS > 8 * CELLS:
                    yield from _sent(held)
                    held = {}
        yield from _sent(held)

    return work


def _sent(held):
    for (f, n), (g, h) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([n]), pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], names=["fit", "node", "g", "h"])


def _choose(state, width):
    def work(table: pa.Table) -> pa.Table:
        """The split of one node; its partial sums are at most one a task."""
        fits = state.value["fits"]
        f, n = table.column("fit")[0].as_py(), table.column("node")[0].as_py()
        g, h = (sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column(c)).reshape(1, width, BINS) for c in ("g", "h"))
        one = fits.table.iloc[f : f + 1]
        s = best_splits(np.array([f]), np.array([n]), g, h, one["least_weight"].to_numpy(float), _allowed(one, np.array([0]), fits.features, width))
        return pa.table({k: pa.array(s[k], pa.float64() if k in ("gain", "g", "h", "gl", "hl") else pa.int64()) for k in ("fit", "node", "feature", "bin", "gain", "g", "h", "gl", "hl")})

    return work


def _moved(state, size):
    def work(batches):
        trees = state.value["trees"]
        for batch in batches:
            for i in range(batch.num_rows):
                block, k = _read(batch, i), batch.column("chunk")[i].as_py()
                margins = np.frombuffer(batch.column("margins")[i].as_buffer(), np.float32).reshape(-1, len(block.y))
                every = np.indices(margins.shape).reshape(2, -1)
                new = margins + trees[k].value[every[0], trees[k].walk(block.bins, *every)].reshape(margins.shape)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in row.schema.names if c != "margins"), pa.array([new.tobytes()], pa.binary())], names=[*(c for c in row.schema.names if c != "margins"), "margins"])

    return work


def _scored(state, size):
    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, k = _read(batch, i), batch.column("chunk")[i].as_py()
                mine = state.value["fits"].chunk(k, size)
                yield _counts(block, mine, np.frombuffer(batch.column("margins")[i].as_buffer(), np.float32).reshape(len(mine), -1), k * size)

    return work


def train_and_count(blocks: DataFrame, n_blocks: int, fits: Fits, width: int, chunk: int | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """Trains all fits. Counts of (truth, prediction) by fit on the rows it is scored on, and the gains by feature (fits x width)."""
    spark = blocks.sparkSession
    ship(spark)
    # fits of like cost stand together, so a chunk doesn't wait for its longest
    order = fits.table.sort_values(["rounds", "depth", "split", "inner", "seed"], kind="stable")
    fits = Fits(order.reset_index(drop=True), fits.features)
    cores = spark.sparkContext.defaultParallelism
    gains = np.zeros((len(order), width))
    if n_blocks == 1:
        deals, places = deal_fits(fits.table, 8 * cores)
        cut = blocks.mapInArrow(_cut(deals), "place int, deal int, n long, ids binary, bins binary, y binary")
        together = cut.repartitionById(places, F.col("place")).sortWithinPartitions("deal")
        got = together.mapInArrow(_grown(deals, fits, width), f"{_COUNTS}, gains array<double>").toPandas()
        for f, g in zip(got["fit"], got["gains"], strict=True):
            if g is not None:
                gains[f] = g
        return _in_order(order, got.drop(columns="gains"), gains)
    chunk = chunk or min(CHUNK, max(4, -(-len(order) // (4 * cores))))
    chunks = -(-len(order) // chunk)
    unit = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(max(1, min(chunks * n_blocks, 16 * cores)))
    tables = SharedTables(spark)
    sizes = [len(fits.chunk(k, chunk)) for k in range(chunks)]
    zero = F.expr(f"unhex(repeat('00', cast(4 * n * (case when chunk = {chunks - 1} then {sizes[-1]} else {chunk} end) as int)))")
    state = tables.put(unit.withColumn("margins", zero))
    rate = [fits.chunk(k, chunk)["rate"].to_numpy(float) for k in range(chunks)]
    for rnd in range(int(order["rounds"].max())):
        depth = int(order["depth"][order["rounds"] > rnd].max())
        trees = [Trees(s, depth) for s in sizes]
        for level in range(depth):
            shared = spark.sparkContext.broadcast({"fits": fits, "trees": trees, "level": level, "round": rnd})
            sums = state.mapInArrow(_sums(shared, chunk), "fit long, node long, g binary, h binary")
            s = sums.groupBy("fit", "node").applyInArrow(_choose(shared, width), _SPLIT).toPandas()  # a row a node
            for k, part in s.groupby(s["fit"] // chunk):
                trees[k].apply({c: part[c].to_numpy() - (k * chunk if c == "fit" else 0) for c in part.columns}, rate[k])
            np.add.at(gains, (s["fit"].to_numpy(), np.maximum(s["feature"].to_numpy(), 0)), s["gain"].to_numpy())
            if not (s["feature"] >= 0).any():
                break
        shared = spark.sparkContext.broadcast({"fits": fits, "trees": trees})
        new = tables.put(state.mapInArrow(_moved(shared, chunk), state.schema))
        tables.drop(state)
        state = new
    shared = spark.sparkContext.broadcast({"fits": fits})
    counts = state.mapInArrow(_scored(shared, chunk), _COUNTS).groupBy("fit").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).toPandas()
    tables.drop(state)
    return _in_order(order, counts, gains)


def _in_order(order: pd.DataFrame, counts: pd.DataFrame, gains: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Counts and gains of sorted fits in the order of the given ones."""
    back = order.index.to_numpy()
    counts["fit"] = back[counts["fit"].to_numpy()]
    out = np.zeros_like(gains)
    out[back] = gains
    return counts.groupby("fit").sum().reindex(range(len(order)), fill_value=0), out
