"""Quality classifier: histogram gradient-boosted trees over document statistics.

* A text becomes ``STATISTICS``: sizes, shares of byte classes, shapes of words and lines, repetition, entropy, and the worst of
  its stretches (a text may start well and end as junk). All texts of a slice of an Arrow batch are measured by whole-array
  operations; no statistic knows the label, the language, the source or the id.
* Values are put into at most ``BINS`` quantile bins (of the training texts). Trees grow level by level: one histogram of gradients
  and Hessians by (node, statistic, bin), the best split of each node by regularised gain, leaf values by Newton steps.
* A model is four flat arrays, trees one after another as complete binary trees; scoring walks all trees of all texts
  of a slice at once.

Labels come from a sample of at most ``MAX_LABELS`` labelled rows (all, if there are fewer), chosen by a hash of doc_id, so the binned
training table (a byte per statistic) has a bound and is fitted on the driver; measuring and scoring are one pass over all texts
without any shuffle.

Null and empty texts have all statistics 0 and are scored like others; rows with a null label or doc_id teach nothing; of
contradicting labels of one doc_id the lower one teaches; repeated rows are kept; very long texts are measured whole; constant
statistics split nothing; without labelled texts of both kinds all texts get the share of label 1 (0.5 if there are none at all); an empty
table gives no rows; other columns stay, but those with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import prepare
from .words import LOWER, hashes, slices, spans

MAX_LABELS = 100_000
BINS = 64
ROUNDS = 80
DEPTH = 4
RATE = 0.15
RIDGE = 1.0
LEAST_HESSIAN = 1.0
STRETCH = 32  # words of a stretch

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "other_script": range(0x80, 256),
    "space": [0x20, 0x09],
    "line_end": [0x0A, 0x0D],
    "stop": [ord(c) for c in ".?!"],
    "comma": [ord(c) for c in ",;:"],
    "quote": [ord(c) for c in "\"'()[]"],
    "symbol": [ord(c) for c in "#$%&*+<=>@\\^_`{|}~/-"],
}
STATISTICS = [
    "log_bytes", "log_words", "log_lines", *(f"share_{c}" for c in _CLASSES),
    "word_bytes", "word_bytes_sd", "long_words", "short_words", "capital_words", "capitalised_words", "bare_symbols", "odd_ends", "doubled_ends", "digit_words", "no_letter_words",
    "distinct_words", "commonest_word", "repeated_pairs", "repeated_runs", "line_bytes", "longest_line", "repeated_lines", "lines_ended", "same_as_next",
    "byte_entropy", "worst_symbols", "worst_capitals", "worst_odd_ends", "worst_bare",
]


def _sums(values: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=rows)


def _repeats(keys: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many different keys it has, and the count of its commonest."""
    order = np.lexsort((keys, of))
    k, o = keys[order], of[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, o[at], np.diff(np.append(at, len(k))))
    return np.bincount(o[at], minlength=rows), most


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for every text."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    out = {}
    per_byte = 1 / np.maximum(size, 1)
    byte_of = np.repeat(np.arange(rows), size)
    histogram = np.bincount(byte_of * 256 + data, minlength=rows * 256).reshape(rows, 256)
    for name, members in _CLASSES.items():
        out[f"share_{name}"] = histogram[:, list(members)].sum(1) * per_byte
    p = histogram * per_byte[:, None]
    out["byte_entropy"] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    starts, ends, of = spans(data, offsets)
    n = np.bincount(of, minlength=rows)
    each = 1 / np.maximum(n, 1)
    length = ends - starts
    counts = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = lambda c: c[ends] - c[starts]
    upper = np.zeros(256, bool)
    upper[65:91] = True
    letters, capitals = inside(counts(_LETTER[data])), inside(counts(upper[data]))
    digits = inside(counts((data >= 48) & (data < 58)))
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    before = data[np.maximum(ends - 2, starts)] if len(ends) else last
    first = data[starts] if len(starts) else last
    plain_end = _LETTER[last] | (last >= 48) & (last < 58) | np.isin(last, [ord(c) for c in ".,;:?!)'\""])
    odd, bare = ~plain_end, letters + digits == 0
    doubled = (last == before) & ~_LETTER[last] & (length > 1) & ~((last >= 48) & (last < 58))
    shouted = (capitals > 1) & (capitals == letters)
    out["word_bytes"] = _sums(length, of, rows) * each
    out["word_bytes_sd"] = np.sqrt(np.maximum(_sums(length.astype(float) ** 2, of, rows) * each - out["word_bytes"] ** 2, 0))
    for name, mask in {
        "long_words": length > 14, "short_words": length < 4, "capital_words": shouted, "capitalised_words": upper[first] & ~shouted, "bare_symbols": bare, "odd_ends": odd,
        "doubled_ends": doubled, "digit_words": digits > 0, "no_letter_words": letters == 0,
    }.items():
        out[name] = _sums(mask, of, rows) * each
    words = hashes(data, starts, ends, LOWER)
    different, most = _repeats(words, of, rows)
    out["distinct_words"], out["commonest_word"] = different * each, most * each
    with np.errstate(over="ignore"):
        for name, width in (("repeated_pairs", 2), ("repeated_runs", 5)):
            m = len(of) - width + 1
            if m < 1:
                out[name] = np.zeros(rows)
                continue
            whole = np.flatnonzero(of[:m] == of[width - 1 :])
            key = np.zeros(len(whole), np.uint64)
            for k in range(width):
                key = key * np.uint64(0xA0761D6478BD642F) + words[whole + k]
            different, _ = _repeats(key, of[whole], rows)
            total = np.bincount(of[whole], minlength=rows)
            out[name] = (total - different) / np.maximum(total, 1)
    same = np.zeros(len(of), bool)
    if len(of) > 1:
        same[:-1] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    out["same_as_next"] = _sums(same, of, rows) * each
    # lines that hold anything
    line = np.ones(256, bool)
    line[[0x0A, 0x0D]] = False
    a, b, line_of = spans(data, offsets, line)
    n_lines = np.bincount(line_of, minlength=rows)
    per_line = 1 / np.maximum(n_lines, 1)
    out["line_bytes"] = np.log1p(_sums(b - a, line_of, rows) * per_line)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, line_of, b - a)
    out["longest_line"] = np.log1p(longest)
    different, _ = _repeats(hashes(data, a, b, LOWER), line_of, rows)
    out["repeated_lines"] = (n_lines - different) * per_line
    out["lines_ended"] = _sums(np.isin(data[b - 1], [ord(c) for c in ".?!"]) if len(b) else np.zeros(0), line_of, rows) * per_line
    out["log_bytes"], out["log_words"], out["log_lines"] = np.log1p(size), np.log1p(n), np.log1p(n_lines)
    # stretches of words; a short rest at the end counts as if it were a whole one
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    many = (n + STRETCH - 1) // STRETCH
    stretch = np.repeat(np.cumsum(many) - many, n) + place // STRETCH
    stretch_of = np.repeat(np.arange(rows), many)
    symbols = inside(counts(np.isin(data, list(_CLASSES["symbol"])))) / np.maximum(length, 1)
    for name, values in {"worst_symbols": symbols, "worst_capitals": shouted, "worst_odd_ends": odd, "worst_bare": bare}.items():
        worst = np.zeros(rows)
        np.maximum.at(worst, stretch_of, _sums(values, stretch, len(stretch_of)) / STRETCH)
        out[name] = worst
    return np.stack([out[s] for s in STATISTICS], 1).astype(np.float32)


def _measured(batches: Iterator[pa.RecordBatch]):
    for rows, data, offsets in slices(batches):
        x = measure(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
        keep = [c for c in rows.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), lists], names=[*keep, "statistics"])


def statistics(docs: DataFrame) -> DataFrame:
    """Every row's other columns with its statistics (an array in the order of STATISTICS)."""
    docs = docs.drop("statistics")
    prepare(docs.sparkSession)
    return docs.mapInArrow(_measured, StructType([*(f for f in docs.schema if f.name.lower() != "text"), *StructType.fromDDL("statistics array<float>")]))


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each column: between neighbouring values at equal shares of the rows."""
    found = []
    for column in x.T:
        values, counts = np.unique(column, return_counts=True)
        if len(values) > bins:
            upto = np.cumsum(counts)
            values = values[np.unique(np.searchsorted(upto, np.arange(1, bins + 1) * len(column) / bins))]
        found.append(((values[:-1].astype(np.float64) + values[1:]) / 2).astype(np.float32))
    return found


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)


def grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int = BINS, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree for gradients g and Hessians h: split statistic and bin of each inner node, value of each leaf (complete binary tree of
    ``depth`` levels), and the leaf of each row. A node that gains nothing sends all rows left (bin 255)."""
    n, f = binned.shape
    node = np.zeros(n, np.int64)
    feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
    column = np.arange(f) * bins
    for level in range(depth):
        nodes = 2**level
        cell = ((node * f * bins)[:, None] + column + binned).ravel()
        sums = [np.bincount(cell, weights=np.repeat(w, f), minlength=nodes * f * bins).reshape(nodes, f, bins).cumsum(2) for w in (g, h)]
        gl, hl = sums
        gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
        gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
        gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = -1
        flat = gain.reshape(nodes, -1)
        best = flat.argmax(1)
        good = flat[np.arange(nodes), best] > 1e-9
        feature[nodes - 1 : 2 * nodes - 1] = np.where(good, best // bins, 0)
        threshold[nodes - 1 : 2 * nodes - 1] = np.where(good, best % bins, 255)
        at = nodes - 1 + node
        node = 2 * node + (binned[np.arange(n), feature[at]] > threshold[at])
    gs, hs = (np.bincount(node, weights=w, minlength=2**depth) for w in (g, h))
    return feature, threshold, -gs / (hs + RIDGE), node


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> dict:
    """The model of statistics x and labels y (0/1): cuts, start, and flat arrays of all trees."""
    cuts = cut_points(x, bins)
    p = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(p / (1 - p)))
    trees: list[tuple] = []
    if 0 < y.sum() < len(y):
        binned = to_bins(x, cuts)
        raw = np.full(len(y), start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            feature, threshold, value, leaf = grow(binned, p - y, p * (1 - p), bins, depth)
            raw += rate * value[leaf]
            trees.append((feature, threshold, rate * value))
    flat = lambda k, kind, width: np.concatenate([t[k] for t in trees]).astype(kind) if trees else np.zeros(0, kind)
    return {"cuts": cuts, "start": start, "depth": depth, "feature": flat(0, np.int16, 2**depth - 1), "threshold": flat(1, np.int16, 2**depth - 1), "value": flat(2, np.float64, 2**depth)}


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities of label 1: all trees of all rows are walked level by level."""
    inner, leaves = 2 ** model["depth"] - 1, 2 ** model["depth"]
    trees = len(model["value"]) // leaves
    binned = to_bins(x, model["cuts"])
    row = np.arange(len(x))[:, None]
    root, node = np.arange(trees) * inner, np.zeros((len(x), trees), np.int64)
    for _ in range(model["depth"]):
        at = root + node
        node = 2 * node + 1 + (binned[row, model["feature"][at]] > model["threshold"][at])
    raw = model["start"] + model["value"][np.arange(trees) * leaves + node - inner].sum(1)
    return 1 / (1 + np.exp(-raw))


def label_sample(labels: DataFrame, column: str = "quality", limit: int = MAX_LABELS) -> DataFrame:
    """doc_id and label of at most ``limit`` rows: the share that fits, by a hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    n = known.count()
    share = int(0.95 * limit / n * 1_000_000) if n > limit else 1_000_000
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < share)


def train(labelled: DataFrame) -> dict:
    """The model of rows with text and label; their number is bounded by the sample of labels."""
    got = statistics(labelled.select("text", F.col("label").cast("int").alias("label"))).toArrow()
    x = got.column("statistics").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    y = got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))  # the model doesn't depend on the order of rows
    return fit(x[order], y[order])


def _scored(shared, keep):
    def scored(batches):
        model = shared.value
        for rows, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(predict(measure(data, offsets), model))], names=[*keep, "score"])

    return scored


def score(docs: DataFrame, model: dict, keep_text: bool = False) -> DataFrame:
    """Every row's other columns (and its text, if asked for) with its score."""
    docs = docs.drop("score")
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if keep_text or c.lower() != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(shared, keep), StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL("score double")]))
