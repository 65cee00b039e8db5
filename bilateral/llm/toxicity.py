"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

* Token weights are log-odds ratios of toxic against other labelled texts with an informative
  Dirichlet prior (the corpus distribution), taken at the near end of their confidence interval, where the likelihood
  ratio of the word's texts passes a test corrected for the number of words tested (of them about one passes by
  chance, however many words the corpus has); unknown tokens get the drift, a small negative weight, so that the expected weight of clean text is negative.
* A linear-time scan keeps all maximal scoring segments of a text (Ruzzo and Tompa).
* A segment's score S gets the extreme-value p-value 1 - exp(-K n exp(-lambda S)), with lambda and
  K fitted on the best segments of clean training texts (1 and 1e-4 where at most ten have any); the text's passages are aggregated as the
  product of their p-values' complements and mapped to a probability by a two-parameter logistic fit
  on training texts.

Of texts of one label that are copies or near copies one teaches, so copies count once. Labels come from a sample of at most ``MAX_LABELS`` labelled rows (all, if there are fewer), chosen
by a hash of doc_id; everything else uses all rows. All words that MIN_COUNT of these texts hold are tested, so their number
is bounded by the sample, not by the corpus. Null and empty texts have no passage and score
as a text without evidence; rows with a null label or doc_id teach nothing; repeated rows are kept; of copies of one label the
lowest doc_id teaches; very long texts are scanned whole; other columns stay (those with the names of results are replaced); without labelled
texts of both kinds all texts score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import set_keys, shingle_sets
from .tables import Tables, prepare
from .words import PLAIN_WORD, hashes, mix, signed, slices, spans

MAX_LABELS = 400_000
PRIOR = 500.0
LEAST_PRIOR = 1.0
Z = 1.64
MIN_COUNT = 3
LEAST_WEIGHT = 1.5
DRIFT = -0.15
MIN_SEGMENT = 0.5
SKETCH = 256
NEAR = 0.47  # of the places of two sketches: between copies edited apart (0.6) and texts that share half (0.33)
KEYS = 6  # least shingles under which near copies meet


def label_sample(labels: DataFrame, column: str = "toxic") -> DataFrame:
    """doc_id and label of at most MAX_LABELS rows: the share that fits, by a hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    n = known.count()
    share = min(1.0, 0.95 * MAX_LABELS / n) if n > MAX_LABELS else 1.0
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known


def _copy_keys(batches):
    """Keys under which copies of a text meet (whole set, KEYS least shingles), and its sketch: the shingles are dealt to SKETCH
    places by their hash, each place keeps one byte of its least (0: no shingle)."""
    for rows, sets, sizes in shingle_sets(batches):
        full = np.flatnonzero(sizes)
        begin = (np.cumsum(sizes) - sizes)[full]
        keys = np.zeros((len(sizes), 1 + KEYS), np.uint64)
        keys[:, 0] = set_keys(sets, sizes)
        for salt in range(1, KEYS + 1):
            if len(full):
                keys[full, salt] = np.minimum.reduceat(mix(sets ^ mix(np.array([salt], np.uint64))), begin)
        h = mix(sets ^ mix(np.zeros(1, np.uint64)))
        place = np.repeat(np.arange(len(sizes), dtype=np.uint64) * np.uint64(SKETCH), sizes) + h % np.uint64(SKETCH)
        bits = np.uint64(64 - (len(sizes) * SKETCH).bit_length())  # of the hash beside the place; 32 or more
        least = np.sort(place << bits | h >> (np.uint64(64) - bits))
        place = (least >> bits).astype(np.int64)
        new = np.flatnonzero(np.diff(place, prepend=-1))
        sketch = np.zeros(len(sizes) * SKETCH, np.uint8)
        sketch[place[new]] = 1 + ((least[new] & ((np.uint64(1) << bits) - np.uint64(1))) >> (bits - np.uint64(32))) % np.uint64(255)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (1 + KEYS)), signed(keys.ravel()))
        sketches = pa.array([x.tobytes() for x in sketch.reshape(-1, SKETCH)], pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), lists, sketches], names=["doc_id", "label", "keys", "sketch"])


def _near(batches):
    for rows in batches:
        x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "first_sketch"))
        same, either = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").filter(pa.array(same >= NEAR * either))], names=["doc_id"])


def one_of_each(labelled: DataFrame, tables: Tables) -> DataFrame:
    """labelled rows without copies and near copies of others of their label. A text that was copied a thousand times
    would else lend its label to all of its rare words.

    A row is a copy if it has the set of shingles of a row with a lower doc_id, or if it shares one of KEYS least shingles with the first
    such row and their sketches agree in the share NEAR of their places (copies that were edited apart agree less with each other than
    with what they were copied from); texts that share a line only have other sketches and all teach."""
    keys = tables.put(labelled.select("doc_id", "label", "text").mapInArrow(_copy_keys, "doc_id long, label int, keys array<long>, sketch binary"))
    each = keys.select("doc_id", "label", F.posexplode("keys").alias("k", "key"))  # at most MAX_LABELS * (1 + KEYS) rows
    first = each.groupBy("label", "k", "key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = each.join(first, ["label", "k", "key"]).where("doc_id <> first")
    met = tables.put(met.groupBy("label", "doc_id", "first").agg(F.min("k").alias("k")))
    sketch = lambda doc, name: keys.select("label", F.col("doc_id").alias(doc), F.col("sketch").alias(name))
    near = met.where("k > 0").join(sketch("first", "first_sketch"), ["label", "first"]).join(sketch("doc_id", "sketch"), ["label", "doc_id"])
    near = near.select("doc_id", "sketch", "first_sketch").mapInArrow(_near, "doc_id long")
    drop = tables.put(met.where("k = 0").select("doc_id").union(near).distinct())
    return labelled.join(F.broadcast(drop), "doc_id", "left_anti")


def _tokens(batches: Iterator[pa.RecordBatch]):
    for rows, data, offsets in slices(batches):
        starts, ends, of = spans(data, offsets, PLAIN_WORD)
        yield rows, hashes(data, starts, ends), of, starts, ends, offsets


def _count(batches):
    for rows, h, of, *_ in _tokens(batches):
        label = rows.column("label").to_numpy(zero_copy_only=False).astype(bool)
        words, at = np.unique(h, return_inverse=True)
        toxic = np.bincount(at, weights=label[of], minlength=len(words)).astype(np.int64)
        each = np.bincount(at, minlength=len(words))
        # how many texts of each kind hold the word
        pair = np.unique(at.astype(np.int64) * rows.num_rows + of)
        d_at, d_of = pair // rows.num_rows, pair % rows.num_rows
        dt = np.bincount(d_at, weights=label[d_of], minlength=len(words)).astype(np.int64)
        d = np.bincount(d_at, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(toxic), pa.array(each - toxic), pa.array(dt), pa.array(d - dt)], names=["word", "n1", "n0", "d1", "d0"])


def token_weights(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and their weights, from rows with text and label (0/1)."""
    prepare(labelled.sparkSession)
    counts = labelled.select("text", "label").mapInArrow(_count, "word long, n1 long, n0 long, d1 long, d0 long")
    tables = Tables(labelled.sparkSession)
    counts = tables.put(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n1", "n0", "d1", "d0")]))
    tested = F.col("d1") + F.col("d0") >= MIN_COUNT
    totals = counts.agg(F.sum("d1"), F.sum("d0"), F.count_if(tested)).first()
    t1, t0 = float(totals[0] or 0), float(totals[1] or 0)
    if not t1 or not t0:
        return np.zeros(0, np.uint64), np.zeros(0)
    # counts of texts damp repetition; the prior spreads PRIOR pseudo-counts as the whole corpus does
    a = F.greatest(PRIOR * (F.col("d1") + F.col("d0")) / (t1 + t0), F.lit(LEAST_PRIOR))
    y1, y0 = F.col("d1") + a * t1 / (t1 + t0), F.col("d0") + a * t0 / (t1 + t0)
    odds = F.log(y1 / (t1 + PRIOR - y1)) - F.log(y0 / (t0 + PRIOR - y0))
    sd = F.sqrt(1 / y1 + 1 / y0)
    # the side of the confidence interval that is nearer to no difference
    sure = F.signum(odds) * F.greatest(F.abs(odds) - Z * sd, F.lit(0.0))
    part = lambda n, share: F.when(n > 0, n * F.log(n / (F.col("d1") + F.col("d0")) / share)).otherwise(0.0)
    ratio = part(F.col("d1"), t1 / (t1 + t0)) + part(F.col("d0"), t0 / (t1 + t0))
    chance = math.log(max(1, totals[2]))  # exp(-ratio) bounds the chance of such counts
    kept = counts.where(tested & (ratio >= chance)).select("word", sure.alias("weight")).where(F.abs("weight") >= LEAST_WEIGHT)
    got = kept.toArrow()  # words of MIN_COUNT texts or more of at most MAX_LABELS
    tables.drop(counts)
    words = got.column("word").to_numpy().view(np.uint64)
    weight = np.clip(got.column("weight").to_numpy().astype(float), -0.5, 6.0)
    order = np.argsort(words)
    return words[order], weight[order]


def weigh(h: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.full(len(h), DRIFT)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, weights[at] + DRIFT, DRIFT)


def segments(w: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a weight sequence, left to right.

    The list of candidates is amortised linear; only positions with positive weight open one."""
    found: list[list[float]] = []  # start, end, sum before, sum after
    total = np.concatenate([[0.0], np.cumsum(w)])
    for i in np.flatnonzero(w > 0):
        start, left, right = int(i), float(total[i]), float(total[i + 1])
        end = int(i) + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right])
                break
            start, left = int(found[j][0]), found[j][2]
            del found[j:]
    return [(int(a), int(b), r - s) for a, b, s, r in found]


def _scan(model, keep_text):
    words, weights = model.value

    def scan(batches):
        for rows, h, of, starts, ends, offsets in _tokens(batches):
            w = weigh(h, words, weights)
            bounds = np.searchsorted(of, np.arange(rows.num_rows + 1))
            hot = np.bincount(of, weights=w > 0, minlength=rows.num_rows)
            out = []
            for i in range(rows.num_rows):
                a, b = bounds[i], bounds[i + 1]
                got = [s for s in segments(w[a:b]) if s[2] >= MIN_SEGMENT] if hot[i] else []
                out.append([{"start": int(starts[a + s] - offsets[i]), "end": int(ends[a + e - 1] - offsets[i]), "n_words": e - s, "score": float(x)} for s, e, x in got])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))
            names = [c for c in rows.schema.names if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(np.diff(bounds).astype(np.int64)), pa.array(out, kind)], names=[*names, "n_words", "passages"])

    return scan


PASSAGES = "n_words long, passages array<struct<start: long, end: long, n_words: long, score: double>>"


def scan(docs: DataFrame, weights, keep_text: bool = False) -> DataFrame:
    """Each row's other columns (and its text, if asked for), its number of words and its passages (byte offsets and scores).

    Columns of docs that have the names of results are replaced."""
    docs = docs.drop("n_words", "passages", "score")
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rest = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if keep_text or c != "text")
    return docs.mapInArrow(_scan(shared, keep_text), f"{rest}, {PASSAGES}")


def evidence(passages, n_words, lam: float, k: float):
    """Minus the log of the chance of passages at least as strong in clean text, as a Column."""
    tail = lambda x: F.least(F.lit(50.0), F.greatest(F.lit(0.0), lam * x["score"] - F.log(k * F.greatest(n_words, F.lit(1)))))
    return F.aggregate(passages, F.lit(0.0), lambda acc, x: acc + tail(x))


def train(labelled: DataFrame) -> dict:
    """The model of rows with doc_id, text and label; sizes are bounded by MAX_LABELS."""
    labelled = one_of_each(labelled, Tables(labelled.sparkSession))
    weights = token_weights(labelled)
    seen = scan(labelled.select("label", "text"), weights).select("label", "n_words", F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0)).alias("best"), "passages")
    clean = seen.where("label = 0 and n_words > 0 and best > 0").agg(F.avg("best"), F.stddev_samp("best"), F.avg(F.log("n_words")), F.count("*")).first()
    share = seen.where("label = 0 and n_words > 0").count()
    if clean[3] and clean[3] > 10 and clean[1]:
        lam = math.pi / (clean[1] * math.sqrt(6))
        k = math.exp(lam * clean[0] - 0.5772156649 - clean[2]) * clean[3] / max(1, share)
    else:
        lam, k = 1.0, 1e-4
    got = seen.select("label", evidence(F.col("passages"), F.col("n_words"), lam, k).alias("x")).groupBy("label", F.round("x", 1).alias("x")).count().toArrow()
    x, y, n = got.column("x").to_numpy().astype(float), got.column("label").to_numpy().astype(float), got.column("count").to_numpy().astype(float)
    beta = np.array([-3.0, 0.5])
    for _ in range(50):  # Newton steps with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(beta[0] + beta[1] * np.minimum(x, 20), -30, 30)))
        design = np.stack([np.ones_like(x), np.minimum(x, 20)])
        grad = design @ (n * (y - p)) - 1e-3 * beta
        hess = (design * (n * p * (1 - p))) @ design.T + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return {"weights": weights, "lambda": lam, "k": k, "beta": (float(beta[0]), float(beta[1]))}


def score(docs: DataFrame, model: dict, keep_text: bool = False) -> DataFrame:
    """Every row's other columns (and text) with n_words, passages and score (0 to 1)."""
    seen = scan(docs, model["weights"], keep_text)
    b0, b1 = model["beta"]
    x = F.least(F.lit(20.0), evidence(F.col("passages"), F.col("n_words"), model["lambda"], model["k"]))
    return seen.withColumn("score", 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * x))))
