"""Importance resampling towards a target distribution, over hashed word n-grams.

* Features are all runs of 1 to 3 words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.
* The CRC of a span is linear: it is the XOR of what each byte contributes at its distance from the span's
  end, and of a constant of the span's length. Contributions stand in a table (distance, byte), so all features of a
  slice of texts are hashed by one gather and one ``bitwise_xor.reduceat``. Spans longer than the table
  are cut into blocks from their end and folded: what came before is moved by one block (four more lookups), then XORed.
* Bucket counts of all documents and of all target texts give each bucket a gain, the log ratio in thousandths.
  A document's weight is the sum of its features' gains; with Gumbel noise from a digest of its id
  the highest scores are a draw without replacement in proportion to the weights.
* Ranks come from one range partitioning by score: places inside a partition plus the sizes of those before it.

The texts are read twice (counts, weights) and never shuffled; only the counts (``BUCKETS`` numbers) reach the driver.

Null and empty texts, and texts without words, have no features, weight 0, and are never drawn; a null doc_id has
the noise of an empty id and comes last among ties; repeated rows count each, and each may be drawn; very long texts and words are
hashed whole; an empty target gives gains from its zero counts; an empty table gives no rows; other columns stay, but those
with the names of results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import Tables, prepare
from .words import LOWER, slices, spans

BUCKETS = 10_000
WIDTHS = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
BLOCK = 256  # bytes of a block: distances in the table
GATHER = 1 << 20  # bytes that are gathered at once
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected

WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _contributions() -> np.ndarray:
    """(distance from the end, byte): the register after that byte and so many zero bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = first >> np.uint32(1) ^ np.uint32(POLYNOMIAL) * (first & np.uint32(1))
    table = np.empty((BLOCK, 256), np.uint32)
    table[0] = first
    for d in range(1, BLOCK):
        table[d] = table[d - 1] >> np.uint32(8) ^ first[table[d - 1] & np.uint32(255)]
    return table


_TABLE = _contributions()
_FLAT = _TABLE.ravel()
#: of a register's four bytes (lowest first), what BLOCK zero bytes make of them: its lowest byte is the next to leave
_MOVED = _TABLE[BLOCK - 4 :][::-1]
_LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK * 4)], np.uint32)


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC of so many zero bytes."""
    out = _LENGTHS[np.minimum(lengths, len(_LENGTHS) - 1)]
    for n in np.unique(lengths[lengths >= len(_LENGTHS)]).tolist():
        out[lengths == n] = zlib.crc32(bytes(n))
    return out


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions of spans of 1 to BLOCK bytes."""
    out = np.empty(len(starts), np.uint32)
    size = ends - starts
    upto = np.cumsum(size)
    lo = 0
    while lo < len(starts):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + GATHER, "right")))
        n = size[lo:hi]
        last = (upto[lo:hi] - before).astype(np.int32)
        at = np.arange(last[-1], dtype=np.int32)
        place = np.repeat(last - 1, n) - at  # distance from the end
        place <<= 8
        place |= data[at + np.repeat((starts[lo:hi] - (last - n)).astype(np.int32), n)]
        out[lo:hi] = np.bitwise_xor.reduceat(_FLAT[place], last - n)
        lo = hi
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each (non-empty) span of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    size = ends - starts
    blocks = (size + BLOCK - 1) // BLOCK
    if int(blocks.max()) == 1:
        return _pieces(data, starts, ends) ^ _length_constants(size)
    first = np.cumsum(blocks) - blocks
    span = np.repeat(np.arange(len(starts)), blocks)
    after = blocks[span] - 1 - (np.arange(len(span)) - first[span])  # whole blocks between the piece and the end
    end = ends[span] - after * BLOCK
    piece = _pieces(data, np.maximum(starts[span], end - BLOCK), end)
    out = piece[first]
    k, long = 1, np.flatnonzero(blocks > 1)
    while len(long):
        held = out[long]
        moved = piece[first[long] + k]
        for j in range(4):
            moved ^= _MOVED[j][held >> np.uint32(8 * j) & np.uint32(255)]
        out[long] = moved
        k += 1
        long = long[blocks[long] > k]
    return out ^ _length_constants(size)


def _features(batches: Iterator[pa.RecordBatch]):
    """Per slice: its rows, words of each row, and for each width the rows and buckets of the features."""
    for rows, data, offsets in slices(batches):
        starts, ends, of = spans(data, offsets, WORD)
        size = ends - starts
        at = np.cumsum(size + 1) - size - 1  # the words again, one space after each
        joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
        inside = np.arange(int(size.sum()))
        shift = np.cumsum(size) - size
        joined[inside + np.repeat(at - shift, size)] = LOWER[data[inside + np.repeat(starts - shift, size)]]
        found = []
        for width in range(1, WIDTHS + 1):
            n = len(of) - width + 1
            if n < 1:
                break
            whole = np.flatnonzero(of[:n] == of[width - 1 :])
            last = whole + width - 1
            found.append((of[whole], crc32_spans(joined, at[whole], at[last] + size[last])))
        yield rows, np.bincount(of, minlength=rows.num_rows), found


def _count(buckets: int):
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, found in _features(batches):
            for _, crc in found:
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Features of all texts in each bucket that has any: bucket, n."""
    prepare(texts.sparkSession)
    return texts.select("text").mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of every bucket, the log ratio of its (smoothed) share in target to that in docs, in whole thousandths."""
    counts = []
    for texts in (docs, target):
        n = np.zeros(buckets, np.float64)
        for r in bucket_counts(texts, buckets).collect():  # at most ``buckets`` rows
            n[r.bucket] = r.n
        counts.append(n)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(shared, keep):
    def weigh(batches):
        gains = shared.value
        for rows, words, found in _features(batches):
            n = np.zeros(rows.num_rows, np.int64)
            weight = np.zeros(rows.num_rows)  # sums of whole numbers, exact in doubles
            for of, crc in found:
                n += np.bincount(of, minlength=rows.num_rows)
                weight += np.bincount(of, weights=gains[crc % np.uint32(len(gains))], minlength=rows.num_rows)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight.astype(np.int64))], names=[*keep, "n_words", "n_features", "weight"])

    return weigh


RESULTS = ["n_words", "n_features", "weight", "score", "rank"]


def importance(docs: DataFrame, gains: np.ndarray, keep_text: bool = False) -> DataFrame:
    """Each row's other columns (and its text, if asked for) with n_words, n_features and weight."""
    docs = docs.drop(*RESULTS)
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if keep_text or c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    kind = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL("n_words long, n_features long, weight long")])
    return docs.mapInArrow(_weigh(shared, keep), kind)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, keep_text: bool = False) -> DataFrame:
    """All docs (columns doc_id and text) with n_words, n_features, weight, score and rank.

    Of the N rows with ``least_words`` words or more the floor(percent * N / 100) highest scores are drawn and have a rank from 1 on."""
    spark = docs.sparkSession
    tables = Tables(spark)
    docs = docs.drop(*RESULTS)
    # the row travels as one column, so its names can't meet those of the work
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"]).alias("row")
    weighed = importance(docs.select(row, "doc_id", "text"), bucket_gains(docs, target, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = tables.put(weighed.withColumn("score", (F.col("weight") + noise).cast("long")))  # range partitioning reads it twice
    # rows that may be drawn first; the position of a row is its partition (upper bits) and its place in it (lower 33 bits)
    order = [F.expr(f"n_words < {least_words}"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    in_order = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = tables.put(in_order.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted(placed.groupBy(part).agg(F.count("*"), F.count_if(F.expr(f"n_words >= {least_words}"))).collect())  # one row a partition
    drawn = percent * sum(r[2] for r in sizes) // 100
    base, before = [], 0
    for p, n, _ in sizes:
        base.append((p, before))
        before += n
    ranked = placed.select("*", part).join(F.broadcast(spark.createDataFrame(base, "part long, before long")), "part")
    rank = F.col("before") + F.expr("at & ((1L << 33) - 1)") + 1
    return ranked.select("row.*", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).cast("long").alias("rank"))
