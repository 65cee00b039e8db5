"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut into pieces. Pieces are range-sorted by length; as a
length is an integer of at most ``capacity``, the sorted pieces and the sorted gaps are runs
(length, count) and (gap, sequences), at most ``capacity`` of each kind whatever the input. A sweep
goes down the pieces and matches every run with its successor, the smallest gap that fits; where more
pieces than gaps meet, pieces win by rank; gaps are updated and the sweep goes on with the
next run. Only these runs are seen by the driver. The placements are joined back to the pieces by
length and rank; ranks come from salted counts, so no length is ranked in one task.

Null and empty texts hold the end token alone; empty tables give no rows; equal rows are packed one
by one; other input columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import Tables
from .words import LOWER, WORD, hashes, slices, spans

CAPACITY = 4096
END = 1
CACHE_WORDS = 1_200_000
LONGEST_MARK = 16  # marks at the end of a word that are cut off; longer runs stay with their words
RANK_ROWS = 50_000  # rows of one length that one window group ranks, on average

_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation, but for the ends of special tokens
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "|>"]] = True

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of white-space separated words, remembered between batches (bounded)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint16)

    def _any(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has, by the offsets of the tokens."""
        some = [w.decode() for w in words]
        got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
        begin = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
        place = np.searchsorted(begin, np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
        return np.array(got.ids, np.uint16), np.bincount(place, minlength=len(some)).astype(np.int32)

    def _runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: each is one run for the tokenizer, so its last token ends a run."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint16)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return self._any(words)
        return ids, np.diff(last, prepend=-1).astype(np.int32)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        raw = data.tobytes()
        # upper case differs for the tokenizer only within the marks of its special tokens
        h = hashes(data, starts, ends, np.arange(256, dtype=np.uint8) if b"<|" in raw else LOWER)
        words, first, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(words) > CACHE_WORDS:
            self.clear()
        place = np.searchsorted(self.keys, words)
        known = np.zeros(len(words), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == words
        new = np.flatnonzero(~known)
        if len(new):
            at = first[new]
            plain = _letters(data, starts[at], ends[at])
            ids, n, order = [], [], np.argsort(~plain, kind="stable")
            for part, call in ((at[plain], self._runs), (at[~plain], self._any)):
                for k in range(0, len(part), 2000):  # the tokenizer's own results are large
                    got = call([raw[starts[i] : ends[i]] for i in part[k : k + 2000]])
                    ids.append(got[0])
                    n.append(got[1])
            n = np.concatenate(n)
            at = len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, *ids])
            new = new[order]
            sort = np.argsort(new)
            place = np.searchsorted(self.keys, words)
            self.keys, self.at, self.n = (np.insert(a, place[new[sort]], b[sort]) for a, b in ((self.keys, words[new]), (self.at, at), (self.n, n)))
        place = np.searchsorted(self.keys, words)
        n = self.n[place][of].astype(np.int64)
        at = self.at[place][of]
        out = self.pool[np.arange(n.sum()) + np.repeat(at - np.cumsum(n) + n, n)]
        return out, n


def _latin(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a letter of ASCII or of U+00C0 to U+00FF."""
    out = _LETTER[data]
    pair = np.flatnonzero(data[:-1] == 0xC3)
    pair = pair[(data[pair + 1] | 0x20) != 0xB7]  # the signs of multiplication and division
    out[pair] = out[pair + 1] = True
    return out


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words hold nothing but such letters."""
    sums = np.concatenate([[0], np.cumsum(_latin(data))])
    return sums[ends] - sums[starts] == ends - starts


def _cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Takes the marks that end a word after a letter as a word of their own: always a token border."""
    at = np.flatnonzero(_MARK[data[ends - 1]])
    mark = ends[at] - 1
    for _ in range(LONGEST_MARK - 1):
        more = _MARK[data[mark - 1]] & (mark > starts[at])
        if not more.any():
            break
        mark -= more
    last, lead = data[mark - 1], data[mark - 2]
    good = (mark > starts[at]) & (_LETTER[last] | ((mark > starts[at] + 1) & (lead == 0xC3) & ((last | 0x20) != 0xB7)))
    at, mark = at[good], mark[good]
    e = ends.copy()
    e[at] = mark
    return np.insert(starts, at + 1, mark), np.insert(e, at + 1, ends[at]), np.insert(of, at + 1, of[at])


def _pieces(path: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for rows, data, offsets in slices(batches):
            starts, ends, of = spans(data, offsets)
            ids, n = encoder.encode(data, *(cut := _cuts(data, starts, ends, of))[:2]) if len(starts) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
            per = np.bincount(cut[2], weights=n, minlength=rows.num_rows).astype(np.int64) if len(starts) else np.zeros(rows.num_rows, np.int64)
            ends_at = np.cumsum(per)
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(rows.num_rows):
                own = np.append(ids[ends_at[i] - per[i] : ends_at[i]].astype("<u4"), np.uint32(END)).astype("<u4")
                for k in range(0, len(own), capacity):
                    part = own[k : k + capacity]
                    row.append(i), piece.append(k // capacity), start.append(k), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of runs (length, count): placements (length, first rank, last rank, first sequence, per sequence, offset)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    order: list[int] = []
    out, opened = [], 0

    def add(gap: int, first: int, n: int):
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for length, n in sorted(counts, reverse=True):
        rank = 0
        while rank < n:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                per = capacity // length
                full, rest = divmod(n - rank, per)
                out.append((length, rank, n - 1, opened, per, 0))
                add(capacity - per * length, opened, full)
                add(capacity - rest * length, opened + full, 1 if rest else 0)
                opened += full + bool(rest)
                break
            gap = order[k]
            first, many = gaps[gap].pop()
            take = min(many, n - rank)
            if take < many:
                gaps[gap].append((first + take, many - take))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            out.append((length, rank, rank + take - 1, first, 1, capacity - gap))
            add(gap - length, first, take)
            rank += take
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    tables = Tables(spark)
    cut = tables.put(pieces(docs, path, capacity))
    runs = [(r.length, r.n) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most `capacity` rows
    salts = max(1, max((n for _, n in runs), default=0) // RANK_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = base.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    inner = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("inner", F.row_number().over(inner) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inner"))
    plan = spark.createDataFrame(sweep(runs, capacity), "length long, lo long, hi long, first long, per long, gap_at long")
    placed = ranked.join(F.broadcast(plan), "length").where("rank between lo and hi")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("first + (rank - lo) div per").alias("sequence_id"),
        F.expr("gap_at + pmod(rank - lo, per) * length").alias("offset"),
    )
