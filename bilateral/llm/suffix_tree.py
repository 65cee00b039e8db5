"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of 1 to ``DEPTH`` words. A context's next-symbol counts are gathered over all
training texts; an entry (context, next word) is retained when it was seen ``LEAST_PAIR`` times or more after a context seen
``LEAST_CONTEXT`` times or more and passes a divergence test: c(context, word) * ln(P(word | context) / P(word | shorter
context)) reaches ``GAIN``. The tree is closed: an entry of a longer context needs its context to be an entry and the entry
of the shorter context to be retained. None of these constants depends on the input's size, and what passes is kept whole.
Retained counts are discounted and the freed mass goes to the shorter context, so every state has a proper distribution:

    P(w | s) = (c(s, w) - d) / N(s) [if retained] + back(s) * P(w | suffix of s)

down to the add-half unigram distribution of the base score. A word is scored from the state of the
longest suffix of what stands before it. The logarithm of that is a sum over the grams of a text: log back(s) for each
state s that a word follows, and log(1 + share / (back * P of the suffix)) for each retained entry. So a text's score is its
base score plus the values of its grams, looked up in tables.

The tree is a table of grams (64-bit hashes) and values. The most frequent words and grams (at most ``HOT_WORDS`` and
``HOT_GRAMS`` a level) are sent to every task, and a Bloom filter of fixed size names all grams: the occurrences of the others
meet the rest of the table in buckets of keys, in blocks of one slice of texts each, and each slice gets its answers back. Where the line runs changes no result.

Null and empty texts are a lone end token; rows with a null doc_id train (their id counts as ''); repeated rows count each;
very long texts are read whole; without training texts N and V are 0 and every token is unknown; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import joined
from .ngram_join import bloom_of, in_bloom
from .tables import Tables, hot_and_rest
from .words import hashes, mix, signed, slices, spans

DEPTH = 3
GAIN = 8.0
LEAST_CONTEXT = 2
LEAST_PAIR = 2
DISCOUNT = 0.5
HOT_WORDS = 500_000
HOT_GRAMS = 500_000
FILTER_BITS = 1 << 26  # 8 MB
SLICE = 2 << 20  # bytes of text that are scored at a time
COUNT_SLICE = 1 << 19  # and counted
COUNT_BUCKET = 1_000_000  # training tokens for each bucket of counted grams
WORD_BIT = np.uint32(1 << 31)
ASK_BUCKET = 2_000_000  # and for each bucket of looked-up ones
END = mix(np.array([1], np.uint64))[0]


def _tokens(batches, limit: int = COUNT_SLICE):
    """Rows with token hashes (an end after each text), their number by row, and each one's place in its text."""
    for rows, data, offsets in slices(batches, limit=limit):
        starts, ends, of = spans(data, offsets)
        h = np.full(len(starts) + rows.num_rows, END, np.uint64)
        h[np.arange(len(starts)) + of] = hashes(data, starts, ends)
        n = np.bincount(of, minlength=rows.num_rows) + 1
        yield rows, h, n, np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)


def longer(g: np.ndarray) -> np.ndarray:
    """Grams one word longer: that of all words but the last, then that of all but the first."""
    return joined(np.concatenate([np.zeros(1, np.uint64), g[:-1]]) if len(g) else g, g)


def _count(batches):
    for _, h, _, _ in _tokens(batches):
        words, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(words), pa.array(n)], names=["word", "n"])


class _Keys:
    """Sorted keys, with the place at which each range of their highest bits begins: they are uniform hashes, so a range has few."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.begin = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(self.begin, append=len(keys)).max())

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        at = self.begin[wanted >> self.shift].astype(np.int64)
        for _ in range(self.most):
            at += self.keys.take(at, mode="clip") < wanted
        return np.where((self.keys.take(at, mode="clip") == wanted) & (at < len(self.keys)), at, -1)


def _sorted(df: DataFrame, key: str, *columns: str) -> tuple[np.ndarray, ...]:
    """A bounded table as arrays, sorted by its (unsigned) key."""
    got = df.select(key, *columns).toArrow()
    keys = got.column(key).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], *(got.column(c).to_numpy()[order] for c in columns)


def _counted(a: np.ndarray, b: np.ndarray):
    """Each different (a, b) with its number of rows."""
    return blocks.added(a, b, np.ones(len(a), np.int64))[1:]


def _pairs(shared):
    """Pairs of words that occur more than once: two frequent words as one number (b = 0), others as two hashes."""

    def pairs(batches):
        (words, _), twice = shared.value
        words = _Keys(words)
        for _, h, _, place in _tokens(batches):
            at = np.flatnonzero(place)
            found = words.find(h)
            c, w = found[at - 1], found[at]
            hot = (c >= 0) & (w >= 0)
            more = at[~hot & in_bloom(twice, h[at]) & in_bloom(twice, h[at - 1])]
            a = np.concatenate([(c[hot] << 32 | w[hot]).view(np.uint64), h[more - 1]])
            yield _counted(a, np.concatenate([np.zeros(int(hot.sum()), np.uint64), h[more]]))

    return pairs


def _named(shared):
    """(key, context, word, total, own, n) of pairs; the counts of words are 0 where they aren't frequent."""

    def named(a, b, n):
        words, count = shared.value[0]
        places = _Keys(words)
        hot = b == 0
        c, w = a.copy(), b.copy()
        if hot.any():
            c[hot], w[hot] = words[a[hot] >> np.uint64(32)], words[a[hot] & np.uint64(0xFFFFFFFF)]
        total, own = (np.where(x >= 0, count[np.maximum(x, 0)] if len(count) else 0, 0) for x in (places.find(c), places.find(w)))
        return pa.RecordBatch.from_arrays([signed(joined(c, w)), signed(c), signed(w), pa.array(total), pa.array(own), pa.array(n)], names=["key", "context", "word", "total", "own", "n"])

    return named


def _grams(shared, depth: int):
    """Grams of depth + 1 words, as those of the first and of the last ``depth``, where both may be retained entries."""

    def grams(batches):
        for _, h, _, place in _tokens(batches):
            g = h
            for _ in range(depth - 1):
                g = longer(g)
            there = in_bloom(shared.value, g) & (place >= depth - 1)
            at = np.flatnonzero(there[1:] & there[:-1] & (place[1:] >= depth)) + 1
            yield _counted(g[at - 1], g[at])

    return grams


def retained(candidates: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Entries (key, n, p, value) that pass the test, and (context, back), from (key, context, total, n, low): how often the
    context stands, the entry stands, and P(word | shorter context)."""
    test = F.col("n") * F.log(F.col("n") / F.col("total") / F.col("low"))
    kept = tables.put(candidates.where((F.col("total") >= LEAST_CONTEXT) & (test >= GAIN)).withColumn("share", (F.col("n") - DISCOUNT) / F.col("total")).select("key", "context", "n", "share", "low"))
    backs = tables.put(kept.groupBy("context").agg(F.greatest(F.lit(1e-6), 1 - F.sum("share")).alias("back")))
    rest = F.col("back") * F.col("low")
    entries = kept.join(backs, "context").select("key", "n", (F.col("share") + rest).alias("p"), F.log10((F.col("share") + rest) / rest).alias("value"))
    entries = tables.put(entries)
    tables.drop(kept)
    return entries, backs


def train(docs: DataFrame, tables: Tables, depth: int | None = None) -> dict:
    """The tree of training texts: total and kinds of tokens, ``words`` (word, n, value) and for each depth ``levels`` (key, n, value).

    The value of a word or gram is what each of its occurrences adds to a score (beside the word's base score)."""
    sc = docs.sparkSession.sparkContext
    text = docs.select("text")
    counts = tables.put(text.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    scale = (total or 0) + 0.5 * (kinds + 1)
    tables.release()

    hot, _ = hot_and_rest(counts, "n", HOT_WORDS)
    shared = sc.broadcast((_sorted(hot, "word", "n"), bloom_of(counts.where(F.col("n") >= LEAST_PAIR).select("word"), FILTER_BITS)))
    buckets = 1 + (total or 0) // COUNT_BUCKET
    found = blocks.counted(text, _pairs(shared), buckets, LEAST_PAIR, _named(shared), "key long, context long, word long, total long, own long, n long")
    found = tables.put(found)
    tables.release()
    base = lambda c: (F.col(c) + 0.5) / scale
    columns = ("key", "context", "total", "n", base("own").alias("low"))
    known = found.where("total > 0 and own > 0").select(*columns)
    context = found.where("total = 0").drop("total").join(counts.toDF("context", "total"), "context")
    context = context.unionByName(found.where("total > 0 and own = 0"))
    both = context.where("own > 0").select(*columns)
    word = context.where("own = 0").drop("own").join(counts.toDF("word", "own"), "word").select(*columns)
    entries, backs = retained(known.union(both).union(word), tables)
    tables.drop(found)

    log_back = lambda df, name: df.select(F.col("context").alias(name), F.log10("back").alias("lb"))
    words = tables.put(counts.join(log_back(backs, "word"), "word", "left").select("word", "n", F.coalesce("lb", F.lit(0.0)).alias("value")))
    tables.drop(counts, backs)
    tables.release()
    tree = {"total": total or 0, "scale": scale, "words": words, "levels": []}
    for d in range(2, (depth or DEPTH) + 1):
        bloom = sc.broadcast(bloom_of(entries.select("key"), FILTER_BITS))
        counted = tables.put(blocks.counted(text, _grams(bloom, d), buckets, LEAST_PAIR, blocks.keyed, "key long, context long, suffix long, n long"))
        tables.release()
        got = counted.join(entries.select(F.col("key").alias("suffix"), F.col("p").alias("low")), "suffix").join(entries.select(F.col("key").alias("context"), F.col("n").alias("total")), "context")
        more, backs = retained(got.select("key", "context", "total", "n", "low"), tables)
        valued = entries.join(log_back(backs, "key"), "key", "left").select("key", "n", (F.col("value") + F.coalesce("lb", F.lit(0.0))).alias("value"))
        tree["levels"].append(tables.put(valued))
        tables.drop(counted, entries, backs)
        tables.release()
        entries = more
    tree["levels"].append(entries.select("key", "n", "value"))
    return tree


DOCS = ("doc_id", "held_out", "n_tokens", "known", "base", "gain")
DOC_TYPES = "doc_id: long, held_out: boolean, n_tokens: long, known: long, base: double, gain: double"


def _score(shared, buckets: int):
    """For each slice of texts a row with its documents and what the frequent words and grams give, and for each bucket a row
    with its other words and grams as a block (row in the slice, gram), a word's row with its highest bit set."""

    def score(batches):
        (words, count, back), levels, every, scale = shared.value
        words, levels = _Keys(words), [(_Keys(keys), value) for keys, value in levels]
        narrow = np.uint16 if buckets <= 1 << 16 else np.int32
        for rows, h, n, place in _tokens(batches, SLICE):
            row = np.repeat(np.arange(rows.num_rows), n)
            at = words.find(h)
            known = at >= 0
            add = lambda v, of=None: np.bincount(row if of is None else row[of], weights=v, minlength=rows.num_rows)  # noqa: E731, B023
            base = np.where(known, np.log10((count[np.maximum(at, 0)] + 0.5) / scale), 0) if len(count) else np.zeros(len(h))
            gain = add(np.where(known, back[np.maximum(at, 0)], 0) if len(back) else np.zeros(len(h)))
            g, asked, of = h, [h[~known]], [row[~known].astype(np.uint32) | WORD_BIT]
            for d, (keys, value) in enumerate(levels, 1):
                g = longer(g)
                inside = np.flatnonzero(place >= d)
                inside = inside[in_bloom(every, g[inside])]
                at = keys.find(g[inside])
                if len(value):
                    gain += add(np.where(at >= 0, value[np.maximum(at, 0)], 0), inside)
                ask = inside[at < 0]
                asked.append(g[ask]), of.append(row[ask].astype(np.uint32))
            asked, of = np.concatenate(asked), np.concatenate(of)
            bucket = blocks.bucket_of(asked, buckets).astype(narrow)
            order = np.argsort(bucket, kind="stable")
            asked, of = asked[order], of[order]
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edge))
            sent = [blocks.block(of[i:j], asked[i:j]) for i, j in zip(edge[full], edge[full + 1], strict=True)]
            docs = [rows.column("doc_id"), rows.column("held_out"), pa.array(n), pa.array(add(known).astype(np.int64)), pa.array(add(base)), pa.array(gain)]
            ends = pa.array(np.minimum(np.arange(len(full) + 2), 1) * rows.num_rows, pa.int32())  # the first row has them all
            docs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(docs, names=DOCS))
            here = pa.array(np.full(len(full) + 1, rows.column("rid")[0].as_py()))
            yield pa.RecordBatch.from_arrays([here, docs, pa.array([None, *full.tolist()], pa.int32()), pa.array([None, *sent], pa.binary())], names=["slice", "docs", "bucket", "block"])

    return score


def _answer(scale: float):
    """Blocks (row, value of its grams) and (row, number and base of its known words) for the asks of a bucket."""

    def answer(key, asks, values):
        keys = values.column("key").to_numpy().view(np.uint64)
        kind = values.column("is_word").to_numpy().astype(bool)
        word, gram = ((keys[m][o], values.column("value").to_numpy()[m][o], values.column("n").to_numpy()[m][o]) for m in (kind, ~kind) for o in [np.argsort(keys[m])])
        words, grams = _Keys(word[0]), _Keys(gram[0])
        out = []
        for data in asks.column("block").to_pylist():
            of, h = blocks.arrays(data, "u4", "u8")
            is_word, of = of >= WORD_BIT, of & ~WORD_BIT
            add = lambda at, v: np.bincount(at, weights=v, minlength=int(of.max()) + 1).astype(float)  # noqa: E731, B023  (of nothing it gives integers)
            at = grams.find(h[~is_word])
            more = add(of[~is_word][at >= 0], gram[1][at[at >= 0]])
            at = words.find(h[is_word])
            more += add(of[is_word][at >= 0], word[1][at[at >= 0]])
            n = np.where(at >= 0, word[2][at], 0) if len(word[0]) else np.zeros(len(at))
            known, base = add(of[is_word], n > 0), add(of[is_word], np.log10((n + 0.5) / scale))
            rows = np.flatnonzero(more).astype(np.uint32), np.flatnonzero(base).astype(np.uint32)
            out.append((blocks.block(rows[0], more[rows[0]]), blocks.block(rows[1], known[rows[1]].astype(np.uint32), base[rows[1]])))
        return pa.table({"slice": asks.column("slice"), "bucket": asks.column("bucket"), "grams": pa.array([x for x, _ in out], pa.binary()), "words": pa.array([x for _, x in out], pa.binary())})

    return answer


def _whole(total: int):
    def whole(key, docs, answers):
        docs = pa.Table.from_struct_array(pa.chunked_array([x.flatten() for x in docs.column("docs").chunks]))
        n = docs.num_rows
        known, base, gain = (docs.column(c).to_numpy().copy() for c in ("known", "base", "gain"))
        more = np.zeros(n)
        for t in answers.sort_by("bucket").select(["grams", "words"]).to_pylist():
            at, value = blocks.arrays(t["grams"], "u4", "f8")
            more[at] += value
            at, count, value = blocks.arrays(t["words"], "u4", "u4", "f8")
            known[at] += count
            base[at] += value
        columns = [docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(base + gain + more)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return whole


def score(docs: DataFrame, held_out, depth: int | None = None) -> DataFrame:
    """Scores every row of docs; ``held_out`` is a Column that is true for rows which don't train."""
    spark = docs.sparkSession
    tables = Tables(spark)
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    tree = train(marked.where("not held_out"), tables, depth)
    hot, rare = hot_and_rest(tree["words"], "n", HOT_WORDS)
    levels, rest = [], None
    for level in tree["levels"]:
        often, others = hot_and_rest(level, "n", HOT_GRAMS)
        levels.append(_sorted(often, "key", "value"))
        rest = others if rest is None else rest.union(others)
    bloom = bloom_of(functools.reduce(DataFrame.union, [level.select("key") for level in tree["levels"]]), FILTER_BITS)
    shared = spark.sparkContext.broadcast((_sorted(hot, "word", "n", "value"), levels, bloom, tree["scale"]))
    buckets = 1 + tree["total"] // ASK_BUCKET
    seen = marked.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _score(shared, buckets), f"slice long, docs array<struct<{DOC_TYPES}>>, bucket int, block binary"
    )
    seen = tables.put(seen)  # fixes the slices
    tables.release()
    asks = seen.where("bucket is not null").select("slice", "bucket", "block")
    key = F.col("key")
    values = rare.select(F.col("word").alias("key"), "n", "value", F.lit(True).alias("is_word")).union(rest.select("key", F.lit(0).cast("long"), "value", F.lit(False)))
    bucket = F.shiftright(F.shiftrightunsigned(key, 32) * buckets, 32).cast("int").alias("bucket")
    values = values.select(bucket, "key", "n", "value", "is_word")
    answers = asks.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_answer(tree["scale"]), "slice long, bucket int, grams binary, words binary")
    whole = seen.where("bucket is null").select("slice", "docs").groupBy("slice").cogroup(answers.groupBy("slice"))
    return whole.applyInArrow(_whole(tree["total"]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
