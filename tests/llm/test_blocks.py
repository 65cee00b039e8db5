"""Keys in blocks against plain sums."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from bilateral.llm import blocks
from pyspark.sql import functions as F


def _work(batches):
    for t in batches:
        a = t.column("a").to_numpy().view(np.uint64)
        yield a, a % np.uint64(3), np.ones(len(a), np.int64)


@pytest.mark.parametrize("buckets, gathered", [(1, 1_000_000), (7, 10), (50, 200)])
def test_counted(spark, monkeypatch, buckets, gathered):
    monkeypatch.setattr(blocks, "GATHERED", gathered)
    blocks_of = lambda df, least: blocks.counted(df, _work, buckets, least, blocks.keyed, "key long, context long, suffix long, n long").collect()
    df = spark.range(0, 5000, 1, 9).select(F.when(F.col("id") % 3 == 0, 11).otherwise(F.col("id") % 700).alias("a"))  # a third are one key
    want = Counter(r.a for r in df.collect())
    for least in (1, 8):
        got = blocks_of(df, least)
        assert {r.context: r.n for r in got} == {a: n for a, n in want.items() if n >= least}
        assert len(got) == len({r.context for r in got}) and all(r.suffix == r.context % 3 for r in got)
    assert blocks_of(df.limit(0), 1) == []


def test_round_trip():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, 100).astype(np.uint64), rng.random(100)
    for n in (0, 1, 100):
        got = blocks.arrays(blocks.block(x[:n], np.arange(n, dtype=np.uint32), y[:n]), "u8", "u4", "f8")
        assert all(np.array_equal(g, w) for g, w in zip(got, (x[:n], np.arange(n), y[:n]), strict=True))


def test_buckets_rise_with_keys():
    key = np.sort(np.random.default_rng(2).integers(0, 1 << 64, 1000, dtype=np.uint64))
    at = blocks.bucket_of(key, 13)
    assert (np.diff(at) >= 0).all() and set(at) == set(range(13))


def test_keys_are_found_by_their_highest_bits():
    from bilateral.llm.suffix_tree import _Keys

    rng = np.random.default_rng(5)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.append(rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2), [top] if n == 2 else []).astype(np.uint64)) if n else np.zeros(0, np.uint64)
        wanted = np.concatenate([keys, keys + np.uint64(1), np.array([0, top, 5], np.uint64)])
        at = {int(k): i for i, k in enumerate(keys)}
        assert _Keys(keys).find(wanted).tolist() == [at.get(int(w), -1) for w in wanted]


def test_words_know_their_rows():
    from bilateral.llm.words import spans, text_bytes

    texts = ["", "a b", None, " ", "c", "", "d  e f ", ""]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    assert spans(data, offsets)[2].tolist() == [i for i, t in enumerate(texts) for _ in (t or "").split()]


def test_hashing_holds_a_piece_at_a_time():
    import tracemalloc

    from bilateral.llm import words

    data = np.frombuffer(b"some words of a long text and " * 140_000, np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]))
    small = words.hashes(data[:30], starts[:7], ends[:7])
    words.hashes(data[: 1 << 19], starts[:1000], ends[:1000])  # the powers are kept
    tracemalloc.start()
    got = words.hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got.reshape(-1, 7), np.broadcast_to(small, (140_000, 7)))
    assert peak < 6 * len(data)  # all at once it held over 30 bytes a byte
    long = np.frombuffer(b"x" * (words.PIECE + 5) + b" y", np.uint8)
    one = words.hashes(long, *words.spans(long, np.array([0, len(long)]))[:2])
    assert len(set(one.tolist())) == 2 and one[1] == words.hashes(long[-1:], np.array([0]), np.array([1]))[0]


def test_words_reach_the_tokenizer_once_without_the_marks_that_end_them():
    import random

    from bilateral.llm import packing as P
    from bilateral.llm.queries import _tokenizer
    from bilateral.llm.words import spans, text_bytes

    encoder = P.Encoder(_tokenizer())

    def ids(texts):
        data, offsets = text_bytes(pa.array(texts))
        starts, ends, of = spans(data, offsets)
        starts, ends, of = P._cuts(data, starts, ends, of)
        got, n = encoder.encode(data, starts, ends)
        return np.split(got, np.cumsum(np.bincount(of, weights=n, minlength=len(texts)).astype(int))[:-1])

    ids(["wort### café### wort! café! wort. café."])
    assert len(encoder.keys) == 2 + 3  # two words, three runs of marks
    rng, parts = random.Random(3), ["a", "B", "é", "É", "ß", "×", "÷", "ş", "Σ", "é", "1", "½", "'s", ".", "##", "|", ">", "<", "<|endoftext|>", "=", "≠", "…", "中", " ", "!" * 30, " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    for t, got in zip(texts, ids(texts), strict=True):
        assert got.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
