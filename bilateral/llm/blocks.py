"""Tables of 64-bit keys that are shuffled in blocks.

A task gathers what it has counted, adds up equal keys, and sends one row for each bucket of keys: (bucket, block), a block being
its arrays one after the other. Buckets are ranges of a uniform hash, and their number follows the input, so a bucket has about as
many different keys at every size; a key that is frequent everywhere is one entry in each block. Blocks of a bucket are added up as they arrive.

Empty tables give no block; equal keys are added up, in whatever tasks they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix, signed

GATHERED = 300_000  # entries that a task holds before it sends or adds up
SENT = 100_000  # rows of results that a task hands to Spark at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _STEP + b)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the key (a uniform hash); it rises with the key."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def block(*arrays: np.ndarray) -> bytes:
    """Arrays of equal lengths, byte by byte of their numbers (equal bytes stand together and compress)."""
    return b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in map(np.ascontiguousarray, arrays))


def arrays(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of a block, given their types."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, raw, at, out = len(data) // sum(sizes), np.frombuffer(data, np.uint8), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def added(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, a, b, n), sorted by key = joined(a, b), one for each different (a, b)."""
    key = joined(a, b)
    order = np.argsort(key)  # equal keys are added up, in any order
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], first) if len(first) else n[:0]
    return key[first], a[order][first], b[order][first], total


def _sent(work: Callable, buckets: int, gathered: int):
    def sent(batches: Iterator[pa.RecordBatch]):
        held, rows = [], 0

        def flush():
            key, a, b, n = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            edge = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edge))
            blocks = [block(a[i:j], b[i:j], n[i:j]) for i, j in zip(edge[full], edge[full + 1], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for a, b, n in work(batches):
            held.append((a, b, n.astype(np.int64)))
            rows += len(a)
            if rows >= gathered:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return sent


def _met(least: int, result: Callable, gathered: int):
    def met(batches: Iterator[pa.RecordBatch]):
        now, held, rows = None, [], 0

        def total():
            return added(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def kept():
            _, a, b, n = total()
            enough = n >= least
            found = result(a[enough], b[enough], n[enough])
            return (found.slice(at, SENT) for at in range(0, found.num_rows, SENT))

        for t in batches:
            for at, data in zip(t.column("bucket").to_pylist(), t.column("block").to_pylist(), strict=True):
                if at != now and held:
                    yield from kept()
                    held, rows = [], 0
                now = at
                held.append(tuple(arrays(data, "u8", "u8", "i8")))
                rows += len(held[-1][0])
                if rows >= 2 * gathered:
                    held = [total()[1:]]
                    rows = len(held[0][0]) // 2  # adds up again once as much has come
        if held:
            yield from kept()

    return met


def counted(rows: DataFrame, work: Callable, buckets: int, least: int, result: Callable, schema: str) -> DataFrame:
    """Sums of the (a, b, n) that ``work`` makes of batches of rows, for each (a, b) whose sum reaches ``least``, as the rows that
    ``result`` makes of arrays a, b and n."""
    sent = rows.mapInArrow(_sent(work, buckets, GATHERED), "bucket int, block binary")
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_met(least, result, GATHERED), schema)


def keyed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([signed(joined(a, b)), signed(a), signed(b), pa.array(n)], names=["key", "context", "suffix", "n"])
