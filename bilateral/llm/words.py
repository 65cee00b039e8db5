"""Vectorised words and shingles of Arrow string columns.

Everything here works on the bytes of a slice of an Arrow batch with whole-array numpy
operations, so a task spends a few nanoseconds per byte and holds some tens of bytes per
byte of the current slice (at most ``SLICE_BYTES``, or one document when that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
PIECE = 1 << 18  # bytes that are hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words of letters and digits only: ASCII punctuation separates as well
PLAIN_WORD = WORD.copy()
PLAIN_WORD[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = False

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= PIECE + 1:
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null counts as empty text."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches between rows into slices of about ``limit`` bytes: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows, at + 20_000)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it belongs to."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each byte span (ordered, none in another): a polynomial over the (folded) bytes, then mixed.

    Spans are hashed in pieces of ``PIECE`` bytes (or one longer span), as a byte takes some 30 bytes meanwhile."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        out[at:end] = _piece_hashes(data[lo : ends[end - 1]], starts[at:end] - lo, ends[at:end] - lo, fold)
        at = end
    return out


def _piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    n = len(data)
    values = fold[data].astype(np.uint64)
    values += np.uint64(1)
    values *= _power("up", _BASE, max(n, 1))[:n]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", _INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row, in order, and how many each row has.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    n = len(words)
    total = np.zeros(n, dtype=np.uint64)
    tail = np.zeros(n, dtype=np.uint64)  # of the words from i to the end of a short row
    factor = np.uint64(0xA0761D6478BD642F)
    with np.errstate(over="ignore"):
        for k in range(width):
            total *= factor
            total[: n - k if n >= k else 0] += words[k:]
    ends = np.cumsum(counts)
    begins = ends - counts
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    keep = np.ones(n, dtype=bool)
    for k in range(1, width):  # the last width - 1 places start no full run
        at = ends - k
        keep[at[(counts >= width) | (k < counts)]] = False
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in words[begins[i] : ends[i]]:
                h = h * factor + w
            total[begins[i]] = h + np.uint64(counts[i]) * np.uint64(0xE7037ED1A0B428DB)
    del tail
    return mix(total[keep] + np.uint64(width)), each


def signed(a: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Spark longs with the same bits."""
    return pa.array(a.view(np.int64))
