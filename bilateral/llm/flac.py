"""FLAC media columns: lossless mono 8-bit FLAC of byte payloads, and its verified decoding.

Both directions work on all frames of a slice at once: the encoder places every code with
cumulative bit offsets; the decoder steps through the samples of all frames side by side (one lane a
frame), so a step is a few array operations whatever the number of frames. Frames carry CRC-8 and
CRC-16, the stream its MD5, and a seek table gives the byte and sample offset of every frame.

Payloads are text bytes, padded with zero bytes to a positive multiple of 64; a null text is empty;
a payload is stored as signed samples (byte - 128). A stream that fails a check raises
``ValueError`` (in ``decode``) - data are never returned unverified. Repeated rows are kept, other
columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import prepare
from .words import slices

BLOCK = 1024
PAD = 64
LPC_ORDER = 4
LPC_BITS = 12
LPC_SHIFT = 9
SLICE = 2 << 20
ENCODE_SLICE = 1 << 19
# fixed predictors of the format, as coefficients of the last 1-4 samples
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_tables(poly: int, bits: int, length: int) -> np.ndarray:
    """[distance to the end, byte] -> its part of the checksum (checksums are linear in the bytes)."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    one = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        one = np.where(one & top, one << 1 ^ poly, one << 1) & mask
    out = np.empty((length, 256), dtype=np.int64)
    out[0] = one
    for k in range(1, length):
        out[k] = (out[k - 1] << 8 & mask) ^ one[out[k - 1] >> (bits - 8)]
    return out


_tables: dict[tuple[int, int], np.ndarray] = {}


def crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, poly: int, bits: int) -> np.ndarray:
    """Checksum of every byte span."""
    if not len(starts):
        return np.zeros(0, np.int64)
    n = ends - starts
    longest = int(n.max())
    table = _tables.get((poly, bits))
    if table is None or len(table) < longest:
        table = _tables[poly, bits] = _crc_tables(poly, bits, max(longest, 16)).astype(np.uint16)
    at = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(at, n)
    parts = table[np.repeat(n, n) - 1 - within, data[np.repeat(starts, n) + within]]
    return np.bitwise_xor.reduceat(parts, at).astype(np.int64)


def _number(i: int) -> bytes:
    """A frame number in the format's variable-length code (as UTF-8 up to 36 bits)."""
    if i < 0x80:
        return bytes([i])
    n = next(k for k in range(2, 8) if i < 1 << (5 * k + 1))
    tail = [0x80 | i >> 6 * j & 0x3F for j in range(n - 2, -1, -1)]
    return bytes([(0xFF00 >> n & 0xFF) | i >> 6 * (n - 1), *tail])


def _lpc(x: np.ndarray, starts: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Quantised predictor of every block, by the Levinson-Durbin recursion on its autocorrelation."""
    f = x.astype(np.float64)
    r = []
    for lag in range(LPC_ORDER + 1):
        prod = f.copy()
        prod[lag:] *= f[: len(f) - lag]
        prod[pos < lag] = 0
        r.append(np.add.reduceat(prod, starts))
    err = r[0] * 1.0001 + 1e-3
    a = np.zeros((len(starts), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[:, j] * r[i - j] for j in range(i))) / err
        old = a.copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = old[:, j] - k * old[:, i - 1 - j]
        err = err * (1 - k * k) + 1e-9
    top = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -top, top - 1).astype(np.int32)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width) -> None:
    """Writes numbers of ``width`` bits (one width, or one each) at bit offsets."""
    widest = int(np.max(width)) if np.size(width) else 0
    for j in range(widest):
        left = width - 1 - j
        if np.ndim(width):
            use = left >= 0
            bits[at[use] + j] = value[use] >> left[use] & 1
        else:
            bits[at + j] = value >> left & 1


def encode(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """FLAC streams of consecutive payloads (unsigned bytes; every size positive)."""
    if not len(sizes):
        return []
    x = data.astype(np.int32) - 128
    per = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(sizes)), per)  # payload of each frame
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(sizes) - sizes, per) + number * BLOCK
    n = np.minimum(BLOCK, np.repeat(sizes, per) - number * BLOCK)
    pos = np.arange(len(x)) - np.repeat(begin, n)
    frame = np.repeat(np.arange(len(n)), n)

    def lagged(k):
        out = np.zeros_like(x)
        out[k:] = x[:-k] if k else x
        return out

    coefs = _lpc(x, begin, n, pos)
    choices = [x]
    for order in (1, 2):
        choices.append(x - sum(c * lagged(j + 1) for j, c in enumerate(FIXED[order])))
    choices.append(x - (sum(coefs[frame, j] * lagged(j + 1) for j in range(LPC_ORDER)) >> LPC_SHIFT))
    orders = np.array([0, 1, 2, LPC_ORDER])
    cost = np.stack([np.add.reduceat(np.where(pos >= o, np.abs(e), 8), begin) for o, e in zip(orders, choices, strict=True)])
    cost[3] += 40
    best = cost.argmin(axis=0)
    best[n <= LPC_ORDER] = 0
    order = orders[best]
    res = np.choose(best[frame], choices)
    coded = pos >= order[frame]
    fold = np.where(res >= 0, 2 * res, -2 * res - 1)
    mean = np.add.reduceat(np.where(coded, fold, 0), begin) / np.maximum(n - order, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int32)
    q = fold >> k[frame]
    width = np.where(coded, q + 1 + k[frame], 8)
    body = np.add.reduceat(width, begin)
    constant = np.add.reduceat(np.abs(x - x[begin][frame]), begin) == 0
    verbatim = ~constant & (body + 10 + np.where(best == 3, 9 + LPC_ORDER * LPC_BITS, 0) >= 8 * n)
    plain = constant | verbatim
    codes = [_number(int(i)) for i in number]
    head = 8 * (4 + np.array([len(c) for c in codes]) + 2 + 1)
    extra = np.where(best == 3, 9 + LPC_ORDER * LPC_BITS, 0)
    total = head + 8 + np.where(constant, 8, np.where(verbatim, 8 * n, body + extra + 10))
    length = -(-total // 8) + 2
    at = (np.cumsum(length) - length) * 8
    bits = np.zeros(int(length.sum()) * 8, dtype=np.uint8)
    kinds = np.where(constant, 0, np.where(verbatim, 1, np.where(best == 3, 32 + LPC_ORDER - 1, 8 + order)))
    sub = at + head
    _put(bits, sub, kinds << 1, 8)
    _put(bits, sub[constant] + 8, x[begin[constant]] & 255, 8)
    # samples: warm-up and verbatim ones take 8 bits, the others a Rice code after the parameters
    raw = ~coded | verbatim[frame]
    width = np.where(constant[frame], 0, np.where(verbatim[frame], 8, width))
    run = np.cumsum(width) - width
    place = (sub + 8)[frame] + run - run[begin][frame] + np.where(coded & ~plain[frame], (extra + 10)[frame], 0)
    use = raw & ~constant[frame]
    _put(bits, place[use], x[use] & 255, 8)
    lpc = (best == 3) & ~plain
    after = sub + 8 + 8 * order
    _put(bits, after[lpc], np.full(lpc.sum(), LPC_BITS - 1), 4)
    _put(bits, after[lpc] + 4, np.full(lpc.sum(), LPC_SHIFT), 5)
    for j in range(LPC_ORDER):
        _put(bits, after[lpc] + 9 + j * LPC_BITS, coefs[lpc, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
    rice = after + extra
    _put(bits, rice[~plain] + 6, k[~plain], 4)  # method 0, partition order 0, parameter
    use = coded & ~plain[frame]
    bits[place[use] + q[use]] = 1
    kk = k[frame][use]
    _put(bits, place[use] + q[use] + 1, fold[use] & ((1 << kk) - 1), kk)
    out = np.packbits(bits)
    first = np.cumsum(length) - length
    for i, code in enumerate(codes):
        h = bytes([0xFF, 0xF8, 0x70, 0x02]) + code + (int(n[i]) - 1).to_bytes(2, "big")
        out[first[i] : first[i] + len(h)] = np.frombuffer(h, np.uint8)
    ends = first + head // 8 - 1
    out[ends] = crc(out, first, ends, 0x07, 8)
    sums = crc(out, first, first + length - 2, 0x8005, 16)
    out[first + length - 2], out[first + length - 1] = sums >> 8, sums & 255

    streams, f = [], 0
    base = np.cumsum(sizes) - sizes
    signed = x.astype(np.int8)
    for i, size in enumerate(sizes):
        g = f + int(per[i])
        own = length[f:g]
        info = BLOCK.to_bytes(2, "big") * 2 + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (44100 << 44 | 0 << 41 | 7 << 36 | int(size)).to_bytes(8, "big") + hashlib.md5(signed[base[i] : base[i] + size].tobytes()).digest()
        points = np.zeros(g - f, dtype=[("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        points["sample"], points["byte"], points["n"] = number[f:g] * BLOCK, first[f:g] - first[f], n[f:g]
        seek = points.tobytes()
        streams.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + out[first[f] : first[g - 1] + length[g - 1]].tobytes())
        f = g
    return streams


def _headers(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples, MD5, seek points and the byte where frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, seek, total, digest, last = 4, None, 0, b"", False
    while not last:
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = bool(kind & 0x80), stream[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise ValueError("only mono 8-bit streams")
            total, digest = packed & ((1 << 36) - 1), body[18:34]
        elif kind & 0x7F == 3:
            seek = np.frombuffer(body, dtype=[("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        at += 4 + n
    if seek is None:
        raise ValueError("no seek table")
    return total, digest, seek, at


class _Bits:
    """Reads numbers at one bit offset per lane."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(data) + 8
        self.words = np.zeros(n, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + n] << np.uint64(56 - 8 * j)
        self.at = at.astype(np.int64)

    def window(self, lanes) -> np.ndarray:
        at = self.at[lanes]
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, lanes, width) -> np.ndarray:
        """``width`` bits (at most 32) of the lanes, as unsigned numbers."""
        w = np.asarray(width)
        out = (self.window(lanes) >> np.uint64(1) >> (63 - w).astype(np.uint64)).astype(np.int64)
        self.at[lanes] += w
        return out

    def unary(self, lanes) -> np.ndarray:
        """Zeros before the next one bit, which is read as well."""
        w = self.window(lanes) >> np.uint64(11)
        zeros = 53 - np.frexp(w.astype(np.float64))[1].astype(np.int64)
        long = np.flatnonzero(w == 0)
        if len(long):  # more than 53 zeros
            index = np.arange(len(self.at))[lanes][long]
            self.at[index] += 53
            rest = self.unary(index)
            self.at[index] -= 53 + rest + 1
            zeros[long] = 53 + rest
        self.at[lanes] += zeros + 1
        return zeros


def _signed(value: np.ndarray, width) -> np.ndarray:
    return value - ((value >> (np.asarray(width) - 1) & 1) << width)


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples (as unsigned bytes) of all streams in order; stream, first sample and samples of each frame."""
    heads = [_headers(s) for s in streams]
    body = [s[h[3] :] for s, h in zip(streams, heads, strict=True)]
    data = np.frombuffer(b"".join(body), np.uint8)
    size = np.array([len(b) for b in body], np.int64)
    base = np.cumsum(size) - size
    per = np.array([len(h[2]) for h in heads], np.int64)
    of = np.repeat(np.arange(len(streams)), per)
    first = np.concatenate([base[i] + h[2]["byte"].astype(np.int64) for i, h in enumerate(heads)]) if heads else np.zeros(0, np.int64)
    sample = np.concatenate([h[2]["sample"].astype(np.int64) for h in heads]) if heads else np.zeros(0, np.int64)
    n = np.concatenate([h[2]["n"].astype(np.int64) for h in heads]) if heads else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.uint8), of, sample, n
    stop = np.append(first[1:], 0)
    last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
    stop[last] = (base + size)[of[last]]
    # headers: sync, block size, frame number, checksums
    lead = data[first + 4].astype(np.int64)
    ones = np.searchsorted([0x80, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE], lead, "right")
    numbers = np.where(ones <= 1, 1, ones)
    code = data[first + 2] >> 4
    if (data[first] != 0xFF).any() or (data[first + 1] != 0xF8).any() or not np.isin(code, [6, 7]).all() or ((data[first + 3] >> 4) != 0).any():
        raise ValueError("unknown frame header")
    at = first + 4 + numbers
    block = np.where(code == 7, data[at].astype(np.int64) << 8 | data[at + 1], data[at]) + 1
    at = at + np.where(code == 7, 2, 1)
    if (block != n).any() or (crc(data, first, at, 0x07, 8) != data[at]).any():
        raise ValueError("frame header checksum")
    if (crc(data, first, stop - 2, 0x8005, 16) != (data[stop - 2].astype(np.int64) << 8 | data[stop - 1])).any():
        raise ValueError("frame checksum")

    # lanes by falling length, so that the active ones are always the first
    lanes = np.argsort(-n, kind="stable")
    n_l = n[lanes]
    bits = _Bits(data, (at[lanes] + 1) * 8)
    everyone = np.arange(len(lanes))
    kind = bits.read(everyone, np.full(len(lanes), 8)) >> 1 & 63
    lpc, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    if not (lpc | fixed | (kind <= 1)).all():
        raise ValueError("unknown subframe")
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    deep = int(order.max())
    where = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)
    to = where[lanes]
    for j in range(deep):
        own = np.flatnonzero(order > j)
        out[to[own] + j] = _signed(bits.read(own, np.full(len(own), 8)), 8)
    coefs = np.zeros((len(lanes), max(deep, 1)), np.int64)
    shift = np.zeros(len(lanes), np.int64)
    for o in range(1, min(deep, 4) + 1):
        coefs[fixed & (order == o), :o] = FIXED[o]
    own = np.flatnonzero(lpc)
    if len(own):
        width = bits.read(own, np.full(len(own), 4)) + 1
        shift[own] = _signed(bits.read(own, np.full(len(own), 5)), 5)
        for j in range(deep):
            use = order[own] > j
            coefs[own[use], j] = _signed(bits.read(own[use], width[use]), width[use])
    same = np.flatnonzero(kind == 0)
    value = _signed(bits.read(same, np.full(len(same), 8)), 8)
    out[np.repeat(to[same], n_l[same]) + np.arange(n_l[same].sum()) - np.repeat(np.cumsum(n_l[same]) - n_l[same], n_l[same])] = np.repeat(value, n_l[same])
    own = np.flatnonzero(kind == 1)
    if len(own):
        spot = np.repeat(bits.at[own] >> 3, n_l[own]) + np.arange(n_l[own].sum()) - np.repeat(np.cumsum(n_l[own]) - n_l[own], n_l[own])
        if (bits.at[own] & 7).any():
            raise ValueError("unaligned verbatim subframe")
        out[np.repeat(to[own] - (np.cumsum(n_l[own]) - n_l[own]), n_l[own]) + np.arange(n_l[own].sum())] = data[spot].view(np.int8)
    rice = np.flatnonzero(kind >= 8)
    if len(rice):
        _residuals(bits, rice, order, n_l, to, coefs, shift, out)
    pcm = out.astype(np.int8)
    at = 0
    for h in heads:
        if hashlib.md5(pcm[at : at + h[0]].tobytes()).digest() != h[1]:
            raise ValueError("stream checksum")
        at += h[0]
    return (out + 128).astype(np.uint8), of, sample, n


def _residuals(bits, lanes, order, n, to, coefs, shift, out) -> None:
    """Decodes Rice residuals and predicts, one sample of every lane a step."""
    method = bits.read(lanes, np.full(len(lanes), 2))
    parts = bits.read(lanes, np.full(len(lanes), 4))
    length = n[lanes] >> parts
    order, to, shift, n = order[lanes], to[lanes], shift[lanes], n[lanes]
    deep = int(order.max())
    coefs = [np.ascontiguousarray(coefs[lanes, j]) for j in range(deep)]
    history = [np.zeros(len(lanes), np.int64) for _ in range(deep)]
    wide = np.where(method == 0, 4, 5)
    k = np.zeros(len(lanes), np.int64)
    raw = np.full(len(lanes), -1)
    simple = not parts.any()
    if simple:
        k = bits.read(lanes, wide)
    active = len(lanes)
    for i in range(int(n.max())):
        while active and n[active - 1] <= i:
            active -= 1
        a = slice(0, active)
        new = np.flatnonzero((i == 0) if simple and i else (i % length[a] == 0)) if not simple else ()
        if len(new):
            k[new] = bits.read(lanes[new], wide[new])
        if i == 0 or len(new):
            escape = np.flatnonzero(k == (1 << wide) - 1)
            escape = escape if i == 0 else np.intersect1d(escape, new)
            raw[new if len(new) else slice(None)] = -1
            if len(escape):
                raw[escape] = bits.read(lanes[escape], np.full(len(escape), 5))
        use = np.flatnonzero(order[a] <= i) if i < deep else None
        at = to[a] + i
        if use is not None and len(use) < active or (raw[a] >= 0).any():
            own = use if use is not None else np.arange(active)
            value = out[at]
            res = np.zeros(len(own), np.int64)
            coded = raw[own] < 0
            rl = lanes[own[coded]]
            res[coded] = _rice(bits, rl, k[own[coded]])
            esc = np.flatnonzero(~coded)
            if len(esc):
                w = raw[own[esc]]
                res[esc] = np.where(w > 0, _signed(bits.read(lanes[own[esc]], w), np.maximum(w, 1)), 0)
            guess = sum((c[own] * h[own] for c, h in zip(coefs, history, strict=True)), np.zeros(len(own), np.int64)) >> shift[own]
            value[own] = res + guess
        else:
            res = _rice(bits, lanes[a], k[a])
            guess = sum((c[a] * h[a] for c, h in zip(coefs, history, strict=True)), np.zeros(active, np.int64)) >> shift[a]
            value = res + guess
        out[at] = value
        for j in range(deep - 1, 0, -1):
            history[j][a] = history[j - 1][a]
        if deep:
            history[0][a] = value


def _rice(bits, lanes, k) -> np.ndarray:
    fold = bits.unary(lanes) << k
    fold |= bits.read(lanes, k)
    return fold >> 1 ^ -(fold & 1)


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to positive multiples of PAD, and their sizes."""
    size = np.diff(offsets)
    padded = np.maximum(-(-size // PAD), 1) * PAD
    out = np.zeros(int(padded.sum()), np.uint8)
    shift = np.cumsum(padded) - padded - offsets[:-1]
    out[np.arange(len(data)) + np.repeat(shift, size)] = data
    return out, padded


def _store(batches):
    for rows, data, offsets in slices(batches, limit=ENCODE_SLICE):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(encode(*payloads(data, offsets)), pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and the FLAC stream of every text."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _groups(batches, limit=SLICE):
    for batch in batches:
        size = np.cumsum([len(x.as_buffer()) for x in batch.column("media")])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def _blocks(batches):
    for b in _groups(batches):
        pcm, of, sample, n = decode(b.column("media").to_pylist())
        at = np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(of)), pa.array(sample), pa.array(n), pa.array([pcm[i : i + m].tobytes() for i, m in zip(at, n, strict=True)], pa.binary())], names=["doc_id", "sample_offset", "n_samples", "pcm"]
        )


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Verified PCM blocks of a media column: doc_id, sample_offset, n_samples, pcm (unsigned bytes)."""
    return media.select("doc_id", "media").mapInArrow(_blocks, "doc_id long, sample_offset long, n_samples long, pcm binary")


def _digest(batches: Iterator[pa.RecordBatch]):
    for b in _groups(batches):
        media = b.column("media").to_pylist()
        pcm, of, _, n = decode(media)
        size = np.bincount(of, weights=n, minlength=len(media)).astype(np.int64)
        begin = np.cumsum(size) - size
        x = pcm.astype(np.int64) - 128
        energy = np.add.reduceat(x * x, begin)
        turns = np.zeros(len(x), np.int64)
        turns[1:] = (x[1:] >= 0) != (x[:-1] >= 0)
        turns[begin] = 0
        crossings = np.add.reduceat(turns, begin)
        peak = np.maximum.reduceat(np.abs(x), begin)
        parts = [pcm[i : i + m].tobytes() for i, m in zip(begin, size, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("n_bytes"), pa.array(size), pa.array([hashlib.sha256(p).hexdigest() for p in parts]), pa.array([zlib.crc32(p[-PAD:]) for p in parts], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                pa.array([f"rms={(e / m) ** 0.5:.3f};crossings={c};peak={p}" for e, m, c, p in zip(energy.tolist(), size.tolist(), crossings.tolist(), peak.tolist(), strict=True)]),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def digest(media: DataFrame) -> DataFrame:
    """What ``decode`` reads back from a media table, as digests and signal features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
