"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

Sets are the distinct 5-word shingles of whole texts. Equal sets form one class (a 64-bit key of
the whole set), so groups of copies are one node. Pairs of classes with Jaccard similarity of at
least num/den are found exactly:

* all shingles get one global order: shingles with long inverted lists ("heavy") last, the others
  by hash. Which are heavy is counted over all documents and sent out as a Bloom filter of fixed
  size; a false positive only moves a shingle in the order that all documents share;
* sets of at most ``boundary`` shingles enumerate all pairs (2-subsets) of their prefix of
  s - t + 2 shingles: two linked sets share two of them. Larger sets write the s - t + 1 prefix
  to an inverted index, whose lists are scanned. Sets just below the boundary do both, as their
  partners can lie above. The boundary is the one of least cost by the histogram of set sizes
  and the measured list length;
* large groups of near copies are first joined into components through the smallest shingle under
  two hash orders (a few pivots a group, its most common texts, each link verified), and lists then
  give only pairs of different components (a link inside one changes nothing) whose places leave room
  for the overlap that they need: an edited copy has its own shingles first, so copies with too many
  edits to be linked with anything drop out of the common lists;
* candidates are pruned by parity sketches (the number of differing bits never exceeds the
  symmetric difference, so no link is lost) and verified on the whole sets;
* lists of more than ``LIST`` rows are cut into parts, and each pair of parts is a list of its own;
* all links are inside components, so they are counted (or listed) there: the classes of a component
  are dealt into blocks, and the sets of two blocks meet as two matrices of their common shingles.

Empty tables give no rows; null or wordless texts have size 0, no links and their own doc_id; repeated rows
are kept, and link with each other; a null doc_id is kept and never the name of a component or class that has other ids. Input
columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import Tables, components, hot_and_rest
from .words import hashes, mix, shingle_hashes, signed, slices, spans

NUM, DEN = 75, 100  # Jaccard threshold
HEAVY = 8  # inverted lists longer than this make a shingle heavy
BLOOM_BITS = 1 << 25  # 4 MB, the whole of what is broadcast
ORDERS = 2  # hash orders whose smallest shingle gathers near copies
PIVOTS = 8  # in each such group
LIST = 2048  # longer inverted lists are scanned in parts
BLOCK, BLOCK_SHINGLES = 512, 500_000  # classes and shingles of a block, on average
_SALT = [np.uint64(x) for x in (0x0, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0x5851F42D4C957F2D)]


def shingle_sets(batches: Iterator[pa.RecordBatch], width: int = 5):
    """Slices with the sorted distinct shingles of each row: (rows, shingles, sizes)."""
    for rows, data, offsets in slices(batches):
        starts, ends, of = spans(data, offsets)
        counts = np.bincount(of, minlength=rows.num_rows)
        h, each = shingle_hashes(hashes(data, starts, ends), counts, width)
        out, at = [], 0
        for n in each:
            part = np.sort(h[at : at + n])
            at += n
            out.append(part[np.r_[True, part[1:] != part[:-1]]] if n else part)
        yield rows, np.concatenate(out) if out else h, np.array([len(x) for x in out], dtype=np.int64)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Fewest shingles that a set of n shares with any partner."""
    return -(-n * NUM // DEN)


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each whole set; 0 for empty ones."""
    ends = np.cumsum(sizes)
    total = np.zeros(len(sets) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(sets ^ _SALT[1]), out=total[1:])
        keys = mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * _SALT[2])
    return np.where(sizes > 0, keys, np.uint64(0))


def _sketch(part: np.ndarray) -> bytes:
    """One bit for each hash class, toggled by every member; at least four times as many bits as members."""
    bits = 1 << max(6, int(4 * len(part) - 1).bit_length())
    return np.packbits(np.bincount((part & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _describe(bloom):
    return lambda batches: _descriptions(batches, bloom.value)


def _descriptions(batches, bits):
    for rows, sets, sizes in shingle_sets(batches):
        ends = np.cumsum(sizes)
        parts = [sets[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        total = np.concatenate([[0], np.cumsum(in_bloom(bits, sets))])
        heavy = total[ends] - total[ends - sizes]
        least = [signed(np.array([mix(p ^ s).min() if len(p) else 0 for p in parts], dtype=np.uint64)) for s in _SALT[1 : 1 + ORDERS]]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(sizes), signed(set_keys(sets, sizes)), pa.array(heavy), pa.array([_sketch(p) if len(p) else None for p in parts], pa.binary()), *least],
            names=["doc_id", "n_shingles", "node", "heavy", "sketch", *(f"m{k}" for k in range(ORDERS))],
        )


def describe(docs: DataFrame, bloom) -> DataFrame:
    """doc_id, set size, class key, number of heavy shingles, parity sketch and smallest shingles of every document."""
    return docs.select("doc_id", "text").mapInArrow(_describe(bloom), "doc_id long, n_shingles long, node long, heavy long, sketch binary, " + ", ".join(f"m{k} long" for k in range(ORDERS)))


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a Bloom filter."""
    hit = np.zeros(len(h), dtype=bool)
    left = np.arange(len(h))
    for shift in (0, 26, 37):  # most hashes fail the first probe
        at = (h[left] >> np.uint64(shift)) & np.uint64(8 * len(bits) - 1)
        left = left[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    hit[left] = True
    return hit


def _fill(size: int):
    def fill(batches):
        bits = np.zeros(size, dtype=bool)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shift in (0, 26, 37):
                bits[((h >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)] = True
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), signed(words[at])], names=["at", "word"])

    return fill


def bloom_of(hashes_: DataFrame, size: int = BLOOM_BITS) -> np.ndarray:
    """Bloom filter of ``size`` bits of a one-column table of 64-bit hashes."""
    merged = hashes_.mapInArrow(_fill(size), "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    words = np.zeros(size // 64, dtype=np.uint64)
    words[merged.column("at").to_numpy()] = merged.column("word").to_numpy().view(np.uint64)
    return words.view(np.uint8)


def _count_prefixes(batches):
    """How often each prefix shingle (in hash order) occurs in this part of the documents."""
    for _, sets, sizes in shingle_sets(batches):
        ends = np.cumsum(sizes)
        take = sizes - least_overlap(sizes) + np.minimum(sizes, 1)
        at = np.arange(take.sum()) + np.repeat(ends - sizes - np.cumsum(take) + take, take)
        tokens, n = np.unique(sets[at], return_counts=True)
        yield pa.RecordBatch.from_arrays([signed(tokens), pa.array(n)], names=["token", "n"])


def heavy_filter(docs: DataFrame, tables: Tables) -> tuple[np.ndarray, float]:
    """Bloom filter of the heavy shingles, and the mean list length that a scan of the others meets.

    Where more shingles are heavy than the filter holds, those with the longest lists go in."""
    counts = docs.select("doc_id", "text").mapInArrow(_count_prefixes, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    counts = tables.put(counts)
    light = counts.where(F.col("n") <= HEAVY).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()

    heavy = hot_and_rest(counts.where(F.col("n") > HEAVY), "n", BLOOM_BITS // 12)[0].select("token")
    bits = bloom_of(heavy)
    tables.drop(counts)
    tables.release()
    return bits, (light[1] or 0) / max(1, light[0] or 0)


def choose_boundary(sizes: DataFrame, mean_list: float) -> int:
    """The largest set size that enumerates 2-subsets, of least rows written plus list entries scanned.

    The candidates are powers of sqrt(2) up to 64 (a 2-subset prefix grows with the square)."""
    options = sorted({0, *(int(2 ** (k / 2)) for k in range(0, 13))})
    n = F.col("n_shingles")
    t = F.ceil(n * NUM / DEN)
    single, pairs = n - t + 1, F.greatest(F.lit(1), (n - t + 2) * (n - t + 1) / 2)
    costs = sizes.where("n_shingles > 0").agg(
        *[F.sum(F.when(n <= b, pairs).otherwise(0) + F.when(n * DEN > b * NUM, single * (1 + mean_list)).otherwise(0)).alias(str(b)) for b in options]
    ).first()
    return min(options, key=lambda b: (costs[str(b)] or 0, b))


def _index(bloom, boundary: int):
    def emit(batches):
        bits = bloom.value
        for _, sets, sizes in shingle_sets(batches):
            keys = set_keys(sets, sizes)
            out = []
            last = in_bloom(bits, sets)
            ends = np.cumsum(sizes)
            seen = set()
            for e, n, key in zip(ends, sizes, keys, strict=True):
                if not n or key in seen:
                    continue
                seen.add(key)
                part, tail = sets[e - n : e], last[e - n : e]
                t = int(-(-n * NUM // DEN))
                before = np.zeros(n - t + 1, np.uint64)  # the heavy shingle that stands before each one
                if tail[: n - t + 2].any():
                    part = np.concatenate([part[~tail], part[tail]])
                    rare = n - int(tail.sum())
                    before[rare + 1 :] = part[rare : n - t]
                if n * DEN > boundary * NUM:
                    p = n - t + 1
                    out.append((part[:p], np.arange(p), key, n, before))
                if n <= boundary:
                    p = min(n, n - t + 2)
                    i, j = np.triu_indices(p, 1) if p > 1 else (np.zeros(1, int), np.zeros(1, int))
                    lo, hi = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
                    out.append((mix(lo * np.uint64(0xA0761D6478BD642F) ^ mix(hi) ^ _SALT[3]), np.minimum(i, j), key, n, np.zeros(len(i), np.uint64)))
            if out:
                each = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate([x[0] for x in out])), signed(np.repeat(np.array([x[2] for x in out], dtype=np.uint64), each)), pa.array(np.repeat([int(x[3]) for x in out], each).astype(np.int32)), pa.array(np.concatenate([x[1] for x in out]).astype(np.int32)), signed(np.concatenate([x[4] for x in out]))],
                    names=["token", "node", "n", "place", "before"],
                )

    return emit


class _Sketches:
    """Parity sketches of the rows of a table, compared pair by pair at the width of the narrower one."""

    def __init__(self, column: pa.ChunkedArray):
        raw = column.to_pylist()
        self.bits = np.array([8 * len(x) if x else 0 for x in raw])
        self.at = np.zeros(len(raw), np.int64)
        self.own, self.half = {}, {}
        for w in np.unique(self.bits[self.bits > 0]).tolist():
            rows = np.flatnonzero(self.bits == w)
            self.at[rows] = np.arange(len(rows))
            own = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), w // 8)
            self.own[w], self.half[w] = own, own[:, : w // 16] ^ own[:, w // 16 :]

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing bits of each pair: at most the size of the symmetric difference (0 where widths are far apart)."""
        out = np.zeros(len(x), np.int64)
        for w in np.unique(self.bits[x][self.bits[x] > 0]).tolist():  # rows of short lists have none
            for v in (w // 2, w, 2 * w):
                rows = np.flatnonzero((self.bits[x] == w) & (self.bits[y] == v))
                if not len(rows):
                    continue
                a = (self.half if v < w else self.own)[w]
                b = (self.half if v > w else self.own)[v]
                step = max(1, (8 << 20) // a.shape[1])
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    out[part] = np.bitwise_count(a[self.at[x[part]]] ^ b[self.at[y[part]]]).sum(axis=1, dtype=np.int64)
        return out


def _list_pairs(batches):
    """Pairs of different components in each inverted list that may be linked; rows come sorted by token and root."""
    left = None

    def pairs(t):
        token, root, node, before = (t.column(k).to_numpy() for k in ("token", "root", "node", "before"))
        n, place = t.column("n").to_numpy().astype(np.int64), t.column("place").to_numpy().astype(np.int64)
        sketches = _Sketches(t.column("sketch"))
        size = len(token)
        new = np.r_[True, token[1:] != token[:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(size), 0))
        other = np.r_[True, (token[1:] != token[:-1]) | (root[1:] != root[:-1])]
        own = np.maximum.accumulate(np.where(other, np.arange(size), 0))
        many = own - begin  # each row meets the rows of its list that stand before its component
        done = np.cumsum(many)
        at = 0
        while at < size:
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 500_000, "right")))
            m = many[at:end]
            x = np.repeat(np.arange(at, end), m)
            y = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[at:end], m)
            # after the same shingle the pair stands in that shingle's list, too
            ok = (before[x] != before[y]) | (before[x] == 0)
            x, y = x[ok], y[ok]
            need = -(-NUM * (n[x] + n[y]) // (NUM + DEN))
            ok = np.minimum(n[x] - place[x], n[y] - place[y]) >= need
            x, y, need = x[ok], y[ok], need[ok]
            ok = sketches.differ(x, y) <= n[x] + n[y] - 2 * need
            x, y = x[ok], y[ok]
            key = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1])], names=["a", "b"])
            at = end

    for batch in batches:
        t = pa.Table.from_batches([left, batch] if left is not None else [batch]).combine_chunks()
        token = t.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1], "left")) if len(token) else 0
        if cut:
            yield from pairs(t.slice(0, cut))
        left = t.slice(cut).combine_chunks().to_batches()[0] if t.num_rows > cut else None
    if left is not None:
        yield from pairs(pa.Table.from_batches([left]))


def _prune(batches):
    """Drops pairs whose sizes or sketches show that they can't be linked."""
    for b in batches:
        keep = []
        for na, nb, sa, sb in zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
            need = -(-NUM * (na + nb) // (NUM + DEN))
            ok = min(na, nb) >= need
            if ok:
                x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (sa, sb))
                while len(x) != len(y):
                    if len(x) < len(y):
                        x, y = y, x
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                ok = int((x ^ y).sum()) <= na + nb - 2 * need
            keep.append(ok)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(bloom):
    return lambda batches: _wanted_sets(batches, bloom.value)


def _wanted_sets(batches, bits):
    """Packed sets of the rows whose id may be in the filter."""
    picked = (b.filter(pa.array(in_bloom(bits, b.column("h").to_numpy().view(np.uint64)))) for b in batches)
    for _, sets, sizes in shingle_sets(picked):
        keys, ends = set_keys(sets, sizes), np.cumsum(sizes)
        packed = [np.ascontiguousarray(sets[e - n : e].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([signed(keys), pa.array(packed, pa.binary())], names=["node", "members"])


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view(">u8").ravel().astype(np.uint64)


def _overlaps(batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column("ma"), b.column("mb"), strict=True):
            x, y = _unpack(x.as_py()), _unpack(y.as_py())
            both = len(np.intersect1d(x, y, assume_unique=False))
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _blocks(column: pa.Array):
    """(ids, copies, row of each shingle, shingles, sizes) of every block of a list column of classes."""
    flat, ends = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    node, copies = (flat.field(k).to_numpy() for k in ("node", "copies"))
    sizes = pc.binary_length(flat.field("members")).to_numpy().astype(np.int64) // 5
    at = np.concatenate([[0], np.cumsum(sizes)])
    shingles = _unpack(b"".join(flat.field("members").to_pylist()))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield node[a:b], copies[a:b], np.repeat(np.arange(b - a), sizes[a:b]), shingles[at[a] : at[b]], sizes[a:b]


def _common(x, y) -> np.ndarray:
    """How many shingles each class of one block shares with each of another."""
    (_, _, rx, sx, nx), (_, _, ry, sy, ny) = x, y
    both, out = np.intersect1d(sx, sy), np.zeros((len(nx), len(ny)), np.int64)
    if not len(both):
        return out
    ax, ay = (np.minimum(np.searchsorted(both, s), len(both) - 1) for s in (sx, sy))
    hx, hy = both[ax] == sx, both[ay] == sy
    ax, rx, ay, ry = ax[hx], rx[hx], ay[hy], ry[hy]
    step = 8192  # columns of the matrices at a time
    for k in range(0, len(both), step):
        m = []
        for at, row, n in ((ax, rx, len(nx)), (ay, ry, len(ny))):
            part = (at >= k) & (at < k + step)
            one = np.zeros((n, min(step, len(both) - k)), np.float32)
            one[row[part], at[part] - k] = 1
            m.append(one)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _links(across: bool, listed: bool):
    """Links of the classes of each block, or pair of blocks: (node, links) with copies counted, or (a, b, shared)."""

    def links(batches):
        for batch in batches:
            left = list(_blocks(batch.column("x")))
            for x, y in zip(left, _blocks(batch.column("y")) if across else left, strict=True):
                shared = _common(x, y)
                linked = DEN * shared >= NUM * (x[4][:, None] + y[4][None, :] - shared)
                if not across:
                    np.fill_diagonal(linked, False)
                if listed:
                    i, j = np.nonzero(linked if across else np.triu(linked))
                    yield pa.RecordBatch.from_arrays([pa.array(x[0][i]), pa.array(y[0][j]), pa.array(shared[i, j])], names=["a", "b", "shared"])
                    continue
                node, n = x[0], linked @ y[1]
                if across:
                    node, n = np.concatenate([node, y[0]]), np.concatenate([n, x[1] @ linked])
                yield pa.RecordBatch.from_arrays([pa.array(node[n > 0]), pa.array(n[n > 0])], names=["node", "links"])

    return links


def links_of(docs: DataFrame, classes: DataFrame, tables: Tables, listed: bool = False) -> DataFrame:
    """Links between different sets, from (node, root, n, copies, id) of each class: (node, links), how many documents of
    other classes each one is linked with, or (a, b, shared), the pairs themselves. A component of k blocks makes k * (k + 1) / 2 tasks' worth of rows."""
    groups = classes.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("all")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    inside = tables.put(classes.join(groups, "root").select("node", "root", "copies", "id", blocks.alias("blocks")))
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(inside.select(F.xxhash64("id").alias("h"))))
    sets = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_sets_of(bloom), "node long, members binary")
    sets = sets.join(inside, "node").dropDuplicates(["node"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = sets.groupBy("root", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("node", "copies", "members")).alias("x"))
    whole = tables.put(whole)
    tables.release()
    other = lambda lo, hi: F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j > F.col(lo)) if hi else (j < F.col(lo))))
    wide = whole.where("blocks > 1")
    x = wide.select("root", F.col("block").alias("i"), other("block", True).alias("j"), "x")
    y = wide.select("root", other("block", False).alias("i"), F.col("block").alias("j"), F.col("x").alias("y"))
    schema = "a long, b long, shared long" if listed else "node long, links long"
    found = whole.select("x").mapInArrow(_links(False, listed), schema).union(x.join(y, ["root", "i", "j"]).select("x", "y").mapInArrow(_links(True, listed), schema))
    found = tables.put(found if listed else found.groupBy("node").agg(F.sum("links").alias("links")))
    tables.drop(whole, inside)
    tables.release()
    return found


def verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b) of a table of class keys (those that sketches don't exclude; the table is dropped) whose whole sets reach the threshold.

    Members travel as the first 40 bits of their hashes: for two sets of n the chance of one false
    match is n * n / 2 ** 40, and it matters only at a pair that misses the threshold by one."""
    close = pairs
    needed = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    ids = known.join(needed, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id"))
    # texts aren't shuffled: a filter of fixed size picks those that are wanted (and a few others, which the joins drop);
    # rows without an id count as one id, and keys are computed anew, so ids that texts share do no harm
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(ids.select(F.xxhash64("id").alias("h"))))
    sets = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_sets_of(bloom), "node long, members binary")
    sets = sets.join(needed, "node", "left_semi").dropDuplicates(["node"])
    sets = tables.put(sets)
    tables.release()
    # in rounds of at most a quarter as many pairs as there are sets, so the members on the way stay below the input's size
    rounds = max(1, -(-close.count() // max(10_000, known.count() // 4)))
    out = None
    for r in range(rounds):
        part = close.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == r)
        met = part.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b")
        one = tables.put(met.mapInArrow(_overlaps, "a long, b long"))
        out = one if out is None else out.union(one)
        tables.release()
    tables.drop(close, sets)
    return out


def _cut(lists: DataFrame) -> DataFrame:
    """Lists of more than ``LIST`` rows as one list for each pair of their parts, in which only rows of different parts (or, for
    a part with itself, of different components) count as of different roots."""
    parts = F.ceil(F.col("size") / LIST).cast("int")
    own = F.pmod(F.xxhash64("root"), parts).cast("int")
    far = lists.where(F.col("size") > LIST).withColumn("p", own).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    far = far.withColumn("token", F.xxhash64("token", F.least("p", "q"), F.greatest("p", "q"))).withColumn("root", F.when(F.col("p") == F.col("q"), F.col("root")).otherwise(F.col("p").cast("long")))
    return lists.where(F.col("size") <= LIST).unionByName(far.drop("p", "q"))


def _labelled(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, n_shingles, node (class key) and root (component key) for every row of docs."""
    spark = docs.sparkSession
    bits, mean_list = heavy_filter(docs, tables)
    bloom = spark.sparkContext.broadcast(bits)
    known = tables.put(describe(docs, bloom))
    full = known.where("n_shingles > 0")
    nodes = full.dropDuplicates(["node"])

    # a pivot is the member (of a hash class) with most of its shingles in common with others: an edit makes
    # shingles that are rare, so pivots are the texts nearest to the one that the copies were made from
    common = (F.round(F.col("heavy") / F.col("n_shingles"), 3) * 1000).cast("long") * 100_000_000 + F.col("n_shingles")
    stars = None
    for k in range(ORDERS):
        pivot = nodes.groupBy(f"m{k}", F.pmod(F.xxhash64("node"), F.lit(PIVOTS))).agg(F.max_by("node", common).alias("a")).select("a")
        pivot = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col(f"m{k}").alias("m")).join(pivot, "a", "left_semi")
        member = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), F.col(f"m{k}").alias("m"))
        near = F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM
        star = member.join(pivot, "m").where((F.col("a") != F.col("b")) & near).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_prune, "a long, b long")
        star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        stars = star if stars is None else stars.union(star)
    links = verified(docs, full, tables.put(stars.distinct()), tables)
    roots = tables.put(components(tables, links))

    boundary = choose_boundary(nodes, mean_list)
    index = docs.select("doc_id", "text").mapInArrow(_index(bloom, boundary), "token long, node long, n int, place int, before long")
    per = W.partitionBy("token")
    live = index.select("*", F.min("node").over(per).alias("lo"), F.max("node").over(per).alias("hi")).where("lo != hi").drop("lo", "hi")
    live = tables.put(live)
    tables.release()
    named = live.join(roots, "node", "left").select("token", F.coalesce("root", "node").alias("root"), "node", "n", "place", "before")
    mixed = named.select("*", F.min("root").over(per).alias("lo"), F.max("root").over(per).alias("hi")).where("lo != hi").drop("lo", "hi")
    # equal sets met in one list: one row is enough (still dealt by token, so this needs no shuffle)
    mixed = mixed.groupBy("token", "node").agg(*[F.first(c).alias(c) for c in ("root", "n", "place", "before")])
    # only long lists carry sketches: a short one makes few pairs, which are pruned once they are distinct
    mixed = mixed.withColumn("size", F.count("*").over(per))
    long = _cut(mixed.where(F.col("size") > 2 * HEAVY)).drop("size").join(nodes.select("node", "sketch"), "node")
    short = mixed.where(F.col("size") <= 2 * HEAVY).drop("size").withColumn("sketch", F.lit(None).cast("binary"))
    named = long.unionByName(short).repartition("token").sortWithinPartitions("token", "root")
    pairs = named.mapInArrow(_list_pairs, "a long, b long").distinct()
    one = nodes.select("node", F.col("n_shingles").alias("n"), "sketch")
    pairs = pairs.join(one.toDF("a", "na", "sa"), "a").join(one.toDF("b", "nb", "sb"), "b").mapInArrow(_prune, "a long, b long")
    pairs = tables.put(pairs)
    tables.drop(live)
    more = verified(docs, full, pairs, tables)
    # the links found now join components, so only those are walked again
    over = more.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = components(tables, over).toDF("root", "top")

    labelled = known.select("doc_id", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return labelled.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def _classes(labelled: DataFrame) -> DataFrame:
    full = labelled.where("n_shingles > 0").groupBy("node")
    return full.agg(F.first("root").alias("root"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("id"))


def ngram_jaccard_join(docs: DataFrame, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with the same set), n_class (documents with it) and, unless
    only components are asked for, n_links (other documents that it is linked with, copies included) for every row of docs."""
    tables = Tables(docs.sparkSession)
    labelled = tables.put(_labelled(docs, tables))
    classes = tables.put(_classes(labelled))
    tables.drop_all_but(labelled, classes)
    names = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    of = classes.select("node", F.col("copies").alias("n_class"), F.col("id").alias("class_id"))
    if links:
        of = of.join(links_of(docs, classes, tables), "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n_class") - 1)
    out = labelled.join(names, "root", "left").join(of, "node", "left")
    own = lambda name, other: F.when(F.col("n_shingles") > 0, F.col(name)).otherwise(other).alias(name)
    out = out.select("doc_id", "n_shingles", *(own(c, F.col("doc_id")) for c in ("component_id", "class_id")), own("n_class", F.lit(1)), *([own("n_links", F.lit(0))] if links else []))
    return out


def ngram_jaccard_pairs(docs: DataFrame) -> DataFrame:
    """Every link between different sets once: a, b (the class_id of both, a the lesser) and shared (shingles in common)."""
    tables = Tables(docs.sparkSession)
    classes = tables.put(_classes(tables.put(_labelled(docs, tables))))
    ids = classes.select("node", "id")
    pairs = links_of(docs, classes, tables, listed=True).join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b")
    return pairs.select(F.least("x", "y").alias("a"), F.when(F.col("x").isNull() | F.col("y").isNull(), None).otherwise(F.greatest("x", "y")).alias("b"), "shared")
