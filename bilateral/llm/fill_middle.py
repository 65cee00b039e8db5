"""Fill-in-the-middle transformation by a learned rank index over token boundaries.

A token is a word with the white space before it; white space at the end of a text is a token of its own. The end of the
k-th token is a function of k that is close to a line, so a text's boundaries are kept as few line
segments and one signed byte of residual each: a cut at rank k is predicted by its segment and
corrected by the stored residual, exactly and without walking through the text.

* Segments are fitted to all boundaries: one line from the first to the last boundary of a text; where a residual is
  beyond ``ERROR``, the segment is halved and both halves are fitted again, until all residuals fit. All texts of a
  slice of an Arrow batch are fitted together.
* Two cuts, the form and the order of the parts are drawn from a digest of the document's id, so reruns agree.
* A text that holds a sentinel, an empty one, and the share that is not drawn stay as they are (form ``plain``).

Null texts count as empty; a null doc_id is drawn like an empty id; repeated rows count each; very long texts (and single words of any length) are indexed and cut
whole; texts of white space alone are one token; an empty table gives no rows; other columns stay, but those with the names of results
are replaced. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import prepare
from .words import slices, spans

SEED = 42
SHARE = 50  # percent of texts that are cut
SUFFIX_FIRST = 80  # percent of those in the order suffix, prefix, middle
ERROR = 127  # bytes: the largest residual
SENTINELS = ("<P>", "<S>", "<M>")


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundary offsets of each text, from 0 to its length in bytes, one after another; and the number of tokens of each text."""
    rows = len(offsets) - 1
    starts, ends, of = spans(data, offsets)
    words = np.bincount(of, minlength=rows)
    upto = np.cumsum(words)
    last = np.zeros(rows, np.int64)
    last[words > 0] = ends[upto[words > 0] - 1] - offsets[:-1][words > 0]
    size = np.diff(offsets)
    tail = (last < size).astype(np.int64)  # white space after the last word
    tokens = words + tail
    first = np.cumsum(tokens + 1) - tokens - 1
    out = np.zeros(int((tokens + 1).sum()), np.int64)
    out[np.arange(len(of)) + np.repeat(first + 1 - (upto - words), words)] = ends - offsets[of]
    at = np.flatnonzero(tail)
    out[first[at] + tokens[at]] = size[at]
    return out, tokens


class RankIndex:
    """Boundaries of many texts as segments (first rank over all texts, rank count, first offset, rise) and residuals."""

    def __init__(self, bounds: np.ndarray, tokens: np.ndarray, error: int = ERROR):
        self.first = np.cumsum(tokens + 1) - tokens - 1  # rank 0 of each text
        self.residuals = np.zeros(len(bounds), np.int8)
        lo, hi = self.first, self.first + tokens
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(lo):
            n = hi - lo + 1
            begin = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(begin, n)
            rise = bounds[hi] - bounds[lo]
            at = step + np.repeat(lo, n)
            off = bounds[at] - (np.repeat(bounds[lo], n) + step * np.repeat(rise, n) // np.maximum(np.repeat(n - 1, n), 1))
            fits = np.maximum.reduceat(np.abs(off), begin) <= error
            kept = np.repeat(fits, n)
            self.residuals[at[kept]] = off[kept]
            done.append((lo[fits], hi[fits]))
            mid = (lo[~fits] + hi[~fits]) // 2  # a segment of two boundaries has no residual, so one that doesn't fit has three or more
            lo, hi = np.concatenate([lo[~fits], mid]), np.concatenate([mid, hi[~fits]])
        lo, hi = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(lo * 2 + (hi > lo), kind="stable")
        self.lo, self.steps = lo[order], (hi - lo)[order]
        self.base, self.rise = bounds[lo[order]], (bounds[hi] - bounds[lo])[order]

    def offset(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Byte offset of boundary ``rank`` of each of the texts (their numbers)."""
        at = self.first[text] + rank
        s = np.searchsorted(self.lo, at, "right") - 1
        return self.base[s] + (at - self.lo[s]) * self.rise[s] // np.maximum(self.steps[s], 1) + self.residuals[at]


def _cut(batches: Iterator[pa.RecordBatch]):
    for rows, data, offsets in slices(batches):
        bounds, tokens = boundaries(data, offsets)
        index = RankIndex(bounds, tokens)
        first = np.cumsum(tokens + 1) - tokens - 1
        segments = np.bincount(np.searchsorted(first, index.lo, "right") - 1, minlength=rows.num_rows)
        every = np.arange(rows.num_rows)
        a, b = (rows.column(c).to_numpy(zero_copy_only=False) % (tokens + 1) for c in ("__h1", "__h2"))
        low, high = index.offset(every, np.minimum(a, b)), index.offset(every, np.maximum(a, b))
        psm, cut = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("__psm", "__cut"))
        whole = data.tobytes()
        forms, outs, lengths = [], [], []
        for i in range(rows.num_rows):
            text = whole[offsets[i] : offsets[i + 1]]
            if not cut[i] or not text or any(s.encode() in text for s in SENTINELS):
                forms.append("plain")
                outs.append(text)
                lengths.append((None, None))
                continue
            prefix, middle, suffix = text[: low[i]], text[low[i] : high[i]], text[high[i] :]
            forms.append("psm" if psm[i] else "spm")
            outs.append(b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle if psm[i] else b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle)
            lengths.append((len(prefix.decode()), len(middle.decode())))
        yield pa.RecordBatch.from_arrays(
            [rows.column("row"), pa.array(tokens), pa.array(segments), pa.array(forms), pa.array([x[0] for x in lengths], pa.int64()), pa.array([x[1] for x in lengths], pa.int64()), pa.array(outs, pa.binary()).cast(pa.string())],
            names=["row", "n", "n_segments", "form", "prefix_chars", "middle_chars", "output"],
        )


RESULTS = ["n", "n_segments", "form", "prefix_chars", "middle_chars", "output"]


def _draws(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, share: int = SHARE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, and others) without text, with n (tokens), n_segments (of its rank index), form (plain, psm or spm),
    prefix_chars and middle_chars (code points, null if plain) and output."""
    docs = docs.drop(*RESULTS)
    prepare(docs.sparkSession)
    h1, h2, h3, h4 = _draws(seed)
    # the row travels as one column, so its names can't meet those of the work
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    ready = docs.select(row.alias("row"), "text", h1.alias("__h1"), h2.alias("__h2"), (h3 % 100 < share).alias("__cut"), (h4 % 100 >= suffix_first).alias("__psm"))
    kind = StructType([ready.schema["row"], *StructType.fromDDL("n long, n_segments long, form string, prefix_chars long, middle_chars long, output string")])
    out = ready.mapInArrow(_cut, kind)
    return out.select("row.*", *RESULTS)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. No sentinel stands in a text that was cut, nor across two parts (only its first byte is a <)."""
    parts = F.split(output, "<[PSM]>")
    text = F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.coalesce(text, F.col(output))
