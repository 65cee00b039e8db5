"""Language identification by a bit-sliced Bloom filter of byte n-grams.

Every slot of the filter holds one bit for each language (any number of them, 64 to a word); looking up an n-gram takes the AND of
its slots, which names all languages that contain it. A text's popcounts by language, corrected
for each language's false-positive rate, decide.

Training counts the 4-byte grams of lower-cased words (with one blank on each side) over all
labelled rows; a gram belongs to a language when it is there at least ``SHARE`` times as frequent
as in the language where it is most frequent, and at least ``RATE`` of that language's grams. So a
language has at most 1 / RATE grams, and the filter's size is fixed.

Null texts and texts without a letter get ``und`` and score 0; ties go to the first language by
name; with no labelled rows every text is ``und``. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import prepare
from .words import LOWER, WORD, mix, slices

SLOTS = 1 << 21
PROBES = 2
RATE = 1e-6
SHARE = 0.2
_SPACE = LOWER.copy()
_SPACE[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte grams as numbers, with the row of each; digits and ASCII punctuation count as blanks."""
    n, rows = len(data), len(offsets) - 1
    at = np.arange(n) + 2 * np.repeat(np.arange(rows), np.diff(offsets)) + 1
    wide = np.full(n + 2 * rows, 0x20, dtype=np.uint32)
    wide[at] = _SPACE[data]
    if len(wide) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    keep = (wide[1:-2] != 0x20) & ((wide[:-3] != 0x20) | (wide[2:-1] != 0x20)) & ~((wide[2:-1] == 0x20) & (wide[3:] != 0x20))
    of = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    keep &= of[:-3] == of[3:]
    return g[keep], of[:-3][keep]


def _count(batches):
    for rows, data, offsets in slices(batches):
        g, of = grams(data, offsets)
        langs = rows.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], dtype=np.uint64)
        keys, n = np.unique(code[of] << np.uint64(32) | g.astype(np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in range(len(names))]).take(pa.array((keys >> np.uint64(32)).astype(np.int64))), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
        )


def _slots(g: np.ndarray) -> list[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(1))
    return [((h >> np.uint64(21 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, filter, false-positive rates) of rows with text and lang."""
    prepare(labelled.sparkSession)
    counts = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted(r.lang for r in totals.select("lang").collect())
    words = -(-len(names) // 64)
    rates = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= RATE)
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.map_from_entries(F.collect_list(F.struct("lang", "rate"))).alias("by"))
    bit = lambda k, name: F.when(F.coalesce(F.col("by")[name], F.lit(0.0)) >= SHARE * F.col("best"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0))
    masks = [sum((bit(k, n) for k, n in enumerate(names[64 * w : 64 * w + 64])), F.lit(0).cast("long")).alias(f"m{w}") for w in range(words)]
    # grams meet in their slots, so at most SLOTS rows come back
    placed = best.select("gram", *masks).mapInArrow(_place, "slot long, " + ", ".join(f"m{w} long" for w in range(words))) if names else None
    slots = np.zeros((words, SLOTS), dtype=np.uint64)
    if placed is not None:
        found = placed.groupBy("slot").agg(*[F.expr(f"bit_or(m{w})").alias(f"m{w}") for w in range(words)]).toArrow()
        for w in range(words):
            slots[w, found.column("slot").to_numpy()] = found.column(f"m{w}").to_numpy().view(np.uint64)
    full = [float(np.mean((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1))) for k in range(len(names))]
    return names, slots, np.array([f**PROBES for f in full])


def _place(batches):
    """The slots of each gram with its masks."""
    for b in batches:
        at = _slots(b.column("gram").to_numpy())
        masks = [pa.array(np.tile(b.column(k).to_numpy(), len(at))) for k in range(1, b.num_columns)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), *masks], names=["slot", *b.schema.names[1:]])


def _predict(model):
    names, slots, false = model.value

    def predict(batches: Iterator[pa.RecordBatch]):
        for rows, data, offsets in slices(batches):
            g, of = grams(data, offsets)
            mask = np.bitwise_and.reduce([slots[:, at] for at in _slots(g)]) if len(g) else np.zeros((len(slots), 0), np.uint64)
            total = np.bincount(of, minlength=rows.num_rows)
            share = np.zeros((rows.num_rows, max(1, len(names))))
            for k in range(len(names)):
                hits = np.bincount(of, weights=((mask[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(float), minlength=rows.num_rows)
                share[:, k] = np.clip((hits - total * false[k]) / (1 - false[k] + 1e-9), 0, None) / np.maximum(total, 1)
            letters = pc.match_substring_regex(rows.column("text").fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            at = share.argmax(axis=1)
            top = np.clip(share.max(axis=1), 0, 1)
            known = letters & bool(names)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.where(known, np.array([*names, "und"])[at if names else 0], "und").astype(object), pa.string()), pa.array(np.where(known, top, 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    return predict


def identify(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
