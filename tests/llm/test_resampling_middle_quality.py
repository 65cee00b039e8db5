"""Importance resampling, fill-in-the-middle and the quality classifier against brute force and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from bilateral.llm import fill_middle, quality, resampling
from bilateral.llm import queries as Q
from pyspark.sql import functions as F

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None), (2, ""), (3, " \n"), (None, "a null id " * 9), (5, "Twice " * 30), (5, "Twice " * 30), (7, " ".join(f"Word{i % 900}" for i in range(30000))),
    (8, "\x00  x <|endoftext|> \U0001f600 café, O'Neil's..."), (9, "z" * 3000 + " " + "é" * 700), (10, "has <S> inside it"), (11, " lead and trail \t"), (12, "!!! ---"),
]


def digest(d, seed=42):
    return hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1.5, "x", 7) for i, t in ODD], "doc_id long, text string, score double, `rank` string, n long")


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    starts = rng.integers(0, 50_000, 900)
    ends = starts + np.concatenate([rng.integers(1, 40, 600), rng.integers(200, 300, 200), rng.integers(1000, 9000, 97), [256, 512, 257]])
    got = resampling.crc32_spans(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert len(resampling.crc32_spans(data, starts[:0], ends[:0])) == 0


def plain_resample(docs, target, percent, least):
    def features(text):
        w = FEATURE_WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    each = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for d, n, f in each:
        h = int(digest(d)[:8], 16)
        weight = sum(gain(b) for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(may[: percent * len(may) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_resampling_odd_rows(spark, odd, tiny):
    target = spark.read.parquet(f"{tiny}/benchmark.parquet")
    texts = [r.text for r in target.collect()]
    got = resampling.resample(odd, target, percent=80)
    assert set(got.columns) == {"doc_id", "n", "n_words", "n_features", "weight", "score", "rank"}
    key = lambda r: (str(r[0]), r[3], r[4] or 0)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=key) == sorted(plain_resample(ODD, texts, 80, 20), key=key)
    assert resampling.resample(odd, target, keep_text=True).where("text is null").count() == 1
    none = resampling.resample(odd, target.limit(0), percent=80)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in none.collect()), key=key) == sorted(plain_resample(ODD, [], 80, 20), key=key)
    assert resampling.resample(odd.limit(0), target).count() == 0


def test_resampling_ties_and_partitions(spark, tiny):
    """Copies with one id tie; ranks are the same for any number of partitions."""
    rows = [(i // 3, "the same words again and again " * 5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.read.parquet(f"{tiny}/benchmark.parquet")
    got = [sorted((r.doc_id, r.score, r["rank"] or 0) for r in resampling.resample(df.repartition(n), target, percent=30).collect()) for n in (1, 7)]
    assert got[0] == got[1] and sorted(r[2] for r in got[0] if r[2]) == list(range(1, 91))


def test_rank_index_is_exact():
    rng = np.random.default_rng(2)
    texts = [b"", b" ", b"a", b" a b\n", b"x" * 5000 + b" y", b"ab " * 20000 + b"z" * 900 + b" q" * 3000, *(bytes(rng.choice(list(b"ab \n"), rng.integers(0, 80))) for _ in range(200))]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    bounds, tokens = fill_middle.boundaries(data, offsets)
    want = [[0, *(m.end() for m in TOKEN.finditer(t.decode()))] for t in texts]
    assert bounds.tolist() == [x for w in want for x in w] and tokens.tolist() == [len(w) - 1 for w in want]
    index = fill_middle.RankIndex(bounds, tokens)
    text, rank = np.repeat(np.arange(len(texts)), tokens + 1), np.concatenate([np.arange(k + 1) for k in tokens])
    assert (index.offset(text, rank) == bounds).all()
    assert index.residuals.dtype == np.int8 and len(index.lo) < len(texts) + 60  # few segments for some 26 000 boundaries
    tight = fill_middle.RankIndex(bounds, tokens, error=1)
    assert (tight.offset(text, rank) == bounds).all() and abs(tight.residuals).max() <= 1


def test_fill_in_middle_odd_rows(spark, odd):
    out = fill_middle.fill_in_middle(odd, share=100).withColumn("back", fill_middle.restored())
    assert set(out.columns) == {"doc_id", "score", "rank", "n", "n_segments", "form", "prefix_chars", "middle_chars", "output", "back"}
    rows = out.collect()
    assert len(rows) == len(ODD) and {r.form for r in rows} == {"plain", "spm", "psm"}
    texts = {d: t or "" for d, t in ODD}
    for r in rows:
        t = texts[r.doc_id]
        tokens = TOKEN.findall(t)
        h = [int(digest(r.doc_id)[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
        p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, len(tokens))))
        form = "plain" if not t or "<S>" in t else "spm" if h[3] % 100 < 80 else "psm"
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.back) == (len(tokens), form, want, t)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert fill_middle.fill_in_middle(odd, share=0).where("form <> 'plain'").count() == 0
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_restoring_sentinels_at_borders(spark):
    """Parts that end in the beginning of a sentinel are parted at the right place."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["< < < <", "<S <P <M >", "a<P b<S c<M", "S> P> M> <"] * 20)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(df, share=100).withColumn("back", fill_middle.restored()).join(df, "doc_id")
    assert out.where("form <> 'plain'").count() == 80 and out.where("back <> text").count() == 0


def plain_score(x, model):
    """One row through all trees, node by node."""
    raw, inner, leaves = model["start"], 2 ** model["depth"] - 1, 2 ** model["depth"]
    bins = [int(np.searchsorted(c, v, "left")) for c, v in zip(model["cuts"], x, strict=True)]
    for t in range(len(model["value"]) // leaves):
        node = 0
        while node < inner:
            node = 2 * node + 1 + (bins[model["feature"][t * inner + node]] > model["threshold"][t * inner + node])
        raw += model["value"][t * leaves + node - inner]
    return 1 / (1 + math.exp(-raw))


def test_trees_against_plain_splits():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality.fit(x, y, rounds=1, depth=1, rate=1.0)
    g, h = np.full(300, (y.sum() + 0.5) / 301) - y, None
    p = (y.sum() + 0.5) / 301
    h = np.full(300, p * (1 - p))
    best = max(
        (gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1), -f, -b) for f in range(4) for b in range(len(model["cuts"][f])) for low in [x[:, f] <= model["cuts"][f][b]] for gl, hl in [(g[low].sum(), h[low].sum())]
        if hl >= 1 and h.sum() - hl >= 1
    )
    assert (model["feature"][0], model["threshold"][0]) == (-best[1], -best[2])
    model = quality.fit(x, y)
    got = quality.predict(x, model)
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.97
    assert np.allclose(got[:40], [plain_score(r, model) for r in x[:40]], atol=1e-12)
    assert quality.predict(x, quality.fit(x, np.ones(300)))[0] == pytest.approx(300.5 / 301) and quality.predict(x[:2], quality.fit(x[:0], y[:0])).tolist() == [0.5, 0.5]


def test_statistics_do_not_depend_on_slices(spark, tiny):
    texts = [r.text.encode() for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect() if r.text is not None]
    both = lambda ts: quality.measure(np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])]))
    assert np.allclose(both(texts), np.concatenate([both([t]) for t in texts]), atol=1e-6)
    x = dict(zip(quality.STATISTICS, both([b"One two, two.\nONE!! ### 7"])[0].tolist(), strict=True))
    assert x["log_words"] == pytest.approx(math.log1p(6)) and x["bare_symbols"] == pytest.approx(1 / 6) and x["capital_words"] == pytest.approx(1 / 6)
    assert x["distinct_words"] == pytest.approx(6 / 6) and x["lines_ended"] == pytest.approx(1 / 2) and x["log_lines"] == pytest.approx(math.log(3))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_of_held_out_rows(spark, sf):
    at = f"/root/testdata/{sf}"
    out = Q.op13_quality_classifier(spark, at)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{at}/documents.parquet").count()
    known = out.join(spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality"), "doc_id").where("quality is not null").collect()
    held = [r for r in known if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in known)
    for label in (0, 1):
        rows = [r for r in held if r.quality == label]
        assert sum(r.predicted == label for r in rows) >= 0.95 * len(rows) and rows


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (7, 0), (8, None), (None, 1), (11, 1)], "doc_id long, quality int")
    known = {r.doc_id: r.label for r in quality.label_sample(labels).collect()}
    assert known == {1: 1, 5: 0, 7: 0, 11: 1}
    assert quality.label_sample(labels, limit=2).count() <= 4
    model = quality.train(odd.join(quality.label_sample(labels), "doc_id").select("text", "label"))
    out = quality.score(odd, model)
    assert set(out.columns) == {"doc_id", "score", "rank", "n"} and out.count() == len(ODD)
    assert out.where("doc_id = 5").select("score").distinct().count() == 1 and out.where("score between 0 and 1").count() == len(ODD)
    assert quality.score(odd, model, keep_text=True).where(F.col("text") == "").count() == 1
    empty = quality.train(odd.limit(0).select("text", F.lit(1).alias("label")))
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5} and quality.score(odd.limit(0), model).count() == 0
