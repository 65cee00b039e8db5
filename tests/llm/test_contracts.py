"""Queries of the llm operators against brute-force versions on the smallest tables."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from bilateral.llm import blocks, fingerprints, flac, language_id, licenses, mixing, packing, suffix_tree, toxicity
from bilateral.llm import queries as Q
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 900}" for i in range(30000))
ODD = [(1, None), (2, ""), (3, " \n"), (None, "a null id"), (5, "Twice."), (5, "Twice."), (7, LONG), (8, "\x00  x <|endoftext|> \U0001f600 café, O'Neil's...")]


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, i, 1, "x") for i, t in ODD], "doc_id long, text string, lang string, n long, size int, source string")


def fold(d, n):
    return zlib.crc32(str("" if d is None else d).encode()) % n


def test_packing(spark, tiny, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q._tokenizer())

    def want(rows):
        out = []
        for d, text in rows:
            ids = t.encode(text or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), 4096):
                part = ids[k : k + 4096]
                out.append((d, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
        return sorted(out, key=str)

    for df, rows in ((Q.op2_best_fit_packing(spark, tiny), [(d[0], d[1]) for d in docs]), (packing.pack(odd, Q._tokenizer()), ODD)):
        got = df.collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want(rows)
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 4096
        assert len(by) <= math.ceil(sum(r.length for r in got) / 4096) * 1.1 + 1
    assert packing.pack(odd.limit(0), Q._tokenizer()).count() == 0


def test_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 65, rng.integers(1, 300)).tolist()
        gaps, want = [], 0
        for n in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                want += 1
                gaps.append(64 - n)
        plan = packing.sweep(list(Counter(lengths).items()), 64)
        used = defaultdict(list)
        for length, lo, hi, first, per, at in plan:
            for r in range(lo, hi + 1):
                used[first + (r - lo) // per].append((at + (r - lo) % per * length, length))
        assert sum(map(len, used.values())) == len(lengths) and len(used) == want
        for parts in used.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 64


def test_language(spark, tiny, docs, odd):
    got = {r.doc_id: r for r in Q.op3_language_id(spark, tiny).collect()}
    assert len(got) == len(docs)
    held = [d for d in docs if fold(d[0], 4) == 2]
    assert sum(got[d[0]].lang_pred == d[2] for d in held) >= 0.97 * len(held)
    assert all(got[d[0]].held_out == (fold(d[0], 4) == 2) and 0 <= got[d[0]].score <= 1 for d in docs)
    model = language_id.train(odd)
    out = language_id.identify(odd, model).collect()
    assert len(out) == len(ODD) and {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(odd.limit(0))).collect()} == {"und"}


def test_language_filter_names_all_languages():
    slots = np.zeros(language_id.SLOTS, np.uint64)
    g = np.arange(2000)
    m = (g % 3 + 1).astype(np.uint64)
    for at in language_id._slots(g):
        np.bitwise_or.at(slots, at, m)
    found = np.bitwise_and.reduce([slots[at] for at in language_id._slots(g)])
    assert ((found & m) == m).all() and (found != m).mean() < 0.01


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        alphabet = rng.sample(letters, 9)
        words = ["".join(rng.choice(alphabet) for _ in range(6)) for _ in range(40)]
        rows += [(100 * k + i, " ".join(rng.choice(words) for _ in range(60)), f"l{k:02}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, language_id.train(df.where("doc_id % 100 < 3"))).collect()}
    assert all(got[d] == lang for d, _, lang in rows)


def test_segments_are_all_maximal():
    rng = np.random.default_rng(2)

    def best(w, lo, hi, out):
        """The recursive definition: the best segment (shortest, first), then both sides."""
        top = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += w[b]
                if total > 0 and (top is None or total > top[2] + 1e-12):
                    top = (a, b + 1, total)
        if top:
            best(w, lo, top[0], out)
            out.append(top)
            best(w, top[1], hi, out)
        return out

    for _ in range(60):
        w = rng.integers(-9, 8, 25).astype(float) + rng.random(25) * 0.01
        assert [(a, b, round(s, 9)) for a, b, s in toxicity.segments(w)] == [(a, b, round(s, 9)) for a, b, s in best(w, 0, 25, [])]


def test_toxicity(spark, odd):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        words = [f"w{k}" for k in rng.integers(0, 400, rng.integers(5, 120))]
        bad = i % 8 == 0
        if bad:
            for k in rng.integers(0, len(words), 3):
                words[k] = ["vile", "rotten", "nasty"][rng.integers(0, 3)]
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = Q.toxicity_model(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    out = toxicity.score(df.select("doc_id", "toxic", "text"), model).collect()
    held = [r for r in out if fold(r.doc_id, 4) == 2]
    assert all((r.score >= 0.3) == bool(r.toxic) for r in held)
    flagged = next(r for r in held if r.toxic)
    text = rows[flagged.doc_id][1]
    assert any(re.search("vile|rotten|nasty", text[p.start : p.end]) for p in flagged.passages)
    assert all(0 <= r.score < 0.3 for r in toxicity.score(odd.withColumn("score", F.lit("x")).withColumn("passages", F.lit(1)), model).collect())
    none = Q.toxicity_model(df.select("doc_id", "text"), df.limit(0).select("doc_id", "toxic"))
    assert toxicity.score(odd, none).count() == len(ODD)


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    filler = "this file does things with the data of other files\n" * 30
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/x", filler), (3, "a/b/c/LICENSE", gpl), (4, "a/b/c/d/y", filler), (5, "z/y", filler),
        (6, "a/own", filler + "-- " + gpl.upper() + "!\n" + filler), (7, "a/q", None), (8, None, filler), (9, "a/b/x", filler),
    ]
    rows += [(100 + i, f"z/{i}", filler) for i in range(60)]
    df = spark.createDataFrame([(a, b, c, a) for a, b, c in rows], "doc_id long, path string, text string, score long")
    got = {r.doc_id: (r.license, r.effective_license, r.inherited_from) for r in licenses.scan_licenses(df).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[3][0] == "GPL-3.0" and got[6][:2] == ("GPL-3.0", "GPL-3.0")
    assert got[2] == got[9] == (None, "MIT", "a") and got[4] == (None, "GPL-3.0", "a/b/c") and got[7] == (None, "MIT", "a")
    assert got[5] == got[8] == got[100] == (None, None, None)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licences_common_wrapped_and_full(spark):
    """A notice on a third of all files, notices and headers over several lines, full texts, and what inherits them."""
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    full = licenses.all_templates()
    rows, want = [], {}
    for i in range(300):
        text, want[i] = prose(60), None
        if i % 3 == 0:
            text, want[i] = f"{prose(20)}\n{licenses.TEMPLATES['MIT']}\n{prose(40)}", "MIT"
        elif i % 50 == 1:
            words = licenses.TEMPLATES["MPL-2.0"].split()
            text, want[i] = prose(20) + "\n# " + "\n# ".join(" ".join(words[j : j + 4]) for j in range(0, len(words), 4)) + f"\n{prose(40)}", "MPL-2.0"
        elif i % 50 == 2:
            text, want[i] = licenses.HEADERS["Apache-2.0"].replace("\n", "\n * ") + f"\n{prose(500)}", "Apache-2.0"
        rows.append((i, f"a/{i}", text))
    for j, n in enumerate(sorted(n for n in full if len(full[n]) > 1 and max(map(len, full[n])) > 1000)):
        rows += [(1000 + j, f"b/{n}/LICENSE", max(full[n], key=len)), (2000 + j, f"b/{n}/src/code", prose(30))]
        want |= {1000 + j: n, 2000 + j: n}
    rows += [(3000, "c/LICENSE", licenses.TEMPLATES["MIT"]), (3001, "c/x/code", prose(30))]
    want |= {3000: "MIT", 3001: "MIT"}
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {i: r.effective_license for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.licence_file} == {i for i in want if 1000 <= i < 2000} | {3000}


def test_licence_runs():
    rng = np.random.default_rng(2)
    v, idf2 = np.append(rng.random(6), 0.0), 1 + rng.random(7)
    v /= np.linalg.norm(v)
    for _ in range(20):
        term = rng.integers(-1, 6, 40)

        def cosine(a, b, term=term):
            n = Counter(x for x in term[a:b].tolist() if x >= 0)
            norm = sum(c * c * idf2[x] for x, c in n.items()) + (term[a:b] < 0).sum() * idf2[-1]
            return sum(v[x] * c * math.sqrt(idf2[x]) for x, c in n.items()) / math.sqrt(norm)

        assert np.allclose(licenses._long_runs(term, v, idf2, 9), [cosine(a, a + 9) for a in range(32)])
        at = np.flatnonzero(term >= 0)
        got, end = licenses._short_runs(term, np.full(40, 40), v, idf2, at, 8)
        for a, c, e in zip(at, got, end, strict=True):
            assert np.isclose(c, max(cosine(a, b) for b in range(a + 1, min(a + 8, 40) + 1) if term[b - 1] >= 0)) and np.isclose(c, cosine(a, e))



def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_fingerprints(spark, tiny, docs, odd):
    for df, rows in ((Q.op6_fingerprints(spark, tiny), [(d[0], d[1]) for d in docs]), (fingerprints.fingerprint_edits(odd), ODD)):
        got = df.collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute_edits(rows)
        by, text = {}, dict(rows)
        for r in got:
            assert by.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if len(got) > 100:
            assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.2
    assert fingerprints.fingerprint_edits(odd.limit(0)).count() == 0
    assert fingerprints.fingerprint_edits(odd.where("doc_id = 7")).first().near_next == 1.0


def test_fingerprints_estimate_generalised_jaccard(spark):
    rng = np.random.default_rng(8)
    rows, truth = [], []
    weight = lambda c: {w: math.sqrt(n) * len(w) for w, n in c.items()}
    for i in range(300):
        base = [f"t{k}p{i}" for k in rng.integers(0, 60, 80)]  # words of its own, as equal words are sampled alike
        other = [w if rng.random() < 0.6 else f"u{rng.integers(0, 60)}p{i}" for w in base]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        a, b = weight(Counter(base)), weight(Counter(other))
        truth.append(sum(min(a.get(w, 0), b.get(w, 0)) for w in a) / sum(max(a.get(w, 0), b.get(w, 0)) for w in {*a, *b}))
    prints = fingerprints.fingerprint_terms(spark.createDataFrame(rows, "id long, t string"), ["id"], "t")
    p = {r.id: r.fingerprint for r in prints.collect()}
    k = fingerprints.SAMPLES
    found = [sum(p[2 * i][6 * j : 6 * j + 6] == p[2 * i + 1][6 * j : 6 * j + 6] for j in range(k)) / k for i in range(300)]
    assert abs(np.mean(found) - np.mean(truth)) < 0.03, (np.mean(found), np.mean(truth))


def test_flac_query(spark, tiny, docs, odd):
    def want(rows):
        out = []
        for d, t in rows:
            raw = (t or "").encode()
            p = raw + b"\0" * (max(-(-len(raw) // 64), 1) * 64 - len(raw))
            out.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        return sorted(out, key=str)

    for df, rows in ((Q.op7_flac_media(spark, tiny), [(d[0], d[1]) for d in docs]), (flac.digest(flac.store(odd)), ODD)):
        assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in df.collect()), key=str) == want(rows)
    blocks = flac.pcm_blocks(flac.store(odd.where("doc_id = 7"))).orderBy("sample_offset").collect()
    assert b"".join(r.pcm for r in blocks).rstrip(b"\0").decode() == LONG
    assert [r.sample_offset for r in blocks] == [flac.BLOCK * i for i in range(len(blocks))]
    assert flac.digest(flac.store(odd.limit(0))).count() == 0


@pytest.mark.parametrize("kind", ["silence", "noise", "sine", "ramp", "text"])
def test_flac_round_trip(kind):
    rng = np.random.default_rng(1)
    n = 64 * 70
    data = {"silence": np.zeros(n), "noise": rng.integers(0, 256, n), "sine": 128 + 90 * np.sin(np.arange(n) / 7), "ramp": np.arange(n) % 256, "text": np.frombuffer((b"some words " * n)[:n], np.uint8)}[kind].astype(np.uint8)
    sizes = np.array([64, n - 64 - 128, 128])
    streams = flac.encode(data, sizes)
    pcm, _, sample, count = flac.decode(streams)
    assert (pcm == data).all() and count.sum() == n
    broken = bytearray(streams[1])
    broken[-9] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])


def test_mixing(spark, tiny, docs, odd):
    sizes = defaultdict(int)
    for _, t, _, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes)
    target, open_, left = {}, list(names), 1.5 * sum(sizes.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over] if over else []
    got = Q.op8_mixing(spark, tiny).collect()
    source = {d[0]: d for d in docs}
    taken = defaultdict(int)
    for r in got:
        d = source[r.doc_id]
        assert r.size == len(WORD.findall(d[1] or "")) and r.source_size == sizes[d[3]] and 0 <= r.taken <= 2 * r.size
        assert math.isclose(r.target, target[d[3]], rel_tol=1e-9)
        taken[d[3]] += r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(got) == sorted(Q.op8_mixing(spark, tiny).collect())
    sized = odd.select("doc_id", mixing.word_count("text").alias("size"), F.array(F.when(F.col("doc_id") > 4, "a")).alias("sources"))
    out = mixing.mix(sized.withColumn("target", F.lit("x")).withColumn("taken", F.lit("x"))).collect()
    assert len(out) == len(ODD) and all(r.taken <= 2 * r.size for r in out)
    assert mixing.mix(sized.limit(0)).count() == 0


def test_mixing_overlapping_sources(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        own = rng.sample(["a", "b", "c", None], rng.choice([1, 1, 2, 3]))
        rows.append((i, rng.randrange(1, 90), own, f"k{i}", i))
    schema = "doc_id long, size long, sources array<string>, key string, part long"  # names that the work uses, too
    got = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, schema)).collect()), key=str)
    turned = [(d, n, own[::-1], k, p) for d, n, own, k, p in reversed(rows)]
    again = mixing.mix(spark.createDataFrame(turned, schema).repartition(7)).collect()
    assert sorted(((r[0], *r[3:]) for r in again), key=str) == sorted(((r[0], *r[3:]) for r in got), key=str)
    names = ["a", "b", "c", None]
    sizes = [sum(n for _, n, own, *_ in rows if s in own) for s in names]
    targets = mixing.source_targets(list(zip(names, sizes, strict=True)))
    by_pattern, taken = Counter(), Counter()
    for d, n, own, k, p, size, target, t in got:
        first = min(own, key=names.index)
        assert (size, k, p) == (sizes[names.index(first)], f"k{d}", d) and math.isclose(target, targets[names.index(first)])
        assert 0 <= t <= 2 * n
        pattern = tuple(sorted(own, key=names.index))
        by_pattern[pattern] += n
        taken[pattern] += t
    # brute force: the most words that the patterns can send, over all subsets of sources (max flow, min cut)
    want = [math.floor(t + 0.5) for t in targets]
    cut = min(
        sum(w for s, w in zip(names, want, strict=True) if s not in cut) + sum(2 * n for p, n in by_pattern.items() if set(p) & set(cut))
        for k in range(5) for cut in itertools.combinations(names, k)
    )
    assert sum(taken.values()) == cut
    # nothing comes twice that a first round could have served
    spare = [p for p, n in by_pattern.items() if taken[p] < n]
    assert not any(set(p) & set(q) and taken[q] > by_pattern[q] for p in spare for q in by_pattern)


def test_flow_prefers_first_rounds():
    # the shared pattern must serve the source that has nothing else
    sent = mixing.min_cost_flow([((0,), 100.0), ((0, 1), 100.0)], [100.0, 100.0], 2)
    assert sent[0] == {0: 100.0} and sent[1] == {0: 0.0, 1: 100.0}
    sent = mixing.min_cost_flow([((0, 1), 100.0), ((0,), 100.0)], [100.0, 100.0], 2)
    assert sent[0] == {0: 0.0, 1: 100.0} and sent[1] == {0: 100.0}


def brute_base(rows):
    tokens = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, (_, t) in enumerate(rows)}
    c = Counter(w for i, (d, _) in enumerate(rows) if fold(d, 5) != 1 for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return [(d, fold(d, 5) == 1, len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])) for i, (d, _) in enumerate(rows)]


def brute_tree(texts, train, depth):
    """log10 probabilities of texts by the definition: dictionaries of contexts, recursion over suffixes."""
    T = suffix_tree
    seqs = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "<end>"] for t in texts]
    used = [s for s, x in zip(seqs, train, strict=True) if x]
    grams = Counter(tuple(s[i : i + k]) for s in used for k in range(1, depth + 2) for i in range(len(s) - k + 1))
    total, kinds = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    entries = defaultdict(dict)

    def p(word, context):
        if not context:
            return (grams[(word,)] + 0.5) / (total + 0.5 * (kinds + 1))
        low = p(word, context[1:])
        if context not in entries:
            return low
        n, own = grams[context], entries[context]
        back = max(1e-6, 1 - sum((c - T.DISCOUNT) / n for c in own.values()))
        return ((own[word] - T.DISCOUNT) / n if word in own else 0) + back * low

    for k in range(1, depth + 1):
        new = []
        for g, c in grams.items():
            if len(g) == k + 1 and c >= T.LEAST_PAIR and grams[g[:-1]] >= T.LEAST_CONTEXT:
                closed = k == 1 or (g[-2] in entries[g[:-2]] and g[-1] in entries[g[1:-1]])
                if closed and c * math.log(c / grams[g[:-1]] / p(g[-1], g[1:-1])) >= T.GAIN:
                    new.append((g[:-1], g[-1], c))
        for context, word, c in new:
            entries[context][word] = c
    entries = {k: v for k, v in entries.items() if v}
    vocabulary = [g[0] for g in grams if len(g) == 1]
    for context in list(entries)[:20]:
        assert math.isclose(sum(p(w, context) for w in vocabulary) + p("<unseen>", context), 1.0, rel_tol=1e-9)
    deepest = max(map(len, entries), default=0)
    return [sum(math.log10(p(w, tuple(s[max(0, i - depth) : i]))) for i, w in enumerate(s)) for s in seqs], deepest


def test_suffix_tree_answers_a_bucket_without_grams():
    """A bucket that is asked for words only, or has no values at all, is answered with numbers that add up."""
    h = np.array([3, 9], np.uint64)
    asks = pa.table({"slice": [0], "bucket": pa.array([0], pa.int32()), "block": [blocks.block(np.array([0, 1], np.uint32) | suffix_tree.WORD_BIT, h)]})
    values = pa.table({"key": pa.array([9], pa.int64()), "n": pa.array([4], pa.int64()), "value": [0.25], "is_word": [True]})
    for given, more in ((values, [0.25]), (values.slice(0, 0), [])):
        got = suffix_tree._answer(10.0)((0,), asks, given)
        assert blocks.arrays(got["grams"][0].as_py(), "u4", "f8")[1].tolist() == more
        at, known, base = blocks.arrays(got["words"][0].as_py(), "u4", "u4", "f8")
        assert at.tolist() == [0, 1] and known.tolist() == [0, len(more)]
        assert np.allclose(base, np.log10((np.array([0, 4 * len(more)]) + 0.5) / 10))


def test_suffix_tree(spark, tiny, docs, odd, monkeypatch):
    last = None
    for limit in (suffix_tree.HOT_WORDS, 50):  # most words and grams in the tables, too
        monkeypatch.setattr(suffix_tree, "HOT_WORDS", limit)
        monkeypatch.setattr(suffix_tree, "HOT_GRAMS", limit)
        if limit == 50:  # and in many buckets
            monkeypatch.setattr(suffix_tree, "COUNT_BUCKET", 20_000)
            monkeypatch.setattr(suffix_tree, "ASK_BUCKET", 20_000)
            monkeypatch.setattr(blocks, "GATHERED", 5_000)
        for df, rows in ((Q.op9_suffix_tree(spark, tiny), [(d[0], d[1]) for d in docs]), (suffix_tree.score(odd, Q._fold(5) == 1), ODD)):
            got = sorted(df.collect(), key=str)
            want = sorted(brute_base(rows), key=lambda x: str(x[:4]))
            key = lambda r: (str(r[0]), r[1], r[2], r[3])
            for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
                assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
                assert math.isclose(g.base_score, w[5], rel_tol=1e-9)
            if len(rows) > 100:
                scores, deepest = brute_tree([t for _, t in rows], [fold(d, 5) != 1 for d, _ in rows], suffix_tree.DEPTH)
                assert deepest == suffix_tree.DEPTH
                by_id = {d: s for (d, _), s in zip(rows, scores, strict=True)}
                assert all(math.isclose(g.score, by_id[g.doc_id], rel_tol=1e-9) for g in got)
                held = [g for g in got if g.held_out]
                assert sum(g.score for g in held) > sum(g.base_score for g in held)
    assert suffix_tree.score(odd.limit(0), Q._fold(5) == 1).count() == 0


def test_only_copies_of_one_label_teach_once(spark):
    """Texts that share a line all teach, copies and near copies once for each label."""
    from bilateral.llm.tables import Tables

    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    line, copied, near = prose(60), prose(80), [prose(20) for _ in range(10)]
    rows = [(i, f"{line} {prose(60)}", i % 2) for i in range(200)]
    rows += [(1000 + i, copied, int(i >= 20)) for i in range(40)]
    rows += [(2000 + i, " ".join([*near, f"own{i}"]), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    left = {r.doc_id for r in toxicity.one_of_each(df, Tables(spark)).collect()}
    assert left == {*range(200), 1000, 1020, 2000}


def test_copies_edited_apart_teach_once(spark):
    """Copies with a similarity of 0.75 or more to one text agree less with each other; they are one text all the same."""
    from bilateral.llm.tables import Tables

    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]

    def edited(i):
        at = set(rng.choice(300, 8, replace=False))
        return " ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(words))

    rows = [(0, " ".join(words), 1), *((i, edited(i), 1) for i in range(1, 60)), (100, "", 1), (101, None, 1), (102, "one", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    left = {r.doc_id for r in toxicity.one_of_each(df, Tables(spark)).collect()}
    assert left - {100, 101} == {0, 102}


def plain_segments(w, a=0):
    """Maximal scoring segments by definition: the best one (the leftmost, then the shortest), then those of both sides."""
    best = None
    for i in range(len(w)):
        total = 0.0
        for j in range(i, len(w)):
            total += w[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, total = best
    return [*plain_segments(w[:i], a), (a + i, a + j, total), *plain_segments(w[j:], a + j)]


def test_toxicity_query(spark, tiny, docs):
    frame = spark.read.parquet(f"{tiny}/documents.parquet")
    model = Q.toxicity_model(frame, spark.read.parquet(f"{tiny}/labels.parquet"))
    weight = dict(zip(model["weights"][0].tolist(), model["weights"][1].tolist(), strict=True))
    got = {r.doc_id: r for r in Q.op4_toxicity(spark, tiny).collect()}
    assert set(got) == {d[0] for d in docs}
    word = re.compile(rb"[^\x00-\x08\x09-\x0d\x0e-\x1f\x20-\x2f:-@\[-`{-~\x7f]+")
    checked = 0
    for d, text, *_ in docs:
        raw = (text or "").encode()
        at = [m.span() for m in word.finditer(raw)]
        if len(at) > 400 or re.search(rb"[\x00-\x08\x0e-\x1f\x7f]", raw):
            continue
        data = np.frombuffer(raw, np.uint8)
        h = toxicity.hashes(data, *np.array(at, np.int64).reshape(-1, 2).T) if at else []
        w = [weight.get(int(x), 0.0) + toxicity.DRIFT for x in h]
        found = [s for s in plain_segments(w) if s[2] >= toxicity.MIN_SEGMENT] if any(x > 0 for x in w) else []
        x = min(20.0, sum(min(50.0, max(0.0, model["lambda"] * s - math.log(model["k"] * max(len(at), 1)))) for *_, s in found))
        b0, b1 = model["beta"]
        assert math.isclose(got[d].score, 1 / (1 + math.exp(-(b0 + b1 * x))), rel_tol=1e-9)
        assert got[d].held_out == (fold(d, 4) == 2) and got[d].predicted == int(got[d].score >= 0.3)
        checked += 1
    assert checked > 100
    assert toxicity.score(frame.select("doc_id", "text").limit(0), model).count() == 0


def test_language_query_against_sets(spark, tiny, docs):
    def grams(text):
        padded = b" " + bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()) + b" "
        for i in range(len(padded) - 3):
            a, b, c, d = padded[i : i + 4]
            if b != 32 and not (a == 32 and c == 32) and not (c == 32 and d != 32):
                yield padded[i : i + 4]

    rate = defaultdict(Counter)
    for d, text, lang, _ in docs:
        if text is not None and lang is not None and fold(d, 4) != 2:
            rate[lang].update(grams(text))
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in rate.items()}
    rate = {k: {g: r for g, r in c.items() if r >= language_id.RATE} for k, c in rate.items()}
    best = Counter()
    for c in rate.values():
        for g, r in c.items():
            best[g] = max(best[g], r)
    got = {r.doc_id: r.lang_pred for r in Q.op3_language_id(spark, tiny).collect()}
    same = 0
    for d, text, *_ in docs:
        own = list(grams(text or ""))
        share = {k: sum(c.get(g, 0) >= language_id.SHARE * best[g] for g in own if g in c) for k, c in rate.items()}
        top = max(sorted(share), key=lambda k: share[k])
        same += got[d] == (top if re.search(r"[^\W\d_]", text or "") else "und")
    assert same >= 0.99 * len(docs)


def test_substring_query_covers_every_shared_run(spark, tiny, docs):
    got = defaultdict(list)
    for r in Q.op10_substring_dedup(spark, tiny).collect():
        assert r.other_doc_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.75
        got[r.doc_id].append((r.start_word, r.start_word + r.n_words))
    first = {}
    total = missed = 0
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, text, *_ in sorted(docs):
        words = WORD.findall((text or "").translate(lower))
        covered = np.zeros(len(words) + 1, bool)
        for a, b in got[d]:
            covered[a:b] = True
        for i in range(len(words) - 49):
            run = hashlib.md5(" ".join(words[i : i + 50]).encode()).digest()
            if first.setdefault(run, d) != d:
                total += 1
                missed += not covered[i : i + 50].all()
    assert total > 100 and missed <= 0.001 * total
