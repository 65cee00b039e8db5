import random
import re

import pytest
from bilateral.llm import ngram_join
from bilateral.llm.ngram_join import ngram_jaccard_join, ngram_jaccard_pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def main(got):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def check_links(df, got):
    """Links of every document and all pairs of classes against all pairs of rows with different ids."""
    rows = [(r.doc_id, shingles(r.text)) for r in df.collect()]
    first, links, pairs = {}, {}, set()
    for d, s in rows:
        first[frozenset(s)] = min(d, first.get(frozenset(s), d))
    for i, (d, s) in enumerate(rows):
        links[d] = 0
        for j, (_, t) in enumerate(rows):
            if i != j and s and t and 100 * len(s & t) >= 75 * len(s | t):
                links[d] += 1
                if s != t:
                    pairs.add((*sorted((first[frozenset(s)], first[frozenset(t)])), len(s & t)))
    assert {r.doc_id: r.n_links for r in got} == links
    assert all(r.class_id == first[frozenset(s)] for r in got for d, s in rows if d == r.doc_id and s)
    assert sorted(tuple(r) for r in ngram_jaccard_pairs(df).select("a", "b", "shared").collect()) == sorted(pairs)


def test_against_all_pairs(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet").limit(400)
    assert main(ngram_jaccard_join(df, links=False).collect()) == brute([(r.doc_id, r.text) for r in df.collect()])


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def planted():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for g in range(60):
        size = rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 90])
        base = [rng.choice(vocabulary) for _ in range(size)]
        if g % 4 == 0:
            base += passage
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 0, 1, 2]))))
    hub = [rng.choice(vocabulary) for _ in range(120)]
    rows += [(1000 + i, edited(rng, hub, rng.choice([0, 1, 2, 3]))) for i in range(80)]  # longer than a light list
    return rows


def test_planted_groups(spark, monkeypatch):
    """Long lists and large components in parts."""
    monkeypatch.setattr(ngram_join, "LIST", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    got = ngram_jaccard_join(df).collect()
    assert main(got) == brute(planted())
    check_links(df, got)


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, " \n\t"), (2, "One two"), (9, "one TWO"), (9, "one TWO"), (None, "one two"), (None, None), (7, "x " * 5000), (8, "x " * 4000)]
    df = spark.createDataFrame([(d, t, d, d) for d, t in rows], "doc_id long, text string, node long, n long")
    got = ngram_jaccard_join(df).collect()
    assert main(got) == sorted([(5, 0, 5), (4, 0, 4), (3, 0, 3), (2, 1, 2), (9, 1, 2), (9, 1, 2), (None, 1, 2), (None, 0, None), (7, 1, 7), (8, 1, 7)], key=str)
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(5, 5, 0), (4, 4, 0), (3, 3, 0), (2, 2, 3), (9, 2, 3), (None, 2, 3), (None, None, 0), (7, 7, 1), (8, 7, 1)}
    assert ngram_jaccard_join(df.limit(0)).count() == 0
