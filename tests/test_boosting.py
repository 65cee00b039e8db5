"""Grouped boosting against plainly grown trees, and searches that run on it."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from bilateral.operators import boosting, models
from pyspark.sql import functions as F


def plain_margins(x, y, rows, p):
    """Margins of all rows after plain boosting on ``rows``: every threshold between values, recursion, no bins."""
    margin = [0.0] * len(x)
    for _ in range(p["rounds"]):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(prob, y, strict=True)], [a * (1 - a) for a in prob]

        def value(r):
            return -p["rate"] * sum(g[i] for i in r) / (sum(h[i] for i in r) + 1)

        def grow(train, every, depth):
            best, at = 1e-9, None
            G, H = sum(g[i] for i in train), sum(h[i] for i in train)
            if depth < p["depth"]:
                for f in range(len(x[0])):
                    for cut in sorted({x[i][f] for i in train}):
                        left = [i for i in train if x[i][f] <= cut]
                        a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                        if b < p["least_weight"] or H - b < p["least_weight"]:
                            continue
                        gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1)
                        if gain > best + 1e-9:
                            best, at = gain, (f, cut)
            if at is None:
                for i in every:
                    margin[i] += value(train)
                return
            f, cut = at
            for side in (True, False):
                grow([i for i in train if (x[i][f] <= cut) == side], [i for i in every if (x[i][f] <= cut) == side], depth + 1)

        grow(rows, list(range(len(x))), 0)
    return margin


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for i in range(90):
        y = i % 2
        rows.append((i, i % 3, "left" if i % 5 < 3 else "right", y, [float(rng.randint(0, 12) + 4 * y), float(rng.randint(0, 9)), float(i % 7)]))
    return rows, spark.createDataFrame(rows, "id long, grp long, side string, y int, x array<double>")


@pytest.mark.parametrize("block", [4096, 20])
def test_trees_equal_plain_ones(spark, data, block):
    rows, df = data
    parts = F.array(F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("id") % 3).cast("tinyint"), F.lit(0).cast("tinyint"))
    ready = df.withColumn("parts", parts).coalesce(1)
    blocks = boosting.pack_blocks(ready, boosting.edges_of(ready, 3), 2, block).cache()
    point = {"rounds": 3, "rate": 0.3, "depth": 3, "least_weight": 1.0, "subsample": 1.0, "share": 1.0, "seed": 5}
    fits = boosting.Fits(pd.DataFrame([{"split": 0, "inner": -1, **point}, {"split": 0, "inner": 1, **point}, {"split": 0, "inner": -1, **point, "depth": 1, "rounds": 1}, {"split": 1, "inner": 0, **point}]))
    counts, gains = boosting.train_and_count(blocks, blocks.count(), fits, 3, chunk=2)
    x, y = [r[4] for r in rows], [r[3] for r in rows]
    for k, (train, test, p) in enumerate([
        ([i for i in range(90) if i % 4], [i for i in range(90) if not i % 4], point), ([i for i in range(90) if i % 4 and i % 3 != 1], [i for i in range(90) if i % 4 and i % 3 == 1], point),
        ([i for i in range(90) if i % 4], [i for i in range(90) if not i % 4], point | {"depth": 1, "rounds": 1}), ([], list(range(90)), point),
    ]):
        m = plain_margins(x, y, train, p)
        want = [sum(1 for i in test if (m[i] > 0) == a and (y[i] == 1) == b) for a, b in ((True, True), (True, False), (False, True), (False, False))]
        assert counts.loc[k, ["tp", "fp", "fn", "tn"]].tolist() == want
    assert gains[0].argmax() == 0 and (gains[3] == 0).all()


def test_search_does_not_depend_on_blocks(data):
    _, df = data
    space = {"maxIter": [2, 4], "stepSize": [0.1, 0.3], "maxDepth": [1, 2]}
    got = [sorted(map(tuple, models.nested_cv(df, outer=2, inner=2, n_points=4, space=space, seed_triples=models.seed_triples(2)[:3], block=b).collect())) for b in (4096, 25)]
    assert [r[:4] for r in got[0]] == [r[:4] for r in got[1]] and len(got[0]) == 3 * 2 * (3 + 3)
    assert np.allclose([r[4] for r in got[0]], [r[4] for r in got[1]], atol=1e-6)
    assert np.mean([r[4] for r in got[0] if r[3] == "balanced_accuracy"]) > 0.6


def test_parts_are_a_deal(data):
    _, df = data
    rows, splits = models.deal_parts(df, models.fold_roles(3), 2, [(1, 2), (1, 3)])
    assert len(splits) == 6
    got = rows.select("id", "grp", "y", "parts").collect()
    for k, ((fold_seed, sample_seed, fold), n) in enumerate(splits):
        part = {r.id: r.parts[k] for r in got}
        assert sum(p >= 0 for p in part.values()) == n
        other = next(j for j, (s, _) in enumerate(splits) if s == (fold_seed, 5 - sample_seed, fold))
        assert {i for i, p in part.items() if p == -1} == {r.id for r in got if r.parts[other] == -1}  # outer folds don't hang on the sample
        for g in range(3):
            sizes = [sum(1 for r in got if r.grp == g and r.y == c and part[r.id] >= 0) for c in (0, 1)]
            assert sizes[0] == sizes[1]
        inner = [sum(1 for r in got if part[r.id] == f and r.y == c) for f in (0, 1) for c in (0, 1)]
        assert max(inner) - min(inner) <= 1


def test_sides_users_and_features(data):
    _, df = data
    args = {"inner": 2, "n_points": 2, "space": {"maxIter": [3], "stepSize": [0.2, 0.3], "maxDepth": [2]}}
    got = models.nested_opposite_side(df, features={"left-right": [1, 2]}, **args).collect()
    fi = {(r.fold, r.metric): r.value for r in got}
    assert fi["left-right", "FI_0"] == 0 and fi["right-left", "FI_0"] > 0 and {r.fold for r in got} == {"left-right", "right-left"}
    got = models.nested_loso(df, "left", "right", **args).where("metric = 'accuracy'").collect()
    assert sorted(r.fold for r in got) == ["0", "1", "2"]
    assert models.nested_loso(df.limit(0), **args).count() == 0
    assert models.nested_loso(df.where("grp = 1"), **args).count() == 0  # nobody is left to train on
    assert models.nested_cv(df.where("y = 1"), outer=2, **args).count() == 0  # one class: undersampling leaves nothing


def test_missing_values_and_ties(spark):
    rows = [(i, 0, i % 2, [None if i % 2 else 1.0, float("nan"), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, grp long, y int, x array<double>")
    got = models.nested_cv(df, outer=2, inner=2, n_points=1, space={"maxIter": [2], "maxDepth": [2], "stepSize": [0.3]}).where("metric = 'accuracy'").collect()
    assert len(got) == 2 and all(r.value == 1 for r in got)


def test_small_tables_are_one_block_whatever_their_partitions(data, monkeypatch):
    """Rows up to WHOLE are searched without a job a level; above, and with a given size, in blocks, with equal scores."""
    df, space = data[1].repartition(7), {"maxIter": [3], "stepSize": [0.1, 0.3], "maxDepth": [2]}
    seen, train = [], boosting.train_and_count
    monkeypatch.setattr(boosting, "train_and_count", lambda blocks, n, *rest: (seen.append(n), train(blocks, n, *rest))[1])
    monkeypatch.setattr(boosting, "BLOCK", 25)
    run = lambda: sorted(map(tuple, models.nested_cv(df, outer=2, inner=2, n_points=2, space=space, seed_triples=models.seed_triples(1)).collect()))
    one = run()
    assert set(seen) == {1}
    seen.clear()
    monkeypatch.setattr(boosting, "WHOLE", 25)
    many = run()
    assert min(seen) > 1 and [r[:-1] for r in one] == [r[:-1] for r in many]
    assert all(abs(a[-1] - b[-1]) < 1e-6 for a, b in zip(one, many, strict=True))


@pytest.mark.parametrize("paired", [1, 10_000])
def test_fits_that_one_task_grows_equal_plain_trees(data, paired, monkeypatch):
    """Counting bins by pairs of features (an odd one is left) and taking the larger child as what remains change no tree."""
    rows, _ = data
    monkeypatch.setattr(boosting, "PAIRED", paired)
    x, y = [r[4] for r in rows], [r[3] for r in rows]
    bins = np.array([[sorted({r[f] for r in x}).index(r[f]) for f in range(3)] for r in x], np.uint8)
    order = [i for i in range(90) if i % 4] + [i for i in range(90) if not i % 4]
    cell = boosting.Cell(np.array(order), bins[order], np.array(y, float)[order], sum(1 for i in range(90) if i % 4))
    p = {"rounds": 4, "rate": 0.3, "depth": 4, "least_weight": 1.0, "subsample": 1.0, "seed": 5}
    margins, gains = boosting.grow(cell, p, None)
    assert np.allclose(margins, np.array(plain_margins(x, y, order[: cell.n], p))[order], atol=1e-5)
    assert gains.argmax() == 0
    assert (boosting.grow(cell, p, np.array([[False, True, True]]))[1][0] == 0)


def test_fits_are_dealt_with_the_rows_they_need(data):
    """A table six times that of 1 GB (102 560 rows) needs no job a level, and a task gets no rows but those of its fits."""
    assert boosting.WHOLE >= 6 * 102_560
    rows, df = data
    ready = df.withColumn("parts", F.array((F.col("id") % 3 - 1).cast("tinyint"))).coalesce(1)
    (blocks,) = boosting.pack_blocks(ready, boosting.edges_of(ready, 3), 1).toArrow().to_batches()
    point = {"split": 0, "rate": 0.3, "least_weight": 1.0, "subsample": 1.0, "seed": 5}
    table = pd.DataFrame([{**point, "inner": k, "share": s, "rounds": r, "depth": 2} for k in (-1, 0, 1) for s in (0.2, 1.0) for r in (2, 3, 40)])
    deals, places = boosting.deal_fits(table, 4)
    assert sorted(i for d in deals for i in d.fits) == list(range(len(table))) and {d.place for d in deals} == set(range(places))
    assert all((table.loc[d.fits, "inner"] == d.cell[1]).all() and (table.loc[d.fits, "share"] == d.cell[3]).all() for d in deals)
    got = {b.column("deal")[0].as_py(): b for b in boosting._cut(deals)([blocks])}
    for k, d in enumerate(deals):
        ids = np.frombuffer(got[k].column("ids")[0].as_buffer(), np.int64)
        part = ids % 3 - 1
        train = (np.arange(len(ids)) < got[k].column("n")[0].as_py())
        assert (part[train] >= 0).all() and (part[train] != d.cell[1]).all() and (part[~train] == d.cell[1]).all()
        assert d.cell[3] == 1 or train.sum() < 30
