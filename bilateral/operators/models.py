"""Model fitting, search and nested evaluation: Spark ML for single models, grouped boosting for searches."""

from __future__ import annotations

import itertools
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import SharedTables
from . import boosting, sampling, summary

FIT_ROWS = 1 << 16  # rows of a partition that models are fitted on, where there are more than cores hold
GBT_SPACE = {"maxIter": [5, 10, 20, 40, 80], "stepSize": [0.01, 0.05, 0.1, 0.2, 0.3], "maxDepth": [2, 3, 4, 5, 6], "minInstancesPerNode": [1, 2, 4, 8, 16], "subsamplingRate": [0.6, 0.8, 0.9, 1.0]}


def preprocessing(df: DataFrame, label: str, most_levels: int = 10) -> Pipeline:
    """Stages that impute and scale numbers, one-hot encode texts of few levels and index the others."""
    numbers = [c for c, t in df.dtypes if c != label and t in ("double", "float", "int", "bigint")]
    texts = [c for c, t in df.dtypes if c != label and t == "string"]
    levels = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first() if texts else {}
    low = [c for c in texts if levels[c] <= most_levels]
    stages, parts = [], []
    if numbers:
        stages += [Imputer(inputCols=numbers, outputCols=[f"{c}_i" for c in numbers]), VectorAssembler(inputCols=[f"{c}_i" for c in numbers], outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_s", withMean=True)]
        parts.append("_s")
    for c in texts:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_x", handleInvalid="keep"))
        parts.append(f"{c}_o" if c in low else f"{c}_x")
        if c in low:
            stages.append(OneHotEncoder(inputCol=f"{c}_x", outputCol=f"{c}_o"))
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def battery(seed: int = 1) -> dict:
    """Default classifiers by name; 'NearestCentroid' and 'DummyClassifier' are handled in SQL."""
    args = {"featuresCol": "features", "labelCol": "label"}
    return {
        "GBT": GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **args), "RandomForest": RandomForestClassifier(numTrees=20, seed=seed, **args), "DecisionTree": DecisionTreeClassifier(seed=seed, **args),
        "LogisticRegression": LogisticRegression(maxIter=30, regParam=0.01, **args), "LinearSVC": LinearSVC(maxIter=20, regParam=0.01, **args), "NaiveBayes": NaiveBayes(modelType="gaussian", **args),
    }


def centroid_predict(train: DataFrame, test: DataFrame, row: str = "id") -> DataFrame:
    """Class of the nearest class mean (ties: the lower class)."""
    means = train.select("label", F.posexplode(vector_to_array("features")).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    each = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))
    centres = each.agg(F.collect_list(F.struct("label", "m")).alias("centres")).where(F.size("centres") > 0)  # a row, an entry a class
    x = test.select(row, "label", vector_to_array("features").alias("x")).crossJoin(F.broadcast(centres))
    far = lambda m: F.aggregate(F.zip_with("x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    near = F.array_min(F.transform("centres", lambda c: F.struct(far(c["m"]).alias("d"), c["label"].alias("label"))))
    return x.select(row, "label", near["label"].cast("double").alias("prediction"))


def dummy_predict(train: DataFrame, test: DataFrame, row: str = "id", seed: int = 1) -> DataFrame:
    """Random classes in the proportion of the training labels."""
    share = train.agg(F.avg(F.col("label").cast("double")).alias("p"))
    unit = F.conv(F.substring(sampling.shuffle_key(F.lit(seed), F.col(row)), 1, 7), 16, 10).cast("double") / float(16**7)
    return test.crossJoin(F.broadcast(share)).select(row, "label", F.when(unit < F.col("p"), 1.0).otherwise(0.0).alias("prediction"))


def candidates(space: dict, n: int, seed: int) -> list[dict]:
    """n points of a grid in a seeded order (no more than there are)."""
    import hashlib

    grid = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    return sorted(grid, key=lambda p: hashlib.md5(f"{seed}:{p}".encode()).hexdigest())[:n]


def scores(predictions: DataFrame) -> dict[str, float]:
    """Balanced accuracy, accuracy and F1 (NaN where there is none)."""
    counts = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))  # predictions are made once
    got = summary.balanced_accuracy(counts.withColumn("_k", F.lit(1)), ["_k"], n="n").first()
    return {m: float(got[m]) if got and got[m] is not None else float("nan") for m in ("balanced_accuracy", "accuracy", "f1")}


def score(predictions: DataFrame) -> float:
    return scores(predictions)["balanced_accuracy"]


def _vectors(df: DataFrame) -> DataFrame:
    """id, grp, side (if there), label, features from an array column x."""
    x = array_to_vector(F.transform("x", lambda v: v.cast("double")))
    return df.select("id", "grp", *[c for c in df.columns if c == "side"], F.col("y").cast("double").alias("label"), x.alias("features"))


def fold_roles(k: int):
    """Roles of stratified outer folds, dealt anew for every fold seed."""

    def roles(data: DataFrame) -> DataFrame:
        dealt = sampling.stratified_folds(data, "y", "id", k, F.col("fold_seed"), "outer", ["fold_seed"])
        each = dealt.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        return each.withColumn("test", F.col("fold") == F.col("outer")).withColumn("fold", F.col("fold").cast("string")).drop("outer")

    return roles


def side_roles(settings=(("left", "right"), ("right", "left"))):
    """Roles with the sides apart, users not held out; folds are named train-test."""

    def roles(data: DataFrame) -> DataFrame:
        ways = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in settings]))
        each = data.withColumn("_w", ways).where("side = _w.a or side = _w.b")
        return each.select(*data.columns, "_w.fold", (F.col("side") == F.col("_w.b")).alias("test"))

    return roles


def user_roles(train_side: str | None = None, test_side: str | None = None):
    """Roles with every user held out in turn; across sides the test rows are of the other one. Rows times users are dealt."""

    def roles(data: DataFrame) -> DataFrame:
        users = data.select(F.col("grp").alias("_u")).distinct()
        each = data.crossJoin(F.broadcast(users)).withColumn("test", F.col("grp") == F.col("_u")).withColumn("fold", F.col("_u").cast("string")).drop("_u")
        if train_side:
            each = each.where(F.when(F.col("test"), F.col("side") == (test_side or train_side)).otherwise(F.col("side") == train_side))
        return each

    return roles


def deal_parts(df: DataFrame, roles, inner: int, seed_pairs) -> tuple[DataFrame, list]:
    """df (id, grp, y, x, side) with an array of parts, one for each split, and the splits as (fold_seed, sample_seed, fold).

    A part is the inner fold of a row that is trained on (after undersampling within groups), TEST, or UNUSED.
    The rows that are shuffled hold no features; their number is that of rows and splits."""
    pairs = df.sparkSession.createDataFrame(list(seed_pairs), "fold_seed long, sample_seed long")
    slim = df.select("id", "grp", "y", *[c for c in df.columns if c == "side"])
    folds = roles(slim.crossJoin(F.broadcast(pairs.select("fold_seed").distinct())))
    each = folds.join(F.broadcast(pairs), "fold_seed").withColumn("split", F.struct("fold_seed", "sample_seed", "fold"))
    test = each.where("test").select("id", "split", F.lit(boosting.TEST).alias("part"))
    train = each.where("not test").withColumn("_g", F.struct("split", "grp"))
    train = sampling.undersample(train, "_g", "y", "id", F.col("sample_seed"))
    train = sampling.stratified_folds(train, "y", "id", inner, F.col("fold_seed"), "part", ["split"]).select("id", "split", "part")
    tables = SharedTables(df.sparkSession)
    parts = tables.put(train.union(test))
    counts = parts.groupBy("split").agg(F.count_if(F.col("part") >= 0).alias("n"), F.count_if(F.col("part") < 0).alias("t")).collect()  # a row a split
    splits = sorted((tuple(r.split), r.n) for r in counts if r.n and r.t)
    number = {s: i for i, (s, _) in enumerate(splits)}
    named = df.sparkSession.createDataFrame([(*s, i) for s, i in number.items()], "fold_seed long, sample_seed long, fold string, k int")
    known = parts.select("id", "part", "split.*").join(F.broadcast(named), ["fold_seed", "sample_seed", "fold"])
    by_row = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "part"))).alias("m"))  # at most one entry a split
    every = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(splits) - 1))), lambda k: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda a, _: a == k)), F.lit(0)), F.lit(boosting.UNUSED)).cast("tinyint"))
    return df.join(by_row.select("id", every.alias("parts")), "id"), splits


def halving(n_train: dict[int, int], seeds: dict[int, list[int]], inner: int, n_points: int | None, space: dict, factor: int = 3):
    """The first rung of every search: (split, seed, place, point, share, growth of share a rung).

    A search starts with ``n_points`` points (all that the rows allow, if None) on the least sample that holds two rows of each class
    in each inner fold, or on more where few points need few rungs."""
    out = []
    for split, n in n_train.items():
        least = min(n, 4 * inner)
        many = n_points or max(1, n // least)
        rungs = 0
        while factor ** (rungs + 1) <= max(1, many) and least * factor ** (rungs + 1) <= n:
            rungs += 1
        for seed in seeds[split]:
            for place, point in enumerate(candidates(space, many, seed)):
                out.append({"split": split, "seed": seed, "place": place, **point, "share": 1.0 / factor**rungs})
    return pd.DataFrame(out)


def _accuracies(c: pd.DataFrame) -> dict:
    with np.errstate(divide="ignore", invalid="ignore"):
        recalls = np.stack([c["tp"] / (c["tp"] + c["fn"]), c["tn"] / (c["tn"] + c["fp"])]).astype(float)
        n = c[["tp", "fp", "fn", "tn"]].sum(axis=1)
        return {"balanced_accuracy": np.nanmean(recalls, axis=0) if len(c) else [], "accuracy": (c["tp"] + c["tn"]) / n, "f1": 2 * c["tp"] / (2 * c["tp"] + c["fp"] + c["fn"])}


_PARAMETERS = {"maxIter": "rounds", "stepSize": "rate", "maxDepth": "depth", "minInstancesPerNode": "least_weight", "subsamplingRate": "subsample"}
_DEFAULTS = {"rounds": 20, "rate": 0.1, "depth": 5, "least_weight": 1.0, "subsample": 1.0}


def nested_search(df: DataFrame, roles, inner: int = 5, n_points: int | None = None, seed_triples=((1, 2, 3),), space: dict | None = None, features: dict[str, list[int]] | None = None, block: int | None = None) -> DataFrame:
    """(seed_id, fold, model, metric, value) of a search nested in any outer splits of (id, grp, y, x, side): undersampled training rows,
    successive halving by accuracy on inner folds, then balanced accuracy, accuracy, F1 and gain importances of the refitted winner.

    All fits of a rung are trained together (``boosting``), whatever the number of seeds, folds and points. Trees need no scaled features, and
    missing ones have their own bin. ``features`` names the places of x that a fold may use (the training side's ranking). Blocks hold
    ``block`` rows (None: all, up to ``boosting.WHOLE``)."""
    spark = df.sparkSession
    triples = list(seed_triples)
    rows, splits = deal_parts(df, roles, inner, sorted({t[:2] for t in triples}))
    schema = "seed_id int, fold string, model string, metric string, value double"
    if not splits:
        return spark.createDataFrame([], schema)
    tables = SharedTables(spark)
    rows = tables.put(rows)
    width = rows.select(F.max(F.size("x"))).first()[0]
    packed = boosting.pack_blocks(rows, boosting.edges_of(rows, width), len(splits), block or boosting.BLOCK)
    blocks = tables.put(packed.repartition(2 * spark.sparkContext.defaultParallelism))
    n_blocks, n_rows = blocks.agg(F.count("*"), F.sum("n")).first()
    if not block and n_rows <= boosting.WHOLE:
        n_blocks = 1  # as many rows as fits may be dealt with
    of_pair: dict[tuple, list[int]] = {}
    for a, b, c in triples:
        of_pair.setdefault((a, b), []).append(c)
    allowed = {i: features[s[2]] for i, (s, _) in enumerate(splits) if features and s[2] in features}
    alive = halving({i: n for i, (_, n) in enumerate(splits)}, {i: of_pair[s[:2]] for i, (s, _) in enumerate(splits)}, inner, n_points, space or GBT_SPACE).rename(columns=_PARAMETERS)
    for name, value in _DEFAULTS.items():
        if name not in alive:
            alive[name] = value
    search = ["split", "seed"]
    while len(alive) > alive.groupby(search).ngroups:
        tried = alive.merge(pd.DataFrame({"inner": range(inner)}), how="cross")
        counts, _ = boosting.train_and_count(blocks, n_blocks, boosting.Fits(tried, allowed), width)
        tried["score"] = np.asarray(_accuracies(counts)["accuracy"], float)
        mean = tried.groupby([*search, "place"], as_index=False)["score"].mean()
        mean["rank"] = mean.sort_values(["score", "place"], ascending=[False, True]).groupby(search).cumcount()
        mean["keep"] = -(-mean.groupby(search)["place"].transform("count") // 3)
        last = alive.groupby(search)["share"].transform("max") >= 1.0
        alive = alive.merge(mean[[*search, "place", "rank", "keep"]], on=[*search, "place"])
        alive = alive[alive["rank"] < np.where(last.to_numpy(), 1, alive["keep"])].drop(columns=["rank", "keep"]).reset_index(drop=True)
        alive["share"] = np.minimum(1.0, alive["share"] * 3)
    final = alive.assign(inner=-1, share=1.0)
    counts, gains = boosting.train_and_count(blocks, n_blocks, boosting.Fits(final, allowed), width)
    tables.drop(rows, blocks)
    number = {t: i for i, t in enumerate(triples)}
    ids = [(number[(*splits[s][0][:2], seed)], splits[s][0][2]) for s, seed in zip(final["split"], final["seed"], strict=True)]
    out = [(*i, "GBT", m, float(v)) for m, vs in _accuracies(counts).items() for i, v in zip(ids, vs, strict=True)]
    out += [(*i, "GBT", f"FI_{k}", float(v)) for i, g in zip(ids, gains / np.maximum(gains.sum(1, keepdims=True), 1e-300), strict=True) for k, v in enumerate(g)]
    return spark.createDataFrame(out, schema)


def seed_triples(n: int = 5, generators=(42, 69, 420)) -> list[tuple[int, int, int]]:
    """All n x n x n combinations of fold, sample and model seeds, from three generator seeds."""
    import hashlib

    lists = [[int(hashlib.md5(f"{g}:{i}".encode()).hexdigest()[:7], 16) for i in range(n)] for g in generators]
    return list(itertools.product(*lists))


def nested_cv(df: DataFrame, outer: int = 5, inner: int = 5, **search) -> DataFrame:
    """fold_scores (seed_id, fold_id, model, metric, value) of nested cross-validation on (id, grp, y, x)."""
    got = nested_search(df, fold_roles(outer), inner, **search)
    return got.select("seed_id", F.col("fold").cast("int").alias("fold_id"), "model", "metric", "value")


def nested_opposite_side(df: DataFrame, **search) -> DataFrame:
    """Nested search on one side, scored on the other, both ways. ``features`` by fold (left-right, right-left) takes each
    training side's best features."""
    return nested_search(df, side_roles(), **search)


def nested_loso(df: DataFrame, train_side: str | None = None, test_side: str | None = None, **search) -> DataFrame:
    """Nested search with every user held out in turn, on the same rows or across sides."""
    return nested_search(df, user_roles(train_side, test_side), **search)


def kfold_battery(df: DataFrame, k: int = 3, seed: int = 1, models: dict | None = None, split=None, parallelism: int = 4) -> DataFrame:
    """fold_scores (balanced accuracy, accuracy, F1) of default classifiers over stratified folds; ``split`` may deal the folds instead.

    ``parallelism`` models are fitted at a time."""
    spark = df.sparkSession
    dealt = SharedTables(spark)
    slim = dealt.put((split or (lambda d: sampling.stratified_folds(d, "label", "id", k, seed, "outer")))(_vectors(df)))
    # every fit makes dozens of passes, so a partition holds many rows, but there is one for each core
    parts = max(spark.sparkContext.defaultParallelism, -(-slim.count() // FIT_ROWS))
    data = slim.repartition(parts, "id").sortWithinPartitions("id").cache()
    data.count()  # else the first fits would each read all

    def fit(task):
        f, name = task
        train, test = data.where(F.col("outer") != f).drop("outer"), data.where(F.col("outer") == f)
        if name == "NearestCentroid":
            said = centroid_predict(train, test)
        elif name == "DummyClassifier":
            said = dummy_predict(train, test, seed=seed)
        else:
            said = tried[name].copy().fit(train).transform(test)
        return [(str(f), name, m, v) for m, v in scores(said).items()]

    tried = models or battery(seed)
    folds = sorted(r[0] for r in data.select("outer").distinct().collect())
    with ThreadPool(parallelism) as pool:
        found = pool.map(inheritable_thread_target(spark)(fit), [(f, name) for f in folds for name in (*tried, "NearestCentroid", "DummyClassifier")], 1)
    data.unpersist()
    dealt.drop(slim)
    return spark.createDataFrame([x for one in found for x in one], "fold_id string, model string, metric string, value double")


def loso(df: DataFrame, model: str = "GBT", seed: int = 1, train_side: str | None = None, test_side: str | None = None, augment: str | None = None) -> DataFrame:
    """Predictions with every user held out in turn (id, held_out, label, prediction); sides as in ``leave_one_out``."""
    out = None
    data = _vectors(df).cache()
    for (user,) in sorted(df.select("grp").distinct().collect()):
        train, test = data.where(F.col("grp") != user), data.where(F.col("grp") == user)
        if train_side:
            train, test = train.where(F.col("side") == train_side), test.where(F.col("side") == test_side)
        train = sampling.undersample(train, "grp", "label", "id", seed)
        if augment:
            more = sampling.augment(train.withColumn("x", vector_to_array("features")), augment, 0.5, "label", "id", seed=seed)
            train = train.unionByName(more.withColumn("features", array_to_vector("x")).drop("x"))
        got = battery(seed)[model].fit(train).transform(test).select("id", F.col("grp").alias("held_out"), "label", "prediction")
        out = got if out is None else out.union(got)
    return out


def opposite_side(df: DataFrame, train_side: str, test_side: str, model: str = "GBT", seed: int = 1) -> float:
    """Balanced accuracy of a model fitted on one side and tested on the other, users not held out."""
    data = _vectors(df)
    train = sampling.undersample(data.where(F.col("side") == train_side), "grp", "label", "id", seed)
    return score(battery(seed)[model].fit(train).transform(data.where(F.col("side") == test_side)))
