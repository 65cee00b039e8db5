"""Counts, shares and score summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label_counts(df: DataFrame, side: str = "side", label: str = "label") -> DataFrame:
    return df.groupBy(side, label).agg(F.count("*").alias("n"))


def label_shares(counts: DataFrame, side: str = "side") -> DataFrame:
    """Percentage within side."""
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(W.partitionBy(side)) * 100)


def artefact_shares(df: DataFrame, user: str = "usr", side: str = "side", flag: str = "artefact", above: float = 0.01) -> DataFrame:
    """(user, side, share) of users whose shares of both sides sum to more than ``above``."""
    wide = df.groupBy(user).agg(*[F.avg(F.when(F.col(side) == s, F.col(flag).cast("double"))).alias(s) for s in ("left", "right")])
    wide = wide.where(F.coalesce("left", F.lit(0.0)) + F.coalesce("right", F.lit(0.0)) > above)
    return wide.unpivot([user], ["left", "right"], side, "share").where("share is not null")


def fold_summary(scores: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample standard error, population sd and population error of fold scores."""
    n = F.count(value)
    return scores.groupBy(*keys).agg(
        F.avg(value).alias("avg"), (F.stddev_samp(value) / F.sqrt(n)).alias("sem"), F.stddev_pop(value).alias("sd"), (F.stddev_pop(value) / F.sqrt(n)).alias("se_pop"), n.alias("n_folds"),
    )


def seed_summary(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over seeds of fold means and the pooled error sqrt(sum se^2) / combinations."""
    return folds.groupBy(*keys).agg(F.avg("avg").alias("avg"), (F.sqrt(F.sum(F.col("sem") * F.col("sem"))) / F.count("*")).alias("std_err"), F.count("*").alias("n_seeds"))


def opposite_error(folds: DataFrame, keys: list[str], how: str = "pooled") -> DataFrame:
    """Mean over seeds and its error when the test side is the other one: 'pooled' as in ``seed_summary``, 'sem'
    (sample sd of the seeds' means over the root of their number) or 'sd' (population sd over that root)."""
    if how == "pooled":
        return seed_summary(folds, keys)
    sd = {"sem": F.stddev_samp, "sd": F.stddev_pop}[how]
    return folds.groupBy(*keys).agg(F.avg("avg").alias("avg"), (sd("avg") / F.sqrt(F.count("*"))).alias("std_err"), F.count("*").alias("n_seeds"))


def stack(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Result frames one below the other, with their names in ``key``."""
    out = None
    for name, df in frames.items():
        one = df.withColumn(key, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def roc_auc(predictions: DataFrame, keys: list[str], score: str, label: str = "label") -> DataFrame:
    """Area under the ROC curve: the chance that a row of class 1 scores above one of class 0 (ties count half).

    Distinct scores are counted first; no pairs are formed."""
    cells = predictions.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("a"), F.sum(F.when(F.col(label) == 0, 1.0).otherwise(0.0)).alias("b"))
    upto = W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, 0)
    run = cells.withColumn("below", F.sum("b").over(upto) - F.col("b") / 2)
    got = run.groupBy(*keys).agg(F.sum(F.col("a") * F.col("below")).alias("wins"), (F.sum("a") * F.sum("b")).alias("pairs"))
    return got.select(*keys, (F.col("wins") / F.nullif(F.col("pairs"), F.lit(0.0))).alias("roc_auc"))


def best_model(scores: DataFrame, keys: list[str], model: str = "model", value: str = "avg") -> DataFrame:
    """The best model of each key (the first by name among equals), with the mean over models."""
    order = W.partitionBy(*keys).orderBy(F.desc(value), model)
    got = scores.withColumn("_r", F.row_number().over(order)).withColumn("mean_of_models", F.avg(value).over(W.partitionBy(*keys)))
    return got.where("_r = 1").select(*keys, model, F.col(value).alias("best"), "mean_of_models")


def without_dummy(scores: DataFrame, model: str = "model", dummy: str = "DummyClassifier") -> DataFrame:
    return scores.where(F.col(model) != dummy)


def mean_importance(importances: DataFrame, keys: list[str]) -> DataFrame:
    return importances.groupBy(*keys).agg(F.avg("importance").alias("importance"))


def feature_rank(importances: DataFrame, keys: list[str], feature: str = "feature", value: str = "importance") -> DataFrame:
    return importances.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), feature)))


def top_features(ranked: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """The first int(percent / 100 * n) features of each ranking."""
    return ranked.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where(F.col("rank") <= F.floor(percent * 0.01 * F.col("_n"))).drop("_n")


def balanced_accuracy(predictions: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction", n: str | None = None) -> DataFrame:
    """Mean recall over classes, with accuracy and the F1 score of class 1. ``n`` names a column that says how often a row counts."""
    times = F.col(n) if n else F.lit(1)
    hit = (F.col(label) == F.col(prediction)).cast("double") * times
    per = predictions.groupBy(*keys, label).agg((F.sum(hit) / F.sum(F.when(hit.isNotNull(), times))).alias("recall"), F.sum(hit).alias("hits"), F.sum(times).alias("n"))
    called = predictions.groupBy(*keys).agg(F.sum((F.col(prediction) == 1).cast("double") * times).alias("called"))
    got = per.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.sum(F.when(F.col(label) == 1, F.col("hits")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("pos"))
    return got.join(called, keys).select(*keys, "balanced_accuracy", "accuracy", (2 * F.col("tp") / F.nullif(F.col("called") + F.col("pos"), F.lit(0.0))).alias("f1"))


def by_class(effects: DataFrame, names=("negative", "positive"), keys=("component", "feature"), cls: str = "cls", value: str = "value") -> DataFrame:
    """Long effects as one column per class."""
    return effects.groupBy(*keys).pivot(cls, list(names)).agg(F.first(value))


def error_bars(effects: DataFrame, keys: list[str]) -> DataFrame:
    return effects.select(*keys, "value", F.abs(F.col("value") - F.col("ci_low")).alias("below"), F.abs(F.col("ci_high") - F.col("value")).alias("above"))
