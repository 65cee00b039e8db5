"""Undersampling, folds, held-out users and augmentation. Random choices order rows by md5(seed:id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import shuffled_rank


def shuffle_key(seed: Column, row: Column) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), row.cast("string")))


def seeds(generators: list[int], n: int, spark) -> DataFrame:
    """(generator, seed_id, seed): n seeds of each generator seed, from md5."""
    return seeds_of(spark.createDataFrame([(g,) for g in generators], "generator int"), n)


def seeds_of(generators: DataFrame, n: int) -> DataFrame:
    """(generator, seed_id, seed): n seeds of each row's generator, from md5."""
    rows = generators.select("generator", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("seed_id"))
    digest = F.md5(F.concat_ws(":", F.col("generator").cast("string"), F.col("seed_id").cast("string")))
    return rows.withColumn("seed", F.conv(F.substring(digest, 1, 7), 16, 10).cast("long"))


def seed_grid(*lists: DataFrame) -> DataFrame:
    """All combinations of small seed lists."""
    out = lists[0]
    for other in lists[1:]:
        out = out.crossJoin(F.broadcast(other))
    return out


def undersample(df: DataFrame, group: str, label: str, row: str, seed) -> DataFrame:
    """A random subset with as many rows of each class as the group's rarest class; groups of one class drop out."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    counts = df.groupBy(group, label).agg(F.count("*").alias("_c")).groupBy(group).agg(F.min("_c").alias("_m"), F.count("*").alias("_k"))
    two = df.join(counts, group).where("_k > 1")
    return shuffled_rank(two, [group, label], shuffle_key(s, F.col(row)), row, "_r").where("_r <= _m").drop("_r", "_m", "_k")


def stratified_folds(df: DataFrame, label: str, row: str, k: int, seed, name: str = "fold", within: list[str] | None = None) -> DataFrame:
    """Adds a fold 0..k-1: rows of each class (within outer folds, if given) dealt in shuffled order."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    ranked = shuffled_rank(df, [*(within or []), label], shuffle_key(s, F.col(row)), row, "_r")
    return ranked.withColumn(name, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r")


def leave_one_out(df: DataFrame, user: str, side: str | None = None, train_side: str | None = None, test_side: str | None = None) -> DataFrame:
    """Rows with held_out user and part ('train' / 'test'); across sides, other rows drop out.

    Users are dealt to every row, so filter to one held-out user before a fit; the plan is a broadcast of the distinct users."""
    users = df.select(F.col(user).alias("held_out")).distinct()
    got = df.crossJoin(F.broadcast(users)).withColumn("part", F.when(F.col(user) == F.col("held_out"), "test").otherwise("train"))
    if side:
        got = got.where(F.when(F.col("part") == "train", F.col(side) == train_side).otherwise(F.col(side) == test_side))
    return got


def leave_one_out_counts(df: DataFrame, user: str, label: str, side: str | None = None, train_side: str | None = None, test_side: str | None = None) -> DataFrame:
    """(held_out, part, label, n) of ``leave_one_out`` without dealing rows to users: a user's training rows are all rows less its own."""
    train = df.where(F.col(side) == train_side) if side else df
    test = df.where(F.col(side) == test_side) if side else df
    total = train.groupBy(label).agg(F.count("*").alias("all"))
    own = train.groupBy(F.col(user).alias("held_out"), label).agg(F.count("*").alias("own"))
    users = df.select(F.col(user).alias("held_out")).distinct()
    # users by labels, both counted: the table of results
    rest = users.crossJoin(F.broadcast(total)).join(own, ["held_out", label], "left").select("held_out", F.lit("train").alias("part"), label, (F.col("all") - F.coalesce("own", F.lit(0))).alias("n"))
    mine = test.groupBy(F.col(user).alias("held_out"), label).agg(F.count("*").alias("n")).select("held_out", F.lit("test").alias("part"), label, "n")
    return rest.where("n > 0").union(mine)


def cross_side(df: DataFrame, side: str, settings=(("right", "right"), ("left", "left"), ("right", "left"), ("left", "right"))) -> DataFrame:
    """Rows with train_side, test_side and part for each setting."""
    rows = [F.struct(F.lit(a).alias("train_side"), F.lit(b).alias("test_side")) for a, b in settings]
    got = df.select("*", F.explode(F.array(*rows)).alias("_s")).select(*df.columns, "_s.*")
    part = F.array_compact(F.array(F.when(F.col(side) == F.col("train_side"), "train"), F.when(F.col(side) == F.col("test_side"), "test")))
    return got.withColumn("part", F.explode(part))


def augment(df: DataFrame, method: str, share: float, label: str, row: str, x: str = "x", seed: int = 1) -> DataFrame:
    """Only the augmented rows of a share of each class: jitter, scale, flip or smooth.

    Noise is a function of (seed, row, place), so reruns agree."""
    sizes = F.broadcast(df.groupBy(label).agg(F.count("*").alias("_n")))  # a row a class
    got = shuffled_rank(df.join(sizes, label), [label], shuffle_key(F.lit(seed), F.col(row)), row, "_r").where(F.col("_r") <= F.floor(share * F.col("_n"))).drop("_r", "_n")
    unit = lambda *k: (F.pmod(F.xxhash64(F.lit(seed), F.col(row), *k), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    v = F.transform(F.col(x), lambda a: a.cast("double"))
    if method == "jitter":  # normal noise, sd 0.05 (Box-Muller)
        new = F.transform(v, lambda a, i: a + 0.05 * F.sqrt(-2 * F.log(unit(i, F.lit(1)))) * F.cos(6.283185307179586 * unit(i, F.lit(2))))
    elif method == "scale":  # one factor of 0.5 .. 2 a row
        new = F.transform(v, lambda a: a * (0.5 + 1.5 * unit(F.lit(3))))
    elif method == "flip":
        new = F.transform(v, lambda a: -a)
    elif method == "smooth":  # gaussian, sd of one place, reflected ends
        g = [2.718281828459045 ** (-k * k / 2) for k in range(-4, 5)]
        n = F.size(x)
        at = lambda i, k: F.when(i + k < 0, -(i + k) - 1).when(i + k >= n, 2 * n - 1 - (i + k)).otherwise(i + k)
        new = F.transform(v, lambda a, i: sum((F.get(v, F.least(F.greatest(at(i, k), F.lit(0)), n - 1)) * (w_ / sum(g)) for k, w_ in zip(range(-4, 5), g, strict=True)), F.lit(0.0)))
    else:
        raise ValueError(f"unknown augmentation {method!r}")
    return got.withColumn(x, new)
