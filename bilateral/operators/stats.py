"""Statistics of paired and grouped values. Every one is one plan over all groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import Z95, average_rank, div, holm, normal_quantile, normal_tail, running_sums, t_two_sided


def pearson(df: DataFrame, keys: list[str], x: str, y: str, z: float = Z95, fill: bool = True) -> DataFrame:
    """r, n, Fisher's interval and t; missing values count as 0 when ``fill``."""
    a, b = (F.coalesce(F.col(c), F.lit(0.0)) if fill else F.col(c) for c in (x, y))
    got = df.groupBy(*keys).agg(F.corr(a, b).alias("r"), F.count("*").alias("n"))
    r = F.when(F.abs("r") < 1, F.col("r"))
    half = z / F.sqrt(F.when(F.col("n") > 3, F.col("n") - 3).cast("double"))
    return got.select(*keys, "r", "n", F.tanh(F.atanh(r) - half).alias("ci_low"), F.tanh(F.atanh(r) + half).alias("ci_high"), correlation_t(r, F.col("n")).alias("t"))


def correlation_t(r: Column, n: Column) -> Column:
    return r * F.sqrt(F.greatest(n - 2, F.lit(0)).cast("double")) / F.sqrt(F.when(F.abs(r) < 1, 1 - r * r))


def with_t_p(df: DataFrame, t: str = "t", n: str = "n", keys: list[str] | None = None, tie: str = "n") -> DataFrame:
    """Two-sided p of a correlation's t, and Holm's correction within keys."""
    got = df.withColumn("p", t_two_sided(F.col(t), (F.col(n) - 2).cast("double")))
    return holm(got, "p", keys or [], tie) if keys is not None else got


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of mean ranks."""
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(got, x, keys, "_rx"), y, keys, "_ry")
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def with_spearman_p(df: DataFrame) -> DataFrame:
    """Two-sided p of rho by Student's t with n - 2 degrees of freedom."""
    rho = F.when(F.abs("rho") < 1, F.col("rho"))
    return df.withColumn("p", t_two_sided(correlation_t(rho, F.col("n")), (F.col("n") - 2).cast("double")))


def kendall_sums(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, s (concordant less discordant pairs) and the tie sums of x and y: tied pairs (tx), t(t-1)(t-2) (x0) and t(t-1)(2t+5) (x1).
    Values are compressed to distinct pairs with counts.

    Concordant less discordant pairs are counted without forming them: two values of y differ first at one binary digit of
    their ranks, so each cell looks, for every digit, at the cells of smaller x with the same digits before and
    the other one there. That is one window over n log n rows."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    n = cells.groupBy(*keys).agg(F.sum("c").alias("n"))
    t = F.col("t").cast("double")
    ties = lambda c: cells.groupBy(*keys, c).agg(F.sum("c").alias("t")).groupBy(*keys).agg(F.sum(t * (t - 1) / 2).alias(f"t{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"{c}0"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{c}1"))
    tx, ty = ties("x"), ties("y")
    ranks = cells.groupBy(*keys, "y").agg(F.lit(1).alias("one")).select(*keys, "y", (F.row_number().over(W.partitionBy(*keys).orderBy("y")) - 1).alias("rank"))
    steps = cells.groupBy(*keys, "x").agg(F.lit(1).alias("one")).select(*keys, "x", F.row_number().over(W.partitionBy(*keys).orderBy("x")).cast("long").alias("step"))
    digits = ranks.groupBy(*keys).agg(F.length(F.bin(F.max("rank").cast("long"))).alias("digits"))
    placed = cells.join(ranks, [*keys, "y"]).join(steps, [*keys, "x"]).join(digits, keys)
    each = placed.select(*keys, "step", "c", "rank", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)).alias("d"))
    each = each.select(*keys, "step", "c", "d", F.expr("shiftright(rank, d + 1)").alias("before"), F.expr("shiftright(rank, d) % 2").alias("digit"))
    less = W.partitionBy(*keys, "d", "before").orderBy("step").rangeBetween(W.unboundedPreceding, -1)
    below = lambda b: F.coalesce(F.sum(F.when(F.col("digit") == b, F.col("c"))).over(less), F.lit(0))
    each = each.select(*keys, (F.col("c") * F.when(F.col("digit") == 1, below(0)).otherwise(-below(1))).alias("s"))
    s = each.groupBy(*keys).agg(F.sum("s").cast("double").alias("s"))
    return n.join(tx, keys).join(ty, keys).join(s, keys, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def kendall(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """tau-b of each group."""
    got = kendall_sums(df, keys, x, y)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return got.select(*keys, div(F.coalesce("s", F.lit(0.0)), F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))).alias("tau"), "n")


def with_kendall_p(df: DataFrame) -> DataFrame:
    """Two-sided normal p of tau (its variance without ties: 2 (2n + 5) / 9n(n - 1))."""
    n = F.col("n").cast("double")
    z = F.col("tau") / F.sqrt(F.when(n > 1, 2 * (2 * n + 5) / (9 * n * (n - 1))))
    return df.withColumn("p", F.least(F.lit(1.0), 2 * normal_tail(F.abs(z))))


def wilcoxon(df: DataFrame, keys: list[str], x: str, y: str, correction: bool = False) -> DataFrame:
    """Signed-rank statistic (zeros dropped), its normal deviate with tie correction; see ``with_normal_p``."""
    d = df.withColumn("_d", F.col(x) - F.col(y)).where("_d != 0").withColumn("_a", F.abs("_d"))
    ranked = average_rank(d, "_a", keys, "_r")
    ties = d.groupBy(*keys, "_a").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    got = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("minus"), F.count("*").alias("n")).join(ties, keys)
    n = F.col("n").cast("double")
    w = F.least("plus", "minus")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0
    shift = 0.5 * F.signum(w - mean) if correction else F.lit(0.0)
    return got.select(*keys, w.alias("w"), "n", div(w - mean - shift, F.sqrt(F.when(var > 0, var))).alias("z"))


def with_normal_p(df: DataFrame, z: str = "z", two_sided: bool = True) -> DataFrame:
    p = normal_tail(F.abs(F.col(z)))
    return df.withColumn("p", F.least(F.lit(1.0), 2 * p) if two_sided else p)


def cliff_delta(df: DataFrame, keys: list[str], x: str, y: str, z: float = Z95) -> DataFrame:
    """Cliff's delta of two samples in columns x and y (NULL: absent) with its asymmetric interval.

    Dominance counts come from cumulative counts over distinct values: no pairs are formed."""
    one = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("v")).agg(F.count("*").alias("a"), F.lit(0).cast("long").alias("b"))
    two = df.where(F.col(y).isNotNull()).groupBy(*keys, F.col(y).alias("v")).agg(F.lit(0).cast("long").alias("a"), F.count("*").alias("b"))
    cells = one.union(two).groupBy(*keys, "v").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    run = running_sums(cells, keys, "v", {"ca": "a", "cb": "b"})
    sizes = cells.groupBy(*keys).agg(F.sum("a").alias("m"), F.sum("b").alias("n")).where("m > 0 and n > 0")
    run = run.join(sizes, keys)
    di = (F.col("cb") - F.col("b") - (F.col("n") - F.col("cb"))) / F.col("n")  # dominance of a value of x over y
    dj = ((F.col("m") - F.col("ca")) - (F.col("ca") - F.col("a"))) / F.col("m")  # of x over a value of y
    got = run.groupBy(*keys).agg(
        F.max("m").alias("m"), F.max("n").alias("n"), F.sum(F.col("a") * di).alias("sd"), F.sum(F.col("a") * di * di).alias("s1"), F.sum(F.col("b") * dj * dj).alias("s2"), F.sum(F.col("a") * F.col("b")).alias("tied"),
    )
    d = got.withColumn("delta", F.col("sd") / F.col("m"))
    m, n, delta = F.col("m"), F.col("n"), F.col("delta")
    by_i, by_j = F.col("s1") - m * delta * delta, F.col("s2") - n * delta * delta
    by_ij = m * n - F.col("tied") - m * n * delta * delta
    var = div(n * n * by_i + m * m * by_j - by_ij, m * n * (m - 1) * (n - 1))
    s = F.sqrt(F.greatest(var, F.lit(0.0)))
    root = z * s * F.sqrt((1 - delta * delta) * (1 - delta * delta) + z * z * s * s)
    den = F.nullif(1 - delta * delta + z * z * s * s, F.lit(0.0))
    mid = delta - delta * delta * delta
    return d.select(*keys, "delta", F.greatest(F.lit(-1.0), (mid - root) / den).alias("ci_low"), F.least(F.lit(1.0), (mid + root) / den).alias("ci_high"), m.cast("long").alias("n_left"), n.cast("long").alias("n_right"))


def effect_bin(delta: str, cuts=(0.11, 0.28, 0.43)) -> Column:
    """Signed size class 0..3 of an effect, NULL for missing values."""
    a = F.abs(F.col(delta))
    return (F.signum(F.col(delta)) * F.when(a < cuts[0], 0).when(a < cuts[1], 1).when(a < cuts[2], 2).otherwise(3)).cast("int")


def standard_error(value: Column, upper: Column) -> Column:
    return (value - upper) / 1.96


def compare_classes(effects: DataFrame, keys: list[str]) -> DataFrame:
    """z of negative against positive class (columns <class>, <class>_high): difference over pooled error, and which is larger."""
    e1, e2 = (standard_error(F.col(c), F.col(f"{c}_high")) for c in ("negative", "positive"))
    z = div(F.col("negative") - F.col("positive"), F.sqrt(e1 * e1 + e2 * e2))
    return effects.select(*keys, z.alias("z"), F.when(F.abs("negative") > F.abs("positive"), "negative").otherwise("positive").alias("larger"))


def class_shares(compared: DataFrame, by: list[str]) -> DataFrame:
    """Share of comparisons in which each class is larger among the rejected ones, and of no difference."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return compared.groupBy(*by).agg(share(F.col("reject") & (F.col("larger") == "negative")).alias("negative_larger"), share(F.col("reject") & (F.col("larger") == "positive")).alias("positive_larger"), share(~F.col("reject")).alias("no_difference"))


def corrected_kfold_t(scores: DataFrame, settings: list[str], pair_by: list[str], value: str, n_train: float, n_test: float, df_mode: str = "reference") -> DataFrame:
    """Corrected repeated k-fold t of every pair of settings (a < b) over paired folds."""
    name = F.concat_ws("|", *settings)
    s = scores.select(name.alias("k"), *pair_by, F.col(value).alias("v"))
    a, b = s.toDF("a", *pair_by, "va"), s.toDF("b", *pair_by, "vb")
    d = a.join(b, pair_by).where("a < b").groupBy("a", "b").agg(F.avg(F.col("va") - F.col("vb")).alias("m"), F.var_samp(F.col("va") - F.col("vb")).alias("s2"), F.count("*").alias("n"))
    t = div(F.col("m"), F.sqrt(F.when(F.col("s2") > 0, (1 / F.col("n") + n_test / n_train) * F.col("s2"))))
    free = F.col("n") - 1 + (n_train / n_test if df_mode == "reference" else 0)
    return d.select("a", "b", t.alias("t"), free.cast("double").alias("df"), "n")


def with_kfold_p(df: DataFrame) -> DataFrame:
    """Two-sided p of each pair's corrected t, and Holm's correction over all pairs."""
    return holm(df.withColumn("p", t_two_sided("t", "df")), "p", [], "a")


def two_sample_t(df: DataFrame, key: str, value: str) -> DataFrame:
    """Pooled two-sample t of every pair of groups."""
    g = df.groupBy(key).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    a, b = g.toDF("a", "ma", "va", "na"), g.toDF("b", "mb", "vb", "nb")
    free = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.nullif(free, F.lit(0))
    joined = a.join(b, F.col("a") < F.col("b"))  # a handful of settings
    return joined.select("a", "b", div(F.col("ma") - F.col("mb"), F.sqrt(F.when(pooled > 0, pooled * (1 / F.col("na") + 1 / F.col("nb"))))).alias("t"), free.cast("double").alias("df"))


def anderson_darling(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A^2 of normality with estimated mean and sd, and its small-sample correction."""
    part = W.partitionBy(*keys)
    sd = F.stddev_samp(value).over(part)
    y = df.where(F.col(value).isNotNull()).select(*keys, value, div(F.col(value) - F.avg(value).over(part), sd).alias("y"))
    up = y.withColumn("q", normal_tail(F.col("y"))).withColumn("p", normal_tail(-F.col("y")))
    order = part.orderBy("y")
    n = F.count("*").over(part)
    i = F.row_number().over(order)
    low = F.greatest(F.col("p"), F.lit(1e-300))
    high = F.greatest(F.col("q"), F.lit(1e-300))
    terms = up.select(*keys, ((2 * i - 1) * F.log(low) + (2 * n + 1 - 2 * i) * F.log(high)).alias("t"))
    got = terms.groupBy(*keys).agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    a2 = -F.col("n") - F.col("t") / F.col("n")
    return got.select(*keys, a2.alias("a2"), (a2 * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))).alias("a2_star"), "n")


def bland_altman(pairs: DataFrame, keys: list[str], a: str, b: str, z: float = 1.96) -> DataFrame:
    """Mean difference, population sd of differences and limits of agreement."""
    d = F.col(a) - F.col(b)
    return pairs.groupBy(*keys).agg(F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("sd_diff"), F.count(d).alias("n")).select("*", (F.col("mean_diff") - z * F.col("sd_diff")).alias("low"), (F.col("mean_diff") + z * F.col("sd_diff")).alias("high"))


def agreement_points(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The points of the agreement plot: mean and difference of each pair."""
    return pairs.select(*keys, ((F.col(a) + F.col(b)) / 2).alias("pair_mean"), (F.col(a) - F.col(b)).alias("difference"))


def mean_difference(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return pairs.groupBy(*keys).agg(F.avg(d).alias("mean_diff"), F.avg(F.abs(d)).alias("mean_abs_diff"), F.count(d).alias("n"))


# fixed values: polynomials of the corrections and of the distribution of W, by rising powers
SHAPIRO_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SHAPIRO_NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SHAPIRO_SMALL_MEAN, SHAPIRO_SMALL_SD, SHAPIRO_SMALL_SHIFT = [0.5440, -0.39978, 0.025054, -0.0006714], [1.3822, -0.77857, 0.062767, -0.0020322], [-2.273, 0.459]
SHAPIRO_MEAN, SHAPIRO_SD = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302]


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + c
    return out


def shapiro_wilk(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, w, p): normality by the squared correlation of the ordered values with their normal scores, for groups of three values
    or more (the distribution of w was fitted for up to 5000). Groups without spread have no w.

    Places in the order come from counts of distinct values by parts, so a large group isn't sorted in one task."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    size = cells.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")).where("n >= 3")
    run = running_sums(cells, keys, "v", {"upto": "c"}).join(size, keys)
    each = run.select(*keys, "n", "mean", "v", F.explode(F.sequence(F.col("upto") - F.col("c") + 1, F.col("upto"))).alias("i"))
    e = each.withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    d = F.col("v") - F.col("mean")
    at = lambda place: F.max(F.when(F.col("i") == place, d))
    g = e.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(d * d).alias("ss"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * d).alias("mx"), at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"),
        at(F.col("n")).alias("xn"), at(F.col("n") - 1).alias("xp"), F.max("m").alias("mn"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("mp"),
    )
    n, u, root = F.col("n").cast("double"), 1 / F.sqrt(F.col("n").cast("double")), F.sqrt("mm")
    last = F.when(n == 3, F.lit(0.5**0.5)).otherwise(F.col("mn") / root + _poly(u, SHAPIRO_LAST))
    following = F.when(n > 5, F.col("mp") / root + _poly(u, SHAPIRO_NEXT))
    two = F.when(n > 5, 1.0).otherwise(0.0)  # whether the places next to the ends have weights of their own
    rest = (F.col("mm") - 2 * F.col("mn") * F.col("mn") - 2 * two * F.col("mp") * F.col("mp")) / (1 - 2 * last * last - 2 * two * F.coalesce(following * following, F.lit(0.0)))
    middle = F.col("mx") - F.col("mn") * (F.col("xn") - F.col("x1")) - two * F.col("mp") * (F.col("xp") - F.col("x2"))
    sum_ = F.when(n > 3, middle / F.sqrt(rest)).otherwise(0.0) + last * (F.col("xn") - F.col("x1")) + F.coalesce(two * following * (F.col("xp") - F.col("x2")), F.lit(0.0))
    w = F.when(F.col("xn") > F.col("x1"), F.least(F.lit(1.0), sum_ * sum_ / F.col("ss")))
    got = g.select(*keys, "n", w.alias("w"))
    log, y = F.log(n), F.log(1 - F.when(F.col("w") < 1, F.col("w")))
    shift = _poly(n, SHAPIRO_SMALL_SHIFT)
    z = F.when(n <= 11, (-F.log(F.when(shift > y, shift - y)) - _poly(n, SHAPIRO_SMALL_MEAN)) / F.exp(_poly(n, SHAPIRO_SMALL_SD))).otherwise((y - _poly(log, SHAPIRO_MEAN)) / F.exp(_poly(log, SHAPIRO_SD)))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(0.75**0.5)))
    return got.withColumn("p", F.when(F.col("w") == 1, 1.0).when(n == 3, three).when(F.col("w").isNotNull(), F.coalesce(normal_tail(z), F.lit(0.0))))
