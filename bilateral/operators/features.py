"""Features of segments, by aggregates over samples (keys name the segment and component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import div, gradient
from ..functions.shared import SharedTables

EDA = [
    "min_feat", "max_feat", "mean_feat", "std_feat", "dynamic_range_feat", "slope_feat", "absolute_slope_feat", "first_derivative_mean", "first_derivative_std",
    "number_of_peaks", "peaks_amplitude", "entropy", "dc_term", "sum_of_all_coefficients", "spectral_energy",
]


def basic(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """min, max, mean, population sd and range."""
    return df.groupBy(*keys).agg(
        F.min(value).alias("min_feat"), F.max(value).alias("max_feat"), F.avg(value).alias("mean_feat"), F.stddev_pop(value).alias("std_feat"),
        (F.max(value) - F.min(value)).alias("dynamic_range_feat"),
    )


def slope(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos") -> DataFrame:
    s = F.regr_slope(F.col(value), F.col(order).cast("double"))
    return df.groupBy(*keys).agg(s.alias("slope_feat"), F.abs(s).alias("absolute_slope_feat"))


def derivatives(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos", second: bool = False) -> DataFrame:
    """Mean and sd of the first (and second) numerical derivative."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_d1", gradient(F.col(value), w))
    aggs = [F.avg("_d1").alias("first_derivative_mean"), F.stddev_pop("_d1").alias("first_derivative_std")]
    if second:
        d = d.withColumn("_d2", gradient(F.col("_d1"), w))
        aggs += [F.avg("_d2").alias("second_derivative_mean"), F.stddev_pop("_d2").alias("second_derivative_std")]
    return d.groupBy(*keys).agg(*aggs)


def area(df: DataFrame, keys: list[str], fs: float, value: str = "value", order: str = "pos") -> DataFrame:
    """Area under the curve by trapezoids."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_t", (F.col(value) + F.lag(value).over(w)) / 2).groupBy(*keys).agg((F.coalesce(F.sum("_t"), F.lit(0.0)) / fs).alias("auc_feat"))


def entropy(df: DataFrame, segment: list[str], component: str, fs: float, value: str = "value") -> DataFrame:
    """-sum p ln p of each component, with p = x^2 / fs over the total of all components of the segment."""
    e = df.withColumn("_e", F.col(value) * F.col(value) / fs)
    p = e.withColumn("_p", div(F.col("_e"), F.sum("_e").over(W.partitionBy(*segment))))
    return p.groupBy(*segment, component).agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log("_p")).otherwise(0.0)).alias("entropy"))


def dc_energy(df: DataFrame, keys: list[str], fs: float, value: str = "value", order: str = "pos") -> DataFrame:
    """|mean| and |sum| of the Fourier coefficients (both follow from the first sample) and |sum x| / fs."""
    first = F.abs(F.min_by(value, order))
    return df.groupBy(*keys).agg(first.alias("dc_term"), (F.count("*") * first).alias("sum_of_all_coefficients"), (F.abs(F.sum(value)) / fs).alias("spectral_energy"))


def _maxima(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn("_peak", (F.col(value) > before) & (F.col(value) >= after)).withColumn("_low", (F.col(value) <= before) & (F.col(value) < after))


def skin_peaks(df: DataFrame, keys: list[str], share: float = 0.1, value: str = "value", order: str = "pos") -> DataFrame:
    """Number and summed amplitude of local maxima that rise over the last local minimum (or the start)
    by at least ``share`` of the largest rise."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = _maxima(df, keys, value, order)
    marked = marked.withColumn("_first", F.lag(value).over(w).isNull())
    base = F.last(F.when(F.coalesce(F.col("_low"), F.lit(False)) | F.col("_first"), F.col(value)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    rises = marked.withColumn("_rise", F.when(F.col("_peak"), F.col(value) - base))
    kept = rises.withColumn("_keep", F.col("_rise") >= share * F.max("_rise").over(W.partitionBy(*keys)))
    return kept.groupBy(*keys).agg(F.sum(F.coalesce(F.col("_keep"), F.lit(False)).cast("int")).cast("long").alias("number_of_peaks"), F.coalesce(F.sum(F.when(F.col("_keep"), F.col(value))), F.lit(0.0)).alias("peaks_amplitude"))


def pulse_peaks(df: DataFrame, keys: list[str], fs: float, value: str = "value", order: str = "pos") -> DataFrame:
    """Peaks of a pulse signal, their heights, heart rate and variability (zeros with at most one peak)."""
    peaks = _maxima(df, keys, value, order)
    only = peaks.where("_peak")
    w = W.partitionBy(*keys).orderBy(order)
    gaps = only.withColumn("_nn", (F.col(order) - F.lag(order).over(w)) * 1000.0 / fs)
    gaps = gaps.withColumn("_dd", F.col("_nn") - F.lag("_nn").over(w))
    found = gaps.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg("_nn").alias("mean_nn"), F.stddev_samp("_nn").alias("sdnn"),
        F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))).alias("rmssd"), F.stddev_samp("_dd").alias("sdsd"),
    )
    sizes = df.groupBy(*keys).agg(F.count("*").alias("len"))
    # the first period is taken as the mean of the others, so the mean rate is that of all periods
    rate = gaps.where("_nn is not null").groupBy(*keys).agg(F.avg(60000.0 / F.col("_nn")).alias("rate"), F.avg("_nn").alias("m"), F.count("*").alias("k"))
    rate = rate.select(*keys, ((F.col("rate") * F.col("k") + 60000.0 / F.col("m")) / (F.col("k") + 1)).alias("mean_hr"))
    z = lambda c: F.coalesce(F.when(F.col("n") > 1, F.col(c)), F.lit(0.0))
    out = sizes.join(found, keys, "left").join(rate, keys, "left")
    return out.select(
        *keys, F.coalesce("n", F.lit(0)).cast("long").alias("number_of_peaks"), (F.coalesce("n", F.lit(0)) / F.col("len")).alias("peaks_ratio"), F.coalesce("hi", F.lit(0.0)).alias("highest_peak"), F.coalesce("lo", F.lit(0.0)).alias("lowest_peak"),
        z("mean_hr").alias("mean_hr"), z("mean_nn").alias("mean_nn"), z("sdnn").alias("sdnn"), z("rmssd").alias("rmssd"), z("sdsd").alias("sdsd"),
    )


def eda_features(df: DataFrame, segment: list[str], component: str = "component", fs: float = 4.0, value: str = "value", order: str = "pos") -> DataFrame:
    """The 15 features of a skin-conductance segment, one row per segment and component.

    All parts group by the same keys, so they share one shuffle of the samples."""
    keys = [*segment, component]
    # rows with a missing component are dropped for all components
    miss = F.max(F.col(value).isNull().cast("int")).over(W.partitionBy(*segment, order))
    d = df.withColumn("_m", miss).where("_m = 0").drop("_m").repartition(*segment)
    parts = [basic(d, keys, value), slope(d, keys, value, order), derivatives(d, keys, value, order), skin_peaks(d, keys, value=value, order=order), entropy(d, segment, component, fs, value), dc_energy(d, keys, fs, value, order)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys)
    return out.select(*keys, *EDA)


def ppg_features(df: DataFrame, keys: list[str], fs: float = 64.0, value: str = "value", order: str = "pos") -> DataFrame:
    d = df.where(F.col(value).isNotNull()).repartition(*keys)
    out = basic(d, keys, value)
    for p in (slope(d, keys, value, order), derivatives(d, keys, value, order), area(d, keys, fs, value, order), pulse_peaks(d, keys, fs, value, order)):
        out = out.join(p, keys)
    return out


def acc_features(df: DataFrame, keys: list[str], value: str = "value", order: str = "pos") -> DataFrame:
    """The 11 features of an acceleration segment."""
    d = df.where(F.col(value).isNotNull()).repartition(*keys)
    out = basic(d, keys, value)
    for p in (slope(d, keys, value, order), derivatives(d, keys, value, order, second=True)):
        out = out.join(p, keys)
    return out


FEATURE_SETS = {"EDA": eda_features, "PPG": ppg_features, "ACC": acc_features}


def feature_set(name: str):
    """The feature function for a signal's name."""
    for key, f in FEATURE_SETS.items():
        if key in name.upper() or key == "PPG" and "BVP" in name.upper():
            return f
    raise ValueError(f"no features for {name!r}")


def fill_empty(segments: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Zeros for segments without samples."""
    names = [c for c in features.columns if c not in keys]
    return segments.select(*keys).join(features, keys, "left").na.fill(0, names)


def flatten(features: DataFrame, segment: list[str], component: str, components: list[str], names: list[str]) -> DataFrame:
    """One vector per segment, ordered feature by feature and component by component within each; the names travel along."""
    cols = [F.max(F.when(F.col(component) == c, F.col(n))).alias(f"{n}|{c}") for n in names for c in components]
    wide = features.groupBy(*segment).agg(*cols)
    order = [f"{n}|{c}" for n in names for c in components]
    return wide.select(*segment, F.array(*[F.col(f"`{c}`").cast("double") for c in order]).alias("x"), F.array(*[F.lit(c) for c in order]).alias("names"))


# fixed values: the orthonormal wavelet with four vanishing moments (low-pass decomposition)
DB4 = [-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523]


def wavelet_features(df: DataFrame, keys: list[str], levels: int = 6, kept: int = 3, value: str = "value", order: str = "pos") -> DataFrame:
    """Mean, sd, min, max, range, variance and sd / length of the last ``kept`` detail levels.

    Each level is a frame sum with stride two over the level before (periodic ends): a row that the last windows need again from the
    start is dealt twice, so a level reads the one before it once, and each is a table (half the rows of the one before)."""
    high = [x * (1 if k % 2 else -1) for k, x in enumerate(reversed(DB4))]
    part, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("i")
    i = (F.row_number().over(part.orderBy(order)) - 1).alias("i")
    current = df.select(*keys, i, F.col(value).alias("v"), F.count("*").over(part).alias("n"))
    tables, out = SharedTables(df.sparkSession), None
    for level in range(1, levels + 1):
        twice = F.when(F.col("i") < len(DB4), F.array("i", (F.col("i") + F.col("n")).cast("int"))).otherwise(F.array("i"))
        both = current.select(*keys, "n", "v", F.explode(twice).alias("i"))
        ahead = [F.lead("v", k).over(w) if k else F.col("v") for k in range(len(DB4))]
        low, det = (sum((F.coalesce(a, F.lit(0.0)) * c for a, c in zip(ahead, f, strict=True)), F.lit(0.0)) for f in (DB4[::-1], high))
        step = tables.put(both.select(*keys, "i", "n", low.alias("a"), det.alias("d")).where("i < n and i % 2 = 0"))
        if level > levels - kept:
            sd = F.stddev_pop("d")
            stats = step.groupBy(*keys).agg(F.avg("d").alias("mean"), sd.alias("std"), F.min("d").alias("min"), F.max("d").alias("max"), (F.max("d") - F.min("d")).alias("range"), F.var_pop("d").alias("variance"), (sd / F.count("*")).alias("std_by_length"))
            stats = stats.withColumn("level", F.lit(level))
            out = stats if out is None else out.unionByName(stats)
        current = step.select(*keys, (F.col("i") / 2).cast("int").alias("i"), F.col("a").alias("v"), F.ceil(F.col("n") / 2).alias("n"))
    return out
