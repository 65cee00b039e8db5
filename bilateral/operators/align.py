"""Interval joins, cutting both sides to their overlap, and pairing of the sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slice_intervals(samples: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows within the intervals of their key, both ends included, with the interval's other columns.

    An equi join on the keys with the range as condition; a sample in two intervals comes twice."""
    return samples.join(intervals, keys).where("ts between start_ts and end_ts").drop("start_ts", "end_ts")


def slice_event(samples: DataFrame, intervals: DataFrame, keys: list[str], event: str) -> DataFrame:
    """Rows of every key within one event; a key without that event (or without samples in it) has one row of NULLs."""
    one = intervals.where(F.col("event") == event).select(*keys, "start_ts", "end_ts")
    got = samples.join(one, keys).where("ts between start_ts and end_ts").drop("start_ts", "end_ts")
    return samples.select(*keys).distinct().join(got, keys, "left").withColumn("event", F.lit(event))


def wide_components(df: DataFrame, keys: list[str], component: str, names: list[str], value: str = "value") -> DataFrame:
    """One column for each component (an outer join on the keys in one shuffle)."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(component) == n, F.col(value))).alias(n) for n in names])


def long_intervals(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event, start_ts, end_ts) from columns start_<event> and end_<event>."""
    events = sorted(c[6:] for c in wide.columns if c.startswith("start_"))
    stack = ", ".join(f"'{e}', start_{e}, end_{e}" for e in events)
    return wide.selectExpr(*keys, f"stack({len(events)}, {stack}) as (event, start_ts, end_ts)")


def wide_intervals(long: DataFrame, keys: list[str], events: list[str]) -> DataFrame:
    """Columns start_<event> and end_<event> of each key (the first by time, if an event comes twice)."""
    got = long.groupBy(*keys).pivot("event", events).agg(F.min("start_ts").alias("start"), F.min("end_ts").alias("end"))
    return got.select(*keys, *[F.col(f"{e}_{p}").alias(f"{p}_{e}") for e in events for p in ("start", "end")])


def sleep_intervals(info: DataFrame, keys: list[str]) -> DataFrame:
    """Sleep, awake_1 (up to bed time) and awake_2 (from wake time); shared ends belong to both."""
    low, high = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    rows = F.array(
        F.struct(F.lit("sleep").alias("event"), F.col("actual_bed_time").alias("start_ts"), F.col("wake_up_time").alias("end_ts")),
        F.struct(F.lit("awake_1").alias("event"), low.alias("start_ts"), F.col("actual_bed_time").alias("end_ts")),
        F.struct(F.lit("awake_2").alias("event"), F.col("wake_up_time").alias("start_ts"), high.alias("end_ts")),
    )
    return info.select(*keys, F.explode(rows).alias("i")).select(*keys, "i.*")


def overlap(samples: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """(keys, from_ts, to_ts) of the time that both sides cover; keys with one side have none."""
    ends = samples.groupBy(*keys, side).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    both = ends.groupBy(*keys).agg(F.max("lo").alias("from_ts"), F.min("hi").alias("to_ts"), F.count("*").alias("n"))
    return both.where("n = 2").drop("n")


def cut_to_overlap(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides from the later first to the earlier last sample."""
    return samples.join(overlap(samples, keys), keys).where("ts between from_ts and to_ts").drop("from_ts", "to_ts")


def trim_to_shortest(samples: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """The overlap, then both sides before the first time that the longer side has and the shorter lacks.

    One window pass: a time is missing where only one side has it; sessions of equal length stay whole."""
    cut = cut_to_overlap(samples, keys)
    lengths = cut.groupBy(*keys, side).agg(F.count("*").alias("n"))
    longer = lengths.groupBy(*keys).agg(F.max_by(side, "n").alias("longer"), F.min("n").alias("a"), F.max("n").alias("b")).where("a < b").drop("a", "b")
    marked = cut.join(longer, keys, "left")
    gap = marked.groupBy(*keys, "ts").agg(F.count("*").alias("n"), F.min(side).alias("only"), F.first("longer").alias("longer"))
    stop = gap.where("n = 1 and only = longer").groupBy(*keys).agg(F.min("ts").alias("stop"))
    return cut.join(stop, keys, "left").where("stop is null or ts < stop").drop("stop")


def empty_after_trim(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a trim left without rows."""
    return before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti")


def bucket_mask(fast: DataFrame, slow: DataFrame, keys: list[str], seconds: float, threshold: float) -> DataFrame:
    """Slow samples with ``artefact``: whether the fast signal exceeds the threshold within the sample's time bucket.

    Equi join on the bucket; a slow sample without fast ones keeps NULL."""
    bucket = lambda c: F.floor(c / seconds)
    top = fast.groupBy(*keys, bucket(F.col("seconds")).alias("bucket")).agg(F.max("value").alias("top"))
    joined = slow.withColumn("bucket", bucket(F.col("seconds"))).join(top, [*keys, "bucket"], "left")
    return joined.withColumn("artefact", (F.col("top") > threshold).cast("int")).drop("top", "bucket")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The last value of right at or before each row of left (ts), by one union and one window."""
    a = left.select("*", F.lit(1).alias("_is"), F.lit(None).cast(right.schema[value].dataType).alias(name))
    b = right.select(*keys, "ts", F.lit(0).alias("_is"), F.col(value).alias(name))
    order = W.partitionBy(*keys).orderBy("ts", "_is").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(order)).where("_is = 1").drop("_is")


def pair_sides(df: DataFrame, keys: list[str], values: list[str], side: str = "side") -> DataFrame:
    """Left and right values of each key (keys with one side drop out)."""
    # one shuffle: a pivot of two known values instead of a self join
    got = df.groupBy(*keys).agg(*[F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{s}_{v}") for s in ("left", "right") for v in values], F.count_distinct(side).alias("_n"))
    return got.where("_n = 2").drop("_n")


def unordered_pairs(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """All pairs a < b of a small table of settings within ``by`` (columns come as <name>_a, <name>_b)."""
    a = df.select(*by, *[F.col(c).alias(f"{c}_a") for c in df.columns if c not in by])
    b = df.select(*by, *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in by])
    joined = a.join(b, by) if by else a.crossJoin(b)
    return joined.where(F.col(f"{key}_a") < F.col(f"{key}_b"))
