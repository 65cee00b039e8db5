"""Fixed segments of paired signals and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assign(samples: DataFrame, size: int, order: str = "pos") -> DataFrame:
    """Adds segment_id = pos div size."""
    return samples.withColumn("segment_id", F.floor(F.col(order) / size).cast("long"))


def fixed_segments(samples: DataFrame, keys: list[str], size: int, seconds: float | None = None, full: bool = True) -> DataFrame:
    """(keys, segment_id, start_ts, end_ts, n_samples[, artefact]). With ``seconds`` only samples up to
    start + seconds belong to a segment (this matters for clocks with gaps); ``full`` drops segments of another length."""
    got = assign(samples, size)
    if seconds is not None:
        start = F.min("ts").over(W.partitionBy(*keys, "segment_id"))
        got = got.withColumn("_s", start).where(F.expr(f"ts <= _s + make_dt_interval(0, 0, 0, {seconds:.6f})")).drop("_s")
    flag = [F.max("artefact").alias("artefact")] if "artefact" in samples.columns else []
    out = got.groupBy(*keys, "segment_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_samples"), *flag)
    return out.where(F.col("n_samples") == size) if full else out


def label_experiment(start: str, end: str, info: dict[str, str], strict: bool = False) -> Column:
    """0 in the baseline, 1 in the task, NULL between, before and after; ``info`` names the columns
    start_base, end_base, start_task, end_task.

    A segment that straddles the end of the baseline counts as baseline and one that straddles the
    task's end as task, as do segments that meet a border exactly; ``strict`` leaves all of these NULL."""
    s, e = F.col(start), F.col(end)
    b0, b1, t0, t1 = (F.col(info[k]) for k in ("start_base", "end_base", "start_task", "end_task"))
    if strict:
        return F.when((s >= b0) & (e <= b1), 0).when((s >= t0) & (e <= t1), 1)
    nothing = F.lit(None).cast("int")
    return (
        F.when(e < b1, 0).when((s < b1) & (e > b1), 0)
        .when((s > b1) & (e < t0), nothing).when(s > t1, nothing).when((s < t0) & (e > t0), nothing)
        .otherwise(1)
    )


def label_sleep(start: str, end: str, bed: str = "actual_bed_time", wake: str = "wake_up_time") -> Column:
    """1 asleep, 0 awake, NULL for segments that straddle bed or wake time."""
    s, e, b, w = F.col(start), F.col(end), F.col(bed), F.col(wake)
    return F.when((e < b) | (s > w), 0).when((s > b) & (e < w), 1)


def both_sides(segments: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """Segments that are there, full and labelled on both sides."""
    w = W.partitionBy(*keys, "segment_id")
    return segments.where("label is not null").withColumn("_n", F.size(F.collect_set(side).over(w))).where("_n = 2").drop("_n")


def wrong_length_share(segments: DataFrame, size: int, by: list[str]) -> DataFrame:
    """Segments of another length, and their share."""
    bad = F.sum((F.col("n_samples") != size).cast("int"))
    return segments.groupBy(*by).agg(F.count("*").alias("n_segments"), bad.alias("n_wrong"), (bad / F.count("*")).alias("share"))


def bad_segments(segments: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Segment keys that have a wrong length on either side."""
    return segments.where(F.col("n_samples") != size).select(*keys, "segment_id").distinct()
