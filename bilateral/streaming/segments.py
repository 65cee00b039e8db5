"""Segment features of a stream: tumbling windows with a watermark for late samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_features(samples: DataFrame, keys: list[str], seconds: int, late: str = "1 minute", value: str = "value") -> DataFrame:
    """min, max, mean, sd and count of each window; works on streams and on batches (ts must be a zoned timestamp)."""
    w = F.window("ts", f"{seconds} seconds")
    got = samples.withWatermark("ts", late).groupBy(*keys, w).agg(F.min(value).alias("min_feat"), F.max(value).alias("max_feat"), F.avg(value).alias("mean_feat"), F.stddev_pop(value).alias("std_feat"), F.count("*").alias("n_samples"))
    return got.select(*keys, F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), "min_feat", "max_feat", "mean_feat", "std_feat", "n_samples")
