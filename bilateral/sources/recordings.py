"""Scans of raw recordings, processed signals and experiment information; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IGNORED = ("tags", "IBI", "Table")
FORMATS = ("parquet", "csv")
# path layouts: user/side/type.csv, and user/x/device/side/type_session.csv
_LAB = r"([^/]+)/(left|right)/([A-Za-z]+)\.csv$"
_SLEEP = r"([^/]+)/[^/]+/([^/]+)/(left|right)/([A-Za-z]+)_([^/]+)\.csv$"


def numbered_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, line, value) of all text files below a folder, lines numbered from 0; blank lines at a file's end are left out.

    Files are read in byte ranges: lines are numbered within each range, and the counts of the ranges before it in its file are added,
    so a long file is many tasks' work and no task sees more than a range."""
    raw = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), "value", F.monotonically_increasing_id().alias("at"))
    lines = raw.withColumn("inside", F.row_number().over(W.partitionBy("path", "range").orderBy("at")) - 1)
    full = F.when(F.trim("value") != "", F.col("inside"))
    ranges = lines.groupBy("path", "range").agg(F.count("*").alias("n"), F.max(full).alias("full"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.select("path", "range", before.alias("base"), "full")
    placed = placed.select("path", "range", "base", F.max(F.col("base") + F.col("full")).over(W.partitionBy("path")).alias("last"))
    return lines.join(placed, ["path", "range"]).select("path", (F.col("base") + F.col("inside")).alias("line"), "value", "last").where("line <= last").drop("last")


def raw_csv(spark: SparkSession, path: str, mode: int = 1) -> tuple[DataFrame, DataFrame]:
    """(recordings, samples) of raw sensor files: two header lines hold the start (unix seconds) and the rate,
    the others one value per column. A file is one session, of any length (see ``numbered_lines``)."""
    if mode not in (1, 2):
        raise ValueError("mode must be 1 or 2")
    lines = numbered_lines(spark, path)
    for word in IGNORED:
        lines = lines.where(~F.element_at(F.split("path", "/"), -1).contains(word))
    pattern, groups = (_LAB, {"usr": 1, "side": 2, "signal": 3}) if mode == 1 else (_SLEEP, {"usr": 1, "device": 2, "side": 3, "signal": 4, "session": 5})
    keyed = lines.where(F.col("path").rlike(pattern)).select(*[F.regexp_extract("path", pattern, g).alias(n) for n, g in groups.items()], "line", "value", "path")
    if mode == 1:
        keyed = keyed.withColumn("session", F.lit("lab"))
    keys = ["signal", "side", "usr", "session"]
    head = lambda i: F.max(F.when(F.col("line") == i, F.trim(F.split("value", ",")[0]))).try_cast("double")
    recordings = keyed.where("line < 2").groupBy(*keys, "path").agg(head(0).alias("start_s"), head(1).alias("fs_hz"), F.count("*").alias("n")).where("n = 2").select(*keys, "start_s", "fs_hz")
    values = F.transform(F.split("value", ","), lambda v: F.nullif(F.trim(v).try_cast("double"), F.lit(float("nan"))))
    samples = keyed.where("line >= 2").select(*keys, (F.col("line") - 2).cast("long").alias("pos"), values.alias("axes"))
    return recordings, samples


def axes(samples: DataFrame, names: list[str]) -> DataFrame:
    """Columns for the axes of a recording (x, y, z for acceleration)."""
    return samples.select(*[c for c in samples.columns if c != "axes"], *[F.get("axes", F.lit(i)).alias(n) for i, n in enumerate(names)])


def kept_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file name holds none of the ignored words."""
    return df.where(~F.col(path).rlike("|".join(IGNORED)))


def _known(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not supported; use one of {FORMATS}")
    return fmt


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet", side: str | None = None, signal: str | None = None, schema: str | None = None) -> DataFrame:
    """Processed signals under signal= / side= folders; both filters prune folders. A path without files raises."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.csv(path, header=True, inferSchema=schema is None) if _known(fmt) == "csv" else reader.parquet(path)
    for name, want in (("side", side), ("signal", signal)):
        if want is not None:
            df = df.where(F.col(name) == want)
    return df


def write_processed(df: DataFrame, path: str, fmt: str = "parquet", by=("signal", "side")) -> None:
    """One folder for each signal and side (not one for each user: files would be small)."""
    writer = df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns])
    writer.csv(path, header=True) if _known(fmt) == "csv" else writer.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def experiment_info(spark: SparkSession, path: str, mode: int, zone: str = "Europe/Rome") -> DataFrame:
    """Lab (1): baseline and cognitive-load events of each user as start_ / end_ columns; sleep (2): bed and wake
    times of each session. Local times become UTC."""
    raw = spark.read.csv(path, header=True)
    utc = lambda c: F.to_utc_timestamp(F.to_timestamp(c), zone)
    if mode == 1:
        return lab_events(raw.withColumn("start_ts", utc("start")).withColumn("end_ts", utc("end")))
    if mode == 2:
        return raw.select("usr", "session", utc("actual_bed_time").alias("actual_bed_time"), utc("wake_up_time").alias("wake_up_time"))
    raise ValueError("mode must be 1 or 2")


def lab_events(events: DataFrame) -> DataFrame:
    """Long lab events to wide columns; other events than baselines and cognitive load are dropped."""
    from ..operators.align import wide_intervals

    kept = events.where(F.col("event").rlike("baseline|cognitive_load"))
    names = sorted(r.event for r in kept.select("event").distinct().collect())
    return wide_intervals(kept, ["usr"], names)


def experiment_time(spark: SparkSession, path: str, by_session: bool = False) -> DataFrame:
    """start_ts and end_ts of each user (and session) from a csv whose first columns are the keys."""
    keys = ["usr", "session"] if by_session else ["usr"]
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*keys, *raw.columns[len(keys) :])
    return raw.select(*keys, F.to_timestamp_ntz("start").alias("start_ts"), F.to_timestamp_ntz("end").alias("end_ts"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Fold scores under one folder for each key <side>_<seed>_<fold>."""
    key = F.concat_ws("_", "side", F.col("seed_id").cast("string"), F.col("fold_id").cast("string"))
    scores.withColumn("key", key).drop("side", "seed_id", "fold_id").write.mode("overwrite").partitionBy("key").parquet(path)


def parse_score_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """side, seed_id and fold_id in place of the key <side>_<seed>_<fold>."""
    part = lambda i: F.split(F.col(key), "_")[i]
    return df.select(part(0).alias("side"), part(1).cast("int").alias("seed_id"), part(2).cast("int").alias("fold_id"), *[c for c in df.columns if c != key])


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return parse_score_keys(spark.read.option("partitionOverwriteMode", "static").parquet(path))


def write_ranking(ranking: DataFrame, path: str) -> None:
    """Feature rankings (side, feature, importance, rank) as csv, one folder a side."""
    ranking.write.mode("overwrite").partitionBy("side").csv(path, header=True)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="feature long, importance double, rank int, side string")


def user_info(spark: SparkSession, path: str, user: str) -> DataFrame:
    return spark.read.csv(path, header=True).withColumn("usr", F.lit(user))


def class_effects(effects: DataFrame) -> DataFrame:
    """Stored effects (cls, component, feature, value, ci_low, ci_high) as one row per component and feature with
    the columns <class>, <class>_low, <class>_high; incomplete rows are dropped."""
    got = effects.groupBy("component", "feature").pivot("cls", ["negative", "positive"]).agg(F.first("value").alias("value"), F.first("ci_low").alias("low"), F.first("ci_high").alias("high"))
    names = [(f"{c}_value", c) for c in ("negative", "positive")] + [(f"{c}_{e}", f"{c}_{e}") for c in ("negative", "positive") for e in ("low", "high")]
    return got.select("component", "feature", *[F.col(a).alias(b) for a, b in names]).dropna("any")
