"""Paired signals made from the given tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import keys

SAMPLES = """samples AS (
  SELECT usr, side, pos, value, event_type, event_id,
         TIMESTAMP '2024-01-01 00:00:00' + (pos + usr % 5 + CASE WHEN side = 'right' THEN 2 ELSE 0 END) * INTERVAL '20' HOUR AS ts
  FROM (SELECT user_id AS usr, value, event_type, event_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side,
               row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS pos FROM events) t)"""
INTERVALS = """intervals AS (
  SELECT usr, TIMESTAMP '2024-01-03' + o AS start_baseline_1, TIMESTAMP '2024-01-10' + o AS end_baseline_1, TIMESTAMP '2024-01-12' + o AS start_cognitive_load,
         TIMESTAMP '2024-01-24' + o AS end_cognitive_load, TIMESTAMP '2024-01-06' + o AS actual_bed_time, TIMESTAMP '2024-01-16' + o AS wake_up_time
  FROM (SELECT DISTINCT user_id AS usr, (user_id % 5) * INTERVAL '20' HOUR AS o FROM events) u)"""
PAIRED = """paired AS (
  SELECT l_returnflag AS grp, l_linestatus AS cls, l_quantity AS left_v, CAST(l_extendedprice AS DOUBLE) / 1000 AS right_v, l_suppkey AS k FROM lineitem)"""
FEAT = """feat AS (SELECT vec_id AS id, vec_id % 6 AS grp, CASE WHEN vec_id % 3 = 0 THEN 'right' ELSE 'left' END AS side, label % 2 AS y, embedding AS x FROM embeddings)"""
SCORES = """scores AS (
  SELECT event_type AS model, user_id % 5 AS fold_id, user_id % 3 AS seed_id, avg(value) AS value FROM events GROUP BY ALL)"""
EFFECTS = """effects AS (
  SELECT event_type AS feature, CASE WHEN user_id % 2 = 0 THEN 'c1' ELSE 'c2' END AS component, CASE WHEN event_id % 3 = 0 THEN 'negative' ELSE 'positive' END AS cls,
         avg(value) / 100 AS value, avg(value) / 100 - 2 * stddev_pop(value) / 100 / sqrt(count(*)) AS ci_low, avg(value) / 100 + 2 * stddev_pop(value) / 100 / sqrt(count(*)) AS ci_high
  FROM events GROUP BY ALL)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Start and rate (one sample in 20 hours) of each user's two sides."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("usr")).distinct()
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.lit(0).alias("late")), F.struct(F.lit("right").alias("side"), F.lit(2).alias("late"))))
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast((usr % 5 + late) * 20 as int))")
    return users.select("usr", sides.alias("s")).select("usr", "s.*").select("usr", "side", start.alias("start_ts"), F.lit(1 / 72000.0).alias("fs_hz"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("event_id") % 2 == 0, "left").otherwise("right")
    e = table(spark, sf, "events").select(F.col("user_id").alias("usr"), side.alias("side"), "value", "event_type", "event_id", "ts")
    order = W.partitionBy("usr", "side").orderBy("ts", "event_id")
    return e.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).drop("ts")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return keys.clock(positions(spark, sf), recordings(spark, sf), ["usr", "side"])


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select(F.col("user_id").alias("usr")).distinct()
    at = lambda day: F.expr(f"TIMESTAMP_NTZ '2024-01-{day} 00:00:00' + make_dt_interval(0, cast(usr % 5 * 20 as int))")
    return users.select(
        "usr", at("03").alias("start_baseline_1"), at("10").alias("end_baseline_1"), at("12").alias("start_cognitive_load"), at("24").alias("end_cognitive_load"),
        at("06").alias("actual_bed_time"), at("16").alias("wake_up_time"),
    )


def paired(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("cls"), F.col("l_quantity").alias("left_v"), (F.col("l_extendedprice").cast("double") / 1000).alias("right_v"), F.col("l_suppkey").alias("k"))


def feat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 6).alias("grp"), F.when(F.col("vec_id") % 3 == 0, "right").otherwise("left").alias("side"), (F.col("label") % 2).cast("long").alias("y"), F.col("embedding").alias("x"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("fold_id"), (F.col("user_id") % 3).alias("seed_id")).agg(F.avg("value").alias("value"))


def effects(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    got = e.groupBy(F.col("event_type").alias("feature"), F.when(F.col("user_id") % 2 == 0, "c1").otherwise("c2").alias("component"), F.when(F.col("event_id") % 3 == 0, "negative").otherwise("positive").alias("cls"))
    half = 2 * F.stddev_pop("value") / 100 / F.sqrt(F.count("*"))
    return got.agg((F.avg("value") / 100).alias("value"), (F.avg("value") / 100 - half).alias("ci_low"), (F.avg("value") / 100 + half).alias("ci_high"))


def segment_samples(spark: SparkSession, sf: str, size: int = 4) -> DataFrame:
    """Samples of full segments with two components (the signal and its logarithm)."""
    s = samples(spark, sf).withColumn("segment_id", F.floor(F.col("pos") / size).cast("long"))
    full = s.withColumn("_n", F.count("*").over(W.partitionBy("usr", "side", "segment_id"))).where(F.col("_n") == size).drop("_n")
    parts = F.explode(F.array(F.struct(F.lit("mixed").alias("component"), F.col("value").alias("v")), F.struct(F.lit("log").alias("component"), F.log1p(F.abs("value")).alias("v"))))
    return full.select("usr", "side", "segment_id", "pos", parts.alias("p")).select("usr", "side", "segment_id", "pos", "p.component", F.col("p.v").alias("value"))


SEGMENTS = """seg AS (
  SELECT usr, side, segment_id, pos, component, CASE WHEN component = 'mixed' THEN value ELSE ln(1 + abs(value)) END AS value
  FROM (SELECT *, CAST(floor(pos / 4) AS BIGINT) AS segment_id, count(*) OVER (PARTITION BY usr, side, CAST(floor(pos / 4) AS BIGINT)) AS nn FROM samples) s
  CROSS JOIN (VALUES ('mixed'), ('log')) c(component) WHERE nn = 4)"""
