"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs in one JVM (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches that carry texts, unless the session has chosen a size itself, and ships the package."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


class Tables:
    """Parquet tables that cut the lineage of one run; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
        self.n = 0
        prepare(spark)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in dfs:
            for file in df.inputFiles()[:1]:
                path = jvm.org.apache.hadoop.fs.Path(file).getParent()
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Removes this run's tables but those named."""
        jvm, keep = self.spark._jvm, {f.rsplit("/", 2)[-2] for df in kept for f in df.inputFiles()[:1]}
        for n in range(1, self.n + 1):
            if str(n) not in keep:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished steps: its cleaner does so once the driver has collected
        what refers to them, which may otherwise be long after the next steps need the disk."""
        gc.collect()
        self.spark._jvm.System.gc()
        time.sleep(1)  # the cleaner works in the background


def components(tables: Tables, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, root) for every node of an edge, root the smallest node.

    Alternates large-star and small-star steps (both are one aggregation by node and one join
    that adaptive execution can split), so a star or chain of any length ends in O(log n) rounds.
    """
    e = tables.put(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = tables.put(small.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tables.drop(e)
        e = new
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def hot_and_rest(df: DataFrame, by: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """df in two: the rows with the largest ``by`` (positive), at most ``limit``, and all others.

    The line runs between whole steps of its logarithm; within a step that would pass the limit, a hash of the row decides."""
    step = F.floor(F.log2(F.col(by).cast("double")) * 16)
    steps = {r.g: r.c for r in df.groupBy(step.alias("g")).agg(F.count("*").alias("c")).collect()}
    kept = 0
    for g in sorted(steps, reverse=True):
        if kept + steps[g] > limit:
            share = int(0.95 * (limit - kept) / steps[g] * 1_000_000)
            hot = (step > g) | ((step == g) & (F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)) < share))
            return df.where(hot), df.where(~hot)
        kept += steps[g]
    return df, df.where(F.lit(False))
