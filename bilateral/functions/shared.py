"""Tables in the folder that driver and executors share, which cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class SharedTables:
    """Parquet tables of one run under spark.checkpoint.dir (a temporary folder only where that is unset and all runs in one JVM)."""

    def __init__(self, spark: SparkSession):
        at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="spark-")
        self.spark, self.base, self.n = spark, f"{at}/s-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        """df, written once and read again."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shared_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Removes tables that ``put`` returned and nothing reads any more."""
        jvm = self.spark._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._shared_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
