"""Exact null distributions of rank statistics, as small tables that are joined by sample size and statistic.

The number of sign patterns with a given rank sum, and of orders with a given number of inversions, follow from those of one value less.
Tables go up to a fixed sample size; larger samples, and samples with ties, use the normal approximation with its tie correction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import average_rank, normal_tail
from .stats import kendall_sums

SIGNED_RANK = 50  # largest n of the exact signed-rank distribution
INVERSIONS = 33  # of that of inversions


def signed_rank_table(spark: SparkSession, most: int = SIGNED_RANK) -> DataFrame:
    """(n, statistic, p): two-sided chance of a smaller rank sum of at most ``statistic``, up to half of all ranks."""
    rows, counts = [], [1]
    for n in range(1, most + 1):
        counts = [(counts[w] if w < len(counts) else 0) + (counts[w - n] if w >= n else 0) for w in range(len(counts) + n)]
        below = 0
        for w in range(n * (n + 1) // 4 + 1):
            below += counts[w]
            rows.append((n, w, min(1.0, 2 * below / 2**n)))
    return spark.createDataFrame(rows, "n long, statistic long, p double")


def inversion_table(spark: SparkSession, most: int = INVERSIONS) -> DataFrame:
    """(n, statistic, p): two-sided chance of at most ``statistic`` inversions of a random order, up to half of all pairs."""
    rows, counts, orders = [], [1], 1
    for n in range(1, most + 1):
        orders *= n
        upto = [0]
        for c in counts:
            upto.append(upto[-1] + c)
        size = n * (n - 1) // 2 + 1
        counts = [upto[min(k + 1, len(counts))] - upto[max(0, k - n + 1)] if k - n + 1 < len(counts) else 0 for k in range(size)]
        below = 0
        for k in range((size - 1) // 2 + 1):
            below += counts[k]
            rows.append((n, k, 1.0 if 2 * k == size - 1 else min(1.0, 2 * below / orders)))
    return spark.createDataFrame(rows, "n long, statistic long, p double")


def _with_exact(df: DataFrame, table: DataFrame, exact, statistic, otherwise) -> DataFrame:
    """df with p (and how it was found): that of the table where ``exact`` holds and the table has it."""
    asked = df.withColumn("_s", F.when(exact, statistic).cast("long"))
    t = F.broadcast(table.select(F.col("n").alias("_n"), F.col("statistic").alias("_t"), F.col("p").alias("_p")))
    got = asked.join(t, (F.col("n") == F.col("_n")) & (F.col("_s") == F.col("_t")), "left")
    return got.withColumn("p", F.coalesce("_p", otherwise)).withColumn("method", F.when(F.col("_p").isNotNull(), "exact").otherwise("normal")).drop("_s", "_n", "_t", "_p")


def wilcoxon_test(df: DataFrame, keys: list[str], x: str, y: str, correction: bool = False) -> DataFrame:
    """(keys, w, n, p, method): two-sided signed-rank test, zeros dropped; exact for up to SIGNED_RANK differences without ties or zeros."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_d", F.col(x) - F.col(y)).withColumn("_a", F.abs("_d"))
    zeros = d.groupBy(*keys).agg(F.count_if(F.col("_d") == 0).alias("_z"))
    d = d.where("_d <> 0")
    ranked = average_rank(d, "_a", keys, "_r")
    tied = d.groupBy(*keys, "_a").agg(F.count("*").cast("double").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("_ties"))
    got = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("_minus"), F.count("*").alias("n"))
    got = got.join(tied, keys).join(zeros, keys).withColumn("w", F.least("_plus", "_minus"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    off = F.greatest(n * (n + 1) / 4 - F.col("w") - (0.5 if correction else 0.0), F.lit(0.0))
    normal = F.when(var > 0, F.least(F.lit(1.0), 2 * normal_tail(off / F.sqrt(var))))
    out = _with_exact(got, signed_rank_table(df.sparkSession), (F.col("_ties") == 0) & (F.col("_z") == 0), F.col("w"), normal)
    return out.select(*keys, "w", "n", "p", "method")


def kendall_test(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, tau, n, p, method): two-sided test of tau-b; exact for up to INVERSIONS pairs of values without ties."""
    g = kendall_sums(df, keys, x, y)
    n = F.col("n").cast("double")
    pairs, m = n * (n - 1) / 2, n * (n - 1)
    root = F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))
    var = (m * (2 * n + 5) - F.col("x1") - F.col("y1")) / 18 + 2 * F.col("tx") * F.col("ty") / F.nullif(m, F.lit(0.0)) + F.coalesce(F.col("x0") * F.col("y0") / F.nullif(9 * m * (n - 2), F.lit(0.0)), F.lit(0.0))
    normal = F.when((var > 0) & (root > 0), F.least(F.lit(1.0), 2 * normal_tail(F.abs("s") / F.sqrt(var))))
    got = g.withColumn("tau", F.col("s") / F.nullif(root, F.lit(0.0)))
    out = _with_exact(got, inversion_table(df.sparkSession), (F.col("tx") == 0) & (F.col("ty") == 0) & (n > 1), (pairs - F.abs("s")) / 2, normal)
    return out.select(*keys, "tau", "n", "p", "method")
