"""Document fingerprints by consistent weighted sampling, in DataFrame expressions alone.

A text's terms are its white-space separated words; a term weighs sqrt(times) * length, so that
short function words say little. For each of ``SAMPLES`` positions every weighted term draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of (term, position); with t = floor(ln w / r + b) the
term's value is ln c - r * (t - b + 1), and the term (with its t) of the least value is the sample. Two texts
share a sample with probability equal to the generalised Jaccard similarity of their weights.

Texts meet their successor by one shuffle into ranges of doc_id, and everything after it keeps that
partitioning. Null and empty texts have one empty term and so all have equal fingerprints; equal
doc_ids are taken one after the other; null doc_ids come last; a lone document is its own
successor; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLES = 16
BUCKETS_PER_PARTITION = 6


def _uniform(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0x1FFFFF)) + 0.5) / 2097152.0


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """A number whose order is that of the term's value at position k; its last 24 bits name the sample."""
    h1 = F.xxhash64(term, F.lit(k))
    h2 = F.xxhash64(h1)
    r = -F.log(_uniform(h1, 0) * _uniform(h1, 21))
    log_c = F.log(-F.log(_uniform(h1, 42) * _uniform(h2, 0)))
    b = _uniform(h2, 21)
    t = F.floor(log_weight / r + b)
    value = log_c - r * (t - b + 1)
    return (value * 262144.0).cast("long") * 16777216 + F.xxhash64(term, t, F.lit(k)).bitwiseAND(F.lit(0xFFFFFF))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [F.when(F.substring(a, 6 * k + 1, 6) == F.substring(b, 6 * k + 1, 6), 1.0).otherwise(0.0) for k in range(SAMPLES)]
    return sum(same[1:], same[0]) / SAMPLES


def _buckets(docs: DataFrame) -> Column:
    n = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("b")).first()["b"] if n > 1 else []
    bounds = sorted(set(bounds or []))
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)


def _after_bucket(rows: DataFrame, column: str) -> DataFrame:
    """For each bucket the column of the row that follows its last one (rows: one per bucket at most)."""
    heads = rows.where("place = 1").select("bucket", F.struct(column).alias("h"))
    order = W.orderBy(F.desc("bucket"))
    return heads.select("bucket", F.coalesce(F.lead("h").over(order), F.first("h").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))


def fingerprint_terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and ``fingerprint`` of a text column; rows must be partitioned by some of the keys to need no shuffle."""
    words = rows.select(*keys, F.explode(F.split(F.col(text), r"[\x20\x09-\x0D]+")).alias("word")).select(*keys, F.xxhash64("word").alias("term"), F.char_length("word").alias("size"))
    terms = words.groupBy(*keys, "term", "size").agg(F.count(F.lit(1)).alias("n"))
    weighed = terms.select(*keys, "term", (0.5 * F.log(F.col("n").cast("double")) + F.log(F.greatest(F.col("size"), F.lit(1)).cast("double"))).alias("lw"))
    mins = weighed.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("lw"), k)).alias(f"s{k}") for k in range(SAMPLES)])
    return mins.select(*keys, F.lower(F.concat(*[F.lpad(F.hex(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFF))), 6, "0") for k in range(SAMPLES)])).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the contract of op6), with likenesses."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    bucket = _buckets(docs)
    inside = src.withColumn("bucket", bucket).select("*", F.row_number().over(order).alias("place"), F.lead(F.struct("text")).over(order).alias("next"))
    # of several rows with the largest doc_id the one of the least text stands first
    heads = src.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("doc_id").alias("top"))
    first = src.withColumn("bucket", bucket).join(F.broadcast(heads.select("bucket", "top")), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min("text").alias("text"))
    after = _after_bucket(first.withColumn("place", F.lit(1)), "text")
    n = F.char_length("text")
    rows = inside.join(after, "bucket").select("bucket", "place", "doc_id", "text", n.cast("long").alias("n_chars"), F.coalesce(F.col("next.text"), F.col("after.text")).alias("next"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), F.expr("substring(next, 1, int(n_chars div 2))")))
    none = F.lit(None)
    parts = F.explode(
        F.array(
            F.struct(F.lit(0).alias("which"), F.col("text").alias("t"), none.cast("long").alias("id"), none.cast("long").alias("n_chars"), none.cast("string").alias("sha")),
            F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"), none.cast("long").alias("id"), none.cast("long").alias("n_chars"), none.cast("string").alias("sha")),
            F.struct(F.lit(2).alias("which"), F.lit("").alias("t"), F.col("doc_id").alias("id"), F.col("n_chars").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha")),
        )
    )
    flat = rows.select("bucket", "place", parts.alias("p")).select("bucket", "place", "p.which", "p.id", "p.n_chars", "p.sha", "p.t")
    prints = fingerprint_terms(flat, ["bucket", "place", "which", "id", "n_chars", "sha"], "t")
    pick = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    wide = prints.groupBy("bucket", "place").agg(pick(2, "id").alias("doc_id"), pick(2, "n_chars").alias("n_chars"), pick(2, "sha").alias("edited_sha256"), pick(0, "fingerprint").alias("fingerprint"), pick(1, "fingerprint").alias("edited_fingerprint"))
    wide = wide.withColumn("next", F.lead("fingerprint").over(W.partitionBy("bucket").orderBy("place")))
    heads = after_prints(first)
    out = wide.join(heads, "bucket").withColumn("next", F.coalesce("next", "after.fingerprint"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )


def after_prints(first: DataFrame) -> DataFrame:
    """The fingerprint that follows each bucket's last row, from the first text of each bucket."""
    heads = fingerprint_terms(first, ["bucket"], "text").withColumn("place", F.lit(1))
    return _after_bucket(heads, "fingerprint")
