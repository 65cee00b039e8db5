"""Queries of the llm operators for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, fingerprints, flac, language_id, licenses, mixing, packing, quality, resampling, substrings, suffix_tree, toxicity
from .ngram_join import ngram_jaccard_join

TOKENIZER = "word_bpe_49k.json"
TOXIC_AT = 0.3
QUALITY_AT = 0.5


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_documents(spark, sf_dir))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _fold(n: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = _fold(4) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).withColumn("held_out", held_out)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Trains on the labelled rows of three folds of four."""
    known = toxicity.label_sample(labels.where(_fold(4) != 2))
    return toxicity.train(docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "passages")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source / thousand / hundred / doc_id."""
    docs = _documents(spark, sf_dir)
    path = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 100"), F.col("doc_id").cast("string"))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_documents(spark, sf_dir))


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(flac.store(_documents(spark, sf_dir)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("sources"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_documents(spark, sf_dir), _fold(5) == 1)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_documents(spark, sf_dir)).drop("rid")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored()).alias("restored_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held_out = _fold(3) == 1
    known = quality.label_sample(spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    model = quality.train(docs.join(F.broadcast(known), "doc_id").select("text", "label"))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n, list_sort(list(g)) AS whole FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT md5(array_to_string(whole, '|')) AS h, count(*) AS k, min(doc_id) AS first FROM n GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(y) FROM r WHERE r.x = d.doc_id)) AS component_id, coalesce(c.k, 1) AS n_class,
  coalesce(c.first, d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.h = md5(array_to_string(n.whole, '|'))"""

_OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, 2.0 * source_size / w AS level, (SELECT 1.5 * sum(source_size) FROM s) AS total FROM s),
c AS (SELECT *, coalesce(sum(2.0 * source_size) OVER (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, sum(w) OVER (ORDER BY level, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM f),
m AS (SELECT arg_min((total - full_before) / w_rest, level) FILTER ((total - full_before) / w_rest <= level) AS lambda_ FROM c),
t AS (SELECT source, source_size, CASE WHEN lambda_ IS NULL OR lambda_ * w > 2.0 * source_size THEN 2.0 * source_size ELSE lambda_ * w END AS target FROM f, m),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(target + 0.5), 2 * source_size)::BIGINT AS supply,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('1:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CASE WHEN source_size = 0 THEN 0 ELSE (supply // source_size) * size + least(size, greatest(0, supply - (supply // source_size) * source_size - before)) END::BIGINT AS taken FROM q"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH RECURSIVE one AS (SELECT b, list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(b)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM d),
qf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM q),
n AS (SELECT f, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t, octet_length(encode(f)) AS k FROM (SELECT f, 1 AS s, 0 AS t FROM df UNION ALL SELECT f, 0, 1 FROM qf) GROUP BY f),
far AS (SELECT max(k) AS m FROM n),
place AS (SELECT 0::BIGINT AS dist, b, v FROM one UNION ALL SELECT dist + 1, p.b, xor(p.v >> 8, one.v) FROM place p, one, far WHERE one.b = p.v & 255 AND dist < far.m),
blank AS (SELECT 0::BIGINT AS k, 4294967295::UBIGINT AS v UNION ALL SELECT k + 1, xor(z.v >> 8, one.v) FROM blank z, one, far WHERE one.b = z.v & 255 AND k < far.m),
bytes AS (SELECT f, k, unnest(range(1, k + 1)) AS i FROM n),
crc AS (SELECT y.f, bit_xor(p.v) AS v, any_value(y.k) AS k FROM bytes y JOIN place p ON p.dist = y.k - y.i AND p.b = ('0x' || substr(hex(y.f), (2 * y.i - 1)::BIGINT, 2))::BIGINT GROUP BY y.f),
fb AS (SELECT crc.f, xor(xor(crc.v, z.v), 4294967295::UBIGINT) % 10000 AS bucket FROM crc JOIN blank z USING (k)),
total AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM n),
gain AS (SELECT bucket, floor(1000 * ln((sum(n.t)::DOUBLE + 1) * (any_value(total.s) + 10000) / ((sum(n.s)::DOUBLE + 1) * (any_value(total.t) + 10000))))::BIGINT AS g FROM n JOIN fb USING (f), total GROUP BY bucket),
x AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM df JOIN fb USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
sc AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS may,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN x ON x.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY may) AS many FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 5 * many // 100 THEN place END AS rank FROM r"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS w, list_transform(range(4), lambda i: ('0x' || substr(s, 1 + 8 * i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS y, array_to_string(w[b + 1:], '') AS z FROM c)
SELECT doc_id, len(w)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against brute force in the tests."""
    return {"op1_ngram_jaccard_join": _OP1, "op8_mixing": _OP8, "op11_importance_resampling": _OP11, "op12_fill_in_middle": _OP12}
