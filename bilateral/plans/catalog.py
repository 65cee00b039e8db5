"""The registered queries of the paired-signal operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import epoch, holm, normal_tail
from ..functions.ship import ship
from ..operators import align, deconvolution, features, filters, keys, lagcorr, models, peaks, rescale, sampling, segments, stationarity, stats, summary, warping
from ..sources import recordings as sources
from . import fixtures as fx
from .fixtures import EFFECTS, FEAT, INTERVALS, PAIRED, SAMPLES, SCORES, SEGMENTS

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}
SIDE = ["usr", "side"]
SEG = ["usr", "side", "segment_id"]


def query(sql: str | None = None, doubles: str = "", longs: str = "", name: str = "", places: int = 6, nine: str = ""):
    """Registers a query; doubles are rounded to six places (``nine`` columns to nine: means of short decimals would tie) and whole
    numbers are BIGINT on both sides."""

    def add(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = f(spark, sf_dir)
            fix = {"double": lambda c: F.round(c, 9 if c in nine.split() else places) + 0.0, "int": lambda c: F.col(c).cast("long"), "tinyint": lambda c: F.col(c).cast("long")}
            return df.select(*[fix[t](c).alias(c) if t in fix else F.col(c) for c, t in df.dtypes])

        _queries[key] = run
        if sql:
            swap = [f"round({c}, {places}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            _sql[key] = f"SELECT * {'REPLACE (' + ', '.join(swap) + ')' if swap else ''} FROM ({sql}) q"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left against right for each segment feature: Pearson's r with interval and Cliff's delta with interval."""
    seg = fx.segment_samples(spark, sf_dir)
    f = features.basic(seg, [*SEG, "component"]).join(features.slope(seg, [*SEG, "component"]), [*SEG, "component"])
    long = f.unpivot([*SEG, "component"], ["min_feat", "max_feat", "mean_feat", "std_feat", "slope_feat"], "feature", "value")
    long = long.withColumn("value", F.round("value", 9))  # equal values stay equal whatever the order of their sums
    pairs = align.pair_sides(long, ["usr", "segment_id", "component", "feature"], ["value"])
    by = ["component", "feature"]
    r = stats.pearson(pairs, by, "left_value", "right_value").drop("t")
    d = stats.cliff_delta(pairs, by, "left_value", "right_value").select(*by, "delta", F.col("ci_low").alias("delta_low"), F.col("ci_high").alias("delta_high"))
    return r.join(d, by).orderBy(*by)


# --- time axis, keys and filters


@query(f"WITH {SAMPLES} SELECT usr, side, pos, CAST(epoch(ts) AS BIGINT) AS t FROM samples")
def clock_build(spark, sf):
    return fx.samples(spark, sf).select("usr", "side", "pos", epoch("ts").alias("t"))


@query("""SELECT event_id, usr, CASE WHEN n > 1 THEN day || '_' || k ELSE day END AS session FROM (
  SELECT event_id, usr, day, count(*) OVER (PARTITION BY usr, day) AS n, row_number() OVER (PARTITION BY usr, day ORDER BY event_id) - 1 AS k FROM (
    SELECT event_id, user_id AS usr, strftime(ts::DATE + CASE WHEN substr(strftime(ts, '%y%m%d-%H%M'), 8, 1) = '0' THEN 0 ELSE 1 END, '%Y-%m-%d') AS day FROM events) a) b""")
def session_name_fix(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.col("user_id").alias("usr"), F.date_format("ts", "yyMMdd-HHmm").alias("name"))
    fixed = e.select("event_id", "usr", keys.fix_session_name("name").cast("string").alias("session"))
    return keys.unique_names(fixed, "session", ["usr"], ["event_id"]).select("event_id", "usr", "session")


@query(f"WITH {SAMPLES} SELECT usr, side, count(*) AS n FROM samples WHERE usr NOT IN (SELECT user_id FROM events WHERE user_id % 4 = 0) GROUP BY ALL")
def user_anti(spark, sf):
    gone = fx.table(spark, sf, "events").where("user_id % 4 = 0").select(F.col("user_id").alias("usr"))
    return keys.filter_users(fx.positions(spark, sf), gone).groupBy("usr", "side").agg(F.count("*").alias("n"))


_SESSIONS = f"""WITH {SAMPLES}, s AS (SELECT *, CAST(floor(pos / 10) AS BIGINT) AS session FROM samples),
info AS (SELECT DISTINCT usr, session FROM s WHERE (usr + session) % 3 <> 0),
one AS (SELECT usr, session FROM s GROUP BY ALL HAVING min(side) = max(side)),
kept AS (SELECT * FROM s WHERE (usr, session) IN (SELECT usr, session FROM info UNION SELECT usr, session FROM one))"""


def _sessions(spark, sf):
    s = fx.positions(spark, sf).withColumn("session", F.floor(F.col("pos") / 10).cast("long"))
    return s, keys.sessions_in_info(s, s.where("(usr + session) % 3 <> 0").select("usr", "session").distinct())


@query(f"{_SESSIONS} SELECT usr, session, side, count(*) AS n FROM kept GROUP BY ALL")
def session_semi(spark, sf):
    return _sessions(spark, sf)[1].groupBy("usr", "session", "side").agg(F.count("*").alias("n"))


@query(f"{_SESSIONS} SELECT usr, count(*) AS removed FROM (SELECT DISTINCT usr, session FROM s EXCEPT SELECT usr, session FROM kept) x GROUP BY ALL")
def session_removed(spark, sf):
    return keys.removed_sessions(*_sessions(spark, sf))


@query(f"WITH {SAMPLES} SELECT usr, side, pos, value FROM samples QUALIFY row_number() OVER (PARTITION BY usr, side ORDER BY pos) <= 10", "value")
def first_samples(spark, sf):
    return keys.first_rows(fx.positions(spark, sf), 10, SIDE, ["pos"]).select("usr", "side", "pos", "value")


@query(f"WITH {SAMPLES} SELECT usr, session FROM (SELECT usr, CAST(floor(pos / 10) AS BIGINT) AS session FROM samples WHERE side = 'left' INTERSECT SELECT usr, CAST(floor(pos / 10) AS BIGINT) FROM samples WHERE side = 'right') x")
def common_sessions(spark, sf):
    return keys.common_keys(fx.positions(spark, sf).withColumn("session", F.floor(F.col("pos") / 10).cast("long")), ["usr", "session"])


# --- interval and alignment joins


@query(f"""WITH {SAMPLES}, {INTERVALS} SELECT s.usr, side, event, count(*) AS n, avg(value) AS mean_value FROM samples s JOIN (
  SELECT usr, 'baseline_1' AS event, start_baseline_1 AS a, end_baseline_1 AS b FROM intervals UNION ALL SELECT usr, 'cognitive_load', start_cognitive_load, end_cognitive_load FROM intervals) i
  ON s.usr = i.usr AND ts BETWEEN a AND b GROUP BY ALL""", "mean_value")
def interval_slice(spark, sf):
    events = align.long_intervals(fx.intervals(spark, sf), ["usr"])
    return align.slice_intervals(fx.samples(spark, sf), events, ["usr"]).groupBy("usr", "side", "event").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query(f"""WITH {SAMPLES}, {INTERVALS} SELECT CASE WHEN event = 'cognitive_load' THEN 'cognitive_load' ELSE 'baseline' END AS grp, event, side, count(*) AS n FROM samples s JOIN (
  SELECT usr, 'baseline_1' AS event, start_baseline_1 AS a, end_baseline_1 AS b FROM intervals UNION ALL SELECT usr, 'cognitive_load', start_cognitive_load, end_cognitive_load FROM intervals) i
  ON s.usr = i.usr AND ts BETWEEN a AND b GROUP BY ALL""")
def event_grouping(spark, sf):
    events = keys.event_groups(align.long_intervals(fx.intervals(spark, sf), ["usr"]))
    return align.slice_intervals(fx.samples(spark, sf), events, ["usr"]).groupBy("grp", "event", "side").agg(F.count("*").alias("n"))


@query(f"""WITH {SAMPLES}, {INTERVALS} SELECT s.usr, side, event, count(*) AS n, avg(value) AS mean_value FROM samples s JOIN (
  SELECT usr, 'sleep' AS event, actual_bed_time AS a, wake_up_time AS b FROM intervals UNION ALL SELECT usr, 'awake_1', TIMESTAMP '0001-01-01', actual_bed_time FROM intervals
  UNION ALL SELECT usr, 'awake_2', wake_up_time, TIMESTAMP '9999-12-31' FROM intervals) i ON s.usr = i.usr AND ts BETWEEN a AND b GROUP BY ALL""", "mean_value")
def event_split(spark, sf):
    events = align.sleep_intervals(fx.intervals(spark, sf), ["usr"])
    return align.slice_intervals(fx.samples(spark, sf), events, ["usr"]).groupBy("usr", "side", "event").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


_CUT = f"""WITH {SAMPLES}, e AS (SELECT usr, side, min(ts) AS lo, max(ts) AS hi FROM samples GROUP BY ALL),
o AS (SELECT usr, max(lo) AS a, min(hi) AS b FROM e GROUP BY usr HAVING count(*) = 2), cut AS (SELECT s.* FROM samples s JOIN o ON s.usr = o.usr AND ts BETWEEN a AND b)"""


@query(f"{_CUT} SELECT usr, side, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS first_t, CAST(epoch(max(ts)) AS BIGINT) AS last_t FROM cut GROUP BY ALL")
def overlap_cut(spark, sf):
    cut = align.cut_to_overlap(fx.samples(spark, sf), ["usr"])
    return cut.groupBy("usr", "side").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).select("usr", "side", "n", epoch("a").alias("first_t"), epoch("b").alias("last_t"))


_GAPPY = _CUT.replace("e AS (SELECT", "g AS (SELECT * FROM samples WHERE NOT (side = 'right' AND usr % 3 = 0 AND pos = 12)), e AS (SELECT", 1).replace("max(ts) AS hi FROM samples", "max(ts) AS hi FROM g").replace("SELECT s.* FROM samples s", "SELECT s.* FROM g s")


@query(f"""{_GAPPY}, c AS (SELECT usr, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS r FROM cut GROUP BY usr),
stop AS (SELECT a.usr, min(a.ts) AS stop FROM cut a JOIN c USING (usr) WHERE l <> r AND a.side = CASE WHEN l > r THEN 'left' ELSE 'right' END
  AND NOT EXISTS (SELECT 1 FROM cut b WHERE b.usr = a.usr AND b.ts = a.ts AND b.side <> a.side) GROUP BY a.usr)
SELECT usr, side, count(*) AS n, CAST(epoch(max(ts)) AS BIGINT) AS last_t FROM cut LEFT JOIN stop USING (usr) WHERE stop IS NULL OR ts < stop GROUP BY ALL""")
def trim_shortest(spark, sf):
    gappy = fx.samples(spark, sf).where("not (side = 'right' and usr % 3 = 0 and pos = 12)")
    return align.trim_to_shortest(gappy, ["usr"]).groupBy("usr", "side").agg(F.count("*").alias("n"), F.max("ts").alias("b")).select("usr", "side", "n", epoch("b").alias("last_t"))


@query(f"""WITH {SAMPLES} SELECT s.usr, s.pos, CASE WHEN top IS NULL THEN NULL WHEN top > 60 THEN 1 ELSE 0 END AS artefact FROM (SELECT * FROM samples WHERE side = 'left') s LEFT JOIN (
  SELECT usr, floor(pos * 0.5 / 2) AS bucket, max(value) AS top FROM samples WHERE side = 'right' GROUP BY ALL) f ON s.usr = f.usr AND floor(s.pos / 2.0) = bucket""", longs="artefact")
def asof_bucket_mask(spark, sf):
    s = fx.positions(spark, sf)
    fast = s.where("side = 'right'").withColumn("seconds", F.col("pos") * 0.5)
    slow = s.where("side = 'left'").withColumn("seconds", F.col("pos").cast("double"))
    return align.bucket_mask(fast, slow, ["usr"], 2.0, 60.0).select("usr", "pos", "artefact")


@query(f"WITH {SAMPLES} SELECT l.usr, l.pos, r.value AS other FROM (SELECT * FROM samples WHERE side = 'left') l ASOF LEFT JOIN (SELECT * FROM samples WHERE side = 'right') r ON l.usr = r.usr AND l.ts >= r.ts", "other")
def as_of_join(spark, sf):
    s = fx.samples(spark, sf)
    return align.as_of(s.where("side = 'left'"), s.where("side = 'right'"), ["usr"], "value", "other").select("usr", "pos", "other")


_PAIRS = "p AS (SELECT l.usr, l.pos, l.value AS left_value, r.value AS right_value FROM samples l JOIN samples r ON l.usr = r.usr AND l.pos = r.pos AND l.side = 'left' AND r.side = 'right')"


def _pairs(spark, sf):
    return align.pair_sides(fx.positions(spark, sf), ["usr", "pos"], ["value"])


@query(f"WITH {SAMPLES}, {_PAIRS} SELECT * FROM p", "left_value right_value")
def side_pairs(spark, sf):
    return _pairs(spark, sf)


# --- aggregations

_LABELS = f"""WITH {SAMPLES}, {INTERVALS}, g AS (SELECT usr, side, CAST(floor(pos / 4) AS BIGINT) AS segment_id, min(ts) AS s, max(ts) AS e, count(*) AS n FROM samples GROUP BY ALL HAVING count(*) = 4),
m1 AS (SELECT g.*, CASE WHEN e < end_baseline_1 THEN 0 WHEN s < end_baseline_1 AND e > end_baseline_1 THEN 0 WHEN s > end_baseline_1 AND e < start_cognitive_load THEN NULL WHEN s > end_cognitive_load THEN NULL
  WHEN s < start_cognitive_load AND e > start_cognitive_load THEN NULL ELSE 1 END AS label FROM g JOIN intervals USING (usr)),
m2 AS (SELECT g.*, CASE WHEN e < actual_bed_time OR s > wake_up_time THEN 0 WHEN s > actual_bed_time AND e < wake_up_time THEN 1 END AS label FROM g JOIN intervals USING (usr))"""
_INFO = {"start_base": "start_baseline_1", "end_base": "end_baseline_1", "start_task": "start_cognitive_load", "end_task": "end_cognitive_load"}


def _labelled(spark, sf, mode=1):
    seg = segments.fixed_segments(fx.samples(spark, sf), SIDE, 4).join(fx.intervals(spark, sf), "usr")
    return seg.withColumn("label", segments.label_experiment("start_ts", "end_ts", _INFO) if mode == 1 else segments.label_sleep("start_ts", "end_ts"))


@query(f"{_LABELS} SELECT usr, side, segment_id, label FROM m1", longs="label")
def segment_labels_m1(spark, sf):
    return _labelled(spark, sf).select("usr", "side", "segment_id", "label")


@query(f"{_LABELS} SELECT usr, side, segment_id, label FROM m2", longs="label")
def segment_labels_m2(spark, sf):
    return _labelled(spark, sf, 2).select("usr", "side", "segment_id", "label")


@query(f"{_LABELS} SELECT usr, side, segment_id, label FROM m1 WHERE label IS NOT NULL AND (usr, segment_id) IN (SELECT usr, segment_id FROM m1 WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) = 2)", longs="label")
def segments_both_sides(spark, sf):
    return segments.both_sides(_labelled(spark, sf), ["usr"]).select("usr", "side", "segment_id", "label")


@query(f"{_LABELS} SELECT usr, side, segment_id, CAST(epoch(s) AS BIGINT) AS start_t, CAST(epoch(e) AS BIGINT) AS end_t, n FROM g")
def segments_fixed(spark, sf):
    return segments.fixed_segments(fx.samples(spark, sf), SIDE, 4).select("usr", "side", "segment_id", epoch("start_ts").alias("start_t"), epoch("end_ts").alias("end_t"), F.col("n_samples").alias("n"))


@query(f"WITH {SAMPLES} SELECT side, count(*) AS n_segments, sum(CASE WHEN n <> 4 THEN 1 ELSE 0 END) AS n_wrong, avg(CASE WHEN n <> 4 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT usr, side, floor(pos / 4), count(*) AS n FROM samples GROUP BY ALL) g GROUP BY side", "share", "n_wrong")
def segment_lengths(spark, sf):
    return segments.wrong_length_share(segments.fixed_segments(fx.samples(spark, sf), SIDE, 4, full=False), 4, ["side"])


@query(f"{_LABELS} SELECT side, label, count(*) AS n FROM m1 GROUP BY ALL", longs="label")
def label_counts(spark, sf):
    return summary.label_counts(_labelled(spark, sf))


@query(f"{_LABELS} SELECT side, label, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY side) AS percent FROM m1 GROUP BY side, label", "percent", "label")
def label_share(spark, sf):
    return summary.label_shares(summary.label_counts(_labelled(spark, sf)))


@query(f"""WITH {SAMPLES}, a AS (SELECT usr, side, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS share FROM samples GROUP BY ALL)
SELECT usr, side, share FROM a WHERE usr IN (SELECT usr FROM a GROUP BY usr HAVING sum(share) > 0.01)""", "share")
def artefact_share(spark, sf):
    return summary.artefact_shares(fx.positions(spark, sf).withColumn("artefact", (F.col("event_type") == "error").cast("int")))


@query(f"WITH {SAMPLES}, {_PAIRS} SELECT usr, avg(left_value - right_value) AS mean_diff, avg(abs(left_value - right_value)) AS mean_abs_diff, count(*) AS n FROM p GROUP BY usr", "mean_diff mean_abs_diff", places=9)
def mean_diff(spark, sf):
    return stats.mean_difference(_pairs(spark, sf), ["usr"], "left_value", "right_value")


@query(f"""WITH {SAMPLES}, {_PAIRS}, b AS (SELECT usr, avg(left_value - right_value) AS mean_diff, stddev_pop(left_value - right_value) AS sd_diff, count(*) AS n FROM p GROUP BY usr)
SELECT *, mean_diff - 1.96 * sd_diff AS low, mean_diff + 1.96 * sd_diff AS high FROM b""", "mean_diff sd_diff low high", places=9)
def bland_altman(spark, sf):
    return stats.bland_altman(_pairs(spark, sf), ["usr"], "left_value", "right_value")


# --- rescaling

_SCALE = "SELECT usr, side, pos, {} AS scaled FROM samples"


def _scaled(method):
    return lambda spark, sf: rescale.rescale(fx.positions(spark, sf), method, SIDE).select("usr", "side", "pos", "scaled")


@query(f"WITH {SAMPLES} " + _SCALE.format("(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)") + " WINDOW w AS (PARTITION BY usr, side)", "scaled")
def scale_standard(spark, sf):
    return _scaled("standard")(spark, sf)


@query(f"WITH {SAMPLES} " + _SCALE.format("(value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0)") + " WINDOW w AS (PARTITION BY usr, side)", "scaled")
def scale_minmax(spark, sf):
    return _scaled("min_max")(spark, sf)


@query(f"""WITH {SAMPLES}, q AS (SELECT usr, side, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM samples GROUP BY ALL)
SELECT usr, side, pos, (value - b) / nullif(c - a, 0) AS scaled FROM samples JOIN q USING (usr, side)""", "scaled")
def scale_robust(spark, sf):
    return _scaled("robust")(spark, sf)


@query(f"WITH {SAMPLES} " + _SCALE.format("ln(1 + value)"), "scaled")
def scale_log1p(spark, sf):
    return _scaled("log")(spark, sf)


@query(f"""WITH {SAMPLES}, lams AS (SELECT -2.0 + 0.25 * i AS lam FROM range(17) r(i)),
y AS (SELECT usr, side, pos, lam, value, CASE WHEN value >= 0 THEN CASE WHEN abs(lam) > 1e-9 THEN (pow(value + 1.0, lam) - 1) / lam ELSE ln(value + 1.0) END
  ELSE CASE WHEN abs(2 - lam) > 1e-9 THEN -(pow(1.0 - value, 2 - lam) - 1) / (2 - lam) ELSE -ln(1.0 - value) END END AS psi FROM samples, lams),
ll AS (SELECT usr, side, lam, -count(*) / 2.0 * ln(nullif(var_pop(psi), 0)) + (lam - 1) * sum(sign(value) * ln(1 + abs(value))) AS l FROM y GROUP BY usr, side, lam),
best AS (SELECT usr, side, arg_max(lam, l) AS lam FROM ll GROUP BY ALL)
SELECT usr, side, pos, lam AS power, (psi - avg(psi) OVER w) / nullif(stddev_pop(psi) OVER w, 0) AS scaled FROM y JOIN best USING (usr, side, lam) WINDOW w AS (PARTITION BY usr, side)""", "power scaled")
def scale_yeojohnson(spark, sf):
    return rescale.yeo_johnson(fx.positions(spark, sf), SIDE).select("usr", "side", "pos", F.col("lambda").alias("power"), "scaled")


_UP, _DOWN = "ln(1 + greatest(v, 0))", "ln(1 + greatest(-v, 0))"
_PSI = f"CASE WHEN v >= 0 THEN CASE WHEN abs(mid) > 1e-9 THEN (exp(mid * {_UP}) - 1) / mid ELSE {_UP} END WHEN abs(2 - mid) > 1e-9 THEN -(exp((2 - mid) * {_DOWN}) - 1) / (2 - mid) ELSE -{_DOWN} END"
_SLOPE = f"CASE WHEN v >= 0 THEN CASE WHEN abs(mid) > 1e-5 THEN (exp(mid * {_UP}) * (mid * {_UP} - 1) + 1) / (mid * mid) ELSE pow({_UP}, 2) / 2 + mid * pow({_UP}, 3) / 3 END WHEN abs(2 - mid) > 1e-5 THEN (exp((2 - mid) * {_DOWN}) * ((2 - mid) * {_DOWN} - 1) + 1) / pow(2 - mid, 2) ELSE pow({_DOWN}, 2) / 2 + (2 - mid) * pow({_DOWN}, 3) / 3 END"


@query(f"""WITH RECURSIVE {SAMPLES}, g AS (SELECT usr, side, list(value::DOUBLE) AS x, count(*) AS n, sum(sign(value) * ln(1 + abs(value))) AS s FROM samples GROUP BY ALL HAVING max(value) > min(value)),
b AS (SELECT usr, side, x, n, s, -4.0::DOUBLE AS lo, 6.0::DOUBLE AS hi, 0 AS k FROM g UNION ALL
  SELECT usr, side, x, n, s, CASE WHEN s - n * c / w > 0 THEN mid ELSE lo END, CASE WHEN s - n * c / w > 0 THEN hi ELSE mid END, k + 1 FROM (
    SELECT *, list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i] * (d[i] - list_avg(d)))) / n AS c, list_sum(list_transform(y, lambda q: pow(q - list_avg(y), 2))) / n AS w FROM (
      SELECT *, list_transform(x, lambda v: {_PSI}) AS y, list_transform(x, lambda v: {_SLOPE}) AS d FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE k < 45) m) t) q),
l AS (SELECT usr, side, (lo + hi) / 2 AS mid FROM b WHERE k = 45), y AS (SELECT usr, side, pos, mid, {_PSI} AS psi FROM (SELECT usr, side, pos, value AS v FROM samples) i LEFT JOIN l USING (usr, side))
SELECT usr, side, pos, mid AS power, (psi - avg(psi) OVER w) / nullif(stddev_pop(psi) OVER w, 0) AS scaled FROM y WINDOW w AS (PARTITION BY usr, side)""", "power scaled")
def scale_yeojohnson_likeliest(spark, sf):
    return rescale.yeo_johnson(fx.positions(spark, sf), SIDE, grid=None).select("usr", "side", "pos", F.col("lambda").alias("power"), "scaled")


@query(f"""WITH {SAMPLES} SELECT usr, side, pos, (rank() OVER (PARTITION BY usr, side ORDER BY value) + (count(*) OVER (PARTITION BY usr, side, value) - 1) / 2.0 - 1)
  / nullif(count(*) OVER (PARTITION BY usr, side) - 1, 0) AS scaled FROM samples""", "scaled")
def scale_quantile(spark, sf):
    return _scaled("quantile")(spark, sf)


# --- filters

_K = f"{math.tan(math.pi * 0.4 / 4)!r}"
_H = f"(CASE WHEN d = 0 THEN b ELSE (b - a * b) * pow(-a, d - 1) END)"
_COEF = f"coef AS (SELECT {_K} / (1 + {_K}) AS b, ({_K} - 1) / (1 + {_K}) AS a)"


@query(f"""WITH {SAMPLES}, {_COEF} SELECT usr, side, pos, sum(v * {_H}) AS filtered FROM (
  SELECT x.usr, x.side, x.pos, z.value AS v, x.pos - z.pos AS d, a, b FROM samples x JOIN samples z ON x.usr = z.usr AND x.side = z.side AND z.pos <= x.pos, coef) s GROUP BY ALL""", "filtered")
def lowpass_causal(spark, sf):
    return filters.lowpass_causal(fx.positions(spark, sf), SIDE, 0.4, 4.0).select("usr", "side", "pos", "filtered")


@query(f"""WITH {SAMPLES}, {_COEF}, m AS (SELECT usr, side, max(pos) + 1 AS n, arg_min(value, pos) AS x0, arg_max(value, pos) AS x1 FROM samples GROUP BY ALL HAVING max(pos) >= 6),
ext AS (SELECT usr, side, pos, value AS x FROM samples JOIN m USING (usr, side) UNION ALL SELECT usr, side, -pos, 2 * x0 - value FROM samples JOIN m USING (usr, side) WHERE pos BETWEEN 1 AND 6
  UNION ALL SELECT usr, side, 2 * (n - 1) - pos, 2 * x1 - value FROM samples JOIN m USING (usr, side) WHERE pos BETWEEN n - 7 AND n - 2),
f1 AS (SELECT usr, side, pos, sum(v * {_H}) + (1 - sum({_H})) * arg_min(v, q) AS x FROM (SELECT p.usr, p.side, p.pos, z.x AS v, z.pos AS q, p.pos - z.pos AS d, a, b FROM ext p JOIN ext z ON p.usr = z.usr AND p.side = z.side AND z.pos <= p.pos, coef) s GROUP BY ALL),
f2 AS (SELECT usr, side, pos, sum(v * {_H}) + (1 - sum({_H})) * arg_max(v, q) AS x FROM (SELECT p.usr, p.side, p.pos, z.x AS v, z.pos AS q, z.pos - p.pos AS d, a, b FROM f1 p JOIN f1 z ON p.usr = z.usr AND p.side = z.side AND z.pos >= p.pos, coef) s GROUP BY ALL)
SELECT s.usr, s.side, s.pos, f2.x AS filtered FROM samples s LEFT JOIN f2 ON s.usr = f2.usr AND s.side = f2.side AND s.pos = f2.pos""", "filtered")
def lowpass_zero_phase(spark, sf):
    return filters.lowpass_zero_phase(fx.positions(spark, sf), SIDE, 0.4, 4.0).select("usr", "side", "pos", "filtered")


def _biquad_sql(name: str, source: str, part: tuple, forward: bool = True, steady: bool = False) -> str:
    """A recursive table ``name`` (usr, side, pos, y) of a section run over ``source`` (usr, side, pos, x)."""
    b0, b1, b2, a1, a2 = (f"({v!r}::DOUBLE)" for v in part)
    first = f"SELECT usr, side, {'min' if forward else 'max'}(pos) AS pos FROM {source} GROUP BY ALL"
    q, r = (f"(1 - {b0}) * x", f"({b2} - {a2}) * x") if steady else ("0.0::DOUBLE", "0.0::DOUBLE")
    step = lambda src: f"SELECT usr, side, pos, y, {b1} * x - {a1} * y + r AS q, {b2} * x - {a2} * y AS r FROM (SELECT *, {b0} * x + q AS y FROM ({src}) i) j"
    start = step(f"SELECT usr, side, pos, x::DOUBLE AS x, {q} AS q, {r} AS r FROM {source} JOIN ({first}) m USING (usr, side, pos)")
    more = step(f"SELECT n.usr, n.side, n.pos, n.x, b.q, b.r FROM {name} b JOIN {source} n ON n.usr = b.usr AND n.side = b.side AND n.pos = b.pos {'+' if forward else '-'} 1")
    return f"{name} AS ({start} UNION ALL {more})"


_THREE = filters.sections(0.4, 4.0, 3)


@query(f"""WITH RECURSIVE {SAMPLES}, x0 AS (SELECT usr, side, pos, value AS x FROM samples), {_biquad_sql('f1', 'x0', _THREE[0])}, x1 AS (SELECT usr, side, pos, y AS x FROM f1), {_biquad_sql('f2', 'x1', _THREE[1])}
SELECT usr, side, pos, y AS filtered FROM f2""", "filtered")
def lowpass_causal_order3(spark, sf):
    return filters.lowpass_causal(fx.positions(spark, sf), SIDE, 0.4, 4.0, degree=3).select("usr", "side", "pos", "filtered")


_TWO = filters.sections(0.2, 4.0, 2)[0]


@query(f"""WITH RECURSIVE {SAMPLES}, m AS (SELECT usr, side, max(pos) + 1 AS n, arg_min(value, pos) AS x0, arg_max(value, pos) AS x1 FROM samples GROUP BY ALL HAVING max(pos) >= 9),
ext AS (SELECT usr, side, pos, value AS x FROM samples JOIN m USING (usr, side) UNION ALL SELECT usr, side, -pos, 2 * x0 - value FROM samples JOIN m USING (usr, side) WHERE pos BETWEEN 1 AND 9
  UNION ALL SELECT usr, side, 2 * (n - 1) - pos, 2 * x1 - value FROM samples JOIN m USING (usr, side) WHERE pos BETWEEN n - 10 AND n - 2),
{_biquad_sql('f1', 'ext', _TWO, True, True)}, turned AS (SELECT usr, side, pos, y AS x FROM f1), {_biquad_sql('f2', 'turned', _TWO, False, True)}
SELECT s.usr, s.side, s.pos, f2.y AS filtered FROM samples s LEFT JOIN f2 ON s.usr = f2.usr AND s.side = f2.side AND s.pos = f2.pos""", "filtered")
def lowpass_zero_phase_order2(spark, sf):
    return filters.lowpass_zero_phase(fx.positions(spark, sf), SIDE, 0.2, 4.0, degree=2).select("usr", "side", "pos", "filtered")


@query(f"""WITH {SAMPLES}, c AS (SELECT usr, side, pos, coalesce(greatest(abs(value / 64 - lag(value / 64) OVER w), abs(ln(1 + value) / 64 - lag(ln(1 + value) / 64) OVER w), abs(sqrt(value) / 64 - lag(sqrt(value) / 64) OVER w)), 0) AS c
  FROM samples WINDOW w AS (PARTITION BY usr, side ORDER BY pos)),
s AS (SELECT usr, side, pos, sum(c) OVER (PARTITION BY usr, side ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) / 32 AS s FROM c)
SELECT x.usr, x.side, x.pos, CASE WHEN x.pos >= 8 THEN sum(z.s * 0.1 * pow(0.9, x.pos - z.pos)) END AS smoothed FROM s x JOIN s z ON x.usr = z.usr AND x.side = z.side AND z.pos <= x.pos GROUP BY x.usr, x.side, x.pos""", "smoothed")
def ema_acc(spark, sf):
    s = fx.positions(spark, sf).select("usr", "side", "pos", F.col("value").alias("x"), F.log1p("value").alias("y"), F.sqrt("value").alias("z"))
    return filters.moving_acceleration(s, SIDE, 8).select("usr", "side", "pos", "smoothed")


@query(f"""WITH {SAMPLES}, m AS (SELECT usr, side, pos, value, quantile_cont(value, 0.5) OVER (PARTITION BY usr, side ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS tonic FROM samples)
SELECT usr, side, pos, tonic, value - tonic AS phasic FROM m""", "tonic phasic")
def tonic_phasic(spark, sf):
    return filters.tonic_phasic(fx.positions(spark, sf), SIDE, 4).select("usr", "side", "pos", "tonic", "phasic")


@query()
def tonic_phasic_sparse(spark, sf):
    return deconvolution.tonic_phasic(fx.positions(spark, sf), SIDE, 4.0).select("usr", "side", "pos", "tonic", "phasic", "driver")


@query(f"""WITH {SAMPLES}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY usr, side ORDER BY pos)) AS d FROM samples)
SELECT usr, side, CAST(floor(pos / 5) AS BIGINT) AS window_id, CASE WHEN min(value) < 0.5 OR max(value) > 150 OR coalesce(max(d), 0) > 80 OR (count(*) > 1 AND min(value) = max(value)) THEN 1 ELSE 0 END AS artefact, count(*) AS n FROM d GROUP BY ALL""", longs="artefact")
def artefact_rules(spark, sf):
    return filters.artefact_rules(fx.positions(spark, sf), SIDE, 5, 0.5, 150.0, 80.0).withColumn("window_id", F.col("window_id").cast("long"))


# --- features

_SEG = f"WITH {SAMPLES}, {SEGMENTS}"
_BY = "usr, side, segment_id, component"
_GRAD = f"""{_SEG}, d AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS d1
  FROM seg WINDOW w AS (PARTITION BY {_BY} ORDER BY pos))"""
KEYS = [*SEG, "component"]


@query(f"{_SEG} SELECT {_BY}, min(value) AS min_feat, max(value) AS max_feat, avg(value) AS mean_feat, stddev_pop(value) AS std_feat, max(value) - min(value) AS dynamic_range_feat FROM seg GROUP BY ALL", "min_feat max_feat mean_feat std_feat dynamic_range_feat")
def feat_basic(spark, sf):
    return features.basic(fx.segment_samples(spark, sf), KEYS)


@query(f"{_SEG} SELECT {_BY}, regr_slope(value, pos::DOUBLE) AS slope_feat, abs(regr_slope(value, pos::DOUBLE)) AS absolute_slope_feat FROM seg GROUP BY ALL", "slope_feat absolute_slope_feat")
def feat_slope(spark, sf):
    return features.slope(fx.segment_samples(spark, sf), KEYS)


@query(f"{_GRAD} SELECT {_BY}, avg(d1) AS first_derivative_mean, stddev_pop(d1) AS first_derivative_std FROM d GROUP BY ALL", "first_derivative_mean first_derivative_std")
def feat_gradient(spark, sf):
    return features.derivatives(fx.segment_samples(spark, sf), KEYS)


@query(f"""{_GRAD}, dd AS (SELECT *, CASE WHEN lag(d1) OVER w IS NULL THEN lead(d1) OVER w - d1 WHEN lead(d1) OVER w IS NULL THEN d1 - lag(d1) OVER w ELSE (lead(d1) OVER w - lag(d1) OVER w) / 2 END AS d2
  FROM d WINDOW w AS (PARTITION BY {_BY} ORDER BY pos)) SELECT {_BY}, avg(d1) AS first_derivative_mean, stddev_pop(d1) AS first_derivative_std, avg(d2) AS second_derivative_mean, stddev_pop(d2) AS second_derivative_std FROM dd GROUP BY ALL""",
       "first_derivative_mean first_derivative_std second_derivative_mean second_derivative_std")
def feat_second_gradient(spark, sf):
    return features.derivatives(fx.segment_samples(spark, sf), KEYS, second=True)


@query(f"{_SEG}, t AS (SELECT *, (value + lag(value) OVER (PARTITION BY {_BY} ORDER BY pos)) / 2 AS t FROM seg) SELECT {_BY}, coalesce(sum(t), 0) / 4.0 AS auc_feat FROM t GROUP BY ALL", "auc_feat")
def feat_auc(spark, sf):
    return features.area(fx.segment_samples(spark, sf), KEYS, 4.0)


@query(f"""{_SEG}, p AS (SELECT *, value * value / 4.0 / nullif(sum(value * value / 4.0) OVER (PARTITION BY usr, side, segment_id), 0) AS p FROM seg)
SELECT {_BY}, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS entropy FROM p GROUP BY ALL""", "entropy")
def feat_entropy(spark, sf):
    return features.entropy(fx.segment_samples(spark, sf), SEG, "component", 4.0)


@query(f"{_SEG} SELECT {_BY}, abs(arg_min(value, pos)) AS dc_term, count(*) * abs(arg_min(value, pos)) AS sum_of_all_coefficients, abs(sum(value)) / 4.0 AS spectral_energy FROM seg GROUP BY ALL", "dc_term sum_of_all_coefficients spectral_energy")
def feat_dc_energy(spark, sf):
    return features.dc_energy(fx.segment_samples(spark, sf), KEYS, 4.0)


_PEAKS = f"""WITH {SAMPLES}, n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM samples WINDOW w AS (PARTITION BY usr, side ORDER BY pos))"""


@query(f"""{_PEAKS}, l AS (SELECT *, last_value(CASE WHEN b IS NULL OR (value <= b AND value < a) THEN value END IGNORE NULLS) OVER (PARTITION BY usr, side ORDER BY pos ROWS UNBOUNDED PRECEDING) AS base FROM n),
r AS (SELECT *, CASE WHEN value > b AND value >= a THEN value - base END AS rise FROM l),
k AS (SELECT *, rise >= 0.1 * max(rise) OVER (PARTITION BY usr, side) AS keep FROM r)
SELECT usr, side, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS number_of_peaks, coalesce(sum(CASE WHEN keep THEN value END), 0) AS peaks_amplitude FROM k GROUP BY ALL""", "peaks_amplitude", "number_of_peaks")
def feat_peaks(spark, sf):
    return features.skin_peaks(fx.positions(spark, sf), SIDE)


@query(f"""WITH {SAMPLES}, r AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM samples WINDOW w AS (PARTITION BY usr, side ORDER BY pos)),
k AS (SELECT usr, side, pos, value FROM r x WHERE value > b AND (SELECT arg_min(z.value, z.pos) FROM samples z WHERE z.usr = x.usr AND z.side = x.side AND z.pos > x.pos AND z.value <> x.value) < value),
g AS (SELECT k.usr, k.side, k.pos, any_value(k.value) AS height, max(CASE WHEN z.pos < k.pos AND z.value > k.value THEN z.pos END) AS l, min(CASE WHEN z.pos > k.pos AND z.value > k.value THEN z.pos END) AS h FROM k JOIN samples z USING (usr, side) GROUP BY ALL),
m AS (SELECT g.usr, g.side, g.pos, any_value(height) AS height, any_value(height) - greatest(min(CASE WHEN z.pos <= g.pos THEN z.value END), min(CASE WHEN z.pos >= g.pos THEN z.value END)) AS prominence
  FROM g JOIN samples z ON g.usr = z.usr AND g.side = z.side AND z.pos > coalesce(l, -1) AND z.pos < coalesce(h, 1000000000) GROUP BY ALL)
SELECT usr, side, pos, height, prominence FROM m""", "height prominence")
def peaks_by_prominence(spark, sf):
    return peaks.prominences(fx.positions(spark, sf), SIDE)


@query(f"""WITH p AS ({{0}}), m AS (SELECT *, max(prominence) OVER (PARTITION BY usr, side) AS most FROM p), {SAMPLES}
SELECT s.usr, s.side, coalesce(n, 0) AS number_of_peaks, coalesce(total, 0) AS peaks_amplitude FROM (SELECT DISTINCT usr, side FROM samples) s LEFT JOIN (SELECT usr, side, count(*) AS n, sum(height) AS total FROM m WHERE prominence >= 0.1 * most GROUP BY ALL) q USING (usr, side)""".replace("{0}", _sql["peaks_by_prominence"].replace("round(height, 6) + 0.0", "height").replace("round(prominence, 6) + 0.0", "prominence")), "peaks_amplitude", "number_of_peaks")
def feat_prominent_peaks(spark, sf):
    return peaks.prominent_peaks(fx.positions(spark, sf), SIDE)


@query(f"""{_PEAKS}, g AS (SELECT usr, side, pos, value, (pos - lag(pos) OVER w) * 1000.0 / 64 AS nn FROM n WHERE value > b AND value >= a WINDOW w AS (PARTITION BY usr, side ORDER BY pos)),
h AS (SELECT *, nn - lag(nn) OVER (PARTITION BY usr, side ORDER BY pos) AS dd FROM g),
f AS (SELECT usr, side, count(*) AS n, max(value) AS hi, min(value) AS lo, avg(nn) AS mean_nn, stddev_samp(nn) AS sdnn, sqrt(avg(dd * dd)) AS rmssd, stddev_samp(dd) AS sdsd, (sum(60000.0 / nn) + 60000.0 / avg(nn)) / (count(nn) + 1) AS hr FROM h GROUP BY ALL),
z AS (SELECT usr, side, count(*) AS len FROM samples GROUP BY ALL)
SELECT usr, side, coalesce(n, 0) AS number_of_peaks, coalesce(n, 0) / len AS peaks_ratio, coalesce(hi, 0) AS highest_peak, coalesce(lo, 0) AS lowest_peak, coalesce(CASE WHEN n > 1 THEN hr END, 0) AS mean_hr,
  coalesce(CASE WHEN n > 1 THEN mean_nn END, 0) AS mean_nn, coalesce(CASE WHEN n > 1 THEN sdnn END, 0) AS sdnn, coalesce(CASE WHEN n > 1 THEN rmssd END, 0) AS rmssd, coalesce(CASE WHEN n > 1 THEN sdsd END, 0) AS sdsd FROM z LEFT JOIN f USING (usr, side)""",
       "peaks_ratio highest_peak lowest_peak mean_hr mean_nn sdnn rmssd sdsd", "number_of_peaks")
def feat_hrv(spark, sf):
    return features.pulse_peaks(fx.positions(spark, sf), SIDE, 64.0)


@query(f"{_SEG}, m AS (SELECT {_BY}, avg(value) AS m FROM seg GROUP BY ALL) SELECT usr, side, segment_id, max(CASE WHEN component = 'mixed' THEN m END) AS mean_mixed, max(CASE WHEN component = 'log' THEN m END) AS mean_log FROM m GROUP BY ALL", "mean_mixed mean_log")
def feat_flatten(spark, sf):
    f = features.flatten(features.basic(fx.segment_samples(spark, sf), KEYS), SEG, "component", ["mixed", "log"], ["mean_feat"])
    return f.select(*SEG, F.col("x")[0].alias("mean_mixed"), F.col("x")[1].alias("mean_log"))


# --- statistics

_Z = "1.959963984540054"


def _tail(z: str) -> str:
    """P(N > z) by Simpson's rule."""
    return f"(0.5 - {z} / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow({z} * i / 400.0, 2)))))"


def _t_tail(t: str, df: str) -> str:
    """P(|T| > |t|) by Simpson's rule over the angle atan(t / sqrt(df))."""
    top = f"atan(abs({t}) / sqrt({df}))"
    return f"(1 - 2 / sqrt(pi()) * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) * {top} / 1200 * list_sum(list_transform(range(0, 401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos({top} * i / 400.0), {df} - 1))))"


@query(f"""WITH {PAIRED}, c AS (SELECT grp, cls, corr(left_v, right_v) AS r, count(*) AS n FROM paired GROUP BY ALL)
SELECT grp, cls, r, n, tanh(atanh(r) - {_Z} / sqrt(n - 3)) AS ci_low, tanh(atanh(r) + {_Z} / sqrt(n - 3)) AS ci_high, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM c""", "r ci_low ci_high t")
def pearson_ci(spark, sf):
    return stats.pearson(fx.paired(spark, sf), ["grp", "cls"], "left_v", "right_v")


@query(f"WITH {PAIRED}, c AS (SELECT grp, corr(left_v, CASE WHEN cls = 'O' THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM paired GROUP BY grp) SELECT grp, n, r * sqrt(n - 2) / sqrt(CASE WHEN abs(r) < 1 THEN 1 - r * r END) AS t FROM c", "t")
def corr_t(spark, sf):
    p = fx.paired(spark, sf).withColumn("y", F.when(F.col("cls") == "O", 1.0).otherwise(0.0))
    return stats.pearson(p, ["grp"], "left_v", "y").select("grp", "n", "t")


_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0"


@query(f"WITH {PAIRED}, r AS (SELECT grp, {_RANK.format(k='grp', v='left_v')} AS a, {_RANK.format(k='grp', v='right_v')} AS b FROM paired) SELECT grp, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY grp", "rho")
def spearman(spark, sf):
    return stats.spearman(fx.paired(spark, sf), ["grp"], "left_v", "right_v")


_KENDALL = f"""WITH {SAMPLES}, {_PAIRS}, s AS (SELECT a.usr, sum(sign(b.left_value - a.left_value) * sign(b.right_value - a.right_value)) / 2 AS s, sum(abs(sign(b.left_value - a.left_value))) / 2 AS ux, sum(abs(sign(b.right_value - a.right_value))) / 2 AS uy FROM p a JOIN p b ON a.usr = b.usr GROUP BY a.usr),
k AS (SELECT usr, s / sqrt(nullif(ux * uy, 0)) AS tau, n FROM s JOIN (SELECT usr, count(*) AS n FROM p GROUP BY usr) c USING (usr))"""


@query(f"{_KENDALL} SELECT usr, tau, n FROM k", "tau")
def kendall(spark, sf):
    return stats.kendall(_pairs(spark, sf), ["usr"], "left_value", "right_value")


_WILCOXON = f"""WITH {SAMPLES}, {_PAIRS}, d AS (SELECT usr, left_value - right_value AS d FROM p WHERE left_value <> right_value), r AS (SELECT usr, d, {_RANK.format(k='usr', v='abs(d)')} AS r FROM d),
t AS (SELECT usr, sum(k * k * k - k) AS ties FROM (SELECT usr, abs(d), count(*)::DOUBLE AS k FROM d GROUP BY ALL) q GROUP BY usr),
w AS (SELECT usr, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, count(*) AS n FROM r GROUP BY usr),
wz AS (SELECT usr, w, n, (w - n * (n + 1) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM w JOIN t USING (usr))"""


@query(f"{_WILCOXON} SELECT * FROM wz", "w z")
def wilcoxon(spark, sf):
    return stats.wilcoxon(_pairs(spark, sf), ["usr"], "left_value", "right_value")


_CLIFF = f"""WITH {PAIRED}, a AS (SELECT grp, left_v AS v FROM paired WHERE cls = 'F'), b AS (SELECT grp, left_v AS v FROM paired WHERE cls = 'O'),
ca AS (SELECT grp, v, count(*)::DOUBLE AS c FROM a GROUP BY ALL), cb AS (SELECT grp, v, count(*)::DOUBLE AS c FROM b GROUP BY ALL),
mn AS (SELECT grp, (SELECT count(*) FROM a WHERE a.grp = g.grp)::DOUBLE AS m, (SELECT count(*) FROM b WHERE b.grp = g.grp)::DOUBLE AS n FROM (SELECT DISTINCT grp FROM paired) g),
x AS (SELECT ca.grp, ca.v, ca.c, sum(cb.c * sign(ca.v - cb.v)) AS s, sum(CASE WHEN ca.v = cb.v THEN cb.c ELSE 0 END) AS tie FROM ca JOIN cb ON ca.grp = cb.grp GROUP BY ALL),
y AS (SELECT cb.grp, cb.v, cb.c, sum(ca.c * sign(ca.v - cb.v)) AS s FROM ca JOIN cb ON ca.grp = cb.grp GROUP BY ALL),
d AS (SELECT grp, m, n, (SELECT sum(c * s) FROM x WHERE x.grp = mn.grp) / (m * n) AS delta FROM mn WHERE m > 0 AND n > 0),
v AS (SELECT d.*, (n * n * (SELECT sum(c * pow(s / n - delta, 2)) FROM x WHERE x.grp = d.grp) + m * m * (SELECT sum(c * pow(s / m - delta, 2)) FROM y WHERE y.grp = d.grp)
  - (m * n - (SELECT sum(c * tie) FROM x WHERE x.grp = d.grp) - m * n * delta * delta)) / (m * n * (m - 1) * (n - 1)) AS s2 FROM d),
ci AS (SELECT grp, delta, (delta - pow(delta, 3) - {_Z} * sqrt(greatest(s2, 0)) * sqrt(pow(1 - delta * delta, 2) + {_Z} * {_Z} * greatest(s2, 0))) / (1 - delta * delta + {_Z} * {_Z} * greatest(s2, 0)) AS lo,
  (delta - pow(delta, 3) + {_Z} * sqrt(greatest(s2, 0)) * sqrt(pow(1 - delta * delta, 2) + {_Z} * {_Z} * greatest(s2, 0))) / (1 - delta * delta + {_Z} * {_Z} * greatest(s2, 0)) AS hi, m, n FROM v)"""


def _cliff(spark, sf):
    p = fx.paired(spark, sf)
    two = p.select("grp", F.when(F.col("cls") == "F", F.col("left_v")).alias("a"), F.when(F.col("cls") == "O", F.col("left_v")).alias("b"))
    return stats.cliff_delta(two, ["grp"], "a", "b")


@query(f"{_CLIFF} SELECT grp, delta, greatest(-1, lo) AS ci_low, least(1, hi) AS ci_high, CAST(m AS BIGINT) AS n_left, CAST(n AS BIGINT) AS n_right FROM ci", "delta ci_low ci_high")
def cliff_delta(spark, sf):
    return _cliff(spark, sf)


@query(f"{_CLIFF} SELECT grp, sign(delta) * CASE WHEN abs(delta) < 0.11 THEN 0 WHEN abs(delta) < 0.28 THEN 1 WHEN abs(delta) < 0.43 THEN 2 ELSE 3 END AS bin FROM ci", longs="bin")
def cliff_bins(spark, sf):
    return _cliff(spark, sf).select("grp", stats.effect_bin("delta").alias("bin"))


_CLASSES = f"""WITH {EFFECTS}, w AS (SELECT component, feature, max(value) FILTER (cls = 'negative') AS negative, max(value) FILTER (cls = 'positive') AS positive, max(ci_high) FILTER (cls = 'negative') AS nh, max(ci_high) FILTER (cls = 'positive') AS ph FROM effects GROUP BY ALL),
z AS (SELECT component, feature, (negative - positive) / sqrt(pow((negative - nh) / 1.96, 2) + pow((positive - ph) / 1.96, 2)) AS z, CASE WHEN abs(negative) > abs(positive) THEN 'negative' ELSE 'positive' END AS larger FROM w WHERE negative IS NOT NULL AND positive IS NOT NULL)"""


def _classes(spark, sf):
    return stats.compare_classes(sources.class_effects(fx.effects(spark, sf)), ["component", "feature"])


@query(f"{_CLASSES} SELECT * FROM z", "z")
def welch_z(spark, sf):
    return _classes(spark, sf)


_HOLM = f"""{_CLASSES}, p AS (SELECT component, feature, larger, least(1.0, 2 * {_tail('abs(z)')}) AS p FROM z), r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY component) - row_number() OVER (PARTITION BY component ORDER BY p, feature) + 1) * p) AS raw FROM p),
h AS (SELECT component, feature, larger, p, max(raw) OVER (PARTITION BY component ORDER BY p, feature ROWS UNBOUNDED PRECEDING) AS p_holm FROM r)"""


@query(f"{_HOLM} SELECT component, feature, larger, p, p_holm FROM h", "p p_holm", name="holm")
def holm_correction(spark, sf):
    p = stats.with_normal_p(_classes(spark, sf)).select("component", "feature", "larger", "p")
    return holm(p, "p", ["component"], "feature")


@query(f"{_HOLM} SELECT component, avg(CASE WHEN p_holm < 0.05 AND larger = 'negative' THEN 1.0 ELSE 0.0 END) AS negative_larger, avg(CASE WHEN p_holm < 0.05 AND larger = 'positive' THEN 1.0 ELSE 0.0 END) AS positive_larger, avg(CASE WHEN p_holm < 0.05 THEN 0.0 ELSE 1.0 END) AS no_difference FROM h GROUP BY component", "negative_larger positive_larger no_difference")
def class_shares(spark, sf):
    return stats.class_shares(holm_correction(spark, sf).withColumn("reject", F.col("p_holm") < 0.05), ["component"])


@query(f"WITH {EFFECTS} SELECT component, feature, max(value) FILTER (cls = 'negative') AS negative, max(value) FILTER (cls = 'positive') AS positive FROM effects GROUP BY ALL", "negative positive")
def pivot_classes(spark, sf):
    return summary.by_class(fx.effects(spark, sf))


@query(f"WITH {EFFECTS} SELECT component, feature, cls, value, abs(value - ci_low) AS below, abs(ci_high - value) AS above FROM effects", "value below above")
def error_bars(spark, sf):
    return summary.error_bars(fx.effects(spark, sf), ["component", "feature", "cls"])


@query(f"""WITH {SCORES}, d AS (SELECT x.model AS a, y.model AS b, avg(x.value - y.value) AS m, var_samp(x.value - y.value) AS s2, count(*) AS n FROM scores x JOIN scores y ON x.fold_id = y.fold_id AND x.seed_id = y.seed_id AND x.model < y.model GROUP BY ALL)
SELECT a, b, m / sqrt((1.0 / n + 0.25) * s2) AS t, n - 1 + 4.0 AS df, n FROM d""", "t df")
def kfold_corrected_t(spark, sf):
    return stats.corrected_kfold_t(fx.scores(spark, sf), ["model"], ["fold_id", "seed_id"], "value", 4.0, 1.0)


_TWO = """WITH g AS (SELECT event_type AS k, avg(value) AS m, var_samp(value) AS v, count(value) AS n FROM events GROUP BY ALL),
two AS (SELECT a.k AS a, b.k AS b, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t, (a.n + b.n - 2)::DOUBLE AS df FROM g a JOIN g b ON a.k < b.k)"""


@query(f"{_TWO} SELECT * FROM two", "t df")
def two_sample_t(spark, sf):
    return stats.two_sample_t(fx.table(spark, sf, "events"), "event_type", "value")


@query(f"{_TWO} SELECT *, {_t_tail('t', 'df')} AS p FROM two", "t df p")
def two_sample_p(spark, sf):
    from ..functions.columns import t_two_sided

    return stats.two_sample_t(fx.table(spark, sf, "events"), "event_type", "value").withColumn("p", t_two_sided("t", "df"))


@query(f"{_WILCOXON} SELECT *, least(1.0, 2 * {_tail('abs(z)')}) AS p FROM wz", "w z p")
def wilcoxon_p(spark, sf):
    return stats.with_normal_p(stats.wilcoxon(_pairs(spark, sf), ["usr"], "left_value", "right_value"))


@query(f"""WITH {SAMPLES}, y AS (SELECT usr, side, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS y, count(*) OVER w AS n FROM samples WINDOW w AS (PARTITION BY usr, side)),
t AS (SELECT usr, side, n, (2 * i - 1) * ln(greatest(1 - q, 1e-300)) + (2 * n + 1 - 2 * i) * ln(greatest(q, 1e-300)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY usr, side ORDER BY y) AS i, {_tail('y')} AS q FROM y) u),
a AS (SELECT usr, side, count(*) AS n, -count(*) - sum(t) / count(*) AS a2 FROM t GROUP BY ALL)
SELECT usr, side, a2, a2 * (1 + 0.75 / n + 2.25 / (n * n)) AS a2_star, n FROM a""", "a2 a2_star")
def normality(spark, sf):
    return stats.anderson_darling(fx.positions(spark, sf), SIDE, "value")


# --- time series


def _series(spark, sf):
    return _pairs(spark, sf).select("usr", "pos", F.col("left_value").alias("x"), F.col("right_value").alias("y"))


_LAGGED = f"""WITH {SAMPLES}, {_PAIRS}, c AS (SELECT usr, row_number() OVER (PARTITION BY usr ORDER BY pos) - 1 AS pos, left_value - avg(left_value) OVER (PARTITION BY usr) AS x, right_value - avg(right_value) OVER (PARTITION BY usr) AS y FROM p),
l AS (SELECT a.usr, k AS lag, a.pos, a.x, b.y FROM c a CROSS JOIN range(4) r(k) JOIN c b ON a.usr = b.usr AND b.pos = a.pos + k)"""


@query(f"""{_LAGGED} SELECT usr, lag, sum(l.x * l.y) / nullif(sqrt(any_value(xx) * any_value(yy)), 0) AS value FROM l JOIN (SELECT usr, sum(x * x) AS xx, sum(y * y) AS yy FROM c GROUP BY usr) s USING (usr) GROUP BY usr, lag""", "value")
def xcorr_lags(spark, sf):
    return lagcorr.cross_correlation(_series(spark, sf), ["usr"], 4)


_DCCA = f"""{_LAGGED}, boxes AS (SELECT o.usr, o.lag, o.pos AS p0, i.pos - o.pos - 4.5 AS t, i.x, i.y FROM l o JOIN l i ON o.usr = i.usr AND o.lag = i.lag AND i.pos BETWEEN o.pos AND o.pos + 9),
s AS (SELECT usr, lag, p0, count(*) AS k, regr_slope(x, t) AS bx, regr_intercept(x, t) AS ax, regr_slope(y, t) AS b_y, regr_intercept(y, t) AS a_y FROM boxes GROUP BY ALL HAVING count(*) = 10),
r AS (SELECT usr, lag, p0, sum((x - ax - bx * t) * (y - a_y - b_y * t)) AS xy, sum(pow(x - ax - bx * t, 2)) AS xx, sum(pow(y - a_y - b_y * t, 2)) AS yy FROM boxes JOIN s USING (usr, lag, p0) GROUP BY ALL),
v AS (SELECT usr, lag, sum(xy) / sqrt(sum(xx) * sum(yy)) AS value, count(*) AS n_boxes FROM r GROUP BY ALL)"""


@query(f"{_DCCA} SELECT * FROM v", "value")
def dcca_lags(spark, sf):
    return lagcorr.detrended(_series(spark, sf), ["usr"], 4, 9)


@query(f"{_DCCA} SELECT usr, max(value) AS value, arg_max(lag, value) AS lag FROM v GROUP BY usr", "value")
def dcca_max(spark, sf):
    return lagcorr.max_over_lags(lagcorr.detrended(_series(spark, sf), ["usr"], 4, 9), ["usr"])


@query(f"{_DCCA}, m AS (SELECT usr, max(value) AS value FROM v GROUP BY usr) SELECT usr % 2 AS event, avg(CASE WHEN value > 0.4 THEN 1.0 ELSE 0.0 END) AS share_above, avg(value) AS mean_value, count(*) AS n FROM m GROUP BY usr % 2", "share_above mean_value")
def dcca_summary(spark, sf):
    return lagcorr.event_summary(dcca_max(spark, sf).withColumn("event", F.col("usr") % 2), ["event"])


@query(f"""WITH {SAMPLES}, e AS (SELECT usr, side, pos, value - avg(value) OVER (PARTITION BY usr, side) AS e FROM samples), c AS (SELECT *, sum(e) OVER (PARTITION BY usr, side ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM e),
g AS (SELECT usr, side, count(*) AS n, sum(s * s) AS ss, sum(e * e) AS g0, CAST(floor(4 * pow(count(*) / 100.0, 0.25)) AS BIGINT) AS lags FROM c GROUP BY ALL),
a AS (SELECT x.usr, x.side, x.pos - z.pos AS k, sum(x.e * z.e) AS cov FROM e x JOIN e z ON x.usr = z.usr AND x.side = z.side AND x.pos > z.pos AND x.pos - z.pos <= 24 GROUP BY ALL),
b AS (SELECT usr, side, coalesce(sum(2 * (1 - k / (lags + 1.0)) * cov), 0) AS cov FROM g LEFT JOIN a USING (usr, side) WHERE k <= lags GROUP BY ALL)
SELECT usr, side, ss / n / n / nullif((g0 + coalesce(cov, 0)) / n, 0) AS kpss, lags, n FROM g LEFT JOIN b USING (usr, side)""", "kpss", "lags")
def kpss_stat(spark, sf):
    return stationarity.kpss(fx.positions(spark, sf), SIDE)


@query(name="stationarity")
def stationarity_all(spark, sf):
    return stationarity.stationarity(fx.positions(spark, sf), SIDE)


@query(f"""WITH RECURSIVE {SAMPLES}, {_PAIRS}, s AS (SELECT usr, list(left_value::DOUBLE ORDER BY pos) AS x, list(right_value::DOUBLE ORDER BY pos) AS y FROM p GROUP BY usr),
r AS (SELECT usr, x, y, 0 AS i, list_prepend(0.0::DOUBLE, list_transform(y, lambda v: 'inf'::DOUBLE)) AS d FROM s
  UNION ALL SELECT usr, x, y, i + 1, list_reduce(list_prepend(['inf'::DOUBLE], list_transform(range(1, len(y) + 1), lambda j: [abs(x[i + 1] - y[j]), least(d[j + 1], d[j])])), lambda a, v: a || [v[1] + least(a[len(a)], v[2])]) FROM r WHERE i < len(x))
SELECT usr, d[len(d)] / greatest(len(x), len(y)) AS distance, greatest(len(x), len(y)) AS n FROM r WHERE i = len(x)""", "distance", "n")
def dtw(spark, sf):
    return warping.dtw(_series(spark, sf), ["usr"])


@query()
def dtw_coarse_to_fine(spark, sf):
    return warping.dtw(_series(spark, sf), ["usr"], radius=1)


@query()
def wavelet(spark, sf):
    return features.wavelet_features(fx.positions(spark, sf), SIDE)


# --- resampling and splits

_MD5 = "md5('7:' || {})"


@query(f"""WITH {FEAT}, m AS (SELECT grp, min(c) AS m, count(*) AS k FROM (SELECT grp, y, count(*) AS c FROM feat GROUP BY ALL) q GROUP BY grp)
SELECT id, grp, y FROM feat JOIN m USING (grp) WHERE k > 1 QUALIFY row_number() OVER (PARTITION BY grp, y ORDER BY {_MD5.format('id')}, id) <= any_value(m) OVER (PARTITION BY grp)""", longs="y")
def undersample(spark, sf):
    return sampling.undersample(fx.feat(spark, sf).select("id", "grp", "y"), "grp", "y", "id", 7).select("id", "grp", "y")


@query(f"WITH {FEAT} SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY {_MD5.format('id')}, id) - 1) % 5 AS fold FROM feat", longs="y fold")
def stratified_folds(spark, sf):
    return sampling.stratified_folds(fx.feat(spark, sf).select("id", "y"), "y", "id", 5, 7)


@query(f"""WITH {FEAT}, o AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY {_MD5.format('id')}, id) - 1) % 5 AS fold FROM feat)
SELECT id, y, fold, (row_number() OVER (PARTITION BY fold, y ORDER BY md5('8:' || id), id) - 1) % 3 AS inner_fold FROM o""", longs="y fold inner_fold")
def nested_folds(spark, sf):
    outer = sampling.stratified_folds(fx.feat(spark, sf).select("id", "y"), "y", "id", 5, 7)
    return sampling.stratified_folds(outer, "y", "id", 3, 8, "inner_fold", ["fold"])


@query(f"WITH {FEAT} SELECT u.grp AS held_out, CASE WHEN f.grp = u.grp THEN 'test' ELSE 'train' END AS part, y, count(*) AS n FROM feat f, (SELECT DISTINCT grp FROM feat) u GROUP BY ALL", longs="y")
def loso_splits(spark, sf):
    return sampling.leave_one_out_counts(fx.feat(spark, sf).select("id", "grp", "y"), "grp", "y")


@query(f"WITH {FEAT} SELECT a AS train_side, b AS test_side, part, count(*) AS n FROM feat, (VALUES ('right', 'right'), ('left', 'left'), ('right', 'left'), ('left', 'right')) s(a, b), (VALUES ('train'), ('test')) p(part) WHERE side = CASE WHEN part = 'train' THEN a ELSE b END GROUP BY ALL")
def cross_side_splits(spark, sf):
    return sampling.cross_side(fx.feat(spark, sf).select("id", "side"), "side").groupBy("train_side", "test_side", "part").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT DISTINCT user_id % 4 AS generator FROM events), s AS (SELECT generator, i AS seed_id, ('0x' || substr(md5(generator || ':' || i), 1, 7))::BIGINT AS seed FROM g, range(5) r(i))
SELECT a.seed_id AS fold_seed_id, b.seed_id AS sample_seed_id, c.seed_id AS model_seed_id, a.seed AS fold_seed, b.seed AS sample_seed, c.seed AS model_seed
FROM s a, s b, s c WHERE a.generator = 0 AND b.generator = 1 AND c.generator = 2""")
def seed_grid(spark, sf):
    s = sampling.seeds_of(fx.table(spark, sf, "events").select((F.col("user_id") % 4).alias("generator")).distinct(), 5)
    role = lambda g, name: s.where(F.col("generator") == g).select(F.col("seed_id").alias(f"{name}_seed_id"), F.col("seed").alias(f"{name}_seed"))
    return sampling.seed_grid(role(0, "fold"), role(1, "sample"), role(2, "model"))


@query(f"""WITH {FEAT} SELECT id, y, -x[1]::DOUBLE AS x0, -x[64]::DOUBLE AS x63 FROM feat QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5('1:' || id), id) <= floor(0.5 * count(*) OVER (PARTITION BY y))""", "x0 x63", "y")
def augment_flip(spark, sf):
    a = sampling.augment(fx.feat(spark, sf), "flip", 0.5, "y", "id")
    return a.select("id", "y", F.col("x")[0].alias("x0"), F.col("x")[63].alias("x63"))


@query()
def augment_all(spark, sf):
    f = fx.feat(spark, sf).select("id", "y", "x")
    out = None
    for m in ("jitter", "scale", "smooth"):
        one = sampling.augment(f, m, 0.3, "y", "id").select("id", F.lit(m).alias("method"), F.col("x")[0].alias("x0"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total"))
        out = one if out is None else out.union(one)
    return out


# --- model scores

_PRED = "pr AS (SELECT user_id % 4 AS fold_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN value > 50 THEN 1 ELSE 0 END AS prediction FROM events)"


@query(f"""WITH {_PRED}, c AS (SELECT fold_id, label, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS recall FROM pr GROUP BY ALL),
a AS (SELECT fold_id, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, 2.0 * sum(label * prediction) / nullif(sum(label) + sum(prediction), 0) AS f1 FROM pr GROUP BY fold_id)
SELECT fold_id, (SELECT avg(recall) FROM c WHERE c.fold_id = a.fold_id) AS balanced_accuracy, accuracy, f1 FROM a""", "balanced_accuracy accuracy f1")
def balanced_accuracy(spark, sf):
    p = fx.table(spark, sf, "events").select((F.col("user_id") % 4).alias("fold_id"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("label"), F.when(F.col("value") > 50, 1).otherwise(0).alias("prediction"))
    return summary.balanced_accuracy(p, ["fold_id"])


_FOLDS = f"WITH {SCORES}, f AS (SELECT model, seed_id, avg(value) AS avg, stddev_samp(value) / sqrt(count(*)) AS sem, stddev_pop(value) AS sd, stddev_pop(value) / sqrt(count(*)) AS se_pop, count(*) AS n_folds FROM scores GROUP BY ALL)"


def _folds(spark, sf):
    return summary.fold_summary(fx.scores(spark, sf), ["model", "seed_id"])


@query(f"{_FOLDS} SELECT * FROM f", "avg sem sd se_pop")
def fold_summary(spark, sf):
    return _folds(spark, sf)


@query(f"{_FOLDS} SELECT model, avg(avg) AS avg, sqrt(sum(sem * sem)) / count(*) AS std_err, count(*) AS n_seeds FROM f GROUP BY model", "avg std_err")
def seed_summary(spark, sf):
    return summary.seed_summary(_folds(spark, sf), ["model"])


@query(f"{_FOLDS} SELECT seed_id, model, avg AS best, m AS mean_of_models FROM (SELECT *, avg(avg) OVER (PARTITION BY seed_id) AS m, row_number() OVER (PARTITION BY seed_id ORDER BY avg DESC, model) AS r FROM f WHERE model <> 'error') q WHERE r = 1", "best mean_of_models")
def best_model(spark, sf):
    return summary.best_model(summary.without_dummy(_folds(spark, sf), dummy="error"), ["seed_id"])


_IMP = "imp AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, user_id % 40 AS feature, avg(value) AS importance FROM events GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY importance DESC, feature) AS rank FROM imp)"


def _ranked(spark, sf):
    e = fx.table(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("side"), (F.col("user_id") % 40).alias("feature"), F.col("value").alias("importance"))
    return summary.feature_rank(summary.mean_importance(e, ["side", "feature"]), ["side"])


@query(f"WITH {_IMP} SELECT * FROM rk", "importance", "rank")
def feature_rank(spark, sf):
    return _ranked(spark, sf)


@query(f"WITH {_IMP} SELECT * FROM rk WHERE rank <= floor(25 * 0.01 * (SELECT count(*) FROM imp i WHERE i.side = rk.side))", "importance", "rank")
def topk_features(spark, sf):
    return summary.top_features(_ranked(spark, sf), ["side"], 25)


@query()
def nested_cv_gbt(spark, sf):
    return models.nested_cv(fx.feat(spark, sf), n_points=20, seed_triples=models.seed_triples(1))


@query()
def nested_opposite_side_gbt(spark, sf):
    return models.nested_opposite_side(fx.feat(spark, sf), n_points=20, seed_triples=models.seed_triples(1))


@query()
def nested_loso_gbt(spark, sf):
    return models.nested_loso(fx.feat(spark, sf), "left", "right", n_points=20, seed_triples=models.seed_triples(1))


@query()
def loso_gbt(spark, sf):
    return summary.balanced_accuracy(models.loso(fx.feat(spark, sf), "GBT"), ["held_out"])


@query()
def kfold_battery(spark, sf):
    return models.kfold_battery(fx.feat(spark, sf), 3)


@query(f"""WITH {SAMPLES} SELECT component, feature, count(*) AS n FROM (SELECT usr, CAST(floor(pos / 4) AS BIGINT) AS s, side FROM samples GROUP BY ALL HAVING count(*) = 4) g
CROSS JOIN (VALUES ('mixed'), ('log')) c(component) CROSS JOIN (VALUES ('min_feat'), ('max_feat'), ('mean_feat'), ('std_feat'), ('slope_feat')) f(feature)
WHERE side = 'left' AND (usr, s) IN (SELECT usr, CAST(floor(pos / 4) AS BIGINT) FROM samples WHERE side = 'right' GROUP BY ALL HAVING count(*) = 4) GROUP BY ALL""")
def left_right_features(spark, sf):
    return flagship(spark, sf).select("component", "feature", "n")


from . import coverage  # noqa: E402, F401  registers further queries
