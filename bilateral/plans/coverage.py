"""Further queries: keys, names, filters, missing events, p-values, feature sets and stored scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import QUANTILE_CENTRE, QUANTILE_FAR, QUANTILE_TAIL, epoch
from ..operators import align, exact, features, filters, keys, lagcorr, neighbours, sampling, segments, stationarity, stats, summary, unitroot
from ..sources import recordings as sources
from . import fixtures as fx
from .catalog import (
    _BY, _CLIFF, _DCCA, _FOLDS, _KENDALL, _LABELS, _PAIRS, _RANK, _SEG, _SESSIONS, _WILCOXON, _Z, KEYS, SEG, SIDE, _folds, _labelled, _pairs, _series, _sessions, _sql, _t_tail, _tail, flagship, query,
)
from .fixtures import FEAT, INTERVALS, PAIRED, SAMPLES, SCORES

# --- names, keys and filters


@query("SELECT event_id, CAST(epoch((to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'Europe/Rome')) AS BIGINT) AS wall FROM events")
def zoned_times(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", epoch("ts").alias("t"))
    return e.select("event_id", keys.zoned("t").alias("w")).select("event_id", epoch("w").alias("wall"))


@query(f"{_SEG} SELECT usr, side, count(*) AS n, avg(value) AS mean_value FROM seg WHERE component = 'log' GROUP BY ALL", "mean_value")
def component_rows(spark, sf):
    return keys.only(fx.segment_samples(spark, sf), "component", ["log"]).groupBy(*SIDE).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query(f"WITH {SAMPLES} SELECT usr, side, pos, value FROM samples WHERE event_type = 'error'", "value")
def flagged_rows(spark, sf):
    s = fx.positions(spark, sf).withColumn("artefact", (F.col("event_type") == "error").cast("int"))
    return keys.flagged(s).select("usr", "side", "pos", "value")


@query(f"""WITH {SAMPLES}, s AS (SELECT usr, side, pos, CASE WHEN usr % 3 = 0 OR pos % 7 = 3 THEN NULL ELSE value END AS v FROM samples),
k AS (SELECT usr, side, pos, v, avg(v) OVER (PARTITION BY usr, side ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS f FROM s WHERE v IS NOT NULL)
SELECT usr, side, pos, v AS value, quantile_cont(v, 0.5) OVER (PARTITION BY usr, side ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS value_filt FROM k UNION ALL SELECT usr, side, pos, NULL, NULL FROM s WHERE usr % 3 = 0""", "value value_filt")
def filtered_column(spark, sf):
    """The running median as value_filt: missing samples drop out, users without any value come back as they are."""
    s = fx.positions(spark, sf).withColumn("value", F.when((F.col("usr") % 3 != 0) & (F.col("pos") % 7 != 3), F.col("value")))
    median = lambda d, by, value, name: filters.tonic_phasic(d, by, 4, value=value).withColumnRenamed("tonic", name)
    return filters.apply_filter(s, SIDE, median).select("usr", "side", "pos", "value", "value_filt")


@query("SELECT user_id % 3 AS k, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error FROM events GROUP BY ALL", "click error")
def swapped_orientation(spark, sf):
    long = fx.table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 3).alias("k")).agg(F.avg("value").alias("value"))
    return keys.swap_orientation(long, "event_type", "k", "value", ["click", "error"])


@query("SELECT CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 END AS code, count(*) AS n FROM events GROUP BY ALL", longs="code")
def mapped_codes(spark, sf):
    return fx.table(spark, sf, "events").groupBy(keys.map_codes("event_type", {"error": 2, "click": 1}).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT user_id::VARCHAR AS usr, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def split_keys(spark, sf):
    e = fx.table(spark, sf, "events").select(F.concat_ws("%", "user_id", "event_type").alias("key"))
    return e.select(*keys.split_key("key", "%", ["usr", "event"])).groupBy("usr", "event").agg(F.count("*").alias("n"))


@query(f"WITH {INTERVALS} SELECT event, count(*) AS n FROM intervals, (VALUES ('baseline_1'), ('cognitive_load')) e(event) GROUP BY ALL")
def event_list(spark, sf):
    wide = fx.intervals(spark, sf).drop("actual_bed_time", "wake_up_time")
    names = keys.event_names(wide)
    return keys.only(align.long_intervals(wide, ["usr"]), "event", names).groupBy("event").agg(F.count("*").alias("n"))


@query(f"WITH {INTERVALS} SELECT usr FROM intervals WHERE usr % 3 <> 0")
def correct_times(spark, sf):
    i = fx.intervals(spark, sf)
    late = F.col("usr") % 3 == 0  # their times are the wrong way round
    i = i.select("usr", F.when(late, F.col("wake_up_time")).otherwise(F.col("actual_bed_time")).alias("actual_bed_time"), F.when(late, F.col("actual_bed_time")).otherwise(F.col("wake_up_time")).alias("wake_up_time"))
    return keys.correct_times(i).select("usr")


@query(f"{_SESSIONS} SELECT DISTINCT usr FROM s WHERE usr NOT IN (SELECT usr FROM kept WHERE session < 1 AND usr % 2 = 0)")
def emptied_users(spark, sf):
    s, kept = _sessions(spark, sf)
    return keys.emptied_users(s, kept.where("session < 1 and usr % 2 = 0"))


_EPISODES = """ep AS (SELECT user_id AS usr, event_id AS event, ts AS start_ts, ts + INTERVAL 1 MINUTE AS end_ts, CASE WHEN value < 30 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END AS intensity FROM events WHERE event_type = 'error')"""


def _episodes(spark, sf):
    e = fx.table(spark, sf, "events").where("event_type = 'error'")
    level = F.when(F.col("value") < 30, "low").when(F.col("value") < 60, "medium").otherwise("high")
    raw = e.select(F.concat_ws("_", "user_id", "event_id").alias("key"), F.col("ts").alias("start_ts"), F.expr("ts + interval 1 minute").alias("end_ts"), level.alias("intensity"))
    return keys.laughter_events(raw)


@query(f"WITH {_EPISODES} SELECT usr::VARCHAR AS usr, event::VARCHAR AS event, CAST(floor(epoch(start_ts)) AS BIGINT) AS a, CASE intensity WHEN 'medium' THEN 1 ELSE 2 END AS intensity FROM ep WHERE intensity <> 'low'", longs="intensity")
def laughter_events(spark, sf):
    return _episodes(spark, sf).select("usr", "event", epoch("start_ts").alias("a"), "intensity")


@query(f"""WITH {INTERVALS}, {_EPISODES} SELECT grp, count(*) AS n, count(DISTINCT usr) AS users FROM (SELECT usr, CASE event WHEN 'baseline_1' THEN 'baseline' ELSE event END AS grp FROM intervals, (VALUES ('baseline_1'), ('cognitive_load')) e(event)
  UNION ALL SELECT usr, 'laughter_episodes' FROM ep WHERE intensity <> 'low') q GROUP BY grp""")
def laughter_appended(spark, sf):
    """Events and their grouping with the laughter episodes; every event of the grouping is counted."""
    wide = align.long_intervals(fx.intervals(spark, sf).drop("actual_bed_time", "wake_up_time"), ["usr"]).withColumn("usr", F.col("usr").cast("string"))
    groups = keys.event_groups(wide).select("event", "grp").distinct()
    events, groups = keys.with_laughter(wide, groups, _episodes(spark, sf))
    return events.join(groups, "event").groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("usr").alias("users"))


@query(f"{_SEG} SELECT usr, side, segment_id, pos, component, value FROM seg WHERE pos % 5 <> 0", "value")
def complete_rows(spark, sf):
    s = fx.segment_samples(spark, sf).withColumn("value", F.when((F.col("pos") % 5 == 0) & (F.col("component") == "log"), F.lit(None).cast("double")).otherwise(F.col("value")))
    return keys.complete_rows(s, [*SEG, "pos"]).select(*SEG, "pos", "component", "value")


@query(f"WITH {SAMPLES} SELECT usr, side, count(*) AS n FROM samples GROUP BY ALL HAVING count(*) > 30")
def enough_rows(spark, sf):
    return keys.enough_rows(fx.positions(spark, sf), SIDE, 30).groupBy(*SIDE).agg(F.count("*").alias("n"))


@query(f"{_LABELS} SELECT side, label, count(*) AS n, avg(value) AS mean_value FROM m1 JOIN samples USING (usr, side) WHERE CAST(floor(pos / 4) AS BIGINT) = segment_id AND label IS NOT NULL GROUP BY ALL", "mean_value", "label")
def samples_by_label(spark, sf):
    lab = _labelled(spark, sf).where("label is not null").select("usr", "side", "segment_id", "label")
    s = segments.assign(fx.positions(spark, sf), 4)
    return s.join(lab, SEG).groupBy("side", "label").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


# --- joins and alignment


@query(f"""WITH {SAMPLES}, {INTERVALS}, one AS (SELECT usr, start_baseline_1 AS a, end_baseline_1 AS b FROM intervals WHERE usr % 4 <> 0), got AS (SELECT s.usr, s.side, s.pos FROM samples s JOIN one ON s.usr = one.usr AND ts BETWEEN a AND b)
SELECT u.usr, side, pos FROM (SELECT DISTINCT usr FROM samples) u LEFT JOIN got USING (usr)""")
def event_or_null(spark, sf):
    events = align.long_intervals(fx.intervals(spark, sf), ["usr"]).where("usr % 4 <> 0")
    return align.slice_event(fx.samples(spark, sf), events, ["usr"], "baseline_1").select("usr", "side", "pos")


@query(f"{_SEG} SELECT usr, side, segment_id, pos, max(CASE WHEN component = 'mixed' THEN value END) AS mixed, max(CASE WHEN component = 'log' THEN value END) AS log FROM seg GROUP BY ALL", "mixed log")
def wide_components(spark, sf):
    return align.wide_components(fx.segment_samples(spark, sf), [*SEG, "pos"], "component", ["mixed", "log"])


@query(f"WITH {SAMPLES} SELECT usr, side, CAST(floor(pos / 4) AS BIGINT) AS segment_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS artefact FROM samples GROUP BY ALL HAVING count(*) = 4", longs="artefact")
def segment_artefacts(spark, sf):
    s = fx.samples(spark, sf).withColumn("artefact", (F.col("event_type") == "error").cast("int"))
    return segments.fixed_segments(s, SIDE, 4).select(*SEG, "artefact")


@query(f"WITH {SAMPLES} SELECT DISTINCT usr, segment_id FROM (SELECT usr, side, CAST(floor(pos / 4) AS BIGINT) AS segment_id FROM samples GROUP BY ALL HAVING count(*) <> 4) q")
def bad_segments(spark, sf):
    return segments.bad_segments(segments.fixed_segments(fx.samples(spark, sf), SIDE, 4, full=False), 4, ["usr"])


@query(f"WITH {SAMPLES} SELECT 's' || CAST(floor(pos / 20) AS BIGINT) AS session, usr, side, pos, CASE WHEN pos < 20 THEN value END AS value, CASE WHEN pos >= 20 THEN value END AS raw FROM samples WHERE pos < 40", "value raw")
def concatenated_sessions(spark, sf):
    s = fx.positions(spark, sf).select("usr", "side", "pos", "value")
    return summary.stack({"s0": s.where("pos < 20"), "s1": s.where("pos >= 20 and pos < 40").withColumnRenamed("value", "raw")}, "session")


@query(f"""WITH {SAMPLES}, t AS (SELECT usr, ts, count(*) AS n, min(side) AS side FROM samples GROUP BY ALL), l AS (SELECT usr, CASE WHEN count(*) FILTER (side = 'left') > count(*) FILTER (side = 'right') THEN 'left' ELSE 'right' END AS longer, count(*) FILTER (side = 'left') AS a, count(*) FILTER (side = 'right') AS b FROM samples GROUP BY usr)
SELECT t.usr, CAST(epoch(ts) AS BIGINT) AS t FROM t JOIN l USING (usr) WHERE n = 1 AND side = longer AND a <> b""")
def longer_side_only(spark, sf):
    s = fx.samples(spark, sf)
    sizes = s.groupBy("usr").pivot("side", ["left", "right"]).count().na.fill(0).where("left <> right").select("usr", F.when(F.col("left") > F.col("right"), "left").otherwise("right").alias("longer"))
    marked = s.join(sizes, "usr")
    more, less = (marked.where(c).select("usr", "ts") for c in ("side = longer", "side <> longer"))
    return more.join(less, ["usr", "ts"], "left_anti").select("usr", epoch("ts").alias("t"))


# --- statistics


@query(f"WITH {SAMPLES}, {_PAIRS} SELECT usr, (left_value + right_value) / 2 AS pair_mean, left_value - right_value AS difference FROM p", "pair_mean difference", places=9)
def agreement_points(spark, sf):
    return stats.agreement_points(_pairs(spark, sf), ["usr"], "left_value", "right_value")


@query(f"{_FOLDS} SELECT model, how, avg(avg) AS avg, CASE how WHEN 'sem' THEN stddev_samp(avg) ELSE stddev_pop(avg) END / sqrt(count(*)) AS std_err, count(*) AS n_seeds FROM f, (VALUES ('sem'), ('sd')) h(how) GROUP BY model, how", "avg std_err")
def opposite_error(spark, sf):
    return summary.stack({how: summary.opposite_error(_folds(spark, sf), ["model"], how) for how in ("sem", "sd")}, "how")


_CORR = f"""WITH {SAMPLES}, {_PAIRS}, c AS (SELECT usr, corr(left_value, right_value) AS r, count(*) AS n FROM p GROUP BY usr HAVING count(*) > 3)"""
_RHO = f"""WITH {SAMPLES}, {_PAIRS}, q AS (SELECT usr, {_RANK.format(k='usr', v='left_value')} AS a, {_RANK.format(k='usr', v='right_value')} AS b FROM p), c AS (SELECT usr, corr(a, b) AS r, count(*) AS n FROM q GROUP BY usr)"""
_T = "r * sqrt(n - 2) / sqrt(1 - r * r)"


@query(f"""{_CORR}, t AS (SELECT usr, n, {_T} AS t FROM c), p2 AS (SELECT usr, n, t, {_t_tail('t', '(n - 2.0)')} AS p FROM t), raw AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, usr) + 1) * p) AS raw FROM p2)
SELECT usr, n, t, p, max(raw) OVER (ORDER BY p, usr ROWS UNBOUNDED PRECEDING) AS p_holm FROM raw""", "t p p_holm")
def correlation_p(spark, sf):
    got = stats.pearson(_pairs(spark, sf), ["usr"], "left_value", "right_value").where("n > 3").select("usr", "n", "t")
    return stats.with_t_p(got, keys=[], tie="usr")


@query(f"{_RHO} SELECT usr, r AS rho, n, {_t_tail(f'({_T})', '(n - 2.0)')} AS p FROM c WHERE n > 3", "rho p")
def spearman_p(spark, sf):
    return stats.with_spearman_p(stats.spearman(_pairs(spark, sf), ["usr"], "left_value", "right_value")).where("n > 3")


@query(f"{_KENDALL} SELECT usr, tau, n, least(1.0, 2 * {_tail('abs(tau / sqrt(2 * (2.0 * n + 5) / (9.0 * n * (n - 1))))')}) AS p FROM k WHERE n > 3", "tau p")
def kendall_p(spark, sf):
    return stats.with_kendall_p(stats.kendall(_pairs(spark, sf), ["usr"], "left_value", "right_value")).where("n > 3")


@query(f"""WITH {SCORES}, d AS (SELECT x.model AS a, y.model AS b, avg(x.value - y.value) AS m, var_samp(x.value - y.value) AS s2, count(*) AS n FROM scores x JOIN scores y ON x.fold_id = y.fold_id AND x.seed_id = y.seed_id AND x.model < y.model GROUP BY ALL),
t AS (SELECT a, b, m / sqrt((1.0 / n + 0.25) * s2) AS t, n + 3.0 AS df, n FROM d), p AS (SELECT *, {_t_tail('t', 'df')} AS p FROM t), raw AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, a) + 1) * p) AS raw FROM p)
SELECT a, b, t, df, n, p, max(raw) OVER (ORDER BY p, a ROWS UNBOUNDED PRECEDING) AS p_holm FROM raw""", "t df p p_holm")
def kfold_p(spark, sf):
    return stats.with_kfold_p(stats.corrected_kfold_t(fx.scores(spark, sf), ["model"], ["fold_id", "seed_id"], "value", 4.0, 1.0))


@query(f"""WITH RECURSIVE {_KENDALL.removeprefix("WITH ")}, z AS (SELECT usr, n, s.s, (SELECT count(*) FROM (SELECT left_value FROM p WHERE p.usr = s.usr GROUP BY ALL HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT right_value FROM p WHERE p.usr = s.usr GROUP BY ALL HAVING count(*) > 1)) AS tied, tau FROM s JOIN k USING (usr)),
f AS (SELECT 1::BIGINT AS n, [1.0::DOUBLE] AS c, 1.0::DOUBLE AS orders UNION ALL SELECT n + 1, list_transform(range(0, n * (n + 1) // 2 + 1), lambda k: list_sum(c[greatest(1, k - n + 1):k + 1])), orders * (n + 1) FROM f WHERE n < 33),
e AS (SELECT z.*, CASE WHEN tied = 0 AND z.n <= 33 AND z.n > 1 THEN (z.n * (z.n - 1) / 2 - abs(s)) / 2 END AS low FROM z),
v AS (SELECT a.usr, a.tx, a.x0, a.x1, b.ty, b.y0, b.y1 FROM (SELECT usr, sum(t * (t - 1) / 2) AS tx, sum(t * (t - 1) * (t - 2)) AS x0, sum(t * (t - 1) * (2 * t + 5)) AS x1 FROM (SELECT usr, left_value, count(*)::DOUBLE AS t FROM p GROUP BY ALL) q GROUP BY usr) a
  JOIN (SELECT usr, sum(t * (t - 1) / 2) AS ty, sum(t * (t - 1) * (t - 2)) AS y0, sum(t * (t - 1) * (2 * t + 5)) AS y1 FROM (SELECT usr, right_value, count(*)::DOUBLE AS t FROM p GROUP BY ALL) q GROUP BY usr) b USING (usr)),
w AS (SELECT e.*, CASE WHEN tau IS NOT NULL THEN abs(s) / sqrt((e.n * (e.n - 1.0) * (2 * e.n + 5) - x1 - y1) / 18 + 2 * tx * ty / (e.n * (e.n - 1.0)) + coalesce(x0 * y0 / nullif(9.0 * e.n * (e.n - 1) * (e.n - 2), 0), 0)) END AS z FROM e JOIN v USING (usr))
SELECT usr, tau, w.n, CASE WHEN low IS NULL THEN least(1.0, 2 * {_tail('z')}) WHEN s = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(c[1:(low + 1)::BIGINT]) / orders) END AS p, CASE WHEN low IS NULL THEN 'normal' ELSE 'exact' END AS method FROM w LEFT JOIN f ON f.n = w.n WHERE w.n > 1""", "tau p")
def kendall_test(spark, sf):
    return exact.kendall_test(_pairs(spark, sf), ["usr"], "left_value", "right_value").where("n > 1")


@query(f"""WITH RECURSIVE {_WILCOXON.removeprefix("WITH ")}, f AS (SELECT 0::BIGINT AS n, [1.0::DOUBLE] AS c UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda w: coalesce(c[w + 1], 0) + CASE WHEN w > n THEN coalesce(c[w - n], 0) ELSE 0 END) FROM f WHERE n < 50),
o AS (SELECT usr, count(*) FILTER (left_value = right_value) AS zeros FROM p GROUP BY usr), e AS (SELECT wz.*, CASE WHEN ties = 0 AND zeros = 0 AND n <= 50 THEN w END AS low FROM wz JOIN t USING (usr) JOIN o USING (usr))
SELECT usr, w, e.n, least(1.0, CASE WHEN low IS NULL THEN 2 * {_tail('abs(z)')} ELSE 2 * list_sum(c[1:low::BIGINT + 1]) / pow(2, e.n) END) AS p, CASE WHEN low IS NULL THEN 'normal' ELSE 'exact' END AS method FROM e LEFT JOIN f ON f.n = e.n""", "w p")
def wilcoxon_test(spark, sf):
    return exact.wilcoxon_test(_pairs(spark, sf), ["usr"], "left_value", "right_value")


def _sql_poly(c) -> str:
    return "(" * (len(c) - 1) + repr(c[0]) + "".join(f" * x + {v!r}::DOUBLE)" for v in c[1:])


_CENTRE, _FAR, _FARTHER = (f"(({_sql_poly(a)}) / ({_sql_poly(b)}))" for a, b in (QUANTILE_CENTRE, QUANTILE_TAIL, QUANTILE_FAR))
_QUANTILE = f"(SELECT CASE WHEN abs(q) <= 0.425 THEN q * (SELECT {_CENTRE} FROM (SELECT 0.180625 - q * q AS x)) WHEN r <= 5 THEN sign(q) * (SELECT {_FAR} FROM (SELECT r - 1.6 AS x)) ELSE sign(q) * (SELECT {_FARTHER} FROM (SELECT r - 5 AS x)) END)"


@query(f"""WITH {SAMPLES}, o AS (SELECT usr, side, value - avg(value) OVER w AS d, row_number() OVER (PARTITION BY usr, side ORDER BY value) AS i, count(*) OVER w AS n FROM samples WINDOW w AS (PARTITION BY usr, side)),
g AS (SELECT *, (i - 0.375) / (n + 0.25) - 0.5 AS q, sqrt(-ln(least((i - 0.375) / (n + 0.25), 1 - (i - 0.375) / (n + 0.25)))) AS r FROM o WHERE n >= 3), m AS (SELECT *, {_QUANTILE} AS m FROM g),
s AS (SELECT usr, side, n, sqrt(1.0 / n) AS u, sum(m * m) AS mm, max(m) AS mn, max(CASE WHEN i = n - 1 THEN m END) AS mp, sum(d * d) AS ss FROM m GROUP BY ALL),
a AS (SELECT *, mn / sqrt(mm) + 0.221157 * u - 0.147981 * u * u - 2.071190 * pow(u, 3) + 4.434685 * pow(u, 4) - 2.706056 * pow(u, 5) AS a1, mp / sqrt(mm) + 0.042981 * u - 0.293762 * u * u - 1.752461 * pow(u, 3) + 5.682633 * pow(u, 4) - 3.582633 * pow(u, 5) AS a2 FROM s),
f AS (SELECT *, CASE WHEN n > 5 THEN (mm - 2 * mn * mn - 2 * mp * mp) / (1 - 2 * a1 * a1 - 2 * a2 * a2) ELSE (mm - 2 * mn * mn) / (1 - 2 * a1 * a1) END AS phi FROM a),
c AS (SELECT usr, side, f.n, pow(sum(d * CASE WHEN f.n = 3 THEN (i - 2) * sqrt(0.5) WHEN i = f.n THEN a1 WHEN i = 1 THEN -a1 WHEN f.n > 5 AND i = f.n - 1 THEN a2 WHEN f.n > 5 AND i = 2 THEN -a2 ELSE m / sqrt(phi) END), 2) / any_value(ss) AS w FROM m JOIN f USING (usr, side) GROUP BY ALL),
y AS (SELECT *, ln(1 - w) AS y, ln(n) AS l FROM c WHERE w < 1),
z AS (SELECT *, CASE WHEN n <= 11 THEN (-ln(-2.273 + 0.459 * n - y) - (0.5440 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * pow(n, 3))) / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * pow(n, 3))
  ELSE (y - (-1.5861 - 0.31082 * l - 0.083751 * l * l + 0.0038915 * pow(l, 3))) / exp(-0.4803 - 0.082676 * l + 0.0030302 * l * l) END AS z FROM y)
SELECT usr, side, n, w, CASE WHEN n = 3 THEN greatest(0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75)))) WHEN z >= 0 THEN {_tail('z')} ELSE 1 - {_tail('(-z)')} END AS p FROM z""", "w p", "n")
def shapiro_wilk(spark, sf):
    return stats.shapiro_wilk(fx.positions(spark, sf), SIDE, "value").where("w < 1")


_KPSS_P = "CASE WHEN kpss <= 0.347 THEN 0.10 WHEN kpss <= 0.463 THEN 0.10 + (0.05 - 0.10) * (kpss - 0.347) / 0.116 WHEN kpss <= 0.574 THEN 0.05 + (0.025 - 0.05) * (kpss - 0.463) / 0.111 WHEN kpss <= 0.739 THEN 0.025 + (0.01 - 0.025) * (kpss - 0.574) / 0.165 WHEN kpss IS NOT NULL THEN 0.01 END"
_KPSS = _sql["kpss_stat"].replace("round(kpss, 6) + 0.0 AS kpss", "kpss AS kpss")


def _kpss(spark, sf):
    got = stationarity.kpss(fx.positions(spark, sf), SIDE)
    return got.select(*SIDE, F.lit("kpss").alias("method"), F.col("kpss").alias("statistic"))


@query(f"SELECT usr, side, 'kpss' AS method, kpss AS statistic, {_KPSS_P} AS p FROM ({_KPSS}) k", "statistic p")
def kpss_p(spark, sf):
    return stationarity.with_p(_kpss(spark, sf))


@query(f"SELECT usr, side, 'kpss' AS method, kpss AS statistic, 1 - {_KPSS_P} AS p FROM ({_KPSS}) k", "statistic p")
def kpss_inverted_p(spark, sf):
    return stationarity.with_p(_kpss(spark, sf), invert=True)


@query(f"""WITH {SAMPLES}, e AS (SELECT usr, side, pos, value - avg(value) OVER w AS e, count(*) OVER w AS n FROM samples WINDOW w AS (PARTITION BY usr, side)),
c AS (SELECT a.usr, a.side, a.n, a.pos - b.pos AS lag, sum(a.e * b.e) / any_value(a.n) AS c FROM e a JOIN e b ON a.usr = b.usr AND a.side = b.side AND b.pos <= a.pos GROUP BY a.usr, a.side, a.n, a.pos - b.pos),
h AS (SELECT usr, side, n, sum(CASE WHEN lag = 0 THEN c WHEN lag <= floor(pow(n, 2.0 / 9) + 1e-12) THEN 2 * c ELSE 0 END) AS s0, sum(CASE WHEN lag <= floor(pow(n, 2.0 / 9) + 1e-12) THEN 2 * lag * c ELSE 0 END) AS s1 FROM c GROUP BY ALL),
l AS (SELECT usr, side, n, least(n - 1, floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3) + 1e-9))::BIGINT AS lags FROM h WHERE s0 > 0),
v AS (SELECT usr, side, n, lags, sum(CASE WHEN lag = 0 THEN c WHEN lag <= lags THEN 2 * (1 - lag / (lags + 1.0)) * c ELSE 0 END) AS lam FROM c JOIN l USING (usr, side, n) GROUP BY ALL),
s AS (SELECT usr, side, sum(s * s) AS ss FROM (SELECT usr, side, sum(e) OVER (PARTITION BY usr, side ORDER BY pos) AS s FROM e) q GROUP BY ALL)
SELECT usr, side, ss / (n * n) / nullif(lam, 0) AS kpss, lags, n FROM v JOIN s USING (usr, side)""", "kpss", "lags n")
def kpss_auto(spark, sf):
    return unitroot.kpss_auto(fx.positions(spark, sf), SIDE)


@query()
def stationarity_p(spark, sf):
    return stationarity.with_p(stationarity.stationarity(fx.positions(spark, sf), SIDE))


_EVENT_DCCA = _DCCA.replace("p AS (SELECT l.usr, l.pos,", "p AS (SELECT l.usr * 2 + CASE WHEN l.pos < 22 THEN 0 ELSE 1 END AS usr, l.pos,", 1)


@query(f"{_EVENT_DCCA} SELECT usr // 2 AS usr, CASE WHEN usr % 2 = 0 THEN 'first' ELSE 'rest' END AS event, max(value) AS value, arg_max(lag, value) AS lag FROM v GROUP BY ALL", "value")
def dcca_events(spark, sf):
    s = _series(spark, sf).withColumn("event", F.when(F.col("pos") < 22, "first").otherwise("rest"))
    return lagcorr.max_over_lags(lagcorr.detrended(s, ["usr", "event"], 4, 9), ["usr", "event"])


_DCCA_ALL = _DCCA.replace("range(4)", "range(64)").replace("o.pos + 9", "o.pos + 20").replace("o.pos - 4.5", "o.pos - 10").replace("count(*) = 10", "count(*) = 21")


@query(f"{_DCCA_ALL} SELECT usr, max(value) AS value, arg_max(lag, value) AS lag FROM v WHERE value IS NOT NULL GROUP BY usr", "value")
def dcca_all_lags(spark, sf):
    """64 lags of boxes of 20 samples."""
    return lagcorr.max_over_lags(lagcorr.detrended(_series(spark, sf), ["usr"], 64, 20), ["usr"])


# --- splits and scores


@query(f"""WITH {FEAT}, u AS (SELECT DISTINCT grp FROM feat) SELECT u.grp AS held_out, part, y, count(*) AS n FROM feat f, u, (VALUES ('train'), ('test')) p(part)
WHERE CASE WHEN part = 'train' THEN f.grp <> u.grp AND side = 'left' ELSE f.grp = u.grp AND side = 'right' END GROUP BY ALL""", longs="y")
def loso_across_sides(spark, sf):
    return sampling.leave_one_out_counts(fx.feat(spark, sf).select("id", "grp", "y", "side"), "grp", "y", "side", "left", "right")


@query("""WITH e AS (SELECT user_id % 4 AS fold_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS label, value FROM events), r AS (SELECT *, rank() OVER (PARTITION BY fold_id ORDER BY value) + (count(*) OVER (PARTITION BY fold_id, value) - 1) / 2.0 AS r FROM e)
SELECT fold_id, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS roc_auc FROM r GROUP BY fold_id""", "roc_auc")
def roc_auc(spark, sf):
    e = fx.table(spark, sf, "events").select((F.col("user_id") % 4).alias("fold_id"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("label"), "value")
    return summary.roc_auc(e, ["fold_id"], "value")


@query(f"WITH {SCORES} SELECT model AS side, seed_id, fold_id, value FROM scores", "value")
def stored_score_keys(spark, sf):
    s = fx.scores(spark, sf)
    return sources.parse_score_keys(s.select(F.concat_ws("_", "model", "seed_id", "fold_id").alias("key"), "value"))


@query(f"WITH {FEAT}, s AS (SELECT id, 'left-left' AS name, side FROM feat WHERE side = 'left' UNION ALL SELECT id, 'right-right', side FROM feat WHERE side = 'right') SELECT name, count(*) AS n FROM s GROUP BY name")
def stacked_sides(spark, sf):
    f = fx.feat(spark, sf).select("id", "side")
    return summary.stack({f"{s}-{s}": f.where(F.col("side") == s) for s in ("left", "right")}, "name").groupBy("name").agg(F.count("*").alias("n"))


@query(f"{_SEG}, b AS (SELECT {_BY}, avg(value) AS m FROM seg WHERE segment_id % 2 = 0 GROUP BY ALL) SELECT {_BY}, coalesce(m, 0) AS mean_feat FROM (SELECT DISTINCT {_BY} FROM seg) s LEFT JOIN b USING ({_BY})", "mean_feat")
def empty_segments(spark, sf):
    s = fx.segment_samples(spark, sf)
    f = features.basic(s.where("segment_id % 2 = 0"), KEYS).select(*KEYS, "mean_feat")
    return features.fill_empty(s.select(*KEYS).distinct(), f, KEYS)


# --- whole feature sets: the SQL joins that of their parts

_SEG_PEAKS = f"""SELECT {_BY}, CAST(number_of_peaks AS BIGINT) AS number_of_peaks, round(peaks_amplitude, 6) + 0.0 AS peaks_amplitude FROM ({_SEG}, n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM seg WINDOW w AS (PARTITION BY {_BY} ORDER BY pos)),
l AS (SELECT *, last_value(CASE WHEN b IS NULL OR (value <= b AND value < a) THEN value END IGNORE NULLS) OVER (PARTITION BY {_BY} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS base FROM n),
r AS (SELECT *, CASE WHEN value > b AND value >= a THEN value - base END AS rise FROM l), k AS (SELECT *, rise >= 0.1 * max(rise) OVER (PARTITION BY {_BY}) AS keep FROM r)
SELECT {_BY}, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS number_of_peaks, coalesce(sum(CASE WHEN keep THEN value END), 0) AS peaks_amplitude FROM k GROUP BY ALL) q"""


def _joined(by: str, *parts: str) -> str:
    return f"SELECT * FROM ({parts[0]}) p0" + "".join(f" JOIN ({p}) p{i} USING ({by})" for i, p in enumerate(parts[1:], 1))


def _whole(name: str) -> str:
    """The SQL of a segment query over all samples of a user's side."""
    return _sql[name].replace(_SEG, f"WITH {SAMPLES}").replace(_BY, "usr, side").replace("FROM seg", "FROM samples")


@query(_joined(_BY, _sql["feat_basic"], _sql["feat_slope"], _sql["feat_gradient"], _SEG_PEAKS, _sql["feat_entropy"], _sql["feat_dc_energy"]))
def feat_eda_all(spark, sf):
    return features.eda_features(fx.segment_samples(spark, sf), SEG)


_AREA = f"SELECT usr, side, round(auc_feat, 9) + 0.0 AS auc_feat FROM (WITH {SAMPLES}, t AS (SELECT *, (value + lag(value) OVER (PARTITION BY usr, side ORDER BY pos)) / 2 AS t FROM samples) SELECT usr, side, coalesce(sum(t), 0) / 64.0 AS auc_feat FROM t GROUP BY ALL) q"


@query(_joined("usr, side", _whole("feat_basic"), _whole("feat_slope"), _whole("feat_gradient"), _AREA, _sql["feat_hrv"]), nine="auc_feat")
def feat_ppg_all(spark, sf):
    return features.ppg_features(fx.positions(spark, sf), SIDE)


@query(_joined("usr, side", _whole("feat_basic"), _whole("feat_slope"), _whole("feat_second_gradient")))
def feat_acc_all(spark, sf):
    return features.acc_features(fx.positions(spark, sf), SIDE)


_FEATURES = ("min_feat", "max_feat", "mean_feat", "std_feat", "slope_feat")
_BOTH = f"""{_SEG}, f AS (SELECT {_BY}, min(value) AS min_feat, max(value) AS max_feat, avg(value) AS mean_feat, stddev_pop(value) AS std_feat, regr_slope(value, pos::DOUBLE) AS slope_feat FROM seg GROUP BY ALL),
g AS ({" UNION ALL ".join(f"SELECT {_BY}, '{n}' AS feature, round({n}, 9) AS v FROM f" for n in _FEATURES)}),
two AS (SELECT l.component, l.feature, l.v AS lv, r.v AS rv FROM g l JOIN g r ON l.usr = r.usr AND l.segment_id = r.segment_id AND l.component = r.component AND l.feature = r.feature AND l.side = 'left' AND r.side = 'right'),
paired AS (SELECT component || '|' || feature AS grp, 'F' AS cls, lv AS left_v FROM two UNION ALL SELECT component || '|' || feature, 'O', rv FROM two)"""


@query(f"""{_CLIFF.replace(f"WITH {PAIRED}", _BOTH, 1)}, c AS (SELECT component, feature, corr(lv, rv) AS r, count(*) AS n FROM two GROUP BY ALL)
SELECT component, feature, r, c.n, tanh(atanh(r) - {_Z} / sqrt(c.n - 3)) AS ci_low, tanh(atanh(r) + {_Z} / sqrt(c.n - 3)) AS ci_high, delta, greatest(-1, lo) AS delta_low, least(1, hi) AS delta_high FROM c JOIN ci ON grp = component || '|' || feature""",
       "r ci_low ci_high delta delta_low delta_high")
def left_right_effects(spark, sf):
    return flagship(spark, sf)


# --- neighbours and discriminants

_DEALT = f"WITH {FEAT}, f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('7:' || id), id) - 1) % 5 AS fold FROM feat)"


@query(f"""{_DEALT}, d AS (SELECT a.id, b.id AS other, b.y, sqrt(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: pow(a.x[i]::DOUBLE - b.x[i]::DOUBLE, 2)))) AS d FROM f a JOIN f b ON a.fold = 0 AND b.fold > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM d), k AS (SELECT * FROM n WHERE r <= 5)
SELECT id, any_value(v.y)::DOUBLE AS prediction, min(d) AS nearest, max(d) AS fifth, sum(other) AS others FROM k JOIN (SELECT id, arg_max(y, c * 1000 - y) AS y FROM (SELECT id, y, count(*) AS c FROM k GROUP BY ALL) q GROUP BY id) v USING (id) GROUP BY id""", "prediction nearest fifth", "others")
def nearest_neighbours(spark, sf):
    """The five nearest of the other folds for every row of the first, and their vote."""
    f = sampling.stratified_folds(fx.feat(spark, sf), "y", "id", 5, 7)
    near = neighbours.nearest(f.where("fold > 0"), f.where("fold = 0"))
    each = near.select("id", F.explode("near").alias("n")).groupBy("id").agg(F.min("n.distance").alias("nearest"), F.max("n.distance").alias("fifth"), F.sum("n.neighbour").alias("others"))
    return neighbours.vote(near).join(each, "id")


@query()
def discriminants(spark, sf):
    """Linear and quadratic discriminants of four folds on the fifth."""
    f = sampling.stratified_folds(fx.feat(spark, sf), "y", "id", 5, 7)
    train, test = f.where("fold > 0"), f.where("fold = 0")
    out = None
    for name, own in (("linear", False), ("quadratic", True)):
        one = neighbours.discriminant(train, test, own).join(test.select("id", "y"), "id").select("id", F.lit(name).alias("model"), F.col("y").alias("label"), "prediction")
        out = one if out is None else out.union(one)
    return out
