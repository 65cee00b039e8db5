"""Users, sessions and names: projections, filters and set operations on the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: codes of the recordings' annotations
INTENSITY = {"low": 0, "medium": 1, "high": 2}
EVENT_GROUPS = {
    "baseline": ["baseline_1", "baseline_2", "baseline_3", "baseline_4", "baseline_5"],
    "cognitive_load": ["cognitive_load"],
    "fake_laughter": ["fake"],
    "clapping_hands": ["clapping_hands"],
    "funny_videos": ["baby", "people_car", "stand_up_comedy", "himym", "cat", "penguins", "man", "bbt", "people_falling"],
}


def clock(samples: DataFrame, recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ts = start_ts + pos / fs_hz from the table of recordings (one row for each of keys)."""
    after = F.expr("make_dt_interval(0, 0, 0, cast(pos / fs_hz as decimal(18,6)))")
    return samples.join(recordings, keys).withColumn("ts", F.col("start_ts") + after).drop("start_ts", "fs_hz")


def zoned(seconds: str, zone: str = "Europe/Rome") -> Column:
    """Wall-clock time in a zone of unix seconds."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({seconds} as decimal(18,6)))"))


def fix_session_name(name: str) -> Column:
    """Date of a session named yymmdd-HHMM..: recordings begun from ten o'clock on belong to the next day."""
    day = F.to_date(F.substring(name, 1, 6), "yyMMdd")
    return F.date_add(day, F.when(F.substring(name, 8, 1) == "0", 0).otherwise(1))


def unique_names(df: DataFrame, name: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds the suffixes _0, _1, .. to names that occur more than once for the keys."""
    part = W.partitionBy(*keys, name)
    place = F.row_number().over(part.orderBy(*order)) - 1
    return df.withColumn(name, F.when(F.count("*").over(part) > 1, F.concat_ws("_", F.col(name).cast("string"), place.cast("string"))).otherwise(F.col(name).cast("string")))


def map_codes(column: str, codes: dict) -> Column:
    """The code of each value, NULL for values without one."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.create_map(*pairs)[F.col(column)]


def event_groups(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds the group of each event (inner join with a small fixed table)."""
    rows = [(e, g) for g, es in (groups or EVENT_GROUPS).items() for e in es]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, "event string, grp string")), "event")


def split_key(column: str, mark: str, names: list[str]) -> list[Column]:
    """Parts of a composite key such as group%event or user_event; the last part keeps further marks."""
    parts = F.split(F.col(column), f"[{mark}]", len(names))
    return [parts[i].alias(n) for i, n in enumerate(names)]


def event_names(wide: DataFrame) -> list[str]:
    """Events of a wide table, from its columns start_<event> and end_<event>."""
    return sorted({c.split("_", 1)[1] for c in wide.columns if c.startswith(("start_", "end_"))})


def swap_orientation(df: DataFrame, rows: str, columns: str, value: str, names: list | None = None) -> DataFrame:
    """One row for each of ``columns`` and one column for each of ``rows`` (long form in, pivot out)."""
    return df.groupBy(columns).pivot(rows, names).agg(F.first(value))


def only(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows of the chosen components (or signals, or sides)."""
    return df.where(F.col(column).isin(*values))


def flagged(df: DataFrame, flag: str = "artefact") -> DataFrame:
    """Rows that are marked."""
    return df.where(F.col(flag).cast("int") == 1)


def filter_users(df: DataFrame, users: DataFrame, user: str = "usr") -> DataFrame:
    """Rows of users that are not named."""
    return df.join(users.select(user).distinct(), user, "left_anti")


def sessions_in_info(df: DataFrame, info: DataFrame, keys=("usr", "session"), side: str = "side", all_sessions: bool = False) -> DataFrame:
    """Rows of sessions that the experiment info knows. Sessions recorded on one side only are
    not checked unless ``all_sessions``."""
    keys = list(keys)
    known = info.select(*keys).distinct()
    if all_sessions:
        return df.join(known, keys, "left_semi")
    one_sided = df.groupBy(*keys).agg(F.min(side).alias("_a"), F.max(side).alias("_b")).where("_a = _b").select(*keys)
    return df.join(known.union(one_sided).distinct(), keys, "left_semi")


def removed_sessions(df: DataFrame, kept: DataFrame, keys=("usr", "session")) -> DataFrame:
    """How many sessions a filter removed, by user (a count for every user that lost one)."""
    gone = df.select(*keys).distinct().join(kept.select(*keys).distinct(), list(keys), "left_anti")
    return gone.groupBy(keys[0]).agg(F.count("*").alias("removed"))


def emptied_users(before: DataFrame, kept: DataFrame, user: str = "usr") -> DataFrame:
    """Users that a filter left without sessions."""
    return before.select(user).distinct().join(kept.select(user).distinct(), user, "left_anti")


def correct_times(info: DataFrame, start: str = "actual_bed_time", end: str = "wake_up_time") -> DataFrame:
    return info.where(F.col(start) < F.col(end))


def first_rows(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def complete_rows(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Long rows of those keys whose components are all present (NULL or NaN in one drops the others)."""
    missing = F.max((F.col(value).isNull() | F.isnan(value)).cast("int")).over(W.partitionBy(*keys))
    return df.withColumn("_m", missing).where("_m = 0").drop("_m")


def enough_rows(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups with more than ``least`` rows."""
    return df.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where(F.col("_n") > least).drop("_n")


def common_keys(df: DataFrame, keys: list[str], side: str = "side", sides=("left", "right")) -> DataFrame:
    """Keys that occur on both sides."""
    a, b = (df.where(F.col(side) == s).select(*keys) for s in sides)
    return a.intersect(b)


def with_laughter(events: DataFrame, groups: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (usr, event, start_ts, end_ts) and their grouping (event, grp) with the laughter episodes of ``laughter_events``."""
    more = episodes.select("usr", "event", "start_ts", "end_ts")
    laugh = episodes.select("event", F.lit("laughter_episodes").alias("grp")).distinct()
    return events.select("usr", "event", "start_ts", "end_ts").unionByName(more), groups.unionByName(laugh)


def laughter_events(episodes: DataFrame) -> DataFrame:
    """Laughter episodes (key user_event, start_ts, end_ts, intensity) with some intensity as events."""
    code = map_codes("intensity", INTENSITY)
    return episodes.where(code > 0).select(*split_key("key", "_", ["usr", "event"]), "start_ts", "end_ts", code.alias("intensity"))
