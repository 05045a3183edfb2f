"""Keyed state over logs of updates: activity, job status, sessions and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_activity(log: DataFrame) -> DataFrame:
    """(key, last_seen) of a log (key, ts)."""
    return log.groupBy("key").agg(F.max("ts").alias("last_seen"))


def _idle(log: DataFrame, hours: int) -> DataFrame:
    """last_activity with ``now``, the log's last time, of the keys that are idle for more than so many hours."""
    now = log.agg(F.max("ts").alias("now"))
    seen = last_activity(log).join(F.broadcast(now))  # one row
    return seen.where(F.col("now") - F.col("last_seen") > F.expr(f"INTERVAL {int(hours)} HOURS"))


def inactive(log: DataFrame, hours: int = 3) -> DataFrame:
    return _idle(log, hours).select("key", "last_seen")


def next_cleanup(log: DataFrame, hours: int = 3) -> DataFrame:
    """The one key that is idle longest beyond the timeout."""
    return _idle(log, hours).orderBy("last_seen", "key").limit(1).select("key", "last_seen")


def cleanup_order(log: DataFrame, failures: DataFrame, hours: int = 3) -> DataFrame:
    """(key, last_seen, failures, turn): idle keys in the order in which they are cleaned up, those that failed least often
    first, so that a key that keeps failing doesn't hold up the others.  failures: key, failures."""
    idle = inactive(log, hours).join(failures.select("key", "failures"), "key", "left").fillna(0, ["failures"])
    # idle keys are the repositories of one service; they are ordered in one task
    return idle.withColumn("turn", F.row_number().over(Window.orderBy("failures", "last_seen", "key")))


def after_cleanup(failures: DataFrame, results: DataFrame) -> DataFrame:
    """(key, failures) after results (key, removed): a key that was removed, or wasn't there (null), has none any more; one
    that couldn't be removed has one more; others keep theirs."""
    both = failures.select("key", "failures").join(results.groupBy("key").agg(F.max(F.coalesce("removed", F.lit(True))).alias("removed")), "key", "full")
    n = F.coalesce("failures", F.lit(0)) + F.when(~F.col("removed"), 1).otherwise(0)
    return both.where("removed is null or not removed").select("key", n.cast("long").alias("failures")).where("failures > 0")


def sessions(log: DataFrame, gap: str = "3 hours") -> DataFrame:
    """(key, started, n): visits of a key, apart by at least the gap."""
    return log.groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("started"), "n")


def latest_status(updates: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """(key, fields): the last value that isn't null of each field; progress is kept within 0 to 100."""
    place = F.struct(*order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))
    out = updates.groupBy("key").agg(*(last(c).alias(c) for c in fields))
    return out.withColumn("progress", F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress")))) if "progress" in fields else out


def wipe(keys: DataFrame, prefix: str) -> DataFrame:
    """(key, removed): whether a session's key belongs to the prefix."""
    return keys.select("key", F.col("key").startswith(prefix).alias("removed"))


def tail(history: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return history.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("back") <= n).drop("back")


def transcript(history: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """(key, text): "Role: text" lines of each key's last n rows."""
    line: Column = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.expr("substring(role, 2)")), F.lit(": "), F.col("text"))
    rows = tail(history, key, order, n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda r: r.line), "\n").alias("text"))


def activity_report(log: DataFrame) -> DataFrame:
    """One row: keys, rows, and the first and last time in ISO form."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return log.agg(F.countDistinct("key").alias("n_keys"), F.count("*").alias("n_rows"), iso(F.min("ts")).alias("first_seen"), iso(F.max("ts")).alias("last_seen"))
