"""Queries over logs of updates: activity, jobs, sessions and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as U
from ..runtime import scratch
from ..streaming import activity as A
from ..streaming import order as O
from . import shared as S

_replayed: dict[tuple[str, str], object] = {}


def _log(spark, sf):
    return S.table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts")


def _updates(spark, sf):
    e = S.table(spark, sf, "events")
    ok = F.col("event_type") != "error"
    return e.select(F.col("user_id").alias("key"), "ts", "event_id", F.when(ok, F.col("event_type")).alias("stage"), F.when(ok, F.floor("value").cast("int")).alias("progress"))


def _history(spark, sf):
    return S.table(spark, sf, "conversations")


def _tail(n):
    return lambda spark, sf: U.transcript(_history(spark, sf), "conv_id", "turn", n)


def _events_tail(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return U.tail(e, "user_id", "event_id", 16)


def _failures(spark, sf):
    """Errors as failed cleanups."""
    return S.table(spark, sf, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("failures"))


def _results(spark, sf):
    """A cleanup's results by user: purchases as removed, sign-ups as failed, clicks as not there."""
    e = S.table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    return e.where("kind in ('purchase', 'signup', 'click')").select("key", F.when(F.col("kind") == "purchase", True).when(F.col("kind") == "signup", False).alias("removed"))


def _watched(spark, sf):
    """events as a stream that has ended, replayed once in an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _replayed:
        _replayed[key] = A.replay(spark, f"{sf}/events.parquet", [F.col("user_id").alias("key"), "ts"])
    return _replayed[key]


def _out_of_order(spark, sf):
    """All events as a log that arrives up to 90 minutes late in four parts, every third one twice; every fiftieth one comes
    when all others have.  Rows as put in order, and those too late for it."""
    e = S.table(spark, sf, "events").select("event_id", "user_id", "ts")
    delay = lambda seed: F.make_interval(secs=F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(5400)))
    held = F.col("event_id") % 50 == 0
    once = e.withColumn("at", F.col("ts") + delay(1))
    log = once.unionByName(once.where("event_id % 3 = 0").withColumn("at", F.col("ts") + delay(2)))
    lo, hi = log.agg(F.min("at"), F.max("at")).first()
    part = F.when(held, 4).otherwise(F.least(F.width_bucket(F.unix_seconds(F.col("at").cast("timestamp")).cast("double"), *(F.unix_seconds(F.lit(t).cast("timestamp")).cast("double") for t in (lo, hi)), F.lit(4)), F.lit(4)) - 1)
    folder, root, states = (scratch(spark, f"order-{x}") for x in ("log", "tables", "states"))
    sink = O.Ordered(root, "event_id")
    for k in range(5):
        log.where(part == k).select(*e.columns).write.mode("append").parquet(folder)
        O.arrive(spark, folder, e.schema, sink, states)
    released, late = sink.released(spark, e.schema, ended=True), sink.late_rows(spark, e.schema)
    return released.withColumn("late", F.lit(False)).unionByName(late.distinct().withColumn("late", F.lit(True)))


def _properties(spark, sf):
    """A property of every event, read from its JSON text: null where the text isn't JSON or lacks it."""
    v = S.table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    k = F.try_variant_get("v", "$.k", "long")
    return v.select("event_id", F.col("v").isNotNull().alias("valid"), k.alias("k"))


QUERIES = {
    "event_properties": _properties,
    "property_sums": lambda spark, sf: _properties(spark, sf).groupBy((F.col("k") % 10).alias("digit")).agg(F.count("*").alias("n"), F.sum("k").alias("total")),
    "stream_last_activity": lambda spark, sf: A.last_of(_watched(spark, sf)),
    "stream_inactive": lambda spark, sf: A.idle_of(_watched(spark, sf)),
    "stream_ordered": _out_of_order,
    "cleanup_order": lambda spark, sf: U.cleanup_order(_log(spark, sf), _failures(spark, sf)),
    "cleanup_failures": lambda spark, sf: U.after_cleanup(_failures(spark, sf), _results(spark, sf)),
    "last_activity": lambda spark, sf: U.last_activity(_log(spark, sf)),
    "inactive_users": lambda spark, sf: U.inactive(_log(spark, sf), 3),
    "next_cleanup": lambda spark, sf: U.next_cleanup(_log(spark, sf), 3),
    "activity_sessions": lambda spark, sf: U.sessions(_log(spark, sf)),
    "activity_report": lambda spark, sf: U.activity_report(_log(spark, sf)),
    "job_status_latest": lambda spark, sf: U.latest_status(_updates(spark, sf), ["ts", "event_id"], ["stage", "progress"]),
    "session_wipe": lambda spark, sf: U.wipe(_history(spark, sf).select(F.concat_ws(":", "conv_id", "role").alias("key")).distinct(), "1"),
    "session_wipe_counts": lambda spark, sf: U.wipe(_history(spark, sf).select(F.concat_ws(":", "conv_id", "role").alias("key")).distinct(), "1").groupBy("removed").agg(F.count("*").alias("n")),
    "history_tail8": _tail(8),
    "history_tail4": _tail(4),
    "history_cap16": _events_tail,
}

_TAIL = """SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text, chr(10) ORDER BY turn) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= {0} GROUP BY conv_id"""
_KEYS = "keys AS (SELECT DISTINCT conv_id || ':' || role AS key FROM conversations)"
_FAILED = "failed AS (SELECT user_id AS key, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY user_id)"
_PROPS = "props AS (SELECT event_id, coalesce(json_valid(props), false) AS valid, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)"
SQL = {
    "event_properties": f"WITH {_PROPS} SELECT event_id, valid, k FROM props",
    "property_sums": f"WITH {_PROPS} SELECT k % 10 AS digit, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM props GROUP BY 1",
    "stream_last_activity": "SELECT user_id AS key, max(ts) AS last_seen FROM events GROUP BY user_id",
    "stream_inactive": "SELECT user_id AS key, max(ts) AS last_seen FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 3 HOURS",
    "stream_ordered": "SELECT event_id, user_id, ts, event_id % 50 = 0 AND ts < (SELECT max(ts) - INTERVAL 2 HOURS FROM events WHERE event_id % 50 <> 0) AS late FROM events",
    "cleanup_order": f"""WITH {_FAILED}, idle AS (SELECT user_id AS key, max(ts) AS last_seen FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 3 HOURS)
      SELECT key, last_seen, coalesce(failures, 0) AS failures, CAST(row_number() OVER (ORDER BY coalesce(failures, 0), last_seen, key) AS INT) AS turn FROM idle LEFT JOIN failed USING (key)""",
    "cleanup_failures": f"""WITH {_FAILED}, kinds AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id), every AS (SELECT key, kind, coalesce(failures, 0) AS n FROM kinds LEFT JOIN failed USING (key))
      SELECT key, n + CASE WHEN kind = 'signup' THEN 1 ELSE 0 END AS failures FROM every WHERE kind NOT IN ('purchase', 'click') AND n + CASE WHEN kind = 'signup' THEN 1 ELSE 0 END > 0""",
    "last_activity": "SELECT user_id AS key, max(ts) AS last_seen FROM events GROUP BY user_id",
    "inactive_users": "SELECT user_id AS key, max(ts) AS last_seen FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 3 HOURS",
    "next_cleanup": "SELECT user_id AS key, max(ts) AS last_seen FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 3 HOURS ORDER BY last_seen, key LIMIT 1",
    "activity_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id AS key, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""",
    "activity_report": "SELECT count(DISTINCT user_id) AS n_keys, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_seen FROM events",
    "job_status_latest": """WITH u AS (SELECT user_id AS key, ts, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS stage, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) END AS progress FROM events)
      SELECT key, arg_max(stage, (ts, event_id)) FILTER (stage IS NOT NULL) AS stage, greatest(0, least(100, arg_max(progress, (ts, event_id)) FILTER (progress IS NOT NULL))) AS progress FROM u GROUP BY key""",
    "session_wipe": f"WITH {_KEYS} SELECT key, starts_with(key, '1') AS removed FROM keys",
    "session_wipe_counts": f"WITH {_KEYS} SELECT starts_with(key, '1') AS removed, count(*) AS n FROM keys GROUP BY 1",
    "history_tail8": _TAIL.format(8),
    "history_tail4": _TAIL.format(4),
    "history_cap16": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 16",
}
