"""J: streaming, run over all input there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query
from quillwork.streaming import streams as ops


def _events(t):
    stream = ops.stream_table(t.spark, f"{t.sf_dir}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("j1_stream_corpus", "SELECT event_id, event_type, value FROM events")
def _(t):
    return ops.drain(_events(t).select("event_id", "event_type", "value"))


@query(
    "j2_stream_keep_on_change",
    """SELECT user_id, ts, event_id, event_type FROM events
    QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type""",
)
def _(t):
    columns = ("user_id", "ts", "event_id", "event_type")
    return ops.drain(ops.stream_keep_on_change(_events(t), *columns), rest=ops.rest_of_changes(*columns))


@query(
    "j3_stream_first_seen",
    "SELECT user_id, event_type, min(1) AS n FROM events GROUP BY ALL",
)
def _(t):
    seen = ops.stream_first_seen(_events(t), "ts", ["user_id", "event_type"], "60 days")
    return ops.drain(seen.select("user_id", "event_type", F.lit(1).alias("n")))


@query(
    "j4_stream_status_counts",
    """SELECT s AS window_start, s + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n
    FROM (SELECT date_trunc('day', ts) AS s, event_type FROM events) GROUP BY s, event_type""",
)
def _(t):
    return ops.drain(ops.stream_status_counts(_events(t), "ts", "event_type", "1 day"), rest=ops.rest_of_counts("event_type"))


@query(
    "j4_stream_sliding_counts",
    """SELECT s AS window_start, s + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n FROM (
      SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s FROM events)
    GROUP BY ALL""",
)
def _(t):
    return ops.drain(ops.stream_status_counts(_events(t), "ts", "event_type", "2 days", "1 day"), rest=ops.rest_of_counts("event_type"))


@query(
    "j4_stream_session_counts",
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
        SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR)::INTEGER AS fresh0,
          coalesce(fresh0, 1) AS fresh FROM events))
    GROUP BY user_id, g""",
)
def _(t):
    return ops.drain(ops.stream_session_counts(_events(t), "ts", "user_id", "2 hours"), rest=ops.rest_of_sessions("user_id"))


@query(
    "j5_stream_upsert",
    """SELECT user_id, coalesce(e.event_type, 'none') AS status, c_name AS note FROM
      (SELECT c_custkey AS user_id, c_name FROM customer) LEFT JOIN
      (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL) e USING (user_id)
    UNION ALL SELECT user_id, arg_max(event_type, event_id), '' FROM events
      WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id""",
)
def _(t):
    target = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.lit("none").alias("status"), F.col("c_name").alias("note")
    )
    stream = _events(t).select("user_id", F.col("event_type").alias("status"), "event_id")
    return ops.stream_upsert(stream, target, "user_id", "event_id", ["status"], {"note": F.lit("")})


@query(
    "j6_stream_notifications",
    """SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS level, false AS is_read
    FROM events WHERE event_type IN ('error', 'purchase')""",
)
def _(t):
    fresh = ops.stream_notifications(_events(t), "event_type", {"error": "error", "purchase": "success"})
    return ops.drain(fresh.select("event_id", "event_type", "level", "is_read"))
