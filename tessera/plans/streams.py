"""Streams run to their end and checked against batch SQL."""

from pyspark.sql import functions as F

from ..streaming import windows as S
from .registry import query


def _ntz(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")) if "start" in df.columns else df


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return _ntz(S.final_state(S.windowed(S.events_stream(spark, d), "1 hour")))


@query("SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, date_trunc('hour', ts) - to_hours(unnest([0, 1])) AS start FROM events) GROUP BY ALL")
def stream_sliding(spark, d):
    return _ntz(S.final_state(S.windowed(S.events_stream(spark, d), "2 hours", "1 hour")))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, (epoch_us(ts) - coalesce(epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)), 0) > 1800000000)::INT AS brk FROM events)) GROUP BY user_id, g")
def stream_sessions(spark, d):
    return _ntz(S.final_state(S.sessions(S.events_stream(spark, d), "30 minutes")))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, d):
    stream = S.events_stream(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return S.final_state(stream, "append")
