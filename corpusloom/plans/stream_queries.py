"""Streaming queries with the SQL of their result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming.jobs import run_to_end, session_counts, windowed_counts


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(d if not os.path.isdir(os.path.join(d, f"{name}.parquet")) else os.path.join(d, f"{name}.parquet"))


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = run_to_end(spark, windowed_counts(events, "ts", "event_type"))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = session_counts(events, "ts", "user_id")
    return counts.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (stream_event_windows, event_sessions)}

SQL = {
    "stream_event_windows": "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by all",
    "event_sessions": """
        with g as (select user_id, ts, case when ts >= lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end as s from events window w as (partition by user_id order by ts)),
        n as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g),
        c as (select user_id, k, count(*) as n from n group by all)
        select user_id, count(*) as sessions, max(n) as longest from c group by user_id
    """,
}
