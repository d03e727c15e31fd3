"""Streaming extension over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.plans.files import place
from tessel.streaming import windows as W


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query('select date_trunc(\'hour\', ts) as start, date_trunc(\'hour\', ts) + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by all')
def st01_tumbling(spark: SparkSession, path: str) -> DataFrame:
    """Hourly counts and sums, upserted by key."""
    rows = W.windowed(W.read_events(spark, path), F.window("ts", "1 hour"), ["event_type"])
    return _plain(W.drain(rows, place(spark, "st01"), ["start", "end", "event_type"]))


@query('with h as (select date_trunc(\'hour\', ts) as b, event_type, value from events), w as (select b - i * interval 1 hour as start, event_type, value from h, (values (0), (1)) t(i)) select start, start + interval 2 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total from w group by all')
def st02_sliding(spark: SparkSession, path: str) -> DataFrame:
    """Windows of two hours every hour."""
    rows = W.windowed(W.read_events(spark, path), F.window("ts", "2 hours", "1 hour"), ["event_type"])
    return _plain(W.drain(rows, place(spark, "st02"), ["start", "end", "event_type"]))


@query("""with o as (select user_id, ts, value, ts > lag(ts) over (partition by user_id order by ts) + interval 30 minute as gap from events), s as (select *, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts) as k from o)
select min(ts) as start, max(ts) + interval 30 minute as "end", user_id, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""")
def st03_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a user that end after half an hour of silence."""
    rows = W.windowed(W.read_events(spark, path), F.session_window("ts", "30 minutes"), ["user_id"])
    return _plain(W.drain(rows, place(spark, "st03"), ["start", "end", "user_id"], mode="complete"))
