"""The registry that query modules add to, and the inputs that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its own name, with the SQL that states its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def millis(ts: str = "ts") -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", millis().alias("t"), "user_id", "event_type", "value")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as timed segments: a turn lasts 60 ms a character and a second at least."""
    conv = table(spark, folder, "conversations").withColumn("dur_ms", F.greatest(F.lit(1000), F.length("text") * 60).cast("long"))
    from palaver.operators.timeline import running_offsets

    return running_offsets(conv, ["conv_id"], ["turn"], "dur_ms")


#: The same segments in SQL.
SEGMENTS = """seg AS (SELECT conv_id, turn, role, text, dur_ms, t_end, t_end - dur_ms AS t_start FROM (
  SELECT *, CAST(sum(dur_ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS t_end
  FROM (SELECT *, CAST(greatest(1000, length(text) * 60) AS BIGINT) AS dur_ms FROM conversations)))"""
EVENTS = "ev AS (SELECT event_id, epoch_us(ts) // 1000 AS t, user_id, event_type, value FROM events)"
