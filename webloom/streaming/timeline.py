"""Lifecycle changes as a stream: counts by day and kind, late rows allowed for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.session import table


def daily(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events by day and type; works on a stream and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", lateness) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(
        F.to_date("w.start").alias("day"), "event_type", "n", "value"
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches of a user's events without a longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def stream_daily(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> StreamingQuery:
    """Read event files as they come, append closed days to ``target``."""
    rows = spark.readStream.schema(schema).parquet(source)
    return daily(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


QUERIES = {
    "daily_events": lambda s, d: daily(table(s, d, "events")),
    "user_sessions": lambda s, d: sessions(table(s, d, "events")),
}
ORACLES = {
    "daily_events": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM k GROUP BY user_id, s",
}
