"""Windows over the event table: an extension, the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.plans.registry import query
from callgrain.sources.tables import table
from callgrain.streaming.windows import session_totals, tumbling_totals


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = tumbling_totals(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")
    return w.select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH o AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS p FROM events), s AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, p ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = session_totals(table(spark, d, "events"), "ts", "30 minutes", ["user_id"])
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
