"""Streaming forms over the events as a stream; what they give once all of it has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import live
from .queries import query, rounded

#: Longer than the events span, so that none comes too late.
LATE = "3650 days"


def stream(spark, d):
    source = spark.read.parquet(f"{d}/events.parquet")
    # A file stream reads folders; the table may be a folder or a file.
    s = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    return s.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))


@query("""SELECT user_id AS id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS begin_s, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL""")
def q_live_bins(spark, d):
    got = live.drained(live.live_bins(stream(spark, d), LATE, "1 day"))
    return rounded(got.select("id", F.unix_timestamp("window.start").alias("begin_s"), "mean", "n"))


@query("""WITH x AS (SELECT user_id AS id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 86400000000 THEN 0 ELSE 1 END AS j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT id, ts, sum(j) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT id, epoch_us(min(ts)) AS begin_us, count(*) AS n FROM y GROUP BY id, s""")
def q_live_segments(spark, d):
    got = live.drained(live.live_segments(stream(spark, d), "1 day", LATE))
    return got.select("id", F.unix_micros("session_window.start").alias("begin_us"), "n")


@query("""SELECT user_id AS id, count(DISTINCT ts) AS n FROM events GROUP BY 1""")
def q_live_without_repeats(spark, d):
    return live.drained(live.without_repeats(stream(spark, d), LATE), "append").groupBy("id").agg(F.count("*").alias("n"))
