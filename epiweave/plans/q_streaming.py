"""Streaming queries over `events`, equal to their batch forms on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.sources.shared import shared_dir
from epiweave.streaming import streams as st

from .bindings import read
from .registry import query


def _stream(spark, d, parts=("true",)):
    """The events as a stream of one batch for each part; each part is written by as many tasks as read it."""
    path = shared_dir(spark, "events")
    rows = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    files = max(2, rows.rdd.getNumPartitions())
    for p in parts:
        rows.where(p).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


_MAX = "(SELECT max(ts) FROM events)"


@query("str_weekly", f"SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(date_trunc('week', min(ts)) AS TIMESTAMP) + INTERVAL 7 DAY <= {_MAX} - INTERVAL 1 DAY")
def weekly(spark, d):
    out = st.run_available(st.weekly(_stream(spark, d), ["event_type"], "1 day"), "weekly")
    return out.select("event_type", _day("window.start").alias("week_start"), "n")


@query("str_rolling", f"SELECT event_type, strftime(date_trunc('week', ts) - INTERVAL 7 DAY * i, '%Y-%m-%d') AS start_day, count(*) AS n FROM events, (SELECT CAST(range AS INTEGER) AS i FROM range(4)) GROUP BY 1, 2, date_trunc('week', ts) - INTERVAL 7 DAY * i HAVING CAST(date_trunc('week', ts) - INTERVAL 7 DAY * i AS TIMESTAMP) + INTERVAL 28 DAY <= {_MAX} - INTERVAL 1 DAY")
def rolling(spark, d):
    out = st.run_available(st.rolling(_stream(spark, d), ["event_type"], "1 day"), "rolling")
    return out.select("event_type", _day("window.start").alias("start_day"), "n")


@query("str_session", f"""SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M') AS first_seen FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= {_MAX} - INTERVAL 1 DAY""")
def session(spark, d):
    out = st.run_available(st.sessions(_stream(spark, d), ["user_id"], "6 hours", "1 day"), "sessions")
    return out.select("user_id", "n", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("first_seen"))


@query("str_first_obs", "SELECT user_id, event_type, 1 AS n FROM events GROUP BY 1, 2")
def first_obs(spark, d):
    out = st.run_available(st.first_seen(_stream(spark, d), ["user_id", "event_type"], "60 days"), "first")
    return out.select("user_id", "event_type", F.lit(1).alias("n"))


@query("str_late", "SELECT event_type, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE NOT late) AS merged FROM (SELECT *, event_id % 2 = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 20 DAY AS late FROM events) GROUP BY 1")
def late(spark, d):
    out = st.split_late(_stream(spark, d, ("event_id % 2 = 0", "event_id % 2 = 1")), spark, "late", "20 days")
    return out.groupBy("event_type").agg(F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("merged"))


@query("str_ledger", """WITH v AS (SELECT DISTINCT user_id, event_type, event_id % 2 AS part, sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(event_id // 2 % 3 AS VARCHAR))) AS hash FROM events),
    f AS (SELECT *, first_value(hash) OVER (PARTITION BY user_id, event_type ORDER BY part, hash) AS own, row_number() OVER (PARTITION BY user_id, event_type ORDER BY part, hash) AS r FROM v)
    SELECT user_id, event_type, max(own) AS hash, count(*) FILTER (WHERE hash = own AND r > 1) AS skipped, count(*) FILTER (WHERE hash <> own) AS conflicts FROM f GROUP BY 1, 2""")
def ledger(spark, d):
    """One record for each user and event type; records of both batches may repeat it or conflict with it."""
    rows = _stream(spark, d, ("event_id % 2 = 0", "event_id % 2 = 1"))
    version = F.floor(F.col("event_id") / 2) % 3
    rows = rows.select("user_id", "event_type", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", version.cast("string")), 256).alias("hash"))
    out = st.run_available(st.append_once(rows, ["user_id", "event_type"]), "once")
    action = F.col("action")
    return out.groupBy("user_id", "event_type").agg(F.max(F.when(action == "append", F.col("hash"))).alias("hash"), F.count_if(action == "skip").alias("skipped"), F.count_if(action == "conflict").alias("conflicts"))
