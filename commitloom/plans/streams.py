"""Streaming queries over the events table, which arrives in three files, the newest third of the time first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from commitloom.plans.registry import register
from commitloom.session import shared_folder
from commitloom.streaming import feeds as S

c = F.col


def feed(t, order=(2, 1, 0)):
    """The thirds of the events' time as a stream of files in the given order, one micro-batch each."""
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    events = t.events.withColumn("ts", c("ts").cast("timestamp"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    third = F.when(c("ts") < first + (last - first) / 3, 0).when(c("ts") < first + 2 * (last - first) / 3, 1).otherwise(2)
    for part in order:  # files are taken in the order in which they were written
        events.where(third == part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return stream, f"{base}/table", f"{base}/state"


@register("t01_stream_commits", "SELECT event_id, user_id, event_type FROM events")
def t01(t):
    """Every event comes twice in its batch, and those of the newest third once more in the last one."""
    stream, folder, state = feed(t, order=(2, 1, 0, 2))
    rows = stream.select("event_id", "user_id", "event_type", "ts")
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    table = S.commit_table(twice, "event_id", folder)
    S.stream_commits(twice, "event_id", "ts", table, state).awaitTermination()
    return S.commits(t.spark, table).select("event_id", "user_id", "event_type")


@register("t02_stream_weekly_activity", """
SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS commits, round(sum(value), 4) AS amount FROM events GROUP BY 1, 2""")
def t02(t):
    stream, folder, state = feed(t)
    table = S.weekly_table(stream, ["user_id"], "value", folder)
    S.stream_weekly_activity(stream, "ts", "value", table, state).awaitTermination()
    table.compact(t.spark, 1, S.weekly_folded(["user_id"]))
    return S.weekly_activity(t.spark, table).withColumn("amount", F.round("amount", 4))


@register("t03_stream_file_metrics", """
SELECT user_id, event_type, round(sum(value), 4) AS churn, count(*) AS commit_count, count(DISTINCT props) AS authors, max(ts) AS last_modified FROM events GROUP BY 1, 2""")
def t03(t):
    stream, folder, state = feed(t)
    by = ["user_id", "event_type"]
    table = S.metrics_table(stream, by, "ts", "value", "props", folder)
    S.stream_file_metrics(stream, "ts", "value", "props", table, state).awaitTermination()
    return S.file_metrics(t.spark, table).withColumns({"churn": F.round("churn", 4), "last_modified": c("last_modified").cast("timestamp_ntz")})


@register("t04_stream_skip_unchanged", """
+ s AS (SELECT user_id, event_type, ts, CASE WHEN ts < a + (b - a) / 3 THEN 0 WHEN ts < a + 2 * (b - a) / 3 THEN 1 ELSE 2 END AS part
  FROM events, (SELECT min(ts) AS a, max(ts) AS b FROM events)),
lasts AS (SELECT user_id, part, arg_max(event_type, ts) AS fingerprint FROM s GROUP BY 1, 2),
changed AS (SELECT *, lag(fingerprint) OVER (PARTITION BY user_id ORDER BY part) AS before FROM lasts)
SELECT user_id AS repo_id, CAST(part AS BIGINT) AS batch_id, fingerprint FROM changed WHERE before IS DISTINCT FROM fingerprint""", "jobs")
def t04(t):
    """What each of the three batches writes: the last fingerprint of every user where it differs from the one before."""
    stream, folder, state = feed(t, order=(0, 1, 2))
    snapshots = stream.select(c("user_id").alias("repo_id"), c("event_type").alias("fingerprint"), c("ts").alias("seen_at"))
    table = S.fingerprint_table(snapshots, folder)
    S.stream_changed_snapshots(snapshots, table, state).awaitTermination()
    return table.read(t.spark).select("repo_id", "batch_id", "fingerprint")
