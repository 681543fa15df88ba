"""Incremental feeds with Structured Streaming: commits, weekly activity, file metrics, changed snapshots.

Each feed is a ``foreachBatch`` sink over a ``BatchTable``: what has been seen is kept in a table, not for the length of a
watermark, so a row counts whenever it arrives. Every feed returns its running query; the function beside it reads the
result as of the last finished batch. Fold a feed's table with ``BatchTable.compact`` and the feed's ``*_folded`` function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from commitloom.streaming.state import BatchTable


def _run(feed: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _typed(feed: DataFrame, **columns: str) -> T.StructType:
    """Schema of a table: the type of a feed's column, or the type named with a leading ``=``."""
    fields = [T.StructField(k, T.StructType.fromDDL(f"x {v[1:]}")[0].dataType if v.startswith("=") else feed.schema[v].dataType) for k, v in columns.items()]
    return T.StructType(fields)


# --- commits -------------------------------------------------------------------------------------

def commit_table(feed: DataFrame, key: str, folder: str, buckets: int = 32) -> BatchTable:
    return BatchTable(folder, feed.schema, (key,), buckets).start(feed.sparkSession)


def write_new_commits(table: BatchTable, batch: DataFrame, batch_id: int, order: str) -> None:
    """The batch's rows whose key no earlier batch holds; of equal keys the one with the least ``order``."""
    spark, key = batch.sparkSession, table.keys[0]
    others = [c for c in table.schema.names if c != key]
    one = batch.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(order, *others)).alias("_row")).select(key, "_row.*")
    known = table.read(spark, batch_id, table.touched(one)).select(key)
    table.write(one.join(known, key, "left_anti"), batch_id)


def stream_commits(feed: DataFrame, key: str, order: str, table: BatchTable, checkpoint: str) -> StreamingQuery:
    """Each commit once, however often and however late the feed repeats it."""
    return _run(feed, lambda batch, n: write_new_commits(table, batch, n, order), checkpoint)


def commits(spark: SparkSession, table: BatchTable) -> DataFrame:
    return table.read(spark).drop("batch_id")


# --- weekly activity -----------------------------------------------------------------------------

def weekly_table(feed: DataFrame, by: Sequence[str], amount: str, folder: str, buckets: int = 32) -> BatchTable:
    schema = _typed(feed, **{c: c for c in by}, week="=date", commits="=long", amount=amount)
    return BatchTable(folder, schema, (*by, "week"), buckets).start(feed.sparkSession)


def stream_weekly_activity(feed: DataFrame, event_time: str, amount: str, table: BatchTable, checkpoint: str) -> StreamingQuery:
    """Events and amount per Monday-based week; late events raise the week they belong to."""
    by = [k for k in table.keys if k != "week"]

    def write(batch: DataFrame, batch_id: int) -> None:
        week = F.date_trunc("week", event_time).cast("date")
        table.write(batch.groupBy(*by, week.alias("week")).agg(F.count("*").alias("commits"), F.sum(amount).alias("amount")), batch_id)

    return _run(feed, write, checkpoint)


def weekly_folded(by: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*by, "week").agg(
        F.sum("commits").alias("commits"), F.sum("amount").alias("amount"), F.max("batch_id").alias("batch_id"))


def weekly_activity(spark: SparkSession, table: BatchTable) -> DataFrame:
    return weekly_folded([k for k in table.keys if k != "week"])(table.read(spark)).drop("batch_id")


# --- file metrics --------------------------------------------------------------------------------

def metrics_table(feed: DataFrame, by: Sequence[str], event_time: str, amount: str, author: str, folder: str, buckets: int = 32) -> BatchTable:
    schema = _typed(feed, **{c: c for c in by}, author=author, churn=amount, commit_count="=long", last_modified=event_time)
    return BatchTable(folder, schema, (*by, "author"), buckets).start(feed.sparkSession)


def _per_author(by: Sequence[str], churn: Column, count: Column, last: Column, *more: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*by, "author").agg(churn.alias("churn"), count.alias("commit_count"), last.alias("last_modified"), *more)


def stream_file_metrics(feed: DataFrame, event_time: str, amount: str, author: str, table: BatchTable, checkpoint: str) -> StreamingQuery:
    """Running churn, commits, authors and last change of every file, kept per file and author so authors stay exact."""
    by = [k for k in table.keys if k != "author"]
    part = _per_author(by, F.sum(amount), F.count("*"), F.max(event_time))
    return _run(feed, lambda batch, n: table.write(part(batch.withColumn("author", F.col(author))), n), checkpoint)


def metrics_folded(by: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return _per_author(by, F.sum("churn"), F.sum("commit_count"), F.max("last_modified"), F.max("batch_id").alias("batch_id"))


def file_metrics(spark: SparkSession, table: BatchTable) -> DataFrame:
    """churn, commit_count, authors (those that are known) and last_modified of every file."""
    by = [k for k in table.keys if k != "author"]
    return metrics_folded(by)(table.read(spark)).groupBy(*by).agg(
        F.sum("churn").alias("churn"), F.sum("commit_count").alias("commit_count"),
        F.count("author").alias("authors"), F.max("last_modified").alias("last_modified"))


# --- changed snapshots ---------------------------------------------------------------------------

def fingerprint_table(feed: DataFrame, folder: str, buckets: int = 32) -> BatchTable:
    return BatchTable(folder, _typed(feed, repo_id="repo_id", fingerprint="fingerprint", seen_at="seen_at"), ("repo_id",), buckets).start(feed.sparkSession)


def latest_fingerprints(rows: DataFrame) -> DataFrame:
    """Of every repository the row seen last."""
    last = rows.groupBy("repo_id").agg(F.max(F.struct("seen_at", "batch_id", "fingerprint")).alias("m"))
    return last.select("repo_id", F.col("m.fingerprint").alias("fingerprint"), F.col("m.seen_at").alias("seen_at"), F.col("m.batch_id").alias("batch_id"))


def write_changed(table: BatchTable, batch: DataFrame, batch_id: int) -> None:
    """The batch's last fingerprint of every repository whose known one is older and differs."""
    spark = batch.sparkSession
    last = latest_fingerprints(batch.withColumn("batch_id", F.lit(batch_id).cast("long"))).drop("batch_id")
    known = latest_fingerprints(table.read(spark, batch_id, table.touched(last))).select(
        "repo_id", F.col("fingerprint").alias("_known"), F.col("seen_at").alias("_at"))
    joined = last.join(known, "repo_id", "left")
    changed = F.col("_at").isNull() | ((F.col("seen_at") > F.col("_at")) & ~F.col("fingerprint").eqNullSafe(F.col("_known")))
    table.write(joined.where(changed), batch_id)


def stream_changed_snapshots(feed: DataFrame, table: BatchTable, checkpoint: str) -> StreamingQuery:
    """Keeps (repo_id, fingerprint, seen_at) rows only where a repository's fingerprint differs from its last one.

    A batch asks only the buckets of its own repositories; a row older than the known one changes nothing.
    """
    return _run(feed, lambda batch, n: write_changed(table, batch, n), checkpoint)
