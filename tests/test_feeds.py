"""Streams over rows that arrive late, twice and again after a failure; trees and logs of many tasks."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from commitloom.sources import files, gitlog
from commitloom.streaming import feeds as S

SCHEMA = "sha string, path string, author string, ts timestamp, n long"


@pytest.fixture(scope="module")
def batches(spark):
    """Three batches of rows over 60 days, the oldest last, with rows that repeat within and across batches."""
    rng = random.Random(1)
    rows = [(f"s{i}", f"p{rng.randrange(9)}", rng.choice(["a", "b", None]), f"2024-0{1 + i // 100}-{1 + i % 28:02d} 10:00:00", rng.randrange(50)) for i in range(300)]
    parts = [rows[200:] + rows[200:220], rows[100:200] + rows[210:230], rows[:100]]
    return [spark.createDataFrame([(a, b, c, d, n) for a, b, c, d, n in p], "sha string, path string, author string, d string, n long").select(
        "sha", "path", "author", F.col("d").cast("timestamp").alias("ts"), "n") for p in parts]


@pytest.fixture
def stream(spark, batches, tmp_path):
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_late_and_repeated_commits_count_once(spark, batches, stream, tmp_path):
    table = S.commit_table(stream, "sha", str(tmp_path / "t"), buckets=3)
    S.stream_commits(stream, "sha", "ts", table, str(tmp_path / "c")).awaitTermination()
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    _same(S.commits(spark, table), every.distinct())
    S.write_new_commits(table, batches[1], 1, "ts")  # a batch that is replayed
    _same(S.commits(spark, table), every.distinct())
    assert table.read(spark, buckets=[0]).count() < 300


def test_late_weeks_and_files_equal_the_batch_result(spark, batches, stream, tmp_path):
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    weeks = S.weekly_table(stream, ["path"], "n", str(tmp_path / "w"), buckets=3)
    S.stream_weekly_activity(stream, "ts", "n", weeks, str(tmp_path / "cw")).awaitTermination()
    wanted = every.groupBy("path", F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count("*").alias("commits"), F.sum("n").alias("amount"))
    _same(S.weekly_activity(spark, weeks), wanted)
    own = S.metrics_table(stream, ["path"], "ts", "n", "author", str(tmp_path / "m"), buckets=3)
    S.stream_file_metrics(stream, "ts", "n", "author", own, str(tmp_path / "cm")).awaitTermination()
    metrics = every.groupBy("path").agg(
        F.sum("n").alias("churn"), F.count("*").alias("commit_count"), F.count_distinct("author").alias("authors"), F.max("ts").alias("last_modified"))
    _same(S.file_metrics(spark, own), metrics)
    for upto in (0, 1, 1, 2):  # folding changes no result, also where it is asked for twice
        weeks.compact(spark, upto, S.weekly_folded(["path"]))
        own.compact(spark, upto, S.metrics_folded(["path"]))
        _same(S.weekly_activity(spark, weeks), wanted)
        _same(S.file_metrics(spark, own), metrics)


def test_unchanged_and_late_snapshots_are_skipped(spark, tmp_path):
    schema = "repo_id string, fingerprint string, seen_at long"
    feed = spark.createDataFrame([], schema)
    table = S.fingerprint_table(feed, str(tmp_path / "f"), buckets=2)
    steps = [[("r", "x", 10), ("q", "a", 10)], [("r", "x", 20), ("q", "b", 20)], [("r", "late", 5), ("q", "a", 30)], [("n", "new", 1), ("r", "y", 40), ("r", "z", 39)]]
    for i, step in enumerate(steps):
        S.write_changed(table, spark.createDataFrame(step, schema), i)
    S.write_changed(table, spark.createDataFrame(steps[1], schema), 1)
    assert sorted((r.batch_id, r.repo_id, r.fingerprint) for r in table.read(spark).collect()) == [
        (0, "q", "a"), (0, "r", "x"), (1, "q", "b"), (2, "q", "a"), (3, "n", "new"), (3, "r", "y")]


def test_a_folder_of_many_files_is_read_whole_by_many_tasks(spark, tmp_path):
    wide, deep = tmp_path / "r/wide", tmp_path / "r" / "/".join(f"d{i}" for i in range(12))
    for folder in (wide, deep, tmp_path / "r/node_modules/x"):
        os.makedirs(folder)
    for i in range(60_000):
        with open(wide / f"f{i}.py", "wb") as out:
            out.write(b"x")
    (deep / "__init__.py").write_bytes(b"y" * 3_000_000)
    (deep / "nul.py").write_bytes(b"y" * 9_000 + b"\0")
    (tmp_path / "r/node_modules/x/a.py").write_bytes(b"x")
    folders = spark.createDataFrame([("r", f"file:{tmp_path}/r"), ("none", str(tmp_path / "r/wide/"))], "repo_id string, folder string")
    got = files.scan_source_files(folders.where("repo_id = 'r'")).withColumn("task", F.spark_partition_id())
    counts = {r.task: r.n for r in got.groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 60_001 and len(counts) >= 4 and max(counts.values()) < 25_000
    assert got.where(F.length("content") == 3_000_000).count() == 1


def _record(i, size=0):
    return f"\x1esha{i:07d}\x1fAnn\x1fa@x\x1f2024-01-02T10:00:00+00:00\x1fm{'é' * size}\n1\t0\tf{i}.py\n"


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_logs_are_cut_into_ranges_without_loss(spark, tmp_path, split):
    (tmp_path / "logs").mkdir()
    for k in range(3):
        (tmp_path / f"logs/{k}.log").write_text("".join(_record(10 * k + i, i % 4) for i in range(10)))
    (tmp_path / "logs/empty.log").write_text("")
    logs = gitlog._Logs({"path": str(tmp_path / "logs"), "split_bytes": str(split), "repo_id": "r"})
    parts = logs.ranges({}, logs.sizes())
    got = sorted(r.split("\x1f")[0] for p in parts for _, r in logs.read(p))
    assert got == [f"sha{i:07d}" for i in range(30)]
    if split == 64:
        spark.dataSource.register(gitlog.CommitLogSource)
        read = spark.read.format("commitlog").option("repo_id", "r").option("split_bytes", 64).load(str(tmp_path / "logs"))
        assert read.rdd.getNumPartitions() > 10
        assert sorted(r.sha for r in gitlog.parse_commits(read).collect()) == got


def test_a_stream_follows_growing_logs(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    log, out = tmp_path / "logs/a.log", str(tmp_path / "out")
    log.write_text(_record(1) + _record(2)[:20])  # the second record is not finished

    def run(tail):
        stream = gitlog.stream_log_records(spark, str(tmp_path / "logs"), "r", tail)
        query = gitlog.parse_commits(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.sha for r in spark.read.parquet(out).collect())

    assert run(False) == ["sha0000001"]
    with open(log, "a") as more:
        more.write(_record(2)[20:] + _record(3))
    (tmp_path / "logs/b.log").write_text(_record(4) + _record(5))
    assert run(False) == ["sha0000001", "sha0000002", "sha0000004"]
    assert run(True) == [f"sha000000{i}" for i in range(1, 6)]
