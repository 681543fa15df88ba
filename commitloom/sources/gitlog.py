"""Commit logs: records start with 0x1E, header fields are split by 0x1F, raw and numstat lines follow.

``CommitLogSource`` is a Python data source for folders of such logs, ``spark.read.format("commitlog")`` and
``spark.readStream.format("commitlog")``. A log of any size is cut into ranges of bytes, one per task; a record belongs to
the range in which it starts. The stream follows logs that grow: each batch takes what was appended to every log since the
last one, and new logs from their beginning. A record counts as complete when another one follows, so the last record of
a log waits for its successor unless the option ``tail`` is ``true``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from commitloom.sources.files import file_system

RECORD = "\x1e"
FIELD = "\x1f"
#: Bytes of a log that one task reads.
SPLIT_BYTES = 64 << 20
_STEP = 1 << 20


@dataclass
class LogRange(InputPartition):
    path: str
    start: int
    end: int


class _Logs:
    """What the batch and the stream reader share: options path, repo_id, split_bytes and tail."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.repo_id = options.get("repo_id")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tail = options.get("tail", "").lower() == "true"

    def sizes(self) -> dict[str, int]:
        """Bytes of every log of the folder, or of the one log."""
        from pyarrow import fs as pafs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=True))
        return {i.path: i.size for i in found if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))}

    def ranges(self, begins: dict[str, int], ends: dict[str, int]) -> list[LogRange]:
        return [
            LogRange(path, at, min(at + self.split, end))
            for path, end in sorted(ends.items()) for at in range(begins.get(path, 0), end, self.split)]

    def last_record(self, path: str, size: int, begin: int) -> int:
        """Where the last record of a log starts, looking back from its end as far as ``begin``."""
        system, _ = file_system(self.path)
        with system.open_input_file(path) as log:
            at = size
            while at > begin:
                start = max(begin, at - _STEP)
                log.seek(start)
                found = log.read(at - start).rfind(RECORD.encode())
                if found >= 0:
                    return start + found
                at = start
        return begin

    def read(self, part: LogRange) -> Iterator[tuple[str | None, str]]:
        """Records that start in the range; the last one is read on to its end."""
        mark = RECORD.encode()
        system, _ = file_system(self.path)
        with system.open_input_file(part.path) as log:
            log.seek(part.start)
            at, held, inside = part.start, b"", False
            while True:
                block = log.read(_STEP)
                pieces = block.split(mark)
                if inside:
                    held += pieces[0]
                place = at + len(pieces[0])
                for piece in pieces[1:]:
                    if inside:
                        yield self.repo_id, held.decode("utf-8", "replace")
                    inside, held = place < part.end, piece
                    if not inside:
                        return
                    place += 1 + len(piece)
                at += len(block)
                if not block or (not inside and at >= part.end):
                    break
            if inside:
                yield self.repo_id, held.decode("utf-8", "replace")


class CommitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.logs = _Logs(options)

    def partitions(self) -> list[LogRange]:
        return self.logs.ranges({}, self.logs.sizes())

    def read(self, partition: LogRange) -> Iterator[tuple[str | None, str]]:
        return self.logs.read(partition)


class CommitLogStreamReader(DataSourceStreamReader):
    """Offsets are bytes taken of every log."""

    def __init__(self, options: dict[str, str]) -> None:
        self.logs = _Logs(options)
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        sizes = self.logs.sizes()
        if not self.logs.tail:
            sizes = {p: self.logs.last_record(p, n, self.seen.get(p, 0)) for p, n in sizes.items()}
        self.seen = sizes
        return {p: n for p, n in sizes.items() if n}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[LogRange]:
        return self.logs.ranges(start, end)

    def read(self, partition: LogRange) -> Iterator[tuple[str | None, str]]:
        return self.logs.read(partition)

    def commit(self, end: dict[str, int]) -> None:
        pass


class CommitLogSource(DataSource):
    """Rows (repo_id, record) of the logs below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "commitlog"

    def schema(self) -> str:
        return "repo_id string, record string"

    def reader(self, schema) -> CommitLogReader:
        return CommitLogReader(self.options)

    def streamReader(self, schema) -> CommitLogStreamReader:
        return CommitLogStreamReader(self.options)


def stream_log_records(spark: SparkSession, path: str, repo_id: str, tail: bool = False) -> DataFrame:
    """The records of growing logs as a stream, for ``parse_commits`` and ``parse_changes``."""
    spark.dataSource.register(CommitLogSource)
    return spark.readStream.format("commitlog").option("repo_id", repo_id).option("tail", str(tail)).load(path)


def read_commit_log(spark: SparkSession, path: str, repo_id: str) -> tuple[DataFrame, DataFrame]:
    """Commits and their changed files from a log, or from the logs of a folder."""
    spark.dataSource.register(CommitLogSource)
    records = spark.read.format("commitlog").option("repo_id", repo_id).load(path)
    return parse_commits(records), parse_changes(records)


def _headed(records: DataFrame) -> DataFrame:
    header = F.split(F.substring_index("record", "\n", 1), FIELD)
    return records.where(F.trim("record") != "").withColumn("_h", header).withColumn(
        "sha", F.get("_h", F.lit(0))
    ).where(F.length("sha") >= 7)


def parse_commits(records: DataFrame) -> DataFrame:
    """(repo_id, sha, author_name, author_email, committed_at, message); missing authors are ``unknown``."""
    field = lambda i: F.nullif(F.get("_h", F.lit(i)), F.lit(""))
    return _headed(records).select(
        "repo_id", "sha", F.coalesce(field(1), F.lit("unknown")).alias("author_name"),
        F.lower(F.coalesce(field(2), F.lit("unknown"))).alias("author_email"),
        F.try_to_timestamp(field(3)).alias("committed_at"), F.coalesce(field(4), F.lit("")).alias("message"),
    )


def parse_changes(records: DataFrame) -> DataFrame:
    """(repo_id, sha, path, change_type, additions, deletions), one row per changed file of a commit.

    A raw line gives the change type, a numstat line the counts (``-`` for binary files is 0).
    """
    lines = _headed(records).select("repo_id", "sha", F.explode(F.slice(F.split("record", "\n"), 2, 2147483647)).alias("line"))
    raw = F.col("line").startswith(":") & F.col("line").contains("\t")
    count = r"^([^\t]*)\t([^\t]*)\t(.+)$"
    stat = ~F.col("line").startswith(":") & F.col("line").rlike(count)
    number = lambda g: F.coalesce(F.regexp_extract("line", count, g).try_cast("long"), F.lit(0))
    rows = lines.where(raw | stat).select(
        "repo_id", "sha",
        F.when(raw, F.regexp_extract("line", r"^[^\t]*\t(.*)$", 1)).otherwise(F.regexp_extract("line", count, 3)).alias("path"),
        F.when(raw, F.coalesce(F.nullif(F.regexp_extract("line", r"^(?:\S+ ){4}(\S)", 1), F.lit("")), F.lit("M"))).alias("_status"),
        F.when(stat, number(1)).alias("_add"), F.when(stat, number(2)).alias("_del"),
    )
    return rows.groupBy("repo_id", "sha", "path").agg(
        F.coalesce(F.max("_status"), F.lit("M")).alias("change_type"),
        F.coalesce(F.max("_add"), F.lit(0)).alias("additions"), F.coalesce(F.max("_del"), F.lit(0)).alias("deletions"),
    )
