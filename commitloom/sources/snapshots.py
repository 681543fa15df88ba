"""Snapshots of repositories: tables whose rows are replaced and deleted by repository.

``SnapshotStore`` keeps several tables in step. Each change writes new folders and then publishes one manifest that names,
for every table and repository, the folder its rows are in; folders that are named are never changed. A reader who took
the manifest sees one state of all tables, whatever is written meanwhile.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitloom.sources import versions

#: Tasks that share the rows of one repository when a table is written.
SPREAD = 8
_MANIFEST = "name string, repo string, write string"


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows placed by repository and a hash of the row, so a large repository is written by several tasks."""
    return df.repartition(key, F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit(SPREAD)))


def write_snapshot(df: DataFrame, folder: str, key: str = "repo_id") -> None:
    """Replaces exactly the repositories present in ``df`` in one plain folder; others stay as they are.

    Partition folders are moved one after another. Where readers must never see old beside new rows, or several tables
    have to change together, use ``SnapshotStore``.
    """
    _spread(df, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


@dataclass(frozen=True)
class SnapshotView:
    """One published state of a store."""

    spark: SparkSession
    folder: str
    version: int
    entries: DataFrame

    def table(self, name: str, repo: str | None = None) -> DataFrame:
        """A table's rows, or those of one repository; folders the manifest does not name are not read.

        The column types are those of the newest folder that was written for the table.
        """
        named = self.entries.where(F.col("name") == name)
        path = f"{self.folder}/data/{name}"
        newest = named.agg(F.max("write")).first()[0]
        if newest is None:
            raise KeyError(f"no repository has a table {name}")
        fields = [f for f in self.spark.read.parquet(f"{path}/write={newest}").schema if f.name != "repo_id"]
        schema = T.StructType([*fields, T.StructField("write", T.StringType()), T.StructField("repo_id", T.StringType())])
        rows = self.spark.read.schema(schema).parquet(path)
        if repo is not None:
            writes = [r[0] for r in named.where(F.col("repo") == repo).select("write").distinct().collect()]  # one at most
            return rows.where((F.col("repo_id") == repo) & F.col("write").isin(writes)).drop("write")
        # the manifest's pairs prune the partitions of the scan
        return rows.join(F.broadcast(named.select("write", F.col("repo").alias("repo_id"))), ["write", "repo_id"], "left_semi").drop("write")


@dataclass(frozen=True)
class SnapshotStore:
    """Tables of a folder, each with a column ``repo_id`` (not null)."""

    spark: SparkSession
    folder: str

    def view(self) -> SnapshotView:
        """The newest published state. What it reads does not change; only ``vacuum`` removes older folders."""
        version, rows = versions.latest(self.spark, self.folder, _MANIFEST)
        if rows is None:
            rows = self.spark.createDataFrame([], _MANIFEST)
        return SnapshotView(self.spark, self.folder, version, rows.where(F.col("name") != "").select("name", "repo", "write"))

    def _publish(self, entries: DataFrame, base: int) -> int:
        mark = self.spark.createDataFrame([("", None, None)], _MANIFEST)
        return versions.publish(entries.unionByName(mark), self.folder, _MANIFEST, base)

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes rows to a new folder; returns its manifest entries, which are read from folder names alone."""
        # names sort by time, so the greatest is the newest
        write = f"{self.spark.sql('SELECT unix_micros(current_timestamp())').first()[0]:020d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/data/{name}/write={write}"
        _spread(rows.withColumn("repo_id", F.col("repo_id").cast("string")), "repo_id").write.partitionBy("repo_id").parquet(path)
        schema = T.StructType([f for f in rows.schema if f.name != "repo_id"] + [T.StructField("repo_id", T.StringType())])
        return self.spark.read.schema(schema).parquet(path).select(F.lit(name).alias("name"), F.col("repo_id").alias("repo"), F.lit(write).alias("write")).distinct()

    def replace(self, tables: Mapping[str, DataFrame]) -> int:
        """Replaces, in all of ``tables`` together, the repositories that any of them holds; returns the version.

        A repository with rows in one of the tables only has none in the others afterwards.
        """
        base = self.view()
        new = reduce(DataFrame.unionByName, [self._write(name, rows) for name, rows in tables.items()])
        touched = new.select("repo").distinct()
        old = base.entries.join(touched.withColumn("_in", F.lit(True)), "repo", "left")
        kept = old.where(F.col("_in").isNull() | ~F.col("name").isin(list(tables))).select("name", "repo", "write")
        return self._publish(kept.unionByName(new), base.version)

    def delete(self, repo: str) -> int:
        """Removes a repository from all tables: only a manifest is written. A repository that is not there is no error."""
        base = self.view()
        return self._publish(base.entries.where(F.col("repo") != repo), base.version)

    def delete_rows(self, name: str, repo: str, gone: Column) -> int:
        """Removes one repository's rows of a table for which ``gone`` is true; its other rows are written anew."""
        base = self.view()
        new = self._write(name, base.table(name, repo).where(~F.coalesce(gone, F.lit(False))))
        return self._publish(base.entries.where((F.col("name") != name) | (F.col("repo") != repo)).unionByName(new), base.version)

    def vacuum(self) -> int:
        """Removes folders the newest manifest does not name; readers of older views must be done. Returns their number."""
        view = self.view()
        system = self.spark._jvm.org.apache.hadoop.fs
        named = {(r["name"], r["write"]) for r in view.entries.select("name", "write").distinct().toLocalIterator()}
        data = system.Path(f"{self.folder}/data")
        files = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        removed = 0
        for table in files.listStatus(data):
            for write in files.listStatus(table.getPath()):
                name, path = table.getPath().getName(), write.getPath()
                if (name, path.getName().removeprefix("write=")) not in named:
                    removed += bool(files.delete(path, True))
        return removed


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def load_edges(edges: DataFrame, repo: str, types: Sequence[str] | None = None) -> DataFrame:
    """Edges of one repository: partition and column pruning happen in the scan."""
    rows = edges.where(F.col("repo_id") == repo)
    if types:
        rows = rows.where(F.col("type").isin(list(types)))
    return rows.select("source", "target", "type", "weight")


def load_graph(spark: SparkSession, folder: str, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, entities and edges of one repository from its snapshot folder."""
    tables = [spark.read.parquet(f"{folder}/{name}").where(F.col("repo_id") == repo) for name in ("files", "entities", "edges")]
    return tables[0], tables[1], tables[2]


STATS = T.StructType(
    [
        T.StructField("files", T.LongType()), T.StructField("loc", T.LongType()),
        T.StructField("languages", T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("loc", T.LongType())]))),
    ]
)


def stats_json(language_stats: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Repository statistics as one JSON text, languages by descending LOC."""
    return language_stats.groupBy(*by).agg(
        F.to_json(
            F.struct(
                F.sum("files").alias("files"), F.sum("loc").alias("loc"),
                F.transform(
                    F.array_sort(F.collect_list(F.struct((-F.col("loc")).alias("n"), "language"))),
                    lambda x: F.struct(x["language"].alias("language"), (-x["n"]).alias("loc")),
                ).alias("languages"),
            )
        ).alias("stats")
    )


def parse_stats(df: DataFrame) -> DataFrame:
    return df.withColumn("stats", F.from_json("stats", STATS))


def usable_vectors(df: DataFrame, dims: int, vector: str = "vector") -> DataFrame:
    """Vectors of the expected width; others belong to another model."""
    return df.where(F.size(vector) == dims)
