"""State of streaming feeds as a table of micro-batches: nothing is forgotten, however late a row arrives.

Every micro-batch writes one folder of thin rows, dealt by a hash of their key into a fixed number of buckets. A row of a
key is looked up in the buckets the batch touches and nowhere else. Aggregates are kept as parts per batch and key, which
merge when read, so a batch reads nothing of what came before it; ``compact`` folds old parts together. A batch that is
replayed after a failure replaces its own folder and looks only at batches before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitloom.sources import versions

_BASE = "upto long, folder string"


@dataclass(frozen=True)
class BatchTable:
    """Rows of ``schema`` by micro-batch and bucket of ``keys`` in a folder."""

    folder: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 32

    def _rows(self, spark: SparkSession, path: str) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())])
        return spark.read.schema(schema).parquet(path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        out = self._bucketed(rows).repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batches/batch_id={batch_id}")

    def start(self, spark: SparkSession) -> BatchTable:
        """Writes an empty first batch, so that reading before any other is defined."""
        self.write(spark.createDataFrame([], self.schema), -1)
        return self

    def _base(self, spark: SparkSession) -> tuple[int, int, str | None]:
        """Version of the last compaction, the last batch it holds and its folder."""
        version, rows = versions.latest(spark, self.folder, _BASE)
        if rows is None:
            return -1, -2, None
        row = rows.first()
        return version, row["upto"], row["folder"]

    def read(self, spark: SparkSession, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows with batch_id, of batches below ``before``, of some buckets; a compacted batch's rows come from its fold."""
        _, upto, folder = self._base(spark)
        rows = self._rows(spark, f"{self.folder}/batches").where(F.col("batch_id") > upto)
        if folder is not None:
            rows = rows.unionByName(self._rows(spark, folder))
        if before is not None:
            rows = rows.where(F.col("batch_id") < before)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(list(buckets)))
        return rows.drop("bucket")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of ``rows``: at most as many as there are."""
        return [r[0] for r in self._bucketed(rows).select("bucket").distinct().collect()]

    def compact(self, spark: SparkSession, upto: int, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Folds all batches up to ``upto``, which is done, into one folder; readers switch when it is published.

        ``fold`` gets rows with batch_id and keeps that column. Folded batch folders may be deleted afterwards.
        """
        version, last, _ = self._base(spark)
        if upto <= last:
            return
        folder = f"{self.folder}/folded/upto={upto}-{version + 1}"
        rows = fold(self.read(spark, before=upto + 1)).select(*self.schema.names, "batch_id")
        out = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        versions.publish(spark.createDataFrame([(upto, folder)], _BASE), self.folder, _BASE, version)
