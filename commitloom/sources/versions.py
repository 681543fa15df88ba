"""Manifests: small tables in numbered versions; publishing one changes in a single step what readers see."""

from __future__ import annotations

from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConcurrentChange(RuntimeError):
    """Another writer published the version this one was made from."""


def _all(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{schema}, version long").parquet(f"{folder}/manifest")
    except AnalysisException:  # nothing was ever published
        return None


def latest(spark: SparkSession, folder: str, schema: str) -> tuple[int, DataFrame | None]:
    """Number and rows of the newest published version; (-1, None) before the first.

    A version is one file that appears by one rename when its job commits, so it is seen whole or not at all. Writers
    add a row that stands for an empty manifest.
    """
    rows = _all(spark, folder, schema)
    number = rows.agg(F.max("version")).first()[0] if rows is not None else None
    if number is None:
        return -1, None
    return number, rows.where(F.col("version") == number)


def publish(rows: DataFrame, folder: str, schema: str, base: int) -> int:
    """Publishes ``rows`` as the version after ``base``; fails if ``base`` is no longer the newest.

    Numbers that a writer took without finishing are passed over.
    """
    spark = rows.sparkSession
    for number in count(base + 1):
        if latest(spark, folder, schema)[0] != base:
            raise ConcurrentChange(f"version {base} of {folder} was replaced meanwhile")
        try:
            rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest/version={number}")
            return number
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
    raise AssertionError
