"""Reading, writing and row conventions shared by the corpus operators.

All operators take only the columns they name, so extra columns, also ones whose names clash with
results, never matter. A null text is an empty text. Rows that repeat both doc_id and text are the
same document and share its decisions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from commitloom.session import shared_folder


#: Rows of one Arrow batch: what a Python worker holds of its task at once.
BATCH_ROWS = 2_000
#: Characters of plan text the driver keeps for each of its latest jobs; unlimited by default, which adds up over rounds.
PLAN_TEXT = 8_192


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session handing whole texts to Python in batches of BATCH_ROWS rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def text_of() -> Column:
    """The text of a row; a null text reads as empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text; a null text reads as empty."""
    docs = in_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, sizes are known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    whole = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    try:
        # pages are measured from the first row on: a hundred long texts would make one page of them all
        df.write.option("parquet.page.size.row.check.min", "1").parquet(path)
    finally:  # the session's other plans are shown whole
        spark.conf.set("spark.sql.maxPlanStringLength", whole)
    return spark.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """As ``stored``, with the number of rows, counted while they are written."""
    seen = Observation()
    return stored(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]


def width(df: DataFrame, rows: int, least: int = 1) -> int:
    """How many partitions hold about ``rows`` rows each, never fewer than the session's own number."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))


#: How to drop what a Python worker remembers between tasks, by the kind of task that uses it.
_remembered: dict[str, Callable[[], None]] = {}


def remember(kind: str, drop: Callable[[], None]) -> None:
    _remembered[kind] = drop


def forget(kind: str | None) -> None:
    """Drops what this worker remembers for tasks of other kinds: a worker outlives its stage."""
    dropped = [k for k in _remembered if k != kind]
    for other in dropped:
        _remembered.pop(other)()
    if dropped:
        pa.default_memory_pool().release_unused()


def per_batch(step: Callable[[pa.RecordBatch], pa.RecordBatch | None], kind: str | None = None) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that applies ``step`` to each batch; ``kind`` names what it remembers between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(kind)
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out

    return run
