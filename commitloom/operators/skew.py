"""Top-k, percentile and join helpers that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark prunes `row_number() <= k` before the shuffle for k up to
# spark.sql.optimizer.windowGroupLimitThreshold (1000), so no task sees a whole hot group.
GROUP_LIMIT = 1000
SALTS = 32


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows of every group in ``order``; ``rank`` names an optional 1-based rank.

    ``order`` must be total, or equal rows are picked arbitrarily.
    """
    name = rank or "_rank"
    if not by:
        kept = df.orderBy(*order).limit(k)
        if rank is None:
            return kept
        return kept.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    if k > GROUP_LIMIT:
        # rank inside salted slices first: the final window then sees at most SALTS * k rows
        salt = F.pmod(F.xxhash64(*[F.col(x) for x in _hashable(df)]), F.lit(SALTS))
        inner = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_slice_rank", F.row_number().over(inner))
            .where(F.col("_slice_rank") <= k)
            .drop("_salt", "_slice_rank")
        )
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]


def value_at_rank(df: DataFrame, by: Sequence[str], value: str, share: float, out: str) -> DataFrame:
    """Per group: the value at 0-based rank ``floor(share * n)`` in descending order.

    Works on the histogram of the values, so a group costs one row per distinct value.
    """
    histogram = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    by_value = Window.partitionBy(*by).orderBy(F.col(value).desc())
    total = Window.partitionBy(*by)
    placed = histogram.select(
        *by, value,
        F.sum("_n").over(by_value).alias("_through"),
        F.floor(F.sum("_n").over(total) * F.lit(share)).alias("_rank"),
    )
    return placed.where(F.col("_through") > F.col("_rank")).groupBy(*by).agg(F.max(value).alias(out))


def share_at_most(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Per group and distinct value: the share of rows whose value is at most this one."""
    histogram = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(F.col(value))
    total = Window.partitionBy(*by)
    return histogram.select(
        *by, value, (F.sum("_n").over(upto) / F.sum("_n").over(total)).alias(out)
    )


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], salts: int = SALTS,
    how: str = "inner",
) -> DataFrame:
    """Equi join whose hot keys are spread over ``salts`` slices of the big side.

    ``spread`` names columns of ``big`` that differ inside a hot key; ``small`` is repeated once
    per slice, so it should hold few rows per key. Only joins that keep ``big``'s rows are allowed.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"salted_join cannot do a {how} join")
    sliced = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return sliced.join(repeated, [*on, "_salt"], how).drop("_salt")
