"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from commitloom.llm.tables import stored


#: Links one task writes.
ROWS = 50_000


def _measured(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
    """``edges`` stored, with its count and a sum of hashes taken while it is written."""
    seen = Observation()
    # a sum of 32-bit parts cannot overflow
    watched = edges.coalesce(max(1, rows // ROWS + 1)) if rows is not None else edges
    watched = watched.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("hashes"))
    return stored(watched), (seen.get["n"], seen.get["hashes"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
    return small.where(F.col("a") != F.col("b")).distinct()


def _directed(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def shortened(links: DataFrame) -> DataFrame:
    """Links (a, b), stored, that connect the same nodes as ``links`` by shorter ways.

    One step and no test of the result: a family of hubs and their members becomes a star at once, a chain of
    families needs further calls with these links.
    """
    return stored(_stars(_directed(links)))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) as (node, component): every linked node with the least node it is connected to.

    Each step points nodes at the least neighbour seen; rounds grow with the logarithm of a component's
    length and only two numbers per round reach the driver.
    """
    edges, state = _measured(_directed(links).distinct())
    before = None
    while state != before:
        before = state
        edges, state = _measured(_stars(edges), state[0])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
