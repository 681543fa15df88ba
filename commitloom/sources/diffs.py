"""Unified diffs as lines (request_id, line_no, text): changed files and line ranges of the new side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.operators.history import carry_forward

REQUEST = ("repo_id", "request_id")


def diff_paths(lines: DataFrame, request: Sequence[str] = REQUEST) -> DataFrame:
    """Every line with the file it belongs to: the last ``+++`` or ``diff --git`` header before it."""
    plus = F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.+?)\s*$", 1)
    git = F.regexp_extract("text", r"^diff --git a/.+? b/(.+)$", 1)
    header = F.when(F.col("text").rlike(r"^\+\+\+ ") & (plus != "/dev/null") & (plus != ""), F.trim(plus)).when(git != "", F.trim(git))
    return carry_forward(lines.withColumn("_header", header), request, "line_no", "_header", "path")


def read_unified_diff(lines: DataFrame, request: Sequence[str] = REQUEST) -> DataFrame:
    """(request, path, start, end); a file without hunks has one row with null range.

    A hunk of length 0 still covers one line.
    """
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    placed = diff_paths(lines, request).where(F.col("path").isNotNull())
    start = F.regexp_extract("text", hunk, 1).try_cast("int")
    length = F.coalesce(F.regexp_extract("text", hunk, 2).try_cast("int"), F.lit(1))
    ranges = placed.where(F.col("text").rlike(hunk)).select(
        *request, "path", start.alias("start"), (start + F.greatest(F.lit(0), length - 1)).alias("end")
    ).distinct()
    files = placed.select(*request, "path").distinct()
    return files.join(ranges, [*request, "path"], "left")
