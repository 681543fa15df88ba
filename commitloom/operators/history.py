"""Commit-history analytics: file metrics, co-change, activity, contributors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitloom.functions.scores import week_start
from commitloom.operators.skew import share_at_most, top_per_group

REPO = ("repo_id",)


def file_history_metrics(changes: DataFrame, commits: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Churn, commit count, distinct authors and last change of every file that has history."""
    dated = changes.join(commits.select(*by, "sha", "author_email", "committed_at"), [*by, "sha"])
    # one row per (file, author) first: a file touched by everyone is counted in many tasks
    per_author = dated.groupBy(*by, "path", "author_email").agg(
        F.sum(F.col("additions") + F.col("deletions")).alias("churn"),
        F.count("*").alias("commit_count"),
        F.max("committed_at").alias("last_modified"),
    )
    return per_author.groupBy(*by, "path").agg(
        F.sum("churn").alias("churn"),
        F.sum("commit_count").alias("commit_count"),
        F.count("author_email").alias("authors"),
        F.max("last_modified").alias("last_modified"),
    )


def commit_totals(changes: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    return changes.groupBy(*by, "sha").agg(
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.count("*").alias("files_changed"),
    )


def dedupe_commits(commits: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    return commits.dropDuplicates([*by, "sha"])


def kept_changes(changes: DataFrame, limit: int | None = None, by: Sequence[str] = REPO) -> DataFrame:
    """The changed files of every commit: all, or the first ``limit`` in path order."""
    return changes if limit is None else top_per_group(changes, [*by, "sha"], [F.col("path")], limit)


def co_change_pairs(
    changes: DataFrame, files: DataFrame, min_files: int = 2, max_files: int = 40,
    by: Sequence[str] = REPO,
) -> DataFrame:
    """How many commits touch both files of a pair, over commits of ``min_files..max_files`` files.

    ``changes`` holds a file once per commit. A file counts as current in its own repository; a ``files``
    table without repositories stands for all of them.

    A commit above the limit never reaches one task whole: the ranked filter drops its rows from
    the ``max_files + 2``-nd on before the shuffle, and the rest only shows that it is too big.
    """
    keys = [c for c in [*by, "path"] if c in files.columns]
    current = changes.join(files.select(*keys).distinct(), keys, "left_semi").select(*by, "sha", "path")
    bounded = top_per_group(current, [*by, "sha"], [F.col("path")], max_files + 1)
    sets = (
        bounded.groupBy(*by, "sha")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
        .where(F.size("paths").between(min_files, max_files))
    )
    pairs = F.flatten(
        F.transform(
            F.col("paths"),
            lambda a, i: F.transform(
                F.slice(F.col("paths"), i + 2, F.size("paths")),
                lambda b: F.struct(a.alias("file_a"), b.alias("file_b")),
            ),
        )
    )
    return (
        sets.select(*by, F.explode(pairs).alias("pair"))
        .select(*by, "pair.file_a", "pair.file_b")
        .groupBy(*by, "file_a", "file_b")
        .agg(F.count("*").alias("together"))
    )


def co_change(
    changes: DataFrame, files: DataFrame, commits: DataFrame, min_pairs: int | None = None,
    top: int | None = None, few_commits: int = 30, by: Sequence[str] = REPO,
) -> DataFrame:
    """CO_CHANGED edges: the pairs seen at least ``min_pairs`` times, or the ``top`` strongest of each repository.

    Without ``min_pairs`` a repository with fewer than ``few_commits`` commits keeps single sightings.
    """
    pairs = co_change_pairs(changes, files, by=by)
    if min_pairs is not None:
        strong = pairs.where(F.col("together") >= min_pairs)
    else:
        sizes = commits.groupBy(*by).agg(F.count("*").alias("_commits"))
        needed = F.when(F.col("_commits") < few_commits, 1).otherwise(2)
        strong = pairs.join(sizes, list(by)).where(F.col("together") >= needed).drop("_commits")
    kept = strong if top is None else top_per_group(strong, by, [F.col("together").desc(), F.col("file_a"), F.col("file_b")], top)
    return kept.select(
        *by, F.concat(F.lit("f:"), "file_a").alias("source"), F.concat(F.lit("f:"), "file_b").alias("target"),
        F.lit("CO_CHANGED").alias("type"), F.col("together").cast("double").alias("weight"),
    )


def newest_commits(commits: DataFrame, limit: int, by: Sequence[str] = REPO) -> DataFrame:
    return top_per_group(commits, by, [F.col("committed_at").desc(), F.col("sha")], limit)


def weekly_activity(commits: DataFrame, max_weeks: int | None = None, by: Sequence[str] = REPO) -> DataFrame:
    """Commits and changed lines per week from the first to the last week, or the ``max_weeks``-th; empty weeks included."""
    weeks = commits.groupBy(*by, week_start(F.col("committed_at")).alias("week")).agg(
        F.count("*").alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
    )
    calendar = (
        weeks.groupBy(*by)
        .agg(F.min("week").alias("_first"), F.max("week").alias("_last"))
        .withColumn("_until", F.col("_last") if max_weeks is None else F.least("_last", F.date_add("_first", 7 * (max_weeks - 1))))
        .select(*by, F.explode(F.expr("sequence(_first, _until, interval 7 days)")).alias("week"))
    )
    zero = F.lit(0).cast("long")
    return calendar.join(weeks, [*by, "week"], "left").select(
        *by, "week",
        *[F.coalesce(F.col(x), zero).alias(x) for x in ("commits", "additions", "deletions")],
    )


def contributor_totals(commits: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    return commits.groupBy(*by, "author_email").agg(
        F.min("author_name").alias("author_name"),
        F.count("*").alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.min("committed_at").alias("first_commit"),
        F.max("committed_at").alias("last_commit"),
    )


def contributors(commits: DataFrame, top: int | None = None, by: Sequence[str] = REPO) -> DataFrame:
    """Totals of every contributor, or of the ``top`` most active ones of each repository."""
    totals = contributor_totals(commits, by)
    return totals if top is None else top_per_group(totals, by, [F.col("commits").desc(), F.col("author_email")], top)


def history_totals(commits: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    per_author = contributor_totals(commits, by)
    return per_author.groupBy(*by).agg(
        F.sum("commits").alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.count("*").alias("contributors"),
        F.min("first_commit").alias("first_commit"),
        F.max("last_commit").alias("last_commit"),
    )


def developers(commits: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """One row per author e-mail with the name used in the first commit seen."""
    first = F.min(F.struct("committed_at", "sha", "author_name")).alias("_first")
    return commits.groupBy(*by, "author_email").agg(first).select(
        *by, "author_email", F.col("_first.author_name").alias("author_name")
    )


def commits_touching(commits: DataFrame, changes: DataFrame, paths: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Commits with a changed file among ``paths`` (columns: keys, path)."""
    hit = changes.join(paths, [*by, "path"], "left_semi")
    return commits.join(hit, [*by, "sha"], "left_semi")


def commit_detail(changes: DataFrame, commits: DataFrame, top: int = 20, by: Sequence[str] = REPO) -> DataFrame:
    """The newest ``top`` commits of every file with author and change size."""
    full = changes.join(
        commits.select(*by, "sha", "author_name", "message", "committed_at"), [*by, "sha"]
    )
    return top_per_group(full, [*by, "path"], [F.col("committed_at").desc(), F.col("sha")], top)


def recent_with_files(
    commits: DataFrame, changes: DataFrame, shown: int = 120, detailed: int = 60, by: Sequence[str] = REPO
) -> DataFrame:
    """The newest ``shown`` commits; the newest ``detailed`` of them carry their file list rows."""
    recent = top_per_group(
        commits, by, [F.col("committed_at").desc(), F.col("sha")], shown, rank="position"
    )
    wanted = recent.where(F.col("position") <= detailed).select(*by, "sha")
    files = changes.join(wanted, [*by, "sha"], "left_semi")
    return recent.join(files.select(*by, "sha", "path", "change_type"), [*by, "sha"], "left")


def commit_percentile(metrics: DataFrame, files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Per repository and commit count: the share of all its ``files`` changed at most so often, unchanged ones included."""
    counts = files.select(*by, "path").distinct().join(metrics.select(*by, "path", "commit_count"), [*by, "path"], "left")
    return share_at_most(counts.withColumn("commit_count", F.coalesce("commit_count", F.lit(0).cast("long"))), by, "commit_count", "percentile")


def relative_to_max(df: DataFrame, score: str, out: str, by: Sequence[str] = REPO) -> DataFrame:
    """``score`` over the largest score of its group; the maximum is pre-aggregated and joined."""
    if not by:
        return df.withColumn(out, F.col(score) / df.agg(F.max(score)).scalar())
    top = df.groupBy(*by).agg(F.max(score).alias("_max"))
    return df.join(top, list(by)).withColumn(out, F.col(score) / F.col("_max")).drop("_max")


def repo_counts(by: Sequence[str] = REPO, **tables: DataFrame) -> DataFrame:
    """Row count of every given table per repository, one column per table."""
    parts = [
        df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        for name, df in tables.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    names = list(tables)
    return rows.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    )


def latest_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int = 1) -> DataFrame:
    return top_per_group(df, by, order, k)


def first_last(commits: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    return commits.groupBy(*by).agg(
        F.min(F.struct("committed_at", "sha")).alias("_f"), F.max(F.struct("committed_at", "sha")).alias("_l")
    ).select(
        *by, F.col("_f.committed_at").alias("first_commit"), F.col("_f.sha").alias("first_sha"),
        F.col("_l.committed_at").alias("last_commit"), F.col("_l.sha").alias("last_sha"),
    )


def carry_forward(df: DataFrame, by: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """The last non-null ``value`` at or before each row."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(window))
