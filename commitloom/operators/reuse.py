"""Reuse of earlier work: by hash, by (path, hash), by question or input after a snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom.functions.text import normalize_question
from commitloom.functions.urls import repo_key

REPO = ("repo_id",)


def reuse_by_hash(chunks: DataFrame, old: DataFrame, value: str = "vector", by: Sequence[str] = ()) -> DataFrame:
    """Chunks with the stored ``value`` of an equal hash; ``reused`` is false for the to-do list.

    ``old`` is reduced to one row per hash first, so repeated content does not multiply.
    """
    known = old.groupBy(*by, "hash").agg(F.min_by(value, "stored_id").alias(value))
    joined = chunks.join(known, [*by, "hash"], "left")
    return joined.withColumn("reused", F.col(value).isNotNull())


def carry_summaries(new: DataFrame, old: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keeps a file's summary when path and content hash are unchanged."""
    kept = old.where(F.col("summary").isNotNull()).select(*by, "path", "hash", "summary")
    return new.drop("summary").join(kept, [*by, "path", "hash"], "left")


def carry_entity_summaries(new: DataFrame, old: DataFrame, old_files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keeps an entity's summary when its key survives and its file's hash is unchanged.

    ``new`` carries the new file ``hash``; ``old`` holds (keys, key, path, summary).
    """
    kept = (
        old.where(F.col("summary").isNotNull()).select(*by, "key", "path", "summary")
        .join(old_files.select(*by, "path", "hash"), [*by, "path"])
        .select(*by, "key", "hash", "summary")
    )
    return new.drop("summary").join(kept, [*by, "key", "hash"], "left")


def file_set_difference(new: DataFrame, old: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """added / removed / changed / unchanged per path between two snapshots."""
    a = new.select(*by, "path", F.col("hash").alias("_new"))
    b = old.select(*by, "path", F.col("hash").alias("_old"))
    state = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_new") == F.col("_old"), "unchanged").otherwise("changed")
    )
    return a.join(b, [*by, "path"], "full").select(*by, "path", state.alias("state"))


def latest_valid_answer(
    questions: DataFrame, log: DataFrame, snapshots: DataFrame | None = None, by: Sequence[str] = (),
    considered: int | None = None,
) -> DataFrame:
    """As-of join: the newest usable answer to the same question since the snapshot.

    ``questions`` holds (keys, query_id, question, asked_at); ``log`` holds (keys, question, answer,
    provider, created_at). Of the log rows after the snapshot with a provider all are looked at, or the newest
    ``considered`` per repository.
    ``snapshots`` holds (keys, snapshot_at) and needs ``by``.
    """
    from commitloom.operators.skew import top_per_group

    rows = log.where(F.col("provider").isNotNull())
    if snapshots is not None:
        rows = rows.join(snapshots, list(by)).where(F.col("created_at") > F.col("snapshot_at")).drop("snapshot_at")
    if considered is not None:
        rows = top_per_group(rows, by, [F.col("created_at").desc(), F.col("question")], considered)
    usable = rows.where(
        F.col("answer").isNotNull() & (F.col("answer") != "") & ~F.col("answer").contains("**Error:**")
    ).select(*by, normalize_question(F.col("question")).alias("normalized"), "answer", "provider", F.col("created_at").alias("answered_at"))
    asked = questions.withColumn("normalized", normalize_question(F.col("question")))
    before = asked.join(usable, [*by, "normalized"]).where(F.col("answered_at") < F.col("asked_at"))
    latest = before.groupBy(*by, "query_id").agg(
        F.max(F.struct("answered_at", "answer", "provider")).alias("m")
    )
    return asked.drop("normalized").join(
        latest.select(*by, "query_id", "m.answer", "m.provider", "m.answered_at"), [*by, "query_id"], "left"
    )


def latest_valid_impact(requests: DataFrame, runs: DataFrame, snapshots: DataFrame, by: Sequence[str] = REPO, need_explanation: bool = True) -> DataFrame:
    """The newest saved run of the same input after the snapshot, if it can be reused.

    Only the newest run counts: when it is unusable the request has no reusable run.
    """
    fresh = runs.join(snapshots, list(by)).where(F.col("created_at") > F.col("snapshot_at"))
    newest = fresh.groupBy(*by, "input_hash").agg(
        F.max(F.struct("created_at", "run_id", "risk_score", "explanation")).alias("m")
    ).select(*by, "input_hash", "m.*")
    explained = F.col("explanation").isNotNull() if need_explanation else F.lit(True)
    usable = newest.where(
        explained & ~F.coalesce(F.startswith("explanation", F.lit("_AI explanation unavailable")), F.lit(False))
    )
    return requests.join(usable, [*by, "input_hash"])


def impact_input_hash(targets: Column, description: Column, diff: Column) -> Column:
    """Identity of an impact request: sorted targets, lower-cased description, trimmed diff."""
    return F.sha1(
        F.to_json(
            F.array(
                F.to_json(F.array_sort(targets)), F.lower(F.trim(F.coalesce(description, F.lit("")))),
                F.trim(F.coalesce(diff, F.lit(""))),
            )
        )
    )


#: Numbers of 60 bits that a (path, hash) pair adds to a fingerprint.
_PARTS = [f"s{i}" for i in range(4)]


def fingerprint_state(files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """(keys, n, s0 .. s3): sums over all (path, hash) pairs of a repository, each pair a wide hash of four numbers.

    Sums do not depend on order and are made before anything is shuffled; they are exact, so states add and subtract. Null
    paths and hashes read as empty.
    """
    pair = F.sha2(F.concat(F.length(F.coalesce("path", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("path", F.lit("")), F.coalesce("hash", F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(pair, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    return files.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(number(i)).cast("decimal(38,0)").alias(c) for i, c in enumerate(_PARTS)])


def change_state(state: DataFrame, added: DataFrame, removed: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """The state after the rows of ``added`` came and those of ``removed`` went, from their states alone."""
    less = removed.select(*by, *[(-F.col(c)).alias(c) for c in ("n", *_PARTS)])
    every = state.unionByName(added).unionByName(less).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", *_PARTS)])
    return every.select(*by, F.col("n").cast("long").alias("n"), *[F.col(c).cast("decimal(38,0)").alias(c) for c in _PARTS]).where(F.col("n") > 0)


def fingerprint(state: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    return state.select(*by, F.sha1(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", *_PARTS)])).alias("fingerprint"))


def snapshot_fingerprint(files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """A hash of all (path, hash) pairs of a repository, independent of their order."""
    return fingerprint(fingerprint_state(files, by), by)


def find_duplicate_repos(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The first known repository with the same canonical address (and branch, where one is asked for)."""
    a = new.withColumn("identity", repo_key(F.col("url")))
    b = existing.select(
        repo_key(F.col("url")).alias("identity"), F.col("repo_id").alias("duplicate_of"),
        F.col("branch").alias("_branch"), "last_sync",
    )
    # the first of each branch and the first of all, so a popular address meets one row, not all of its kind
    first = F.min(F.struct("duplicate_of", "last_sync")).alias("_first")
    known = b.where(F.col("_branch").isNotNull()).groupBy("identity", "_branch").agg(first).unionByName(b.groupBy("identity").agg(first).withColumn("_branch", F.lit(None).cast("string")))
    same = (F.col("k.identity") == F.col("a.identity")) & F.col("k._branch").eqNullSafe(F.col("a.branch"))
    return a.alias("a").join(known.alias("k"), same).select(*[F.col(f"a.{c}") for c in new.columns], F.col("k._first.duplicate_of"), F.col("k._first.last_sync"))


def stale_repos(repos: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """A repository is stale when never synced or last synced more than ``minutes`` before ``now``."""
    limit = now - F.make_dt_interval(mins=F.lit(minutes))
    return repos.select(
        "repo_id", "last_sync", (F.col("last_sync").isNull() | (F.col("last_sync") < limit)).alias("stale")
    )
