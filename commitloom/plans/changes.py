"""Commit-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitloom.functions import paths as P
from commitloom.operators import history as H
from commitloom.operators.graph import co_change_symmetric
from commitloom.operators.skew import top_per_group
from commitloom.plans.registry import register

c = F.col

METRICS = """metrics AS (
  SELECT ch.repo_id, ch.path, CAST(sum(additions + deletions) AS BIGINT) AS churn, count(*) AS commit_count,
         count(DISTINCT author_email) AS authors, max(committed_at) AS last_modified
  FROM changes ch JOIN commits co ON ch.repo_id = co.repo_id AND ch.sha = co.sha
  GROUP BY ch.repo_id, ch.path)"""

# the current files of the two repositories differ: one has lost its documents, the other its tests
PAIRS = """live_changes AS (SELECT * FROM changes WHERE NOT (repo_id = 'O' AND path LIKE 'docs/%') AND NOT (repo_id = 'F' AND path LIKE '%/tests/%')),
pairs AS (
  SELECT a.repo_id, a.path AS file_a, b.path AS file_b, count(*) AS together
  FROM live_changes a JOIN live_changes b ON a.repo_id = b.repo_id AND a.sha = b.sha AND a.path < b.path
  JOIN (SELECT repo_id, sha FROM live_changes GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 40) s
    ON s.repo_id = a.repo_id AND s.sha = a.sha
  GROUP BY 1, 2, 3)"""

CO = PAIRS + """,
co AS (SELECT repo_id, 'f:' || file_a AS source, 'f:' || file_b AS target, 'CO_CHANGED' AS type,
              CAST(together AS DOUBLE) AS weight
       FROM pairs WHERE together >= 2)"""

TOTALS = """totals AS (
  SELECT co.*, t.additions, t.deletions, t.files_changed FROM commits co JOIN (
    SELECT repo_id, sha, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
           count(*) AS files_changed FROM changes GROUP BY 1, 2) t ON co.repo_id = t.repo_id AND co.sha = t.sha)"""


def metrics(t):
    return H.file_history_metrics(t.changes, t.commits)


def totals(t):
    return t.commits.join(H.commit_totals(t.changes), ["repo_id", "sha"])


def current_files(t):
    gone = ((c("repo_id") == "O") & c("path").startswith("docs/")) | ((c("repo_id") == "F") & c("path").contains("/tests/"))
    return t.repo_files.where(~gone)


def co_change(t):
    return H.co_change(t.changes, current_files(t), t.commits)


def all_files(t):
    """Every file of the tree in both repositories, also those without history."""
    return t.tree.select("path", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("repo_id"))


@register("a01_file_history_metrics", "+ " + METRICS + " SELECT * FROM metrics", "changes commits")
def a01(t):
    return metrics(t)


@register("j09_co_change", "+ " + CO + " SELECT * FROM co", "changes")
def j09(t):
    return co_change(t)


@register("j14_commits_touching", """
SELECT co.repo_id, co.sha, co.author_email, co.committed_at FROM commits co
WHERE EXISTS (SELECT 1 FROM changes ch JOIN repo_files f ON ch.repo_id = f.repo_id AND ch.path = f.path
              WHERE ch.repo_id = co.repo_id AND ch.sha = co.sha AND f.path LIKE '%/tests/%')""",
          "commits changes repo_files")
def j14(t):
    tests = t.repo_files.where(P.is_test_path(c("path"))).select("repo_id", "path")
    return H.commits_touching(t.commits, t.changes, tests).select("repo_id", "sha", "author_email", "committed_at")


@register("j15_commit_detail", """
SELECT repo_id, path, sha, author_name, message, committed_at, change_type, additions, deletions FROM (
  SELECT ch.*, co.author_name, co.message, co.committed_at,
         row_number() OVER (PARTITION BY ch.repo_id, ch.path ORDER BY committed_at DESC, ch.sha) AS rn
  FROM changes ch JOIN commits co ON ch.repo_id = co.repo_id AND ch.sha = co.sha) WHERE rn <= 20""",
          "changes commits")
def j15(t):
    return H.commit_detail(t.changes, t.commits).select(
        "repo_id", "path", "sha", "author_name", "message", "committed_at", "change_type", "additions", "deletions"
    )


@register("a11_weekly_activity", "+ " + TOTALS + """,
w AS (SELECT repo_id, CAST(date_trunc('week', committed_at) AS DATE) AS week, count(*) AS commits,
        CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM totals GROUP BY 1, 2),
cal AS (SELECT repo_id, CAST(unnest(generate_series(CAST(min(week) AS TIMESTAMP),
          CAST(max(week) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM w GROUP BY repo_id)
SELECT cal.repo_id, cal.week, coalesce(commits, 0) AS commits, coalesce(additions, 0) AS additions,
  coalesce(deletions, 0) AS deletions FROM cal LEFT JOIN w ON cal.repo_id = w.repo_id AND cal.week = w.week""",
          "changes commits")
def a11(t):
    return H.weekly_activity(totals(t))


@register("a12_contributors", "+ " + TOTALS + """
SELECT repo_id, author_email, min(author_name) AS author_name, count(*) AS commits,
    CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
    min(committed_at) AS first_commit, max(committed_at) AS last_commit
  FROM totals GROUP BY 1, 2""", "changes commits")
def a12(t):
    return H.contributors(totals(t))


@register("a13_history_totals", "+ " + TOTALS + """
SELECT repo_id, count(*) AS commits, CAST(sum(additions) AS BIGINT) AS additions,
  CAST(sum(deletions) AS BIGINT) AS deletions, count(DISTINCT author_email) AS contributors,
  min(committed_at) AS first_commit, max(committed_at) AS last_commit FROM totals GROUP BY 1""", "changes commits")
def a13(t):
    return H.history_totals(totals(t))


@register("a14_commit_totals", "+ " + TOTALS + """
SELECT repo_id, sha, author_email, additions, deletions, files_changed, files_changed AS files_kept
FROM totals""", "changes commits")
def a14(t):
    kept = H.kept_changes(t.changes).groupBy("repo_id", "sha").agg(F.count("*").alias("files_kept"))
    twice = t.commits.unionByName(t.commits)  # a re-read log repeats commits
    return (
        H.dedupe_commits(twice).join(H.commit_totals(t.changes), ["repo_id", "sha"]).join(kept, ["repo_id", "sha"])
        .select("repo_id", "sha", "author_email", "additions", "deletions", "files_changed", "files_kept")
    )


@register("a15_developers", """
SELECT repo_id, author_email, arg_min(author_name, sha) AS author_name FROM commits GROUP BY 1, 2""", "commits")
def a15(t):
    return H.developers(t.commits)


@register("a17_co_change_confidence", "+ " + CO + ", " + METRICS + """,
dirs AS (SELECT repo_id, source AS key, target AS other, weight FROM co
         UNION ALL SELECT repo_id, target, source, weight FROM co)
SELECT repo_id, request_id, key, weight, confidence FROM (
  SELECT b.repo_id, b.key AS request_id, b.other AS key, b.weight, round(least(1, b.weight / greatest(1, m.commit_count)), 6) AS confidence,
    row_number() OVER (PARTITION BY b.repo_id, b.key ORDER BY b.weight DESC, b.other) AS rn
  FROM dirs b JOIN metrics m ON b.repo_id = m.repo_id AND b.key = 'f:' || m.path) WHERE rn <= 15""", "changes commits")
def a17(t):
    from commitloom.operators.impact import co_change_partners

    m = metrics(t)
    targets = m.select("repo_id", P.file_key(c("path")).alias("request_id"), P.file_key(c("path")).alias("file_key"), "commit_count")
    return co_change_partners(targets, co_change(t), 15).select(
        "repo_id", "request_id", "key", "weight", F.round("confidence", 6).alias("confidence")
    )


@register("a21_commit_percentile", "+ " + METRICS + """
SELECT DISTINCT repo_id, commit_count, round(cume_dist() OVER (PARTITION BY repo_id ORDER BY commit_count), 6) AS percentile
FROM (SELECT r.repo_id, coalesce(m.commit_count, 0) AS commit_count FROM tree f CROSS JOIN (VALUES ('F'), ('O')) AS r(repo_id)
  LEFT JOIN metrics m ON m.repo_id = r.repo_id AND m.path = f.path)""", "changes commits tree")
def a21(t):
    return H.commit_percentile(metrics(t), all_files(t)).withColumn("percentile", F.round("percentile", 6))


@register("a23_repo_counts", """
SELECT r.repo_id, (SELECT count(DISTINCT author_email) FROM commits x WHERE x.repo_id = r.repo_id) AS developers,
  (SELECT count(*) FROM commits x WHERE x.repo_id = r.repo_id) AS commits,
  (SELECT count(*) FROM changes x WHERE x.repo_id = r.repo_id) AS changes,
  (SELECT count(*) FROM entities x WHERE x.repo_id = r.repo_id) AS entities
FROM (SELECT DISTINCT repo_id FROM commits) r""", "commits changes entities")
def a23(t):
    return H.repo_counts(developers=H.developers(t.commits), commits=t.commits, changes=t.changes, entities=t.entities)


@register("a26_hidden_coupling", "+ " + CO + """
SELECT repo_id, key, sum(weight) AS coupling, count(*) AS partners FROM (
  SELECT repo_id, source AS key, weight FROM co UNION ALL SELECT repo_id, target, weight FROM co) GROUP BY 1, 2""",
          "changes")
def a26(t):
    return co_change_symmetric(co_change(t)).groupBy("repo_id", c("source").alias("key")).agg(
        F.sum("weight").alias("coupling"), F.count("*").alias("partners")
    )


@register("u03_co_change_symmetric", "+ " + CO + """
SELECT repo_id, source, target, type, weight FROM co UNION ALL SELECT repo_id, target, source, type, weight FROM co""",
          "changes")
def u03(t):
    return co_change_symmetric(co_change(t))


@register("k01_top_churn", "+ " + METRICS + """
SELECT repo_id, path, churn, commit_count, authors FROM (SELECT *, row_number() OVER (PARTITION BY repo_id
  ORDER BY churn DESC, path) AS rn FROM metrics WHERE churn > 0) WHERE rn <= 15""", "changes commits")
def k01(t):
    return top_per_group(metrics(t).where(c("churn") > 0), ["repo_id"], [c("churn").desc(), c("path")], 15).select(
        "repo_id", "path", "churn", "commit_count", "authors"
    )


@register("k02_newest_commits", """
+ r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, sha) AS position FROM commits)
SELECT r.repo_id, r.sha, r.position, r.committed_at, ch.path, ch.change_type FROM r
LEFT JOIN changes ch ON r.position <= 60 AND r.repo_id = ch.repo_id AND r.sha = ch.sha WHERE r.position <= 120""",
          "commits changes")
def k02(t):
    return H.recent_with_files(t.commits, t.changes).select(
        "repo_id", "sha", c("position").cast("long").alias("position"), "committed_at", "path", "change_type"
    )


@register("s08_predicate_scan", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 250000 AND o_orderdate IS NOT NULL
ORDER BY o_orderdate DESC, o_orderkey LIMIT 2000""")
def s08(t):
    return (
        t.orders.where(c("o_orderstatus").isin("F", "O") & (c("o_totalprice") > 250000) & c("o_orderdate").isNotNull())
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .orderBy(c("o_orderdate").desc(), "o_orderkey").limit(2000)
    )


@register("w01_latest_job_per_repo", """
SELECT repo_id, job_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY repo_id
  ORDER BY created_at DESC, job_id) AS rn FROM jobs) WHERE rn = 1""", "jobs")
def w01(t):
    return top_per_group(t.jobs, ["repo_id"], [c("created_at").desc(), c("job_id")], 1).select(
        "repo_id", "job_id", "status", "created_at"
    )


@register("w07_relative_to_max", "+ " + METRICS + """
SELECT repo_id, path, round(churn / max(churn) OVER (PARTITION BY repo_id), 6) AS relative FROM metrics""",
          "changes commits")
def w07(t):
    return H.relative_to_max(metrics(t), "churn", "relative").select(
        "repo_id", "path", F.round("relative", 6).alias("relative")
    )


@register("w10_first_last", """
SELECT repo_id, min(committed_at) AS first_commit, arg_min(sha, (committed_at, sha)) AS first_sha,
  max(committed_at) AS last_commit, arg_max(sha, (committed_at, sha)) AS last_sha FROM commits GROUP BY 1""", "commits")
def w10(t):
    return H.first_last(t.commits)


@register("w11_recent_per_repo", """
SELECT repo_id, job_id, status, created_at, position FROM (SELECT *, row_number() OVER (PARTITION BY repo_id
  ORDER BY created_at DESC, job_id) AS position FROM jobs) WHERE position <= 25""", "jobs")
def w11(t):
    return top_per_group(t.jobs, ["repo_id"], [c("created_at").desc(), c("job_id")], 25, rank="position").select(
        "repo_id", "job_id", "status", "created_at", c("position").cast("long").alias("position")
    )


@register("r13_stale_repos", """
SELECT repo_id, last_sync, last_sync < (SELECT max(created_at) FROM jobs) - INTERVAL 10 MINUTE AS stale
FROM (SELECT repo_id, max(created_at) AS last_sync FROM jobs GROUP BY 1)""", "jobs")
def r13(t):
    from commitloom.operators.reuse import stale_repos

    now = t.jobs.agg(F.max("created_at")).scalar()
    return stale_repos(t.jobs.groupBy("repo_id").agg(F.max("created_at").alias("last_sync")), now)
