"""Queries over logs, diffs, snapshots and earlier results (as-of joins, reuse by hash)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from commitloom.functions import text as X
from commitloom.operators import reuse as R
from commitloom.plans.registry import register
from commitloom.sources import snapshots as S

c = F.col


def log_records(t):
    """One log record per commit, as the version-control log prints it."""
    one = F.struct(
        "path",
        F.concat(F.lit(":100644 100644 aaa bbb "), "change_type", F.lit("\t"), "path", F.lit("\n"), c("additions").cast("string"),
                 F.lit("\t"), c("deletions").cast("string"), F.lit("\t"), "path").alias("l"),
    )
    body = t.changes.groupBy("repo_id", "sha").agg(F.array_sort(F.collect_list(one)).alias("b"))
    header = F.concat_ws(
        "\x1f", F.format_string("%08d", c("sha")), "author_name", F.upper("author_email"),
        F.concat(c("committed_at").cast("string"), F.lit("T00:00:00+00:00")), "message",
    )
    return body.join(t.commits, ["repo_id", "sha"]).select(
        "repo_id", F.concat(header, F.lit("\n"), F.array_join(F.transform("b", lambda x: x["l"]), "\n")).alias("record")
    )


@register("s04_read_commit_log", """
SELECT co.repo_id, CAST(co.sha AS BIGINT) AS sha, co.author_email, co.committed_at, co.message, ch.path, ch.change_type, ch.additions, ch.deletions
FROM commits co JOIN changes ch ON co.repo_id = ch.repo_id AND co.sha = ch.sha""", "commits changes")
def s04(t):
    from commitloom.sources.gitlog import parse_changes, parse_commits

    records = log_records(t)
    commits = parse_commits(records).select("repo_id", "sha", "author_email", c("committed_at").cast("date").alias("committed_at"), "message")
    joined = commits.join(parse_changes(records), ["repo_id", "sha"])
    return joined.withColumn("sha", c("sha").cast("long"))


def diff_lines(t):
    """Every order's lines as a unified diff: a file header and one hunk per line."""
    rows = t.hunks.withColumn("n", c("end_") - c("start") + 1).select(
        "repo_id", "request_id", "path", "start",
        F.posexplode(F.array(
            F.concat(F.lit("+++ b/"), "path"),
            F.concat(F.lit("@@ -1,2 +"), c("start").cast("string"), F.lit(","), c("n").cast("string"), F.lit(" @@ x")),
            F.lit("+new text"),
        )).alias("i", "text"),
    )
    from pyspark.sql import Window

    order = Window.partitionBy("repo_id", "request_id").orderBy("path", "start", "text_key")
    keyed = rows.withColumn("text_key", F.concat(c("i").cast("string"), "text"))
    return keyed.withColumn("line_no", F.row_number().over(order)).select("repo_id", "request_id", "line_no", "text")


@register("s05_read_unified_diff", """SELECT DISTINCT repo_id, request_id, path, start, end_ AS "end" FROM hunks""", "hunks")
def s05(t):
    from commitloom.sources.diffs import read_unified_diff

    return read_unified_diff(diff_lines(t))


@register("w09_carry_forward", """
SELECT repo_id, request_id, path, count(*) * 3 AS lines FROM hunks GROUP BY 1, 2, 3""", "hunks")
def w09(t):
    from commitloom.sources.diffs import diff_paths

    return diff_paths(diff_lines(t)).groupBy("repo_id", "request_id", "path").agg(F.count("*").alias("lines"))


def snapshot_store(t):
    from commitloom.session import shared_folder

    return S.SnapshotStore(t.spark, f"{shared_folder(t.spark)}/snapshot-{uuid.uuid4().hex}")


def snapshot_tables(t):
    return {"files": t.repo_files.select("repo_id", "path", "language", "loc"), "entities": t.entities.select("repo_id", "key", "path")}


@register("s06_write_snapshot", """
SELECT f.repo_id, f.path, f.language, f.loc, count(e.key) AS entities FROM repo_files f
LEFT JOIN entities e ON f.repo_id = e.repo_id AND f.path = e.path GROUP BY 1, 2, 3, 4""", "repo_files entities")
def s06(t):
    """Writes two tables of both repositories, replaces one repository with part of its rows and again with all."""
    store, tables = snapshot_store(t), snapshot_tables(t)
    store.replace(tables)
    store.replace({name: rows.where((c("repo_id") == "F") & c("path").startswith("docs/")) for name, rows in tables.items()})
    store.replace({name: rows.where(c("repo_id") == "F") for name, rows in tables.items()})
    view = store.view()
    found = view.table("entities").groupBy("repo_id", "path").agg(F.count("*").alias("entities"))
    return view.table("files").join(found, ["repo_id", "path"], "left").withColumn("entities", F.coalesce("entities", F.lit(0)))


@register("s09_json_columns", """
SELECT repo_id, CAST(sum(files) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc, string_agg(language || '=' || loc, ',' ORDER BY loc DESC, language) AS languages
FROM (SELECT repo_id, language, count(*) AS files, sum(loc)::BIGINT AS loc FROM repo_files GROUP BY 1, 2) GROUP BY 1""", "repo_files")
def s09(t):
    from commitloom.operators.graph import language_stats

    parsed = S.parse_stats(S.stats_json(language_stats(t.repo_files)))
    named = F.transform("stats.languages", lambda x: F.concat_ws("=", x["language"], x["loc"].cast("string")))
    return parsed.select("repo_id", "stats.files", "stats.loc", F.array_join(named, ",").alias("languages"))


@register("s10_vector_column", """
SELECT vec_id, round(embedding[1], 5) AS first FROM embeddings WHERE len(embedding) = 64""")
def s10(t):
    rows = S.usable_vectors(t.embeddings, 64, "embedding")
    return rows.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@register("s11_delete_repo", """
SELECT 'files' AS name, repo_id, path FROM repo_files WHERE repo_id <> 'F' AND language <> 'go'
UNION ALL SELECT 'entities', repo_id, key FROM entities WHERE repo_id <> 'F'""", "repo_files entities")
def s11(t):
    """Deletes a repository from both tables, twice, then some rows of the other one's files."""
    store = snapshot_store(t)
    store.replace(snapshot_tables(t))
    store.delete("F")
    store.delete("F")
    store.delete_rows("files", "O", c("language") == "go")
    view = store.view()
    files = view.table("files").select(F.lit("files").alias("name"), "repo_id", "path")
    return files.unionByName(view.table("entities").select(F.lit("entities").alias("name"), "repo_id", c("key").alias("path")))


@register("a19_snapshot_fingerprint", """
+ pairs AS (SELECT lang, sha256(length(path) || ':' || path || sha1(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END)) AS h FROM texts WHERE doc_id % 5 <> 0)
SELECT lang AS repo_id, sha1(concat_ws(':', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT), sum(('0x' || substr(h, 16, 15))::BIGINT),
  sum(('0x' || substr(h, 31, 15))::BIGINT), sum(('0x' || substr(h, 46, 15))::BIGINT))) AS fingerprint FROM pairs GROUP BY 1""", "texts")
def a19(t):
    """The second snapshot's fingerprint, from the first one's state, the rows that went and those that came."""
    pairs = t.texts.select(c("lang").alias("repo_id"), "path", "text", c("doc_id"))
    first = pairs.select("repo_id", "path", "doc_id", F.sha1("text").alias("hash"))
    edited = pairs.where((c("doc_id") % 3 == 0) & (c("doc_id") % 5 != 0)).select("repo_id", "path", F.sha1(F.concat("text", F.lit("x"))).alias("hash"))
    gone = first.where((c("doc_id") % 3 == 0) | (c("doc_id") % 5 == 0))
    state = R.change_state(R.fingerprint_state(first), R.fingerprint_state(edited), R.fingerprint_state(gone))
    return R.fingerprint(state)


@register("j19_carry_entity_summaries", """
+ old_files AS (SELECT repo_id, path, sha1(path || loc) AS hash FROM repo_files),
new_files AS (SELECT repo_id, path, sha1(path || CASE WHEN language = 'go' THEN loc + 1 ELSE loc END) AS hash FROM repo_files)
SELECT e.repo_id, e.key, CASE WHEN o.hash IS NOT NULL AND e.type <> 'class' THEN 'about ' || e.name END AS summary FROM entities e
JOIN new_files n ON e.repo_id = n.repo_id AND e.path = n.path LEFT JOIN old_files o ON o.repo_id = n.repo_id AND o.path = n.path AND o.hash = n.hash""", "repo_files entities")
def j19_entities(t):
    """Entities of changed files (all of one language) lose their summaries; classes never had one."""
    hashed = lambda loc: t.repo_files.select("repo_id", "path", F.sha1(F.concat("path", loc.cast("string"))).alias("hash"))
    old_files, new_files = hashed(c("loc")), hashed(F.when(c("language") == "go", c("loc") + 1).otherwise(c("loc")))
    old = t.entities.select("repo_id", "key", "path", F.when(c("type") != "class", F.concat(F.lit("about "), "name")).alias("summary"))
    new = t.entities.select("repo_id", "key", "path").join(new_files, ["repo_id", "path"])
    return R.carry_entity_summaries(new, old, old_files, ["repo_id"]).select("repo_id", "key", "summary")


# equal texts share a hash: the stored vector of one copy serves all copies
@register("j18_reuse_by_hash", """
+ old AS (SELECT sha1(text) AS hash, min(vec_id) AS vec_id FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1)
SELECT d.doc_id, o.vec_id, o.vec_id IS NOT NULL AS reused FROM documents d LEFT JOIN old o ON sha1(d.text) = o.hash""", "texts")
def j18(t):
    hashed = t.documents.select("doc_id", F.sha1("text").alias("hash"))
    old = hashed.join(t.embeddings, c("doc_id") == c("vec_id")).select("hash", c("vec_id").alias("stored_id"), c("vec_id").alias("vector"))
    return R.reuse_by_hash(hashed, old).select("doc_id", c("vector").alias("vec_id"), "reused")


# documents of the same source and language as two snapshots: labels hold the old one's hash
SNAPSHOTS = """old AS (SELECT 'p' || d.doc_id AS path, sha1(d.text) AS hash, 'quality ' || l.quality AS summary FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
new AS (SELECT 'p' || doc_id AS path, sha1(CASE WHEN lang = 'fr' THEN text || 'x' ELSE text END) AS hash FROM documents WHERE lang <> 'de')"""


def snapshots(t):
    path = F.concat(F.lit("p"), c("doc_id").cast("string"))
    old = t.documents.join(t.labels, "doc_id").select(
        path.alias("path"), F.sha1("text").alias("hash"), F.concat(F.lit("quality "), c("quality").cast("string")).alias("summary")
    )
    edited = F.when(c("lang") == "fr", F.concat("text", F.lit("x"))).otherwise(c("text"))
    new = t.documents.where(c("lang") != "de").select(path.alias("path"), F.sha1(edited).alias("hash"))
    return new, old


@register("j19_carry_summaries", "WITH " + SNAPSHOTS + """
SELECT n.path, n.hash, o.summary FROM new n LEFT JOIN old o ON n.path = o.path AND n.hash = o.hash""")
def j19(t):
    return R.carry_summaries(*snapshots(t))


@register("u09_file_set_difference", "WITH " + SNAPSHOTS + """
SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.hash = o.hash THEN 'unchanged' ELSE 'changed' END AS state
FROM new n FULL JOIN old o ON n.path = o.path""")
def u09(t):
    return R.file_set_difference(*snapshots(t))


_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@register("j20_latest_valid_answer", """
+ q AS (SELECT doc_id AS query_id, """ + _NORM.format("text") + """ AS n FROM documents),
log AS (SELECT doc_id AS created_at, lang AS answer, source AS provider, """ + _NORM.format("text") + """ AS n FROM documents WHERE source <> 'src0' AND lang <> 'de')
SELECT q.query_id, max(l.created_at) AS answered_at, arg_max(l.answer, l.created_at) AS answer, arg_max(l.provider, l.created_at) AS provider
FROM q LEFT JOIN log l ON q.n = l.n AND l.created_at < q.query_id GROUP BY 1""", "texts")
def j20(t):
    asked = t.documents.select(c("doc_id").alias("query_id"), c("text").alias("question"), c("doc_id").alias("asked_at"))
    log = t.documents.select(
        c("text").alias("question"), F.when(c("lang") != "de", c("lang")).alias("answer"),
        F.when(c("source") != "src0", c("source")).alias("provider"), c("doc_id").alias("created_at"),
    )
    return R.latest_valid_answer(asked, log).select("query_id", "answered_at", "answer", "provider")


@register("j21_latest_valid_impact", """
+ req AS (SELECT repo_id, status AS input_hash, job_id AS request_id FROM jobs),
snap AS (SELECT repo_id, min(created_at) + INTERVAL 1 DAY AS snapshot_at FROM jobs GROUP BY 1),
newest AS (SELECT repo_id, input_hash, run_id, explanation FROM (SELECT j.repo_id, j.status AS input_hash, j.job_id AS run_id, CASE WHEN value > 2 THEN 'ok ' || status END AS explanation,
  row_number() OVER (PARTITION BY j.repo_id, j.status ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs j JOIN snap s ON j.repo_id = s.repo_id WHERE created_at > snapshot_at) WHERE rn = 1)
SELECT r.repo_id, r.request_id, n.run_id FROM req r JOIN newest n ON r.repo_id = n.repo_id AND r.input_hash = n.input_hash WHERE n.explanation IS NOT NULL""", "jobs")
def j21(t):
    requests = t.jobs.select("repo_id", c("status").alias("input_hash"), c("job_id").alias("request_id"))
    runs = t.jobs.select(
        "repo_id", c("status").alias("input_hash"), c("job_id").alias("run_id"), "created_at", c("value").alias("risk_score"),
        F.when(c("value") > 2, F.concat(F.lit("ok "), "status")).alias("explanation"),
    )
    snap = t.jobs.groupBy("repo_id").agg((F.min("created_at") + F.expr("interval 1 day")).alias("snapshot_at"))
    return R.latest_valid_impact(requests, runs, snap).select("repo_id", "request_id", "run_id")


@register("j22_find_duplicate_repo", """
+ k AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http://', 'https://'), '^https://www[.]', 'https://'), '/+$', ''), '[.]git$', '')) AS key FROM pages)
SELECT a.page_id, min(b.page_id) AS duplicate_of FROM k a JOIN k b ON a.key = b.key GROUP BY a.page_id""", "hrefs")
def j22(t):
    url = F.regexp_replace("url", "[?#].*$", "")
    new = t.pages.select("page_id", F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".git/")).alias("url"), F.lit(None).cast("string").alias("branch"))
    known = t.pages.select(c("page_id").alias("repo_id"), url.alias("url"), F.lit("main").alias("branch"), F.lit(None).cast("timestamp").alias("last_sync"))
    return R.find_duplicate_repos(new, known).select("page_id", "duplicate_of")


def written_tree(t):
    """All source files as a tree of real files in the shared folder, one brand's folder under an ignored name."""
    from commitloom.session import shared_folder

    base = f"{shared_folder(t.spark)}/tree-{uuid.uuid4().hex}"

    def write(batches):
        import os

        import pandas as pd
        from pyarrow import fs as pafs

        from commitloom.sources.files import file_system

        for batch in batches:
            for repo_id, path, content in zip(batch["repo_id"], batch["path"], batch["content"], strict=True):
                system, root = file_system(base)
                whole = f"{root}/{repo_id}/{path}"
                system.create_dir(os.path.dirname(whole), recursive=True)
                with system.open_output_stream(whole) as stream:
                    stream.write(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    named = t.sources.withColumn("path", F.regexp_replace("path", "^src/Brand_13/", "src/node_modules/"))
    named.select("repo_id", "path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    repos = named.select("repo_id").distinct()
    return repos.withColumn("folder", F.concat(F.lit(base + "/"), "repo_id"))


@register("s01_scan_source_files", """
SELECT repo_id, path, language, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS digest FROM source_lines
WHERE path NOT LIKE 'src/Brand_13/%' GROUP BY 1, 2, 3""", "source_lines")
def s01(t):
    """Scans the tree that Spark wrote."""
    from commitloom.sources.files import scan_source_files

    return scan_source_files(written_tree(t)).select("repo_id", "path", "language", F.sha2("content", 256).alias("digest"))
