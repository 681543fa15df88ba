from __future__ import annotations

import os

from pyspark.sql import functions as F

from commitloom.functions import paths as P
from commitloom.functions import urls as U
from commitloom.operators import history as H
from commitloom.operators import impact as I
from commitloom.operators import imports as M
from commitloom.sources import diffs, files, gitlog, snapshots

LOG = (
    "\x1eaaaaaaa1\x1fAnn\x1fAnn@X.org\x1f2024-01-02T10:00:00+00:00\x1ffirst\n"
    ":000000 100644 000 abc A\tsrc/a.py\n:000000 100644 000 abc A\tlogo.png\n\n10\t0\tsrc/a.py\n-\t-\tlogo.png\n"
    "\x1ebbbbbbb2\x1f\x1f\x1f2024-01-03T10:00:00+00:00\x1f\n:100644 000000 abc 000 D\tsrc/a.py\n\n0\t10\tsrc/a.py\n"
    "\x1eccc\x1fshort\x1fs@x\x1f2024-01-03T10:00:00+00:00\x1fignored\n"
    "\x1eddddddd4\x1fBob\x1fb@x.org\x1f2024-01-04T10:00:00+00:00\x1fno files"
)


def test_commit_log(spark, rows, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text(LOG)
    commits, changes = gitlog.read_commit_log(spark, str(path), "r")
    assert rows(commits, "sha", "author_name", "author_email", "message") == [
        ("aaaaaaa1", "Ann", "ann@x.org", "first"), ("bbbbbbb2", "unknown", "unknown", ""), ("ddddddd4", "Bob", "b@x.org", "no files"),
    ]
    assert rows(changes, "sha", "path", "change_type", "additions", "deletions") == [
        ("aaaaaaa1", "logo.png", "A", 0, 0), ("aaaaaaa1", "src/a.py", "A", 10, 0), ("bbbbbbb2", "src/a.py", "D", 0, 10),
    ]


DIFF = """diff --git a/app/x.py b/app/x.py
--- a/app/x.py
+++ b/app/x.py
@@ -1,2 +5,3 @@ def f():
+a
@@ -9 +12,0 @@
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1,4 +0,0 @@
"""


def test_unified_diff_and_targets(spark, rows):
    lines = spark.createDataFrame(
        [("r", "q", i, x) for i, x in enumerate(DIFF.split("\n"))], "repo_id string, request_id string, line_no int, text string"
    )
    hunks = diffs.read_unified_diff(lines)
    assert rows(hunks, "path", "start", "end") == [("app/x.py", 5, 7), ("app/x.py", 12, 12), ("gone.py", 0, 0)]
    tree = spark.createDataFrame([("r", "f:src/app/x.py", "src/app/x.py"), ("r", "f:x.py", "x.py")], "repo_id string, key string, path string")
    matched = I.match_diff_files(hunks, tree)
    assert rows(matched, "path", "file_key") == [("app/x.py", "f:src/app/x.py")]
    ents = spark.createDataFrame(
        [("r", "f:src/app/x.py", "C", 1, 20), ("r", "f:src/app/x.py", "C.m", 4, 8), ("r", "f:src/app/x.py", "z", 30, 40)],
        "repo_id string, file_key string, key string, start_line int, end_line int",
    )
    located = hunks.join(matched, ["repo_id", "request_id", "path"])
    hits = I.diff_entities(located, ents)
    assert rows(hits, "key") == [("C",), ("C.m",)]
    assert rows(I.innermost(hits, located), "key") == [("C.m",)]
    assert rows(I.innermost(hits.where("key = 'none'"), located), "key") == [("f:src/app/x.py",)]


def test_scan_source_files(spark, rows, tmp_path):
    for name, body in {
        "r1/src/a.py": b"x = 1\n", "r1/node_modules/b.js": b"x", "r1/.github/w.yml": b"on: push", "r1/.hidden/c.py": b"x",
        "r1/data.bin": b"xx", "r1/nul.py": b"a\0b", "r1/empty.py": b"", "r2/Makefile": b"all:", "r1/package-lock.json": b"{}",
        "r1/pkg/__init__.py": b"#", "r1/big.py": b"x" * 500,
    }.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(body)
    folders = spark.createDataFrame([(r, str(tmp_path / r)) for r in ("r1", "r2")], "repo_id string, folder string")
    got = files.scan_source_files(folders, max_bytes=400)
    assert rows(got, "repo_id", "path", "language") == [
        ("r1", ".github/w.yml", "yaml"), ("r1", "pkg/__init__.py", "python"), ("r1", "src/a.py", "python"), ("r2", "Makefile", "shell"),
    ]


def test_snapshot_replaces_one_repository(spark, rows, tmp_path):
    folder = str(tmp_path / "files")
    schema = "repo_id string, path string"
    snapshots.write_snapshot(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], schema), folder)
    snapshots.write_snapshot(spark.createDataFrame([("a", "n")], schema), folder)
    assert rows(spark.read.parquet(folder), "repo_id", "path") == [("a", "n"), ("b", "z")]


PATHS = [
    "src/x.ts", "src/lib/y.tsx", "src/main.ts", "src/widgets/index.ts", "app/core/base.py", "app/core/__init__.py", "app/helpers.py", "app/w.py",
    "java/com/acme/util/Text.java", "java/com/acme/util/Num.java", "java/com/acme/Main.java", "go/model/a.go", "go/model/a_test.go", "go/main.go",
    "c/main.c", "c/util.h", "c/inc/deep.h", "rust/src/main.rs", "rust/src/model.rs", "rust/src/parts/mod.rs", "rb/a.rb", "rb/lib/b.rb",
    "php/App/Models/User.php", "php/index.php", "lib/pkg/thing.dart",
]


def test_import_resolution(spark, rows):
    tree = spark.createDataFrame([("r", p) for p in PATHS], "repo_id string, path string")
    cases = [
        ("src/main.ts", "typescript", "./x.js", []), ("src/main.ts", "typescript", "@/lib/y", []), ("src/main.ts", "typescript", "./widgets", []),
        ("src/main.ts", "typescript", "lib/y", []), ("src/main.ts", "typescript", "@scope/pkg/deep", []), ("src/main.ts", "typescript", "node:fs", []),
        ("src/main.ts", "typescript", "./missing", []), ("src/main.ts", "typescript", "./main", []),
        ("app/w.py", "python", ".core.base", ["Thing"]), ("app/w.py", "python", ".", ["helpers"]), ("app/w.py", "python", "core", ["base"]),
        ("app/w.py", "python", "os.path", []), ("app/core/base.py", "python", "..helpers", []),
        ("java/com/acme/Main.java", "java", "com.acme.util.Text", []), ("java/com/acme/Main.java", "java", "com.acme.util.*", []),
        ("java/com/acme/Main.java", "java", "org.other.Thing", []), ("java/com/acme/Main.java", "java", "com.acme.util.Text.CONST", []),
        ("go/main.go", "go", "example.com/app/model", []), ("go/main.go", "go", "fmt", []), ("go/main.go", "go", "github.com/a/b/c", []),
        ("c/main.c", "c", "util.h", []), ("c/main.c", "c", "deep.h", []), ("c/main.c", "c", "<stdio.h", []),
        ("rust/src/main.rs", "rust", "crate::model::Item", []), ("rust/src/main.rs", "rust", "mod:parts", []), ("rust/src/main.rs", "rust", "serde::Deserialize", []),
        ("rb/a.rb", "ruby", "./lib/b", []), ("rb/a.rb", "ruby", "json", []),
        ("php/index.php", "php", "App\\Models\\User", []), ("php/index.php", "php", "Other\\Name\\Deep", []),
        ("lib/pkg/thing.dart", "dart", "dart:io", []),
    ]
    imports = spark.createDataFrame([("r", *c) for c in cases], "repo_id string, path string, language string, spec string, names array<string>")
    resolved = M.resolve_imports(imports, tree)
    got = {}
    for r in resolved.collect():
        got.setdefault((r["path"], r["spec"]), set()).add(r["target"])
    assert got[("src/main.ts", "./x.js")] == {"src/x.ts"}
    assert got[("src/main.ts", "@/lib/y")] == {"src/lib/y.tsx"}
    assert got[("src/main.ts", "./widgets")] == {"src/widgets/index.ts"}
    assert got[("src/main.ts", "lib/y")] == {"src/lib/y.tsx"}
    assert got[("app/w.py", ".core.base")] == {"app/core/base.py"}
    assert got[("app/w.py", ".")] == {"app/helpers.py"}
    assert got[("app/core/base.py", "..helpers")] == {"app/helpers.py"}
    assert "app/core/__init__.py" in got[("app/w.py", "core")]
    assert got[("java/com/acme/Main.java", "com.acme.util.Text")] == {"java/com/acme/util/Text.java"}
    assert got[("java/com/acme/Main.java", "com.acme.util.Text.CONST")] == {"java/com/acme/util/Text.java"}
    assert got[("java/com/acme/Main.java", "com.acme.util.*")] == {"java/com/acme/util/Text.java", "java/com/acme/util/Num.java"}
    assert got[("go/main.go", "example.com/app/model")] == {"go/model/a.go"}
    assert got[("c/main.c", "util.h")] == {"c/util.h"} and got[("c/main.c", "deep.h")] == {"c/inc/deep.h"}
    assert got[("rust/src/main.rs", "crate::model::Item")] == {"rust/src/model.rs"}
    assert got[("rust/src/main.rs", "mod:parts")] == {"rust/src/parts/mod.rs"}
    assert got[("rb/a.rb", "./lib/b")] == {"rb/lib/b.rb"}
    assert got[("php/index.php", "App\\Models\\User")] == {"php/App/Models/User.php"}
    packages = {r["target"] for r in M.link_imports(imports, resolved).collect() if r["target"].startswith("p:")}
    assert {"p:@scope/pkg", "p:node:fs", "p:os", "p:org.other", "p:std:fmt", "p:github.com/a/b", "p:stdio", "p:serde", "p:json", "p:Other\\Name", "p:dart:io"} <= packages
    assert ("src/main.ts", "./missing") not in got


def test_scalars(spark):
    row = spark.range(1).select(
        P.normalize_path(F.lit("a/./b/../c//d")).alias("n"), P.normalize_path(F.lit("../x")).alias("up"),
        P.language_of(F.lit("x/README")).alias("readme"), P.language_of(F.lit("a.min.js")).alias("minified"),
        P.is_test_path(F.lit("a/FooTest.java")).alias("java_test"), P.is_test_path(F.lit("a/contest.py")).alias("contest"),
        P.module_of(F.lit("src/a/b.ts")).alias("m1"), P.module_of(F.lit("x.ts")).alias("m2"), P.module_of(F.lit("src/b.ts")).alias("m3"),
        U.normalize_repo_url(F.lit("owner/repo")).alias("url"), U.normalize_repo_url(F.lit("https://github.com/a/b/tree/main/x")).alias("tree"),
        U.repo_key(F.lit("git@Host.org:Own/Repo.git")).alias("key"), U.repo_name(F.lit("https://h.org/own/repo.git")).alias("name"),
    ).first()
    assert row["n"] == "a/c/d" and row["up"] == "x"
    assert row["readme"] == "markdown" and row["minified"] is None
    assert row["java_test"] and not row["contest"]
    assert (row["m1"], row["m2"], row["m3"]) == ("src/a", "(root)", "src")
    assert row["url"] == "https://github.com/owner/repo.git" and row["tree"] == "https://github.com/a/b.git"
    assert row["key"] == "https://host.org/own/repo" and row["name"] == "own/repo"


def test_co_change_bounds(spark, rows):
    data = [("r", "one", "a"), ("r", "two", "a"), ("r", "two", "b"), ("r", "gone", "a"), ("r", "gone", "old")]
    data += [("r", "big", f"f{i:02d}") for i in range(41)] + [("r", "full", f"f{i:02d}") for i in range(40)]
    changes = spark.createDataFrame(data, "repo_id string, sha string, path string")
    tree = spark.createDataFrame([("a",), ("b",)] + [(f"f{i:02d}",) for i in range(41)], "path string")
    pairs = H.co_change_pairs(changes, tree)
    assert rows(pairs.where("file_a = 'a'"), "file_a", "file_b", "together") == [("a", "b", 1)]
    assert pairs.where("file_a like 'f%'").count() == 40 * 39 // 2  # the 41-file commit does not count
