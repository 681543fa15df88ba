"""Cases the test tables cannot show."""

from __future__ import annotations


def test_current_files_are_those_of_the_same_repository(spark, rows):
    from commitloom.operators.history import co_change_pairs

    changes = spark.createDataFrame([("r1", "c", p) for p in ("a", "b", "gone")], "repo_id string, sha string, path string")
    files = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "gone")], "repo_id string, path string")
    assert rows(co_change_pairs(changes, files), "file_a", "file_b") == [("a", "b")]
    assert len(rows(co_change_pairs(changes, files.select("path")), "file_a", "file_b")) == 3


def test_a_duplicate_repository_is_the_first_known_one(spark, rows):
    from commitloom.operators.reuse import find_duplicate_repos

    url = "https://host.org/a/b"
    known = spark.createDataFrame(
        [("k2", url, "dev", None), ("k1", url + ".git", "main", None), ("k3", url, None, None)], "repo_id string, url string, branch string, last_sync timestamp")
    new = spark.createDataFrame([(1, url, None), (2, url, "dev"), (3, url, "other")], "id int, url string, branch string")
    assert rows(find_duplicate_repos(new, known), "id", "duplicate_of") == [(1, "k1"), (2, "k2")]


def test_an_import_of_the_own_file_gives_no_edge(spark, rows):
    from commitloom.operators import imports as M

    tree = spark.createDataFrame([("r", "pkg/a.py"), ("r", "pkg/b.py")], "repo_id string, path string")
    specs = spark.createDataFrame([("r", "pkg/a.py", "python", "pkg.a"), ("r", "pkg/a.py", "python", "pkg.b"), ("r", "pkg/a.py", "python", "os")], "repo_id string, path string, language string, spec string")
    hits = M.import_hits(specs, tree)
    edges = M.link_imports(specs, hits.where("path <> target"), hits)
    assert rows(edges, "source", "target") == [("f:pkg/a.py", "f:pkg/b.py"), ("f:pkg/a.py", "p:os")]


def test_thousands_of_files_of_one_name_meet_one_row_each(spark, rows):
    from commitloom.operators import impact as I
    from commitloom.operators import imports as M

    tree = spark.range(20_000).selectExpr("'r' AS repo_id", "concat('f:d', id, '/x/index.h') AS key", "concat('d', id, '/x/index.h') AS path")
    index = M._file_index(tree.select("repo_id", "path"), ["repo_id"])
    assert index.where("kind = 'suffix' AND value = 'index.h'").count() == 1
    asked = spark.range(500).selectExpr("'r' AS repo_id", "concat('q', id) AS request_id", "'x/index.h' AS path")
    assert rows(I.match_diff_files(asked, tree).select("file_key").distinct(), "file_key") == [("f:d0/x/index.h",)]


def test_percentiles_count_files_without_history(spark, rows):
    from commitloom.operators.history import commit_percentile

    metrics = spark.createDataFrame([("r", "a", 5), ("r", "b", 1)], "repo_id string, path string, commit_count long")
    files = spark.createDataFrame([("r", p) for p in "abcd"], "repo_id string, path string")
    assert rows(commit_percentile(metrics, files), "commit_count", "percentile") == [(0, 0.5), (1, 0.75), (5, 1.0)]


def test_a_file_seed_reaches_the_chunks_of_its_entities(spark, rows):
    from commitloom.operators import search as Q

    chunks = spark.createDataFrame([(1, "e:f", "f:a", 0), (2, "f:a", "f:a", 1), (3, "e:g", "f:a", 2), (4, "f:b", "f:b", 0)], "doc_id long, owner string, file_key string, chunk_index int")
    seeds = spark.createDataFrame([("q", "f:a", 1), ("p", "e:g", 1)], "query_id string, key string, node_position int")
    assert rows(Q.chunks_for_nodes(seeds, chunks, 3), "query_id", "doc_id", "position") == [("p", 3, 1), ("q", 1, 1), ("q", 2, 2), ("q", 3, 3)]


def test_earlier_answers_are_those_before_the_question(spark, rows):
    from commitloom.operators import search as Q

    log = spark.createDataFrame([("r", t, f"q{t}", f"a{t}" if t != 3 else None) for t in range(1, 7)] + [("s", 1, "x", "y")], "repo_id string, created_at long, question string, answer string")
    asked = spark.createDataFrame([("one", "r", 1), ("five", "r", 5), ("end", "r", 99), ("other", "s", 1), ("later", "s", 2)], "query_id string, repo_id string, created_at long")
    got = {r.query_id: r.conversation.split("\n\n") for r in Q.earlier_answers(asked, log, most=2).collect()}
    said = lambda t: f"Asked: q{t}\nAnswered: a{t}"
    assert got == {"five": [said(2), said(4)], "end": [said(5), said(6)], "later": ["Asked: x\nAnswered: y"]}


def test_fingerprints_follow_changes_in_any_order(spark, rows):
    from commitloom.operators import reuse as R

    schema = "repo_id string, path string, hash string"
    first = spark.createDataFrame([("r", f"p{i}", f"h{i}") for i in range(50)] + [("s", "a", "b")], schema)
    second = spark.createDataFrame([("r", f"p{i}", f"h{i}" if i > 2 else "new") for i in reversed(range(45))], schema)
    state = R.change_state(R.fingerprint_state(first), R.fingerprint_state(second.exceptAll(first)), R.fingerprint_state(first.exceptAll(second)))
    assert rows(R.fingerprint(state), "repo_id", "fingerprint") == rows(R.snapshot_fingerprint(second.repartition(3)), "repo_id", "fingerprint")
    parts = spark.createDataFrame([("r", "ab", "c"), ("s", "a", "bc")], schema)
    assert R.snapshot_fingerprint(parts).select("fingerprint").distinct().count() == 2


def test_commits_and_texts_are_read_whole(spark, rows):
    from pyspark.sql import functions as F

    from commitloom.operators.history import kept_changes
    from commitloom.plans.registry import load_all
    from commitloom.sources.files import read_head

    changes = spark.createDataFrame([("r", "c", f"p{i:03d}") for i in range(400)], "repo_id string, sha string, path string")
    assert kept_changes(changes).count() == 400 and kept_changes(changes, 4).count() == 4
    text = "\n".join(f"line {i}" for i in range(2000)) + "\n"
    head, truncated = read_head(F.col("text"))
    assert rows(spark.createDataFrame([(text,)], "text string"), head.alias("a"), truncated.alias("b")) == [(text, False)]
    found = load_all()
    assert "least(files_changed" not in found["a14_commit_totals"].oracle and "[1:5]" not in found["s12_read_text_slice"].oracle


def test_texts_are_cut_once_and_after_they_are_dealt(spark):
    """The optimizer must not copy tokenising below the exchange that deals the texts, nor do it again."""
    from commitloom.functions import text as X
    from commitloom.operators.grams import containing
    from commitloom.operators.index import postings

    docs = spark.createDataFrame([(1, "fooBar foo_bar HTTPServer x"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["term"]: r["tf"] for r in postings(docs).collect()}
    assert rows == {"foobar": 1, "foo": 2, "bar": 2, "foo_bar": 1, "httpserver": 1, "http": 1, "server": 1}
    for made in (postings(docs.repartition(2)), X.term_rows(docs.repartition(2), "text", "doc_id")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
    terms = spark.createDataFrame([("bar",)], "term string")
    assert [r["key"] for r in containing(docs.withColumnRenamed("doc_id", "key"), terms, "text").collect()] == [1]


def test_uses_meet_a_few_candidates_only(spark, rows):
    """a name that many uses and many entities of a file share must not pair them all."""
    from commitloom.operators.names import resolve_names

    n = 40
    ents = spark.createDataFrame(
        [("r", f"e{i:02}", f"f:{'ab'[i % 2]}", "same", "class" if i % 4 else "interface", i, "python") for i in range(n)],
        "repo_id string, key string, file_key string, name string, type string, start_line int, language string")
    refs = spark.createDataFrame(
        [("r", i, f"f:{'ac'[i % 2]}", "same", ["new", "base", "call", None][i // 2 % 4], True, "python") for i in range(n)],
        "repo_id string, ref_id int, file_key string, name string, use string, strict boolean, language string")
    links = spark.createDataFrame([("r", "f:c", "f:b", "IMPORTS")], "repo_id string, source string, target string, type string")
    found = resolve_names(refs, ents, links)
    first = {"new": [2, 6], "base": [0, 2], "call": [2, 6], None: [2, 6]}
    want = []
    for i in range(n):
        use = ["new", "base", "call", None][i // 2 % 4]
        want += [(i, f"e{k:02}", 0) for k in first[use]] if i % 2 == 0 else [(i, f"e{k:02}", 1) for k in (1, 3)]
    assert rows(found, "ref_id", "target", "tier") == sorted(want)
    # candidates are ranked before they meet the uses: own file, imported files, rare names, and the uses' best at the end
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") >= 4


def test_rows_of_a_file_do_not_carry_the_whole_file(spark, rows):
    """Bodies, chunks and free lines are cut inside the file's row, before it becomes rows of entities."""
    from commitloom.operators import chunks as K
    from commitloom.operators import extract as X

    text = "import os\n" + "".join(f"def f{i}(x):\n    g{i}(x)\n\n" for i in range(30)) + "h(1)\n"
    files = X.with_lines(spark.createDataFrame([("r", "a.py", "python", text)], "repo_id string, path string, language string, content string"))
    ents = X.extract_entities(files)
    bodies = X.entity_bodies(files, ents)
    assert rows(bodies, "start_line", "body")[:2] == [(2, "def f0(x):\n    g0(x)"), (5, "def f1(x):\n    g1(x)")]
    free = X.module_level_text(files, ents).first()
    assert free["line_numbers"] == [1, *range(4, 92, 3), 92, 93] and free["body"].startswith("import os\n\n") and free["body"].endswith("h(1)\n")
    made = K.entity_chunks(files, ents)
    assert made.where("entity = 'f3'").first()["content"] == "def f3(x):\n    g3(x)"
    for df in (bodies, made):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # nothing is cut from a file's lines above the explode
        assert "Generate" in plan and "slice(" not in plan.split("Generate")[0]


def test_texts_of_files_are_put_together_without_numbering_lines(spark, tmp_path):
    """lines are sorted within their file only, no window sorts all of them by path; files without a path stay one."""
    from commitloom.plans.bindings import Tables

    folder = str(tmp_path)
    parts = [(1, "a b", "B#1", "ECONOMY", 10), (2, "a b", "B#1", "LARGE", 3), (3, "a b", None, "LARGE", 3), (4, "a b", None, "LARGE", 3)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    lines = [(o, p, s, n, 5.0, 0.05, "N", "O") for o, p, s, n in ((1, 1, 7, 1), (1, 2, 8, 2), (2, 1, 7, 1), (2, 1, 9, 2), (3, 3, 5, 1), (3, 4, 6, 2))]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string",
    ).write.parquet(f"{folder}/lineitem.parquet")
    tables = Tables(spark, folder)
    plan = tables.sources._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    found = {r["path"]: r["content"] for r in tables.sources.collect()}
    assert found["src/B_1/tests/part_1.py"] == "def unit_7(x):\n    # see hidden_7(x)\n    unit_8(x);\n    unit_9(x);\n\ndef unit_9(x):\n    # see hidden_9(x)\n"
    assert found["src/B_1/part_2.go"] == "func unit_8(x int) {\n    // see hidden_8(x)\n}"
    assert found[None] == "func unit_5(x int) {\n    // see hidden_5(x)\n    unit_6(x);\n}\nfunc unit_6(x int) {\n    // see hidden_6(x)\n}"
    assert sorted(found, key=str) == [None, "src/B_1/part_2.go", "src/B_1/tests/part_1.py"]
