"""Cases of the findings of round 4."""

from __future__ import annotations


def test_an_import_of_a_directory_links_all_its_files(spark, rows):
    """no number of files of a directory is left out of the links."""
    from commitloom.operators import imports as M

    paths = ["main.go", *[f"pkg/model/f{i:02}.go" for i in range(12)], "pkg/model/f_test.go", "pkg/other/x.go"]
    tree = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    specs = spark.createDataFrame([("r", "main.go", "go", "example.com/app/pkg/model")], "repo_id string, path string, language string, spec string")
    hits = M.import_hits(specs, tree)
    edges = M.link_imports(specs, hits.where("path <> target"), hits)
    assert rows(edges, "source", "target") == [("f:main.go", f"f:pkg/model/f{i:02}.go") for i in range(12)]
    # lists that are shown keep their first files
    assert rows(M.resolve_imports(specs, tree, first=True), "target") == [(f"pkg/model/f{i:02}.go",) for i in range(8)]


def test_impacted_nodes_are_counted_over_all_that_is_reached(spark, rows):
    """the list that is shown ends at 300 nodes, the count does not."""
    from types import SimpleNamespace

    from commitloom.plans import impacts

    reached = spark.range(350).selectExpr(
        "'r' AS repo_id", "'f:a' AS request_id", "concat('e:', id) AS key", "1 AS depth", "1.0D AS score", "'calls' AS relation", "'f:a' AS parent")
    files = spark.createDataFrame([("r", "f:a")], "repo_id string, key string")
    tables = SimpleNamespace(stored=lambda name, build: reached, repo_files=files)
    assert rows(impacts.u06(tables), "repo_id", "request_id", "impacted") == [("r", "f:a", 350)]


def test_storing_a_table_leaves_the_sessions_plans_whole(spark):
    """The driver keeps short plan texts of what is stored; other plans of the session are not cut."""
    from commitloom.llm.tables import stored

    before = spark.conf.get("spark.sql.maxPlanStringLength")
    assert stored(spark.range(3)).count() == 3
    assert spark.conf.get("spark.sql.maxPlanStringLength") == before


def test_a_level_of_reach_meets_seeds_and_levels_once(spark, rows, monkeypatch):
    """Rows as by plain search, and no level computes the ones before it again."""
    import math
    import random

    from commitloom.operators import reach as R

    rng = random.Random(7)
    files = [f"f:{i}" for i in range(6)]
    homes = {f"e:{i}": files[i % 6] for i in range(24)}
    contains = [(f, e) for e, f in homes.items()]
    links = {(rng.choice([*homes]), rng.choice([*homes]), rng.choice(["CALLS", "EXTENDS"])): rng.randint(1, 5) for _ in range(60)}
    imports = {(rng.choice(files), rng.choice(files)) for _ in range(8)}
    imports = sorted((a, b) for a, b in imports if a != b)
    table = [("r", "CONTAINS", a, b, 1.0) for a, b in contains] + [("r", t, a, b, float(w)) for (a, b, t), w in links.items() if a != b]
    table += [("r", "IMPORTS", a, b, 1.0) for a, b in imports]
    edges = spark.createDataFrame(table, "repo_id string, type string, source string, target string, weight double")
    exported = {e for i, e in enumerate(homes) if i % 3 == 0}
    nodes = spark.createDataFrame(
        [("r", f, "file", None, None) for f in files] + [("r", e, "entity", f, e in exported) for e, f in homes.items()],
        "repo_id string, key string, kind string, file_key string, exported boolean")
    targets = spark.createDataFrame([("r", f, f) for f in files], "repo_id string, request_id string, key string")
    backward: dict = {}
    for _, kind, a, b, w in table:
        if kind != "CONTAINS":
            backward.setdefault(b, []).append((a, kind.lower(), w if kind == "CALLS" else 2.0 if kind == "EXTENDS" else 1.0))
    want = set()
    for f in files:
        front = seeds = {f, *(e for e, h in homes.items() if h == f)}
        seen: set = set()
        for depth in (1, 2, 3):
            found: dict = {}
            for key in front:
                more = [(a, "imports module of", 0.6) for a, b in imports if depth == 1 and key in exported and homes[key] == b]
                for other, relation, w in backward.get(key, []) + more:
                    score = 1 / depth * min(2, 0.6 + math.log2(1 + w))
                    if other != f and other not in seen:
                        found.setdefault(other, []).append((-round(score, 9), key, relation))
            best = {other: min(ways) for other, ways in found.items()}
            want |= {(f, other, depth, parent, relation) for other, (_, parent, relation) in best.items()}
            seen |= set(best)
            front = set(best) - seeds
    plans: list = []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    for chains in (False, True):
        got = R.reverse_reach(targets, nodes, edges, chains=chains)
        assert set(rows(got, "request_id", "key", "depth", "parent", "relation")) == want
        assert plans[-1].count("Join ") <= 3  # dependents, targets, levels before


def test_structure_is_computed_once_for_edges_and_nodes(spark, tmp_path):
    """Neighbours and nodes read the merged edges, they do not derive them again."""
    from commitloom.plans import graphs
    from commitloom.plans.bindings import Tables

    folder = str(tmp_path)
    spark.createDataFrame(
        [(1, "a b", "B#1", "ECONOMY", 10), (2, "a b", "B#1", "LARGE", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    ).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(
        [(o, p, s, n, 5.0, 0.05, "N", "O") for o, p, s, n in ((1, 1, 7, 1), (1, 2, 8, 2), (2, 1, 7, 1), (2, 1, 9, 2))],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(s, f"s{s}") for s in (7, 8, 9)], "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    tables = Tables(spark, folder)
    known = graphs.nodes(tables)
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan and "supplier" not in plan and "s_name" not in plan
    found = {r["key"]: (r["fan_in"], r["fan_out"]) for r in known.collect()}
    assert found["e:src/B_1/tests/part_1.py#unit_7"] == (0, 2) and found["e:src/B_1/part_2.go#unit_8"] == (1, 0) and found["p:s7"][0] == 1


def test_scores_do_not_depend_on_how_terms_are_added_up(spark, rows, monkeypatch):
    """Frequent terms go through one matrix product, others document by document; equal texts score alike."""
    import random

    from commitloom.operators import index as I

    rng = random.Random(11)
    words = [f"word{a}{b}" for a in "abcdef" for b in "xyz"]
    texts = [" ".join(["common"] * (i % 3) + [rng.choice(words) for _ in range(rng.randint(0, 30))]) for i in range(60)]
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts + texts[:20])], "doc_id string, text string")
    asked = spark.createDataFrame(
        [(f"q{i % 11}", " ".join(["common"] + [rng.choice(words) for _ in range(i % 5)])) for i in range(14)], "query_id string, question string")
    index = I.TextIndex.fresh(spark)
    index.update(docs)
    found = []
    for heavy, near in ((0, 1000), (3, 2), (1000, 7)):
        monkeypatch.setattr(I, "HEAVY", heavy)
        monkeypatch.setattr(I, "NEAR", near)
        ranked = I.rank(asked, index, 10, block_docs=8).selectExpr("query_id", "doc_id", "position", "round(score, 9) AS score")
        found.append(rows(ranked, "query_id", "position", "doc_id", "score"))
    assert found[0] == found[1] == found[2] and len(found[0]) > 90
