"""Graph queries: node and edge sets, degrees, neighbours, modules, components, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitloom.functions import paths as P
from commitloom.operators import cycles as C
from commitloom.operators import graph as G
from commitloom.operators.skew import top_per_group, value_at_rank
from commitloom.plans.changes import CO, METRICS, co_change, metrics
from commitloom.plans.registry import register

c = F.col
CODE = "('python','typescript','java','go','rust')"

MERGED = """merged AS (SELECT repo_id, type, source, target, sum(weight) AS weight FROM edges
  WHERE source <> target GROUP BY 1, 2, 3, 4)"""
DEGREE = MERGED + """,
counted AS (SELECT * FROM merged WHERE type IN ('CALLS', 'EXTENDS') OR (type = 'IMPORTS' AND target LIKE 'f:%')),
degree AS (SELECT repo_id, key, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (
   SELECT repo_id, source AS key, 0 AS i, 1 AS o FROM counted UNION ALL SELECT repo_id, target, 1, 0 FROM counted)
   GROUP BY 1, 2)"""
NODES = DEGREE + """,
nodes AS (
  SELECT f.repo_id, f.key, 'file' AS kind, regexp_extract(f.path, '[^/]*$') AS name, CAST(NULL AS VARCHAR) AS qualified_name,
         f.path, CAST(NULL AS VARCHAR) AS type, f.language, CAST(f.loc AS INT) AS loc, CAST(NULL AS VARCHAR) AS file_key,
         CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, CAST(NULL AS BOOLEAN) AS exported,
         coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out
  FROM repo_files f LEFT JOIN degree d ON f.repo_id = d.repo_id AND f.key = d.key
  UNION ALL
  SELECT e.repo_id, e.key, 'entity', e.name, e.qualified_name, e.path, e.type, e.language,
         e.end_line - e.start_line + 1, e.file_key, e.start_line, e.end_line, e.exported,
         coalesce(fan_in, 0), coalesce(fan_out, 0)
  FROM entities e LEFT JOIN degree d ON e.repo_id = d.repo_id AND e.key = d.key
  UNION ALL
  SELECT repo_id, target, 'package', substr(target, 3), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), 0
  FROM merged WHERE target LIKE 'p:%' GROUP BY repo_id, target)"""
ALLEDGES = """alledges AS (SELECT repo_id, type, source, target, weight FROM merged
  UNION ALL SELECT repo_id, type, source, target, weight FROM co)"""
NEAR = CO + ", " + NODES + ", " + ALLEDGES + """,
raw AS (SELECT repo_id, source AS key, target AS other, type, 'out' AS dir, weight FROM alledges
        UNION ALL SELECT repo_id, target, source, type, CASE WHEN type = 'CO_CHANGED' THEN 'out' ELSE 'in' END, weight FROM alledges),
near AS (SELECT raw.*, n.fan_in AS other_fan_in, n.kind AS other_kind, CASE n.kind WHEN 'entity' THEN n.qualified_name
                  WHEN 'file' THEN n.path ELSE n.name END AS other_label
         FROM raw JOIN nodes n ON raw.repo_id = n.repo_id AND raw.other = n.key)"""
GRAPH_TABLES = "edges repo_files entities"
FULL = GRAPH_TABLES + " changes"


def merged(t):
    return G.merge_edges(t.edges)


def structure(t):
    """The merged edges, written once for queries that read them several times."""
    return t.stored("structure", merged)


def full_edges(t):
    """Structural edges plus CO_CHANGED edges."""
    return structure(t).unionByName(co_change(t))


def nodes(t):
    return G.node_set(t.repo_files, t.entities, structure(t))


def near(t, types=None):
    return G.known_neighbours(full_edges(t), nodes(t), types)


def code_files(t, edges=None):
    """Code files of every repository with module, degrees and history metrics."""
    degree = G.degrees(merged(t) if edges is None else edges)
    zero = F.lit(0).cast("long")
    files = t.repo_files.where(P.is_code(c("language")))
    history = metrics(t).drop("last_modified")
    return (
        G.with_degrees(files, degree).join(history, ["repo_id", "path"], "left")
        .withColumns({x: F.coalesce(x, zero) for x in ("churn", "commit_count", "authors")})
        .withColumn("module", P.module_of(c("path")))
    )


def stored_files(t):
    """The code files, written once for queries that read them several times."""
    return t.stored("code_files", lambda t: code_files(t, structure(t)))


CODE_FILES = DEGREE + ", " + METRICS + f""",
code_files AS (
  SELECT f.repo_id, f.key, f.path, f.language, f.loc, array_to_string(string_split(f.path, '/')[1:2], '/') AS module0,
    CASE WHEN f.path LIKE 'src/%' THEN array_to_string(string_split(f.path, '/')[1:2], '/') ELSE string_split(f.path, '/')[1] END AS module,
    coalesce(d.fan_in, 0) AS fan_in, coalesce(d.fan_out, 0) AS fan_out, coalesce(m.churn, 0) AS churn,
    coalesce(m.commit_count, 0) AS commit_count, coalesce(m.authors, 0) AS authors
  FROM repo_files f LEFT JOIN degree d ON f.repo_id = d.repo_id AND f.key = d.key
  LEFT JOIN metrics m ON f.repo_id = m.repo_id AND f.path = m.path WHERE f.language IN {CODE})"""
CODE_TABLES = "edges repo_files changes commits"

MODULES = CODE_FILES + """,
module_edges AS (SELECT s.repo_id, s.module AS source, t.module AS target, count(*) AS weight
  FROM merged e JOIN code_files s ON e.repo_id = s.repo_id AND e.source = s.key
  JOIN code_files t ON e.repo_id = t.repo_id AND e.target = t.key
  WHERE e.type = 'IMPORTS' AND s.module <> t.module GROUP BY 1, 2, 3),
module_stats AS (SELECT z.repo_id, z.module, z.files, z.loc, fan_in, fan_out,
  CASE WHEN fan_in + fan_out > 0 THEN round(fan_out / (fan_in + fan_out), 2) ELSE 0 END AS instability FROM (
  SELECT m.*, CAST(coalesce((SELECT sum(weight) FROM module_edges e WHERE e.repo_id = m.repo_id AND e.target = m.module), 0) AS BIGINT) AS fan_in,
    CAST(coalesce((SELECT sum(weight) FROM module_edges e WHERE e.repo_id = m.repo_id AND e.source = m.module), 0) AS BIGINT) AS fan_out
  FROM (SELECT repo_id, module, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM code_files GROUP BY 1, 2) m) z)"""


def module_edges(t):
    return G.edges_to_modules(structure(t), stored_files(t))


def module_stats(t):
    return G.module_stats(stored_files(t), module_edges(t))


@register("s07_load_graph", """
SELECT source, target, type, weight FROM edges WHERE repo_id = 'F' AND type = 'IMPORTS'""", "edges")
def s07(t):
    from commitloom.sources.snapshots import load_edges

    return load_edges(t.edges, "F", ["IMPORTS"])


@register("a02_merge_edges", "+ " + MERGED + " SELECT * FROM merged", "edges")
def a02(t):
    return merged(t)


@register("a03_degrees", "+ " + DEGREE + " SELECT * FROM degree", "edges")
def a03(t):
    return G.degrees(merged(t))


@register("a04_package_usage", "+ " + MERGED + """
SELECT repo_id, substr(target, 3) AS package, count(*) AS files FROM merged WHERE type = 'IMPORTS' AND target LIKE 'p:%'
GROUP BY 1, 2""", "edges")
def a04(t):
    return G.package_usage(merged(t))


@register("a05_entity_edge_counts", "+ " + MERGED + """
SELECT repo_id, 'entity' AS what, type, count(*) AS n FROM entities GROUP BY 1, 3
UNION ALL SELECT repo_id, 'edge', type, count(*) FROM merged GROUP BY 1, 3""", "edges entities")
def a05(t):
    ents = G.count_by(t.entities, "type").withColumn("what", F.lit("entity"))
    return ents.unionByName(G.count_by(merged(t), "type").withColumn("what", F.lit("edge")))


@register("a06_language_stats", """
SELECT repo_id, language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc,
  round(sum(loc) / sum(sum(loc)) OVER (PARTITION BY repo_id), 6) AS share FROM repo_files GROUP BY 1, 2""", "repo_files")
def a06(t):
    return G.language_stats(t.repo_files).withColumn("share", F.round("share", 6))


@register("a07_repo_stats", f"""
SELECT repo_id, count(*) FILTER (loc <= 900) AS files, count(*) FILTER (loc <= 900 AND language IN {CODE}) AS code_files,
  CAST(sum(loc) FILTER (loc <= 900) AS BIGINT) AS loc, count(*) FILTER (loc > 900) AS skipped FROM repo_files GROUP BY 1""",
          "repo_files")
def a07(t):
    return G.repo_stats(t.repo_files, c("loc") > 900)


@register("a08_module_stats", "+ " + MODULES + " SELECT repo_id, module, files, loc, fan_in, fan_out, instability FROM module_stats",
          CODE_TABLES)
def a08(t):
    return module_stats(t)


@register("a09_directory_rollup", "+ " + METRICS + """,
f AS (SELECT r.repo_id, r.path, r.loc, m.churn FROM repo_files r JOIN metrics m ON r.repo_id = m.repo_id AND r.path = m.path),
d AS (SELECT repo_id, loc, churn, '' AS dir FROM f
  UNION ALL SELECT repo_id, loc, churn, array_to_string(string_split(path, '/')[1:n], '/') FROM
    (SELECT *, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM f))
SELECT repo_id, dir, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(churn) AS BIGINT) AS churn, count(*) AS files FROM d GROUP BY 1, 2""",
          "repo_files changes commits")
def a09(t):
    return G.directory_rollup(t.repo_files.join(metrics(t), ["repo_id", "path"]))


@register("a10_directory_summary", """
SELECT repo_id, dir, files, loc FROM (SELECT repo_id, dir, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc,
  row_number() OVER (PARTITION BY repo_id ORDER BY sum(loc) DESC, dir) AS rn
  FROM (SELECT repo_id, loc, regexp_replace(array_to_string(string_split(path, '/')[1:2], '/'), '/[^/]*[.][^/]*$', '') AS dir
        FROM repo_files) GROUP BY 1, 2) WHERE rn <= 15""", "repo_files")
def a10(t):
    return G.directory_summary(t.repo_files)


@register("a24_legend", """
SELECT repo_id, language, n FROM (SELECT repo_id, language, count(*) AS n,
  row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, language) AS rn FROM repo_files GROUP BY 1, 2) WHERE rn <= 8""",
          "repo_files")
def a24(t):
    return top_per_group(G.count_by(t.repo_files, "language"), ["repo_id"], [c("n").desc(), c("language")], 8)


@register("a25_module_externals", "+ " + MERGED + """
SELECT e.repo_id, CASE WHEN f.path LIKE 'src/%' THEN array_to_string(string_split(f.path, '/')[1:2], '/') ELSE string_split(f.path, '/')[1] END AS module,
  substr(e.target, 3) AS package, count(*) AS files FROM merged e JOIN repo_files f ON e.repo_id = f.repo_id AND e.source = f.key
WHERE e.type = 'IMPORTS' AND e.target LIKE 'p:%' GROUP BY 1, 2, 3""", "edges repo_files")
def a25(t):
    return G.module_externals(merged(t), t.repo_files)


@register("a09_tree_listing", "+ " + METRICS + """,
f AS (SELECT r.repo_id, r.path, r.loc, m.churn FROM repo_files r JOIN metrics m ON r.repo_id = m.repo_id AND r.path = m.path),
d AS (SELECT repo_id, loc, churn, array_to_string(string_split(path, '/')[1:n], '/') AS path FROM
    (SELECT *, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM f)),
rows AS (SELECT repo_id, path, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(churn) AS BIGINT) AS churn, true AS is_dir FROM d GROUP BY 1, 2
  UNION ALL SELECT repo_id, path, loc, churn, false FROM f),
parts AS (SELECT *, string_split(path, '/') AS p FROM rows)
SELECT repo_id, path, array_to_string(p[1:len(p) - 1], '/') AS parent, len(p) AS depth, is_dir, loc, churn, row_number() OVER (
  PARTITION BY repo_id, array_to_string(p[1:len(p) - 1], '/') ORDER BY NOT is_dir, p[-1]) AS position FROM parts""", "repo_files changes commits")
def a09_tree(t):
    """Every folder's entries in order: directories first, then files, by name."""
    from pyspark.sql import Window

    rows = G.tree_listing(t.repo_files.join(metrics(t), ["repo_id", "path"]))
    order = Window.partitionBy("repo_id", "parent").orderBy("sort_key")
    return rows.withColumn("position", F.row_number().over(order).cast("long")).withColumn("depth", c("depth").cast("long")).drop("sort_key")


@register("j13_enrich_entities", """
SELECT e.repo_id, e.key, e.qualified_name, f.path, f.loc, e.end_line - e.start_line + 1 AS lines
FROM entities e JOIN repo_files f ON e.repo_id = f.repo_id AND e.file_key = f.key""", "entities repo_files")
def j13(t):
    return G.enrich_entities(t.entities, t.repo_files)


@register("j13_enrich_chunks", """
SELECT e.repo_id, e.key AS chunk, 'f:' || e.path AS file_key, CASE WHEN e.type <> 'class' THEN e.qualified_name END AS entity_name,
  CASE WHEN e.type <> 'class' THEN e.type END AS entity_type, CASE WHEN e.type <> 'class' THEN e.key ELSE 'f:' || e.path END AS owner FROM entities e""", "entities repo_files")
def j13_chunks(t):
    """One chunk per entity; chunks of classes stand for their file."""
    chunks = t.entities.select("repo_id", c("key").alias("chunk"), "path", F.when(c("type") != "class", c("key")).alias("entity_key"))
    return G.enrich_chunks(chunks, t.repo_files, t.entities).select("repo_id", "chunk", "file_key", "entity_name", "entity_type", "owner")


@register("j16_endpoints_in", "+ " + MERGED + f"""
SELECT e.repo_id, e.source, e.target, e.type, e.weight FROM merged e
WHERE EXISTS (SELECT 1 FROM repo_files f WHERE f.repo_id = e.repo_id AND f.key = e.source AND f.language IN {CODE})
  AND EXISTS (SELECT 1 FROM repo_files f WHERE f.repo_id = e.repo_id AND f.key = e.target AND f.language IN {CODE})""",
          "edges repo_files")
def j16(t):
    return G.endpoints_in(merged(t), t.repo_files.where(P.is_code(c("language"))))


@register("j17_edges_to_modules", "+ " + MODULES + " SELECT * FROM module_edges", CODE_TABLES)
def j17(t):
    return module_edges(t)


@register("j25_neighbours", "+ " + NEAR + """
SELECT repo_id, key, other, type, dir, weight, other_fan_in FROM near""", FULL)
def j25(t):
    return near(t).select("repo_id", "key", "other", "type", "dir", "weight", "other_fan_in")


_LIMIT = """CASE type || dir WHEN 'CONTAINSout' THEN 10 WHEN 'CALLSout' THEN 6 WHEN 'CALLSin' THEN 6 WHEN 'EXTENDSout' THEN 6
  WHEN 'EXTENDSin' THEN 6 WHEN 'IMPORTSout' THEN 8 WHEN 'IMPORTSin' THEN 8 WHEN 'CO_CHANGEDout' THEN 5 ELSE 0 END"""
TOPREL = NEAR + f""",
toprel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, key, type, dir ORDER BY weight DESC, other) AS position
  FROM near) WHERE position <= {_LIMIT})"""


@register("w03_top_relations", "+ " + TOPREL + " SELECT repo_id, key, other, type, dir, weight, position FROM toprel", FULL)
def w03(t):
    return G.top_relations(near(t), G.FACT_LIMITS).select(
        "repo_id", "key", "other", "type", "dir", "weight", c("position").cast("long").alias("position")
    )


@register("w04_node_relations", "+ " + NEAR + """
SELECT repo_id, key, other, type, dir, weight, position FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, key, type, dir
  ORDER BY weight DESC, other_fan_in DESC, other) AS position FROM near) WHERE position <= 50""", FULL)
def w04(t):
    return G.node_relations(near(t)).select(
        "repo_id", "key", "other", "type", "dir", "weight", c("position").cast("long").alias("position")
    )


@register("w06_neighbour_cap", "+ " + NEAR + """
SELECT repo_id, key, other, type, dir, position FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, key
  ORDER BY weight DESC, other, type, dir) AS position FROM near WHERE type IN ('CALLS', 'EXTENDS', 'IMPORTS')) WHERE position <= 4""", FULL)
def w06(t):
    return G.neighbour_cap(near(t, ["CALLS", "EXTENDS", "IMPORTS"])).select(
        "repo_id", "key", "other", "type", "dir", c("position").cast("long").alias("position")
    )


@register("w08_percentile_threshold", "+ " + CODE_FILES + """
SELECT repo_id, greatest(10, max(c) FILTER (rn = floor(0.05 * n) + 1)) AS threshold FROM (
  SELECT repo_id, fan_in + fan_out AS c, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in + fan_out DESC) AS rn,
    count(*) OVER (PARTITION BY repo_id) AS n FROM code_files) GROUP BY 1""", CODE_TABLES)
def w08(t):
    coupled = code_files(t).select("repo_id", (c("fan_in") + c("fan_out")).alias("coupling"))
    return value_at_rank(coupled, ["repo_id"], "coupling", 0.05, "threshold").withColumn(
        "threshold", F.greatest(F.lit(10), "threshold")
    )


@register("u01_node_set", "+ " + NODES + """
SELECT repo_id, key, kind, name, path, loc, fan_in, fan_out FROM nodes""", GRAPH_TABLES)
def u01(t):
    return nodes(t).select("repo_id", "key", "kind", "name", "path", "loc", "fan_in", "fan_out")


@register("u02_edge_set", "+ " + CO + ", " + MERGED + ", " + ALLEDGES + " SELECT * FROM alledges", "edges changes")
def u02(t):
    parts = [t.contains, t.file_imports, t.package_imports, t.entity_links]
    return G.merge_edges(G.edge_union(*parts)).unionByName(co_change(t))


@register("k03_top_files", "+ " + CODE_FILES + """,
shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in + fan_out + churn / 50 DESC, key) AS rn
  FROM code_files) WHERE rn <= 400)
SELECT s.repo_id, s.key, s.fan_in, s.fan_out, s.churn, a.total, a.total > count(*) OVER (PARTITION BY s.repo_id) AS truncated
FROM shown s JOIN (SELECT repo_id, count(*) AS total FROM repo_files GROUP BY 1) a ON s.repo_id = a.repo_id""", CODE_TABLES)
def k03(t):
    zero = F.lit(0).cast("long")
    every = G.with_degrees(t.repo_files, G.degrees(merged(t))).join(metrics(t).select("repo_id", "path", "churn"), ["repo_id", "path"], "left")
    return G.hottest_files(every.withColumn("churn", F.coalesce("churn", zero))).select(
        "repo_id", "key", "fan_in", "fan_out", "churn", "total", "truncated"
    )


@register("k04_top_entities", "+ " + NODES + """
SELECT repo_id, key, fan_in, fan_out FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in + fan_out DESC, key) AS rn
  FROM nodes WHERE kind = 'entity') WHERE rn <= 400""", GRAPH_TABLES)
def k04(t):
    ents = nodes(t).where(c("kind") == "entity")
    return top_per_group(ents, ["repo_id"], [(c("fan_in") + c("fan_out")).desc(), c("key")], 400).select(
        "repo_id", "key", "fan_in", "fan_out"
    )


@register("k05_most_imported", "+ " + CODE_FILES + """
SELECT repo_id, path, fan_in FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, path) AS rn
  FROM code_files) WHERE rn <= 12""", CODE_TABLES)
def k05(t):
    return top_per_group(code_files(t), ["repo_id"], [c("fan_in").desc(), c("path")], 12).select("repo_id", "path", "fan_in")


@register("k06_key_entities", "+ " + NODES + """
SELECT repo_id, key, type, fan_in FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, key) AS rn
  FROM nodes WHERE kind = 'entity' AND type <> 'method') WHERE rn <= 20""", GRAPH_TABLES)
def k06(t):
    ents = nodes(t).where((c("kind") == "entity") & (c("type") != "method"))
    return top_per_group(ents, ["repo_id"], [c("fan_in").desc(), c("key")], 20).select("repo_id", "key", "type", "fan_in")


# strongly connected components: the oracle closes reachability over file imports
SCC = """links AS (SELECT DISTINCT repo_id, source, target FROM file_imports WHERE source <> target),
reach(repo_id, a, b) AS (SELECT repo_id, source, target FROM links
  UNION SELECT r.repo_id, r.a, l.target FROM reach r JOIN links l ON r.repo_id = l.repo_id AND r.b = l.source),
mutual AS (SELECT x.repo_id, x.a AS node, x.b AS peer FROM reach x JOIN reach y
  ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b),
members AS (SELECT repo_id, node, least(node, min(peer)) AS component, count(DISTINCT peer) + 1 AS size FROM mutual GROUP BY 1, 2)"""


def file_members(t):
    return C.strongly_connected(t.file_imports)


@register("g01_strongly_connected", "RECURSIVE + " + SCC + " SELECT * FROM members", "file_imports")
def g01(t):
    return file_members(t)


CYCLE = SCC + """,
inner_links AS (SELECT l.*, m.component FROM links l JOIN members m ON l.repo_id = m.repo_id AND l.source = m.node
  JOIN members n ON l.repo_id = n.repo_id AND l.target = n.node AND m.component = n.component),
walk(repo_id, component, path, closed) AS (
  SELECT DISTINCT repo_id, component, [component], false FROM members
  UNION ALL SELECT w.repo_id, w.component, list_append(w.path, l.target), l.target = w.component
  FROM walk w JOIN inner_links l ON w.repo_id = l.repo_id AND w.component = l.component AND w.path[-1] = l.source
  WHERE NOT w.closed AND (l.target = w.component OR NOT list_contains(w.path, l.target))),
cycles AS (SELECT repo_id, component, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, component ORDER BY len(path), path) AS rn
  FROM walk WHERE closed) WHERE rn = 1)"""


@register("g02_sample_cycle", "RECURSIVE + " + CYCLE + """
SELECT repo_id, component, array_to_string(path, ' > ') AS cycle FROM cycles""", "file_imports")
def g02(t):
    members = file_members(t)
    return C.sample_cycles(members, t.file_imports).select("repo_id", "component", F.array_join("cycle", " > ").alias("cycle"))


@register("k12_largest_components", "RECURSIVE + " + SCC + """
SELECT repo_id, component, size, position FROM (SELECT DISTINCT repo_id, component, size,
  row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, component) AS position FROM members WHERE node = component) WHERE position <= 15""",
          "file_imports")
def k12(t):
    return C.largest_components(file_members(t)).select(
        "repo_id", "component", "size", c("position").cast("long").alias("position")
    )


EGO = NEAR + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, key ORDER BY other_fan_in DESC, other, type, dir) AS p FROM near),
usable AS (SELECT * FROM ranked WHERE p <= 60 AND type <> 'CO_CHANGED'),
focus AS (SELECT repo_id, key AS focus FROM repo_files),
one AS (SELECT f.focus, u.* FROM focus f JOIN usable u ON f.repo_id = u.repo_id AND f.focus = u.key),
front AS (SELECT DISTINCT repo_id, focus, other AS key FROM one WHERE other <> focus),
two AS (SELECT f.focus, u.* FROM front f JOIN usable u ON f.repo_id = u.repo_id AND f.key = u.key WHERE u.p <= 12),
ego AS (SELECT DISTINCT repo_id, focus, CASE WHEN dir = 'out' THEN key ELSE other END AS source,
  CASE WHEN dir = 'out' THEN other ELSE key END AS target, type, weight FROM (SELECT * FROM one UNION ALL SELECT * FROM two))"""


def file_ego(t, depth=2):
    focus = t.repo_files.select("repo_id", c("key").alias("focus"))
    return G.ego_links(focus, near(t), depth)


@register("g07_ego_graph", "+ " + EGO + " SELECT * FROM ego", FULL)
def g07(t):
    return file_ego(t)


@register("g09_import_neighbourhood", "+ " + NEAR + """,
imp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, key ORDER BY other_fan_in DESC, other, type, dir) AS p FROM near)
   WHERE p <= 60 AND type = 'IMPORTS' AND key LIKE 'f:%')
SELECT DISTINCT repo_id, key AS focus, unnest([key, other]) AS key FROM imp""", FULL)
def g09(t):
    return G.import_neighbourhood(file_ego(t, 1))


@register("g10_graph_facts", "+ " + TOPREL + """,
named AS (SELECT repo_id, key, type, dir, string_agg(other_label, ', ' ORDER BY position) AS names FROM toprel GROUP BY 1, 2, 3, 4),
worded AS (SELECT repo_id, key, CASE type || dir WHEN 'CONTAINSout' THEN 0 WHEN 'CALLSout' THEN 1 WHEN 'CALLSin' THEN 2 WHEN 'EXTENDSout' THEN 3
    WHEN 'EXTENDSin' THEN 4 WHEN 'IMPORTSout' THEN 5 WHEN 'IMPORTSin' THEN 6 ELSE 7 END AS i,
  CASE type || dir WHEN 'CONTAINSout' THEN 'contains ' WHEN 'CALLSout' THEN 'calls ' WHEN 'CALLSin' THEN 'is called by '
    WHEN 'EXTENDSout' THEN 'extends/implements ' WHEN 'EXTENDSin' THEN 'is extended by ' WHEN 'IMPORTSout' THEN 'imports '
    WHEN 'IMPORTSin' THEN 'is imported by ' ELSE 'historically co-changes with ' END || names AS s FROM named),
facts AS (SELECT n.repo_id, n.key, CASE n.kind WHEN 'file' THEN 'file ' || n.path WHEN 'package' THEN 'package ' || n.name
    ELSE n.type || ' ' || n.qualified_name || ' (' || n.path || ':' || n.start_line || ')' END || ' — ' || b.body AS fact
  FROM nodes n JOIN (SELECT repo_id, key, string_agg(s, '; ' ORDER BY i) AS body FROM worded GROUP BY 1, 2) b
    ON n.repo_id = b.repo_id AND n.key = b.key)
SELECT * FROM facts""", FULL)
def g10(t):
    return G.graph_facts(nodes(t), near(t))


@register("r12_name_search", "+ " + NODES + """,
terms AS (SELECT DISTINCT r.repo_id, lower(p.p_name[1:position(' ' IN p.p_name) - 1]) AS term FROM part p, (SELECT DISTINCT repo_id FROM repo_files) r
  UNION SELECT repo_id, 'unit_' || term FROM (SELECT DISTINCT repo_id, CAST(p_size AS VARCHAR) AS term FROM part, (SELECT DISTINCT repo_id FROM repo_files) r)
  UNION SELECT repo_id, '.' || x FROM (SELECT unnest(['py', 'go']) AS x), (SELECT DISTINCT repo_id FROM repo_files) r),
scored AS (SELECT n.repo_id, t.term, n.key, CASE WHEN lower(n.name) = term THEN 100 WHEN starts_with(lower(n.name), term) THEN 70
    WHEN contains(lower(n.name), term) THEN 50 ELSE 30 END + least(20, n.fan_in) + CASE WHEN n.kind = 'file' THEN 5 ELSE 0 END AS score
  FROM nodes n JOIN terms t ON n.repo_id = t.repo_id
  WHERE n.kind IN ('file', 'entity') AND (contains(lower(n.name), term) OR contains(lower(coalesce(n.qualified_name || ' ', '') || n.path), term)))
SELECT repo_id, term, key, score FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, term ORDER BY score DESC, key) AS rn FROM scored)
WHERE rn <= 25""", GRAPH_TABLES)
def r12(t):
    repos = t.repo_files.select("repo_id").distinct()
    words = t.part.select(
        F.explode(
            F.array(F.lower(F.substring_index("p_name", " ", 1)), F.concat(F.lit("unit_"), "p_size"), F.lit(".py"), F.lit(".go"))
        ).alias("term")
    ).distinct()
    every = words.withColumn("repo_id", F.explode(F.array(F.lit("F"), F.lit("O"))))
    terms = every.join(repos, "repo_id", "left_semi")
    return G.search_names(nodes(t), terms)
