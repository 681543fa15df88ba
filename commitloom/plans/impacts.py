"""Change-impact queries. Every file is one request that asks: what depends on a change here?"""

from __future__ import annotations

from pyspark.sql import functions as F

from commitloom.functions import paths as P
from commitloom.operators import impact as I
from commitloom.operators import reach as R
from commitloom.operators.history import commit_percentile
from commitloom.plans.changes import CO, METRICS, all_files, co_change, metrics
from commitloom.plans import graphs
from commitloom.plans.graphs import ALLEDGES, FULL, NODES, full_edges, structure
from commitloom.plans.registry import register

c = F.col
RQ = ["repo_id", "request_id"]
TABLES = FULL + " commits tree"


def nodes(t):
    return t.stored("nodes", graphs.nodes)


def targets(t):
    return t.repo_files.select("repo_id", c("key").alias("request_id"), "key")


SEEDS = NODES + """,
targets AS (SELECT repo_id, key AS request_id, key FROM repo_files),
seeds AS (SELECT repo_id, request_id, key, true AS is_target, CAST([] AS VARCHAR[]) AS up FROM targets
  UNION ALL SELECT t.repo_id, t.request_id, e.target, false, [t.key] FROM targets t JOIN merged e
    ON t.repo_id = e.repo_id AND t.key = e.source AND e.type = 'CONTAINS')"""

_LEVEL = """
arr{d} AS (SELECT f.repo_id, f.request_id, b.other AS key, f.key AS parent, b.relation, f.chain,
    1.0 / {d} * least(2, 0.6 + log2(1 + b.w)) AS score FROM front{p} f JOIN {dep} b ON f.repo_id = b.repo_id AND f.key = b.key),
lvl{d} AS (SELECT * FROM (SELECT *, {d} AS depth, row_number() OVER (PARTITION BY repo_id, request_id, key
    ORDER BY round(score, 9) DESC, parent, relation) AS rn FROM arr{d} a
  WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.repo_id = a.repo_id AND t.request_id = a.request_id AND t.key = a.key)
  {seen}) WHERE rn = 1),
front{d} AS (SELECT repo_id, request_id, key, list_prepend(key, chain) AS chain FROM lvl{d} l
  WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.repo_id = l.repo_id AND s.request_id = l.request_id AND s.key = l.key))"""
_SEEN = "AND NOT EXISTS (SELECT 1 FROM lvl{q} b WHERE b.repo_id = a.repo_id AND b.request_id = a.request_id AND b.key = a.key)"

REACH = CO + ", " + SEEDS + ", " + ALLEDGES + """,
deps AS (SELECT repo_id, target AS key, source AS other, lower(type) AS relation,
    CASE type WHEN 'CALLS' THEN weight WHEN 'EXTENDS' THEN 2.0 ELSE 1.0 END AS w FROM alledges WHERE type IN ('CALLS', 'EXTENDS', 'IMPORTS')),
incoming AS (SELECT repo_id, target AS file_key, source AS other, type FROM alledges WHERE target LIKE 'f:%'
  UNION ALL SELECT repo_id, source, target, type FROM alledges WHERE type = 'CO_CHANGED'),
importers AS (SELECT * FROM incoming WHERE type = 'IMPORTS'),
deps1 AS (SELECT * FROM deps UNION ALL SELECT n.repo_id, n.key, i.other, 'imports module of', 0.6 FROM nodes n JOIN importers i
  ON n.repo_id = i.repo_id AND n.file_key = i.file_key WHERE n.kind = 'entity' AND n.exported),
front0 AS (SELECT repo_id, request_id, key, list_concat([key], up) AS chain FROM seeds),
""" + ",".join(
    _LEVEL.format(d=d, p=d - 1, dep="deps1" if d == 1 else "deps", seen=" ".join(_SEEN.format(q=q) for q in range(1, d)))
    for d in (1, 2, 3)
) + """,
reached AS (SELECT repo_id, request_id, key, depth, score, relation, parent, chain AS via FROM (
  SELECT * FROM lvl1 UNION ALL SELECT * FROM lvl2 UNION ALL SELECT * FROM lvl3)),
impacted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, request_id ORDER BY depth, round(score, 9) DESC, key) AS position
  FROM reached) WHERE position <= 300)"""

FILES = REACH + ", " + METRICS + """,
impacted_files AS (SELECT i.repo_id, i.request_id, h.file_key, min(i.depth) AS depth,
    array_to_string(list_sort(list_distinct(list(trim(i.relation || ' ' || coalesce(CASE p.kind WHEN 'entity' THEN p.qualified_name WHEN 'file' THEN p.path ELSE p.name END, ''))))), '; ') AS reasons
  FROM reached i JOIN (SELECT repo_id, key, CASE WHEN kind = 'file' THEN key ELSE file_key END AS file_key FROM nodes) h
    ON i.repo_id = h.repo_id AND i.key = h.key
  LEFT JOIN nodes p ON p.repo_id = i.repo_id AND p.key = i.parent
  WHERE h.file_key IS NOT NULL AND h.file_key <> i.request_id GROUP BY 1, 2, 3),
partners AS (SELECT * FROM (SELECT b.repo_id, b.key AS request_id, b.other AS key, b.weight,
    row_number() OVER (PARTITION BY b.repo_id, b.key ORDER BY b.weight DESC, b.other) AS rn
  FROM (SELECT repo_id, source AS key, target AS other, weight FROM co UNION ALL SELECT repo_id, target, source, weight FROM co) b)),
test_files AS (SELECT repo_id, key AS file_key, lower(regexp_extract(path, '[^/]*$')) AS name FROM repo_files WHERE path LIKE '%/tests/%'),
related AS (SELECT repo_id, request_id, file_key, arg_min(reason, o) AS reason FROM (
    SELECT i.repo_id, i.request_id, i.file_key, 2 AS o, 'reaches the change' AS reason FROM impacted_files i
      JOIN test_files x ON i.repo_id = x.repo_id AND i.file_key = x.file_key
    UNION ALL SELECT i.repo_id, i.request_id, i.key, 1, 'often committed with it' FROM partners i
      JOIN test_files x ON i.repo_id = x.repo_id AND i.key = x.file_key
    UNION ALL SELECT f.repo_id, f.key, x.file_key, 0, 'its name contains the file''s' FROM repo_files f JOIN test_files x ON f.repo_id = x.repo_id
      AND contains(x.name, lower(regexp_replace(regexp_extract(f.path, '[^/]*$'), '[.][^.]+$', ''))))
  GROUP BY 1, 2, 3),
tests AS (SELECT * FROM related)"""


def reached(t, chains=False):
    return t.stored("chains" if chains else "reached", lambda t: R.reverse_reach(targets(t), nodes(t), full_edges(t), chains=chains))


def impacted(t, chains=False):
    """The list that is shown; nothing is computed from it."""
    return R.top_impacted(reached(t, chains), 300)


def target_files(t):
    own = metrics(t).select("repo_id", P.file_key(c("path")).alias("file_key"), "commit_count", "authors")
    return own.withColumn("request_id", c("file_key"))


def impacted_files(t):
    return I.impacted_files(reached(t), target_files(t), nodes(t))


def tests(t, files=None, partners=None):
    own = target_files(t)
    return I.related_tests(
        files if files is not None else impacted_files(t),
        partners if partners is not None else I.co_change_partners(own, co_change(t)), own, t.repo_files,
    )


@register("g03_reverse_reach", "+ " + REACH + """
SELECT repo_id, request_id, key, depth, round(score, 6) AS score, relation, parent FROM reached""", TABLES)
def g03(t):
    return reached(t).select("repo_id", "request_id", "key", "depth", F.round("score", 6).alias("score"), "relation", "parent")


@register("g04_seed_expansion", "+ " + SEEDS + """
SELECT repo_id, request_id, key, is_target, array_to_string(up, ' ') AS up FROM seeds""", FULL)
def g04(t):
    return R.seed_expansion(targets(t), structure(t)).withColumn("up", F.array_join("up", " "))


@register("g05_exported_module_dependents", "+ " + REACH + """
SELECT s.repo_id, s.request_id, s.key, d.other, d.relation, d.w FROM seeds s JOIN deps1 d ON s.repo_id = d.repo_id AND s.key = d.key
WHERE d.relation = 'imports module of'""", TABLES)
def g05(t):
    seeds = R.seed_expansion(targets(t), structure(t)).select(*RQ, "key")
    return R.exported_module_dependents(seeds, nodes(t), full_edges(t))


@register("g06_explain_path", "+ " + REACH + """
SELECT repo_id, request_id, key, array_to_string(via, ' < ') AS via FROM reached""", TABLES)
def g06(t):
    return reached(t, chains=True).select(*RQ, "key", F.array_join("via", " < ").alias("via"))


@register("g08_ripple_graph", "+ " + FILES + """,
top AS (SELECT * FROM impacted WHERE position <= 70),
drawn AS (SELECT repo_id, request_id, key FROM top UNION SELECT repo_id, request_id, key FROM targets),
hops AS (SELECT repo_id, request_id, key AS target, relation, unnest(via) AS hop, generate_subscripts(via, 1) AS n FROM top)
SELECT h.repo_id, h.request_id, arg_min(h.hop, h.n) AS source, h.target, h.relation AS type FROM hops h JOIN drawn d
  ON h.repo_id = d.repo_id AND h.request_id = d.request_id AND h.hop = d.key GROUP BY 1, 2, 4, 5
UNION ALL SELECT repo_id, request_id, request_id, key, 'co-changes' FROM partners WHERE rn <= 8""", TABLES)
def g08(t):
    own = target_files(t)
    return R.ripple_graph(
        targets(t).withColumn("file_key", c("key")), impacted(t, chains=True), I.co_change_partners(own, co_change(t))
    )


@register("k11_impact_list", "+ " + REACH + """
SELECT repo_id, request_id, key, depth, position FROM impacted""", TABLES)
def k11(t):
    return impacted(t).select(*RQ, "key", "depth", c("position").cast("long").alias("position"))


@register("u06_impacted_except_targets", "+ " + REACH + """
SELECT repo_id, request_id, count(*) AS impacted FROM reached WHERE key <> request_id GROUP BY 1, 2""", TABLES)
def u06(t):
    others = reached(t).join(targets(t), [*RQ, "key"], "left_anti")
    return others.groupBy(*RQ).agg(F.count("*").alias("impacted"))


@register("a16_impacted_files", "+ " + FILES + """
SELECT repo_id, request_id, file_key, depth, reasons FROM impacted_files""", TABLES)
def a16(t):
    return impacted_files(t).withColumn("reasons", F.array_join("reasons", "; "))


@register("a22_distinct_directories", "+ " + FILES + """
SELECT repo_id, request_id, count(DISTINCT regexp_replace(file_key, '/[^/]*$', '')) AS directories FROM impacted_files GROUP BY 1, 2""", TABLES)
def a22(t):
    path = F.expr("substring(file_key, 3)")
    return impacted_files(t).groupBy(*RQ).agg(F.count_distinct(P.dirname(path)).alias("directories"))


@register("j24_related_tests", "+ " + FILES + " SELECT repo_id, request_id, file_key, reason FROM tests", TABLES)
def j24(t):
    return tests(t)


@register("r10_edge_score", "+ " + REACH + """
SELECT repo_id, key, other, relation, round(1.0 / d * least(2, 0.6 + log2(1 + w)), 6) AS score, d AS depth
FROM deps1, (SELECT unnest([1, 2, 3]) AS d)""", TABLES)
def r10(t):
    from commitloom.functions.scores import dependency_score

    edges = full_edges(t)
    seeds = nodes(t).select("repo_id", "key")
    extra = R.exported_module_dependents(seeds, nodes(t), edges)
    rows = R.dependents(edges).unionByName(extra.select("repo_id", "key", "other", "relation", "w"))
    levels = rows.withColumn("depth", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return levels.select(
        "repo_id", "key", "other", "relation", "depth", F.round(dependency_score(c("depth"), c("w")), 6).alias("score")
    )


RISK = FILES + """,
breadth AS (SELECT repo_id, request_id, count(*) FILTER (NOT contains(file_key, '/tests/')) AS dependents FROM impacted_files GROUP BY 1, 2),
coupling AS (SELECT repo_id, request_id, sum(weight) AS coupling FROM partners GROUP BY 1, 2),
test_count AS (SELECT repo_id, request_id, count(*) AS tests FROM tests GROUP BY 1, 2),
shares AS (SELECT DISTINCT repo_id, commit_count, cume_dist() OVER (PARTITION BY repo_id ORDER BY commit_count) AS pct
  FROM (SELECT r.repo_id, coalesce(m.commit_count, 0) AS commit_count FROM tree f CROSS JOIN (VALUES ('F'), ('O')) AS r(repo_id)
    LEFT JOIN metrics m ON m.repo_id = r.repo_id AND m.path = f.path)),
base AS (SELECT f.repo_id, f.key AS request_id, coalesce(b.dependents, 0) AS dependents, coalesce(d.fan_in, 0) AS fan_in,
    m.commit_count, y.pct, coalesce(q.coupling, 0) AS co, coalesce(x.tests, 0) AS tests, m.authors
  FROM repo_files f JOIN metrics m ON f.repo_id = m.repo_id AND f.path = m.path
  JOIN shares y ON y.repo_id = f.repo_id AND y.commit_count = m.commit_count
  LEFT JOIN degree d ON f.repo_id = d.repo_id AND f.key = d.key
  LEFT JOIN breadth b ON f.repo_id = b.repo_id AND f.key = b.request_id
  LEFT JOIN coupling q ON f.repo_id = q.repo_id AND f.key = q.request_id
  LEFT JOIN test_count x ON f.repo_id = x.repo_id AND f.key = x.request_id),
factors AS (SELECT repo_id, request_id, CAST(floor(least(1, dependents / 20) * 35 + 0.5) AS INT) AS breadth,
    CAST(floor(least(1, fan_in / 12) * 20 + 0.5) AS INT) AS centrality,
    CASE WHEN commit_count > 1 THEN CAST(floor(pct * 15 + 0.5) AS INT) ELSE 0 END AS frequency,
    CAST(floor(least(1, co / 12) * 10 + 0.5) AS INT) AS coupling,
    CASE WHEN tests = 0 THEN 15 WHEN tests < 2 THEN 6 ELSE 0 END AS untested,
    CASE WHEN authors = 1 AND commit_count >= 3 THEN 5 ELSE 0 END AS ownership FROM base)"""


def risk(t):
    own = target_files(t)
    all_nodes = nodes(t)
    files = I.impacted_files(reached(t), own, all_nodes)
    partners = I.co_change_partners(own, co_change(t))
    related = I.related_tests(files, partners, own, t.repo_files)
    degree = all_nodes.select("repo_id", c("key").alias("file_key"), "fan_in")
    facts = own.join(degree, ["repo_id", "file_key"])
    return I.risk_scores(targets(t), files, partners, related, facts, commit_percentile(metrics(t), all_files(t)))


@register("r11_risk_score", "+ " + RISK + """
SELECT *, greatest(0, least(100, breadth + centrality + frequency + coupling + untested + ownership)) AS score,
  CASE WHEN breadth + centrality + frequency + coupling + untested + ownership < 30 THEN 'low'
       WHEN breadth + centrality + frequency + coupling + untested + ownership < 60 THEN 'medium' ELSE 'high' END AS level
FROM factors""", TABLES)
def r11(t):
    return risk(t).drop("directories")


# --- diffs ---------------------------------------------------------------------------------------

MATCHED = """matched AS (SELECT d.repo_id, d.path, min(f.path) AS file FROM (SELECT DISTINCT repo_id, path FROM hunks) d
  JOIN repo_files f ON d.repo_id = f.repo_id AND (f.path = d.path OR ends_with(f.path, '/' || d.path) OR ends_with(d.path, '/' || f.path))
  GROUP BY 1, 2),
located AS (SELECT DISTINCT h.repo_id, h.request_id, 'f:' || m.file AS file_key, h.start, h.end_ FROM hunks h
  JOIN matched m ON h.repo_id = m.repo_id AND h.path = m.path),
hits AS (SELECT DISTINCT l.repo_id, l.request_id, l.file_key, e.key, e.start_line, e.end_line FROM located l JOIN entities e
  ON l.repo_id = e.repo_id AND l.file_key = e.file_key AND e.start_line <= l.end_ AND e.end_line >= l.start),
spans AS (SELECT *, count(*) OVER (PARTITION BY repo_id, request_id, file_key, start_line, end_line) AS equal_spans,
  min(end_line) OVER (PARTITION BY repo_id, request_id, file_key ORDER BY start_line DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later_end,
  min(end_line) OVER (PARTITION BY repo_id, request_id, file_key, start_line) AS same_end FROM hits),
inner_hits AS (SELECT * FROM spans WHERE equal_spans = 1 AND same_end = end_line AND coalesce(later_end, end_line + 1) > end_line),
counted_hits AS (SELECT l.repo_id, l.request_id, l.file_key, count(i.key) AS n FROM (SELECT DISTINCT repo_id, request_id, file_key FROM located) l
  LEFT JOIN inner_hits i ON l.repo_id = i.repo_id AND l.request_id = i.request_id AND l.file_key = i.file_key GROUP BY 1, 2, 3),
diff_targets AS (SELECT x.repo_id, x.request_id, x.file_key, i.key FROM counted_hits x JOIN inner_hits i
    ON x.repo_id = i.repo_id AND x.request_id = i.request_id AND x.file_key = i.file_key WHERE x.n BETWEEN 1 AND 12
  UNION ALL SELECT repo_id, request_id, file_key, file_key FROM counted_hits WHERE n NOT BETWEEN 1 AND 12)"""
DIFF = "hunks repo_files entities"


def located(t):
    hunks = t.hunks.withColumnRenamed("end_", "end")
    files = I.match_paths(hunks, t.repo_files)
    return hunks.join(files, ["repo_id", "path"]).select(*RQ, "file_key", "start", "end")


def diff_targets(t):
    where = located(t)
    return I.innermost(I.diff_entities(where, t.entities), where)


@register("j10_match_diff_files", "+ " + MATCHED + """
SELECT DISTINCT h.repo_id, h.request_id, h.path, 'f:' || m.file AS file_key FROM hunks h JOIN matched m ON h.repo_id = m.repo_id AND h.path = m.path""",
          DIFF)
def j10(t):
    return I.match_diff_files(t.hunks, t.repo_files)


@register("j11_diff_entities", "+ " + MATCHED + " SELECT * FROM hits", DIFF)
def j11(t):
    return I.diff_entities(located(t), t.entities)


@register("j12_innermost", "+ " + MATCHED + " SELECT * FROM diff_targets", DIFF)
def j12(t):
    return diff_targets(t)


@register("u04_impact_targets", "+ " + MATCHED + """,
picked AS (SELECT repo_id, sha AS request_id, 'f:' || path AS key FROM changes WHERE change_type = 'A'),
named AS (SELECT * FROM picked UNION SELECT repo_id, request_id, key FROM diff_targets WHERE key LIKE 'e:%'),
mentioned AS (SELECT repo_id, sha AS request_id, 'f:' || path AS key, additions AS position FROM changes)
SELECT repo_id, request_id, key FROM named
UNION SELECT repo_id, request_id, key FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, request_id ORDER BY position, key) AS rn
  FROM mentioned m WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.repo_id = m.repo_id AND n.request_id = m.request_id)) WHERE rn <= 4""",
          DIFF + " changes")
def u04(t):
    keyed = t.changes.select("repo_id", c("sha").alias("request_id"), P.file_key(c("path")).alias("key"), "change_type", "additions")
    picked = keyed.where(c("change_type") == "A")
    mentioned = keyed.withColumn("position", c("additions"))
    return I.choose_targets(picked, diff_targets(t).where(c("key").startswith("e:")), mentioned)


@register("a20_impact_input_hash", """
SELECT ch.repo_id, ch.sha, sha1('["' || replace(CAST(to_json(list_sort(list(path))) AS VARCHAR), '"', '\\"') || '","' || lower(any_value(message)) || '",""]') AS input_hash
FROM changes ch JOIN commits co ON ch.repo_id = co.repo_id AND ch.sha = co.sha GROUP BY 1, 2""", "changes commits")
def a20(t):
    from commitloom.operators.reuse import impact_input_hash

    requests = t.changes.join(t.commits.select("repo_id", "sha", "message"), ["repo_id", "sha"]).groupBy(
        "repo_id", "sha", "message"
    ).agg(F.collect_list("path").alias("targets"))
    return requests.select("repo_id", "sha", impact_input_hash(c("targets"), c("message"), F.lit(None)).alias("input_hash"))
