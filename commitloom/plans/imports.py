"""Import and name resolution queries (J1-J8) over the import lines of the derived sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitloom.operators import imports as M
from commitloom.operators import names as N
from commitloom.plans.registry import register

c = F.col
KEY = ["repo_id", "path", "language", "spec"]


def specs(t, *languages):
    rows = t.import_specs.select(*KEY)
    return rows.where(c("language").isin(*languages)) if languages else rows


def resolve(t, *languages, where=None, first=False):
    rows = specs(t, *languages)
    if where is not None:
        rows = rows.where(where)
    return M.resolve_imports(rows, t.repo_files.select("repo_id", "path"), languages=languages or None, first=first)


# candidate target paths of script and Python imports, written out as (spec, candidate, rank)
_PROBE = """base AS (SELECT repo_id, path, language, spec, CASE
    WHEN language = 'python' THEN replace(spec, '.', '/')
    WHEN spec LIKE '.%' THEN regexp_replace(spec, '^([.][.]/)+', '') ELSE 'src/' || substr(spec, 3) END AS stem,
    spec LIKE '@/%' AS aliased FROM import_specs WHERE language IN ('typescript', 'python')),
exts AS (SELECT * FROM (VALUES ('typescript', '.ts', 1), ('python', '.py', 1)) AS v(language, ext, rank)),
files AS (SELECT DISTINCT repo_id, path FROM repo_files),
hits AS (SELECT b.repo_id, b.path, b.language, b.spec, f.path AS target FROM base b JOIN exts x ON b.language = x.language
  JOIN files f ON f.repo_id = b.repo_id AND f.path = b.stem || x.ext
  UNION ALL SELECT b.repo_id, b.path, b.language, b.spec, f.path FROM base b JOIN files f ON f.repo_id = b.repo_id AND b.aliased AND f.path = substr(b.spec, 3) || '.ts'
    AND NOT EXISTS (SELECT 1 FROM files g WHERE g.repo_id = b.repo_id AND g.path = b.stem || '.ts'))"""


@register("j01_resolve_relative", "+ " + _PROBE + " SELECT DISTINCT * FROM hits WHERE spec LIKE '.%' AND path <> target", "import_specs repo_files")
def j01(t):
    return resolve(t, "typescript", where=c("spec").startswith("."))


@register("j02_resolve_alias_root", "+ " + _PROBE + " SELECT DISTINCT * FROM hits WHERE spec LIKE '@/%' AND path <> target", "import_specs repo_files")
def j02(t):
    return resolve(t, "typescript", where=c("spec").startswith("@/"))


@register("j03_resolve_module", "+ " + _PROBE + " SELECT DISTINCT * FROM hits WHERE language = 'python' AND path <> target", "import_specs repo_files")
def j03(t):
    return resolve(t, "python")


@register("j04_resolve_suffix", """
SELECT DISTINCT s.repo_id, s.path, s.language, s.spec, f.path AS target FROM import_specs s JOIN repo_files f
  ON s.repo_id = f.repo_id AND f.path LIKE '%/' || replace(s.spec, '.', '/') || '.java' WHERE s.language = 'java' AND s.path <> f.path""",
          "import_specs repo_files")
def j04(t):
    return resolve(t, "java")


@register("j05_resolve_directory", """
+ dirs AS (SELECT repo_id, regexp_replace(path, '/[^/]*$', '') AS dir, path FROM repo_files),
best AS (SELECT s.repo_id, s.path, s.language, s.spec, min(struct_pack(n := length(s.spec) - length(d.dir), d := d.dir)) AS b FROM import_specs s
  JOIN (SELECT DISTINCT repo_id, dir FROM dirs) d ON s.repo_id = d.repo_id AND ends_with(s.spec, '/' || d.dir) WHERE s.language = 'go' GROUP BY 1, 2, 3, 4)
SELECT repo_id, path, language, spec, target FROM (SELECT b.repo_id, b.path, b.language, b.spec, d.path AS target,
  row_number() OVER (PARTITION BY b.repo_id, b.path, b.spec ORDER BY d.path) AS rn
  FROM best b JOIN dirs d ON b.repo_id = d.repo_id AND b.b.d = d.dir WHERE d.path LIKE '%.go') WHERE rn <= 8 AND target <> path""",
          "import_specs repo_files")
def j05(t):
    return resolve(t, "go", first=True)


@register("j06_resolve_crate", """
SELECT DISTINCT s.repo_id, s.path, s.language, s.spec, f.path AS target FROM import_specs s JOIN repo_files f
  ON s.repo_id = f.repo_id AND f.path = 'src/' || replace(substr(s.spec, 8), '::', '/') || '.rs' WHERE s.language = 'rust' AND s.path <> f.path""",
          "import_specs repo_files")
def j06(t):
    return resolve(t, "rust")


_ALL = _PROBE + """,
go_dirs AS (SELECT repo_id, regexp_replace(path, '/[^/]*$', '') AS dir, path FROM repo_files WHERE path LIKE '%.go'),
go_best AS (SELECT s.repo_id, s.path, s.language, s.spec, min(struct_pack(n := length(s.spec) - length(d.dir), d := d.dir)) AS b FROM import_specs s
  JOIN (SELECT DISTINCT repo_id, regexp_replace(path, '/[^/]*$', '') AS dir FROM repo_files) d ON s.repo_id = d.repo_id AND ends_with(s.spec, '/' || d.dir) WHERE s.language = 'go' GROUP BY 1, 2, 3, 4),
every AS (SELECT * FROM hits
  UNION ALL SELECT s.repo_id, s.path, s.language, s.spec, f.path FROM import_specs s JOIN repo_files f
    ON s.repo_id = f.repo_id AND f.path LIKE '%/' || replace(s.spec, '.', '/') || '.java' WHERE s.language = 'java'
  UNION ALL SELECT s.repo_id, s.path, s.language, s.spec, f.path FROM import_specs s JOIN repo_files f
    ON s.repo_id = f.repo_id AND f.path = 'src/' || replace(substr(s.spec, 8), '::', '/') || '.rs' WHERE s.language = 'rust'
  UNION ALL SELECT repo_id, path, language, spec, target FROM (SELECT b.repo_id, b.path, b.language, b.spec, d.path AS target,
      row_number() OVER (PARTITION BY b.repo_id, b.path, b.spec ORDER BY d.path) AS rn
    FROM go_best b JOIN go_dirs d ON b.repo_id = d.repo_id AND b.b.d = d.dir) WHERE rn <= 8)"""


# an import of a directory links all its files
@register("j07_link_imports", "+ " + _ALL.replace(" WHERE rn <= 8", "") + """
SELECT DISTINCT repo_id, 'f:' || path AS source, 'f:' || target AS target, 'IMPORTS' AS type, 1.0::DOUBLE AS weight FROM every WHERE path <> target
UNION SELECT s.repo_id, 'f:' || s.path, 'p:' || CASE s.language WHEN 'python' THEN split_part(s.spec, '.', 1)
    WHEN 'typescript' THEN split_part(s.spec, '/', 1) || '/' || split_part(s.spec, '/', 2)
    WHEN 'java' THEN array_to_string(string_split(s.spec, '.')[1:2], '.') ELSE array_to_string(string_split(s.spec, '/')[1:3], '/') END,
  'IMPORTS', 1.0 FROM import_specs s WHERE s.language IN ('python', 'typescript', 'java', 'go') AND s.spec NOT LIKE '.%'
  AND NOT EXISTS (SELECT 1 FROM every n WHERE n.repo_id = s.repo_id AND n.path = s.path AND n.spec = s.spec)""",
          "import_specs repo_files")
def j07(t):
    rows = specs(t)
    hits = M.import_hits(rows, t.repo_files.select("repo_id", "path"))
    return M.link_imports(rows, hits.where(c("target") != c("path")), hits)


@register("j07_composed_build", "+ " + _ALL + """
SELECT DISTINCT repo_id, 'f:' || path AS source, 'f:' || target AS target, 'IMPORTS' AS type FROM every WHERE path <> target
UNION SELECT s.repo_id, 'f:' || s.path, 'p:' || CASE s.language WHEN 'python' THEN split_part(s.spec, '.', 1)
    WHEN 'typescript' THEN split_part(s.spec, '/', 1) || '/' || split_part(s.spec, '/', 2)
    WHEN 'java' THEN array_to_string(string_split(s.spec, '.')[1:2], '.') ELSE array_to_string(string_split(s.spec, '/')[1:3], '/') END,
  'IMPORTS' FROM import_specs s WHERE s.language IN ('python', 'typescript', 'java', 'go') AND s.spec NOT LIKE '.%'
  AND NOT EXISTS (SELECT 1 FROM every n WHERE n.repo_id = s.repo_id AND n.path = s.path AND n.spec = s.spec)
UNION SELECT repo_id, file_key, key, 'CONTAINS' FROM entities WHERE language <> 'markdown'""", "import_specs repo_files entities")
def composed(t):
    """Containment and imports of a snapshot built from the one before: a fifth of the files were new or differed then."""
    from commitloom.operators import build as B

    sources = t.stored("all_sources", lambda t: t.sources).select("repo_id", "path", "language", "content")
    part = F.pmod(F.xxhash64("path"), F.lit(10))
    first = sources.where(part != 0).withColumn("content", F.when(part == 1, F.concat("content", F.lit("\n// old"))).otherwise(c("content")))
    before = B.file_facts(first.unionByName(first.limit(3).withColumn("path", F.concat(F.lit("gone/"), "path")))).stored()
    snapshot, _ = B.rebuild(before, sources, t.changes, t.commits, first=True)
    return snapshot.edges.where(c("type").isin("CONTAINS", "IMPORTS")).select("repo_id", "source", "target", "type")


# names shared by parts of one brand file: the cascade over all parts as entities
_NAMED = """ent AS (SELECT p_partkey, 'r' AS repo_id, 'e' || p_partkey AS key, 'f:' || p_brand AS file_key, p_name || '_' || p_size AS name,
    CASE p_type WHEN 'ECONOMY' THEN 'class' WHEN 'SMALL' THEN 'interface' ELSE 'function' END AS type, p_size AS start_line,
    CASE WHEN p_brand LIKE '%1%' THEN 'python' ELSE 'typescript' END AS language FROM part),
refs AS (SELECT p_partkey AS ref_id, 'r' AS repo_id, 'f:' || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'Brand#' || (p_partkey % 25 + 1) END AS file_key,
    p_name || '_' || p_size AS name, CASE p_partkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'base' ELSE 'call' END AS use, p_partkey % 5 = 0 AS strict,
    CASE WHEN CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'Brand#' || (p_partkey % 25 + 1) END LIKE '%1%' THEN 'python' ELSE 'typescript' END AS language FROM part),
links AS (SELECT DISTINCT 'f:' || a.p_brand AS source, 'f:' || b.p_brand AS target FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_brand <> b.p_brand),
ok AS (SELECT r.ref_id, r.file_key AS own, r.strict, r.language AS rl, e.* FROM refs r JOIN ent e ON r.name = e.name AND CASE r.use WHEN 'new' THEN e.type = 'class'
  WHEN 'base' THEN e.type IN ('class', 'interface') ELSE e.type <> 'interface' END),
tiers AS (SELECT ref_id, key, file_key, start_line, 0 AS tier FROM ok WHERE own = file_key
  UNION ALL SELECT ref_id, key, file_key, start_line, 1 FROM ok WHERE EXISTS (SELECT 1 FROM links l WHERE l.source = ok.own AND l.target = ok.file_key)
  UNION ALL SELECT ref_id, key, file_key, start_line, 2 FROM (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n FROM ok WHERE rl = language AND NOT strict) WHERE n <= 2)"""


@register("j08_resolve_names", "WITH " + _NAMED + """
SELECT ref_id, key AS target, tier FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tier, file_key, start_line, key) AS rn,
  min(tier) OVER (PARTITION BY ref_id) AS first FROM tiers) WHERE rn <= 2 AND tier = first""")
def j08(t):
    other = F.concat(F.lit("Brand#"), (c("p_partkey") % 25 + 1).cast("string"))
    home = F.when(c("p_partkey") % 3 == 0, c("p_brand")).otherwise(other)
    language = lambda b: F.when(b.contains("1"), "python").otherwise("typescript")
    name = F.concat_ws("_", "p_name", c("p_size").cast("string"))
    ents = t.part.select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("e"), c("p_partkey").cast("string")).alias("key"),
        F.concat(F.lit("f:"), "p_brand").alias("file_key"), name.alias("name"),
        F.when(c("p_type") == "ECONOMY", "class").when(c("p_type") == "SMALL", "interface").otherwise("function").alias("type"),
        c("p_size").alias("start_line"), language(c("p_brand")).alias("language"),
    )
    refs = t.part.select(
        c("p_partkey").alias("ref_id"), F.lit("r").alias("repo_id"), F.concat(F.lit("f:"), home).alias("file_key"), name.alias("name"),
        F.when(c("p_partkey") % 4 == 0, "new").when(c("p_partkey") % 4 == 1, "base").otherwise("call").alias("use"),
        (c("p_partkey") % 5 == 0).alias("strict"), language(home).alias("language"),
    )
    pairs = t.part.select("p_name", "p_size", "p_brand").distinct()
    peers = pairs.join(pairs.withColumnRenamed("p_brand", "b"), ["p_name", "p_size"]).where(c("p_brand") != c("b"))
    links = peers.select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("f:"), "p_brand").alias("source"), F.concat(F.lit("f:"), "b").alias("target"),
        F.lit("IMPORTS").alias("type"),
    ).distinct()
    return N.resolve_names(refs, ents, links).select("ref_id", "target", "tier")


@register("u05_refs_except_calls", """
+ r AS (SELECT DISTINCT repo_id, path, sk, 'unit_' || extra AS callee FROM source_lines WHERE kind = 'call'),
q AS (SELECT DISTINCT repo_id, path, sk, 'unit_' || sk AS callee FROM source_lines WHERE kind = 'head')
SELECT repo_id, path, sk, callee FROM q EXCEPT SELECT repo_id, path, sk, callee FROM r""", "source_lines")
def u05(t):
    on = ["repo_id", "path", "sk", "callee"]
    calls = t.source_lines.where(c("kind") == "call").select("repo_id", "path", "sk", F.concat(F.lit("unit_"), "extra").alias("callee"))
    refs = t.source_lines.where(c("kind") == "head").select("repo_id", "path", "sk", F.concat(F.lit("unit_"), c("sk").cast("string")).alias("callee")).distinct()
    return N.references_without_calls(refs, calls, on)
