"""Scalar functions over whole columns of the bound tables (survey rows P1-P26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitloom.functions import paths as P
from commitloom.functions import scores as S
from commitloom.functions import text as X
from commitloom.functions import urls as U
from commitloom.plans.registry import register

c = F.col

# file-like paths: the source tree plus the paths of crawled pages
_PATHS = """+ url_paths AS (
  SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path
  FROM pages UNION SELECT path FROM tree)
"""


def _all_paths(t):
    urls = t.pages.select(
        F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")
    )
    return urls.union(t.tree.select("path")).distinct()


@register("p01_language_of", _PATHS + """
SELECT path, CASE WHEN base LIKE '%.%' THEN
   CASE ext WHEN 'html' THEN 'html' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript'
            WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown'
            END END AS language
FROM (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS base,
             regexp_extract(lower(path), '[.]([^./]*)$', 1) AS ext FROM url_paths)""", "tree")
def language_of(t):
    return _all_paths(t).select("path", P.language_of(c("path")).alias("language"))


@register("p02_is_code", """
SELECT path, language, language IN ('python','typescript','java','go','rust') AS code FROM tree""", "tree")
def is_code(t):
    return t.tree.select("path", "language", P.is_code(c("language")).alias("code"))


@register("p03_is_test_path", """
SELECT path, (path LIKE '%/tests/%' OR regexp_matches(path, '(^|/)test_[^/]+[.]py$')) AS is_test FROM tree""", "tree")
def is_test_path(t):
    return t.tree.select("path", P.is_test_path(c("path")).alias("is_test"))


@register("p04_module_of", _PATHS + """
SELECT path, CASE WHEN path NOT LIKE '%/%' THEN '(root)'
   WHEN seg[1] = 'src' AND len(seg) > 2 THEN seg[1] || '/' || seg[2] ELSE seg[1] END AS module
FROM (SELECT path, string_split(path, '/') AS seg FROM url_paths)""", "tree")
def module_of(t):
    return _all_paths(t).select("path", P.module_of(c("path")).alias("module"))


@register("p05_normalize_path", """
SELECT page_id, path, array_to_string([x for x in string_split(regexp_replace(path, '^[^/]*/', ''), '/') if x <> ''], '/')
  AS normalized
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)""")
def normalize_path(t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    climbing = F.concat(c("path"), F.lit("/./extra/../"))
    without_host = F.concat(F.regexp_replace(climbing, "^[^/]*/", "x/../"))
    return t.pages.select("page_id", path.alias("path")).select(
        "page_id", "path", P.normalize_path(without_host).alias("normalized")
    )


@register("p06_dirname_basename_stem", _PATHS + """
SELECT path, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dirname,
  regexp_extract(path, '[^/]*$') AS basename,
  regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '') AS stem FROM url_paths""", "tree")
def dirname(t):
    p = c("path")
    return _all_paths(t).select(
        "path", P.dirname(p).alias("dirname"), P.basename(p).alias("basename"), P.stem(p).alias("stem")
    )


@register("p07_summary_dir", _PATHS + """
SELECT path, CASE WHEN path LIKE '%/%' THEN regexp_replace(array_to_string(string_split(path, '/')[1:2], '/'),
   '/[^/]*[.][^/]*$', '') ELSE '(root)' END AS dir FROM url_paths""", "tree")
def summary_dir(t):
    return _all_paths(t).select("path", P.summary_dir(c("path")).alias("dir"))


@register("p08_keys", """
SELECT DISTINCT p_brand, p_name, p_size, 'f:' || p_brand AS file_key, 'p:' || p_type AS package_key,
  'e:' || p_brand || '#' || p_name || CASE WHEN row_number() OVER (PARTITION BY p_brand, p_name
     ORDER BY p_size, p_partkey) > 1 THEN '@' || p_size ELSE '' END AS entity_key, p_partkey FROM part""")
def keys(t):
    from commitloom.operators.graph import unique_entity_keys

    base = t.part.select(
        "p_brand", "p_name", "p_size", "p_partkey",
        P.file_key(c("p_brand")).alias("file_key"), P.package_key(c("p_type")).alias("package_key"),
        P.entity_key(c("p_brand"), c("p_name")).alias("key"),
    )
    return unique_entity_keys(base, "key", "p_size", tie="p_partkey").withColumnRenamed("key", "entity_key")


@register("p09_content_hash", """
SELECT doc_id, sha1(text) AS content_hash, sha1(path || chr(10) || text) AS chunk_hash FROM texts""", "texts")
def content_hash(t):
    return t.texts.select(
        "doc_id", X.content_hash(c("text")).alias("content_hash"),
        X.chunk_hash(c("path"), c("text")).alias("chunk_hash"),
    )


@register("p10_loc", """
SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS loc FROM documents""")
def loc(t):
    return t.documents.select("doc_id", X.line_count(c("text")).alias("loc"))


@register("p11_normalize_repo_url", """
SELECT page_id, s AS repo_url FROM (
  SELECT page_id, regexp_replace(trim(url), '/+$', '') AS s FROM pages)
UNION ALL
SELECT -1 - p_partkey, 'https://github.com/' || 'acme' || '/' || replace(p_name, ' ', '-') || '.git' FROM part""")
def normalize_repo_url(t):
    short = t.part.select(
        (-1 - c("p_partkey")).alias("page_id"),
        F.concat(F.lit(" acme/"), F.translate("p_name", " ", "-"), F.lit("/")).alias("url"),
    )
    every = t.pages.select("page_id", "url").union(short)
    return every.select("page_id", U.normalize_repo_url(c("url")).alias("repo_url"))


@register("p12_repo_key", """
SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^http://', 'https://'),
  '^https://www[.]', 'https://'), '/+$', ''), '[.]git$', '')) AS repo_key FROM pages
UNION ALL SELECT -1 - c_custkey, 'https://host.example/' || lower(c_mktsegment) || '/' || lower(c_name) FROM customer""")
def repo_key(t):
    ssh = t.customer.select(
        (-1 - c("c_custkey")).alias("page_id"),
        F.concat(F.lit("git@host.example:"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".git/")).alias("url"),
    )
    every = t.pages.select("page_id", "url").union(ssh)
    return every.select("page_id", U.repo_key(c("url")).alias("repo_key"))


@register("p13_repo_name", """
SELECT page_id, array_to_string(p[greatest(len(p) - 1, 1):], '/') AS repo_name FROM (
  SELECT page_id, [x for x in string_split_regex(regexp_replace(regexp_replace(url, '[.]git$', ''), '/+$', ''), '[/:]') if x <> ''] AS p FROM pages)""")
def repo_name(t):
    return t.pages.select("page_id", U.repo_name(c("url")).alias("repo_name"))


@register("p14_normalize_question", """
SELECT query_id, trim(regexp_replace(lower(question), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normalized FROM questions""",
          "questions")
def normalize_question(t):
    return t.questions.select("query_id", X.normalize_question(c("question")).alias("normalized"))


# tokens of a text column in SQL: words, then the parts of compound words
def tokens_sql(source: str, key: str, text: str, out: str) -> str:
    from commitloom import fixed

    stop = ", ".join(f"'{w}'" for w in sorted(set(fixed.STOP_WORDS)))
    return f"""{out}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS w
   FROM {source}),
{out}_p AS (SELECT {key}, w, string_split_regex(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
   '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[ _]+') AS parts FROM {out}_w),
{out} AS (SELECT {key}, term FROM (SELECT {key}, lower(w) AS term FROM {out}_p
   UNION ALL SELECT {key}, lower(unnest(parts)) FROM {out}_p WHERE len(parts) > 1)
   WHERE length(term) >= 2 AND term NOT IN ({stop}))"""


@register("p15_tokenize", "+ " + tokens_sql("texts", "doc_id", "text", "tok") + """
SELECT t.doc_id, count(term) AS n_tokens, coalesce(string_agg(term, ' ' ORDER BY term), '') AS terms
FROM texts t LEFT JOIN tok ON t.doc_id = tok.doc_id GROUP BY t.doc_id""", "texts")
def tokenize(t):
    return t.texts.select("doc_id", X.tokenize(c("text")).alias("tokens")).select(
        "doc_id", F.size("tokens").alias("n_tokens"),
        F.array_join(F.array_sort("tokens"), " ").alias("terms"),
    )


@register("p16_week_start", """
SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders""")
def week_start(t):
    return t.orders.select("o_orderkey", S.week_start(c("o_orderdate")).alias("week"))


_NODES = """+ mixed AS (
  SELECT DISTINCT 'file' AS kind, path AS name, CAST(NULL AS VARCHAR) AS qualified_name, path,
     CAST(NULL AS VARCHAR) AS type, CAST(NULL AS INT) AS start_line FROM tree
  UNION ALL SELECT 'entity', name, qualified_name, path, type, start_line FROM entities
  UNION ALL SELECT 'package', s_name, NULL, NULL, NULL, NULL FROM supplier)
"""


def _mixed(t):
    null = F.lit(None)
    files = t.tree.select(
        F.lit("file").alias("kind"), c("path").alias("name"), null.cast("string").alias("qualified_name"),
        "path", null.cast("string").alias("type"), null.cast("int").alias("start_line"),
    )
    entities = t.entities.select(
        F.lit("entity").alias("kind"), "name", "qualified_name", "path", "type", "start_line"
    )
    packages = t.supplier.select(
        F.lit("package").alias("kind"), c("s_name").alias("name"),
        null.cast("string").alias("qualified_name"), null.cast("string").alias("path"),
        null.cast("string").alias("type"), null.cast("int").alias("start_line"),
    )
    return files.union(entities).union(packages)


@register("p17_node_label", _NODES + """
SELECT kind, name, path, CASE kind WHEN 'entity' THEN coalesce(qualified_name, name) WHEN 'file' THEN path
  ELSE name END AS label FROM mixed""", "tree entities")
def node_label(t):
    return _mixed(t).select(
        "kind", "name", "path",
        P.node_label(c("kind"), c("name"), c("qualified_name"), c("path")).alias("label"),
    )


@register("p18_node_size", """
SELECT p_partkey, round(greatest(1, log2(2 + p_size * 20) + sqrt(p_size)), 6) AS node_size,
  round(greatest(2, 1.4 * log2(2 + p_size * 20)), 6) AS module_size FROM part""")
def node_size(t):
    lines = c("p_size") * 20
    return t.part.select(
        "p_partkey", F.round(S.node_size(lines, c("p_size")), 6).alias("node_size"),
        F.round(S.module_size(lines), 6).alias("module_size"),
    )


@register("p19_is_identifier_like", """
+ words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM documents)
SELECT w, regexp_matches(substr(w, 2), '[A-Z_]') OR w LIKE '%\\_%' ESCAPE '\\' OR regexp_matches(w, '^[A-Z]') AS identifier_like
FROM words""", "texts")
def is_identifier_like(t):
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))
    return t.texts.select(words.alias("w")).distinct().select(
        "w", P.is_identifier_like(c("w")).alias("identifier_like")
    )


@register("p20_entry_point_special_name", """
+ w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS name FROM documents)
SELECT name, count(*) AS uses,
  regexp_matches('pkg/' || name || '.py', '(^|/)(index|main|app|server|cli|setup|manage|program|mod|lib|page|layout|route|middleware|config)[.]py$') AS entry_point,
  regexp_matches(name, '^(main|constructor|init|render|setup|teardown|handle\\w*|get|post|put|patch|delete|default|run|execute|apply|call|invoke|test\\w*|it|describe|configure|register|build|new|drop|fmt|from|into|serve)$') AS special
FROM w GROUP BY name""", "texts")
def entry_point(t):
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+"), F.lit(0)))
    counted = t.texts.select(words.alias("name")).groupBy("name").agg(F.count("*").alias("uses"))
    return counted.select(
        "name", "uses", P.is_entry_point(F.concat(F.lit("pkg/"), "name", F.lit(".py"))).alias("entry_point"),
        P.is_special_function(c("name")).alias("special"),
    )


@register("p21_top_level_package", """
SELECT DISTINCT path, spec, CASE language
   WHEN 'typescript' THEN CASE WHEN spec LIKE '.%' THEN NULL
        ELSE array_to_string(string_split(spec, '/')[1:2], '/') END
   WHEN 'python' THEN string_split(spec, '.')[1]
   WHEN 'java' THEN array_to_string(string_split(spec, '.')[1:2], '.')
   WHEN 'go' THEN array_to_string(string_split(spec, '/')[1:3], '/') END AS package
FROM import_lines""", "import_lines")
def top_level_package(t):
    return t.import_lines.select(
        "path", "spec", P.top_level_package(c("spec"), c("language")).alias("package")
    ).distinct()


@register("p22_family", """
SELECT key, language, CASE WHEN language = 'typescript' THEN 'js' ELSE language END AS family
FROM entities""", "entities")
def family(t):
    return t.entities.select("key", "language", P.language_family(c("language")).alias("family"))


@register("p23_describe_node", _NODES + """
SELECT kind, name, path, CASE kind WHEN 'file' THEN 'file ' || path WHEN 'package' THEN 'package ' || name
  ELSE type || ' ' || qualified_name || ' (' || path || ':' || start_line || ')' END AS description
FROM mixed""", "tree entities")
def describe_node(t):
    return _mixed(t).select(
        "kind", "name", "path",
        P.describe_node(
            c("kind"), c("name"), c("qualified_name"), c("path"), c("type"), c("start_line")
        ).alias("description"),
    )


@register("p24_risk_level", """
SELECT o_orderkey, CASE WHEN s < 30 THEN 'low' WHEN s < 60 THEN 'medium' ELSE 'high' END AS risk,
  CASE WHEN s >= 75 THEN 'ok' WHEN s >= 50 THEN 'warn' ELSE 'bad' END AS tone
FROM (SELECT o_orderkey, least(100, o_totalprice / 5000) AS s FROM orders)""")
def risk_level(t):
    score = F.least(F.lit(100.0), c("o_totalprice") / 5000)
    return t.orders.select(
        "o_orderkey", S.risk_level(score).alias("risk"), S.health_tone(score).alias("tone")
    )


@register("p25_l2_normalize", """
SELECT vec_id, round(sqrt(list_sum([x * x for x in n])), 6) AS norm, round(n[1], 5) AS first, round(n[64], 5) AS last
FROM (SELECT vec_id, [x / sqrt(list_sum([y * y for y in e])) for x in e] AS n
      FROM (SELECT vec_id, [CAST(x AS DOUBLE) * (vec_id + 1) for x in embedding] AS e FROM embeddings))""")
def l2_normalize(t):
    scaled = t.embeddings.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (c("vec_id") + 1)).alias("e")
    )
    unit = scaled.select("vec_id", S.l2_normalize(c("e")).alias("n"))
    return unit.select(
        "vec_id", F.round(F.sqrt(S.dot(c("n"), c("n"))), 6).alias("norm"),
        F.round(F.get("n", F.lit(0)), 5).alias("first"), F.round(F.get("n", F.lit(63)), 5).alias("last"),
    )


@register("p26_mentions", """
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z_$][\\w$]*(?:\\.[\\w$]+)*')) AS n_identifiers,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)[\\w./-]+\\.[a-z]{1,5}\\b'))), ' ') AS paths
FROM documents""")
def mentions(t):
    return t.documents.select(
        "doc_id", F.size(X.mention_identifiers(c("text"))).alias("n_identifiers"),
        F.array_join(F.array_sort(F.array_distinct(X.mention_paths(c("text")))), " ").alias("paths"),
    )
