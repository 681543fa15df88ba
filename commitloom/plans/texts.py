"""Text-to-table queries (survey rows X1-X15) over documents and derived source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitloom.operators import chunks as K
from commitloom.operators import extract as X
from commitloom.plans.registry import register

c = F.col
CODE = "('python','typescript','java','go','rust')"
FILE = ["repo_id", "path"]


def code_sources(t):
    return t.sources.where(c("language").isin("python", "typescript", "java", "go", "rust"))


def kept_sources(t):
    """Code files for queries that read them more than once: put together once."""
    return t.stored("kept_sources", code_sources)


def entities(t):
    return X.extract_entities(X.with_lines(code_sources(t)))


def text_files(t):
    return t.texts.select(c("doc_id").alias("repo_id"), "path", c("text").alias("content"))


UNITS = f"""units AS (SELECT repo_id, path, language, sk, 'unit_' || sk AS name, min(line_no) AS start_line,
    max(line_no) - CASE WHEN language = 'python' THEN 1 ELSE 0 END AS last_line,
    arg_min(text, line_no) AS signature, max(line_no) FILTER (kind = 'call') AS last_call
  FROM source_lines WHERE sec = 1 AND language IN {CODE} GROUP BY 1, 2, 3, 4),
spans AS (SELECT repo_id, path, language, sk, name, start_line, signature, last_call,
    CASE WHEN language = 'python' THEN coalesce(last_call, start_line) ELSE last_line END AS end_line FROM units)"""


@register("x01_explode_lines", """
SELECT doc_id, n AS line_no, string_split(text, chr(10))[n] AS text FROM (
  SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n FROM documents)""")
def x01(t):
    return X.explode_lines(t.documents.select("doc_id", "text"), "text").select("doc_id", "line_no", "text")


@register("x02_mask_literals", f"""
SELECT repo_id, path, line_no, CASE WHEN kind = 'note' THEN '    ' || repeat(' ', length(text) - 4)
   WHEN kind = 'import' AND language IN ('typescript', 'go') THEN regexp_replace(text, '".*"', repeat(' ', length(extra) + 2)) ELSE text END AS masked
FROM source_lines WHERE language IN {CODE}""", "source_lines")
def x02(t):
    masked = code_sources(t).withColumn("masked", X.mask_literals(c("content"), c("language")))
    return X.explode_lines(masked.select(*FILE, "masked"), "masked").select(*FILE, "line_no", c("text").alias("masked"))


@register("x03_extract_declarations", "+ " + UNITS + """
SELECT repo_id, path, start_line AS line, 'function' AS kind, name, signature, true AS exported FROM spans WHERE language <> 'go'
UNION ALL SELECT repo_id, path, start_line, 'function', name, signature, false FROM spans WHERE language = 'go'""", "source_lines")
def x03(t):
    decls = X.extract_declarations(code_sources(t)).select(*FILE, F.explode_outer("decls").alias("d")).where(c("d").isNotNull() & ~c("d.d.member"))
    return decls.select(
        *FILE, c("d.start").alias("line"), c("d.d.kind").alias("kind"), c("d.d.name").alias("name"),
        c("d.signature").alias("signature"), c("d.d.exported").alias("exported"),
    )


@register("x04_block_end_by_indent", "+ " + UNITS + """
SELECT repo_id, path, name, start_line, end_line FROM spans WHERE language = 'python'""", "source_lines")
def x04(t):
    python = t.sources.where(c("language") == "python")
    return X.extract_entities(python).select(*FILE, "name", "start_line", "end_line")


@register("x05_block_end_by_depth", "+ " + UNITS + """
SELECT repo_id, path, name, start_line, end_line FROM spans WHERE language <> 'python'""", "source_lines")
def x05(t):
    braces = code_sources(t).where(c("language") != "python")
    return X.extract_entities(braces).select(*FILE, "name", "start_line", "end_line")


# every file wrapped in a class of its own language, so that its units become members
WRAP_LANGS = ("python", "typescript", "java")


@register("x06_assign_parent", "+ " + UNITS + """
SELECT repo_id, path, 'Outer.' || name AS qualified_name, 'method' AS type, start_line - n AS start_line, end_line - n AS end_line, 1 AS parent_start
FROM (SELECT s.*, coalesce(i.n, 0) - 1 AS n FROM spans s LEFT JOIN (SELECT repo_id, path, count(*) AS n FROM source_lines WHERE sec = 0 GROUP BY 1, 2) i
  ON s.repo_id = i.repo_id AND s.path = i.path WHERE s.language IN ('python', 'typescript', 'java'))
UNION ALL SELECT repo_id, path, 'Outer', 'class', 1, max(end_line) - any_value(n) + CASE WHEN any_value(language) = 'python' THEN 0 ELSE 1 END, NULL
FROM (SELECT s.*, coalesce(i.n, 0) - 1 AS n FROM spans s LEFT JOIN (SELECT repo_id, path, count(*) AS n FROM source_lines WHERE sec = 0 GROUP BY 1, 2) i
  ON s.repo_id = i.repo_id AND s.path = i.path WHERE s.language IN ('python', 'typescript', 'java')) GROUP BY 1, 2""", "source_lines")
def x06(t):
    lines = t.source_texts.where((c("sec") == 1) & c("language").isin(*WRAP_LANGS))
    member = F.when(c("language") == "typescript", F.regexp_replace("text", "^export function ", "")).otherwise(c("text"))
    body = lines.groupBy("part", *FILE, "language").agg(
        F.array_sort(F.collect_list(F.struct("sk", "ord", F.concat(F.lit("  "), member).alias("text")))).alias("b")
    )
    python = c("language") == "python"
    head = F.when(python, "class Outer:").when(c("language") == "java", "public class Outer {").otherwise("export class Outer {")
    text = F.concat_ws(
        "\n", head, F.array_join(F.transform("b", lambda x: x["text"]), "\n"), F.when(python, F.lit(None)).otherwise("}")
    )
    wrapped = body.select(*FILE, "language", text.alias("content"))
    return X.extract_entities(wrapped).select(*FILE, "qualified_name", "type", "start_line", "end_line", "parent_start")


@register("x07_split_bases", """
SELECT p_partkey, string_split(p_name, ' ')[1] || ',' || string_split(p_name, ' ')[2] || ',' || lower(p_type) AS bases FROM part""")
def x07(t):
    words = F.split("p_name", " ")
    header = F.concat(
        F.lit("extends lib."), words[0], F.lit("<T, Map<K>> implements "), words[1], F.lit("(x, y), public "), F.lower("p_type")
    )
    return t.part.select("p_partkey", F.array_join(X.split_bases(header), ",").alias("bases"))


@register("x08_extract_imports", f"""
SELECT repo_id, path, extra AS spec, line_no AS line FROM source_lines WHERE kind = 'import' AND language IN {CODE}""", "source_lines")
def x08(t):
    return X.extract_imports(code_sources(t)).select(*FILE, "spec", "line")


@register("x09_import_names", """
SELECT p_partkey, string_split(p_name, ' ')[1] || ',' || string_split(p_name, ' ')[2] || ',default' AS names FROM part""")
def x09(t):
    words = F.split("p_name", " ")
    clause = F.concat(F.lower("p_type"), F.lit(", { type "), words[0], F.lit(" as alias, "), words[1], F.lit(" }"))
    return t.part.select("p_partkey", F.array_join(X.import_names(clause), ",").alias("names"))


CALLS = UNITS + f""",
calls AS (SELECT s.repo_id, s.path, s.language, 'unit_' || s.sk AS qualified_name, u.start_line, 'unit_' || s.extra AS callee, count(*) AS count
  FROM source_lines s JOIN spans u ON s.repo_id = u.repo_id AND s.path = u.path AND s.sk = u.sk
  WHERE s.kind = 'call' AND s.language IN {CODE} AND CAST(s.sk AS VARCHAR) <> s.extra GROUP BY ALL)"""


def bodies(t):
    ready = X.with_lines(kept_sources(t))
    return X.entity_bodies(ready, X.extract_entities(ready))


@register("x10_extract_calls", "+ " + CALLS + """
SELECT repo_id, path, qualified_name, start_line, callee, count, false AS is_new FROM calls""", "source_lines")
def x10(t):
    return X.extract_calls(bodies(t)).select(*FILE, "qualified_name", "start_line", "callee", "count", "is_new")


@register("x11_extract_refs", "+ " + UNITS + """
SELECT u.repo_id, u.path, u.name AS qualified_name, u.start_line, 'x' AS callee FROM spans u WHERE language <> 'rust' OR last_call IS NOT NULL""", "source_lines")
def x11(t):
    known = t.sources.select("repo_id", F.lit("x").alias("name")).distinct()
    return X.extract_refs(bodies(t), known).select(*FILE, "qualified_name", "start_line", "callee")


@register("x12_module_level_lines", f"""
+ {UNITS},
flat AS (SELECT repo_id, path, line_no FROM source_lines s WHERE language IN {CODE} AND NOT EXISTS (SELECT 1 FROM spans u WHERE u.repo_id = s.repo_id
  AND u.path = s.path AND s.line_no BETWEEN u.start_line AND u.end_line))
SELECT repo_id, path, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS line_sum FROM flat GROUP BY 1, 2""", "source_lines")
def x12(t):
    ready = X.with_lines(kept_sources(t))
    top = X.module_level_text(ready, X.extract_entities(ready))
    return top.select(*FILE, F.explode_outer("line_numbers").alias("no")).where(c("no").isNotNull()).groupBy(*FILE).agg(
        F.count("*").alias("n"), F.sum("no").alias("line_sum")
    )


WINDOWS = """lined AS (SELECT doc_id, path, string_split(text, chr(10)) AS l FROM texts),
starts AS (SELECT doc_id, path, l, s FROM (SELECT doc_id, path, l, unnest(generate_series(1, len(l), 52)) AS s FROM lined)
  WHERE s = 1 OR s + 7 < len(l)),
win AS (SELECT doc_id, path, s AS start_line, least(len(l), s + 59) AS end_line, array_to_string(l[s:least(len(l), s + 59)], chr(10)) AS full_text FROM starts),
kept AS (SELECT doc_id, path, start_line, end_line, full_text AS content,
    row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS chunk_index
  FROM win WHERE length(regexp_replace(full_text, '^\\s+|\\s+$', '', 'g')) > 20)"""


@register("x13_window_chunks", "+ " + WINDOWS + """
SELECT doc_id, path, chunk_index, start_line, end_line, content FROM kept""", "texts")
def x13(t):
    return K.window_chunks(text_files(t)).select(
        c("repo_id").alias("doc_id"), "path", c("chunk_index").cast("long").alias("chunk_index"),
        c("start_line").cast("long").alias("start_line"), c("end_line").cast("long").alias("end_line"), "content",
    )


@register("w05_chunk_index", "+ " + WINDOWS + """
SELECT path, chunk_index, sha1(path || chr(10) || content) AS hash FROM kept""", "texts")
def w05(t):
    return K.with_chunk_hash(K.window_chunks(text_files(t))).select(
        "path", c("chunk_index").cast("long").alias("chunk_index"), "hash"
    )


# units are short, so every unit is one chunk; more than three import lines make a window chunk
ENTITY_CHUNKS = UNITS + f""",
parts AS (SELECT repo_id, path, language, name AS entity, start_line, end_line FROM spans
  UNION ALL SELECT repo_id, path, any_value(language), NULL, 1, min(start_line) - 1 FROM spans GROUP BY 1, 2 HAVING min(start_line) > 4),
chunked AS (SELECT p.*, row_number() OVER (PARTITION BY repo_id, path ORDER BY start_line) - 1 AS chunk_index FROM parts p)"""


@register("x14_entity_chunks", "+ " + ENTITY_CHUNKS + """
SELECT repo_id, path, entity, start_line, end_line, chunk_index,
  (SELECT string_agg(text, chr(10) ORDER BY line_no) FROM source_lines s WHERE s.repo_id = k.repo_id AND s.path = k.path
     AND s.line_no BETWEEN k.start_line AND k.end_line) AS content FROM chunked k""", "source_lines")
def x14(t):
    return code_chunks(t).select(*FILE, "entity", "start_line", "end_line", "chunk_index", "content")


def code_chunks(t):
    ready = kept_sources(t)
    return K.entity_chunks(ready, X.extract_entities(ready))


@register("x15_chunk_embedding_text", "+ " + WINDOWS + """
SELECT doc_id, chunk_index, 'File: ' || path || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || 'text doc_' || doc_id || chr(10) || chr(10) || content AS embedding_text
FROM kept""", "texts")
def x15(t):
    from commitloom.functions.text import chunk_embedding_text

    rows = K.window_chunks(text_files(t))
    text = chunk_embedding_text(
        c("path"), c("start_line"), c("end_line"), F.lit("text"), F.concat(F.lit("doc_"), "repo_id"), c("content")
    )
    return rows.select(
        c("repo_id").alias("doc_id"), c("chunk_index").cast("long").alias("chunk_index"), text.alias("embedding_text")
    )


@register("k10_embedding_priority", "+ " + ENTITY_CHUNKS + """
SELECT repo_id, path, chunk_index, priority FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY priority, path, chunk_index) AS rn FROM (
  SELECT *, CASE WHEN entity IS NULL THEN 1 ELSE 0 END + CASE WHEN contains(path, '/tests/') THEN 3 ELSE 0 END AS priority FROM chunked)) WHERE rn <= 2500""",
          "source_lines")
def k10(t):
    chunks = code_chunks(t).join(kept_sources(t).select(*FILE, "language"), FILE)
    return K.embedding_priority(chunks).select(*FILE, "chunk_index", "priority")


@register("s02_reject_files", """
SELECT lang, count(*) FILTER (NOT bad) AS kept, count(*) FILTER (bad) AS skipped FROM (
  SELECT lang, length(text) = 0 OR n_chars > 8000 AS bad FROM documents) GROUP BY 1""")
def s02(t):
    from commitloom.sources.files import rejected

    rows = t.documents.select("lang", rejected(c("text"), c("n_chars"), 8000).alias("bad"))
    return rows.groupBy("lang").agg(F.count_if(~c("bad")).alias("kept"), F.count_if(c("bad")).alias("skipped"))


@register("s03_prioritise_and_cap", """
SELECT repo_id, path, rn AS position FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY
  CASE WHEN language = 'markdown' THEN 1 ELSE 0 END, len(string_split(path, '/')), path) AS rn FROM repo_files) WHERE rn <= 3000""", "repo_files")
def s03(t):
    from commitloom.sources.files import prioritise_and_cap

    return prioritise_and_cap(t.repo_files).select("repo_id", "path", c("position").cast("long").alias("position"))


@register("s12_read_text_slice", """
SELECT doc_id, array_to_string(string_split(text, chr(10))[3:12], chr(10)) AS slice,
  text AS head, CASE WHEN text IS NOT NULL THEN false END AS truncated FROM documents""")
def s12(t):
    from commitloom.functions.text import text_slice
    from commitloom.sources.files import read_head

    head, truncated = read_head(c("text"))
    return t.documents.select(
        "doc_id", text_slice(c("text"), F.lit(3), F.lit(12)).alias("slice"), head.alias("head"), truncated.alias("truncated")
    )
