"""Bindings of the operators' input tables onto the driver's tables, as portable SQL.

Every binding reads its source tables whole. Spark runs the text through ``spark.sql`` and the
checks run the same text as common table expressions, so operator and oracle start from equal input.

Two repositories (``repo_id`` = line status) share one file tree and each holds about half of all
change rows, so every per-repository group in the checks is a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# a line of a source file, as its language writes it
_LINE_TEXT = """               CASE x.kind
                 WHEN 'import' THEN CASE t.language
                      WHEN 'typescript' THEN concat('import m from "', x.extra, '";')
                      WHEN 'python' THEN concat('import ', x.extra)
                      WHEN 'java' THEN concat('import ', x.extra, ';')
                      WHEN 'go' THEN concat('import "', x.extra, '"')
                      WHEN 'rust' THEN concat('use ', x.extra, ';')
                      ELSE concat('see ', x.extra) END
                 WHEN 'head' THEN CASE t.language
                      WHEN 'typescript' THEN concat('export function unit_', x.sk, '(x) {{')
                      WHEN 'python' THEN concat('def unit_', x.sk, '(x):')
                      WHEN 'java' THEN concat('public void unit_', x.sk, '(int x) {{')
                      WHEN 'go' THEN concat('func unit_', x.sk, '(x int) {{')
                      WHEN 'rust' THEN concat('pub fn unit_', x.sk, '(x: i32) {{')
                      ELSE concat('## unit_', x.sk) END
                 WHEN 'note' THEN concat('    ', CASE WHEN t.language = 'python' THEN '#' ELSE '//' END,
                                         ' see hidden_', x.sk, '(x)')
                 WHEN 'call' THEN concat('    unit_', x.extra, '(x);')
                 ELSE CASE WHEN t.language IN ('python', 'markdown') THEN '' ELSE '}}' END
               END"""

# name -> SQL text; {x} names a source table or another binding.
BINDINGS: dict[str, str] = {
    # parts as source files: path, language and size come from part attributes
    "tree": """
        SELECT p_partkey AS pk,
               concat(CASE WHEN p_type = 'PROMO' THEN 'docs/' ELSE 'src/' END, replace(p_brand, '#', '_'), '/',
                      CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE '' END, 'part_', p_partkey,
                      CASE p_type WHEN 'ECONOMY' THEN '.py' WHEN 'SMALL' THEN '.ts'
                                  WHEN 'STANDARD' THEN '.java' WHEN 'LARGE' THEN '.go'
                                  WHEN 'MEDIUM' THEN '.rs' ELSE '.md' END) AS path,
               CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'SMALL' THEN 'typescript'
                           WHEN 'STANDARD' THEN 'java' WHEN 'LARGE' THEN 'go'
                           WHEN 'MEDIUM' THEN 'rust' ELSE 'markdown' END AS language,
               p_size * 20 AS loc
        FROM {part}""",
    # orders as commits, their lines as changed files
    "change_keys": """
        SELECT l_linestatus AS repo_id, l_orderkey AS sha, l_partkey AS pk,
               min(l_returnflag) AS change_type,
               CAST(sum(l_quantity) AS BIGINT) AS additions,
               CAST(sum(l_linenumber) AS BIGINT) AS deletions
        FROM {lineitem} GROUP BY l_linestatus, l_orderkey, l_partkey""",
    "changes": """
        SELECT c.repo_id, c.sha, t.path, c.change_type, c.additions, c.deletions
        FROM {change_keys} c JOIN {tree} t ON c.pk = t.pk""",
    "commits": """
        SELECT s.repo_id, s.sha, lower(c.c_name) AS author_email, c.c_name AS author_name,
               o.o_orderpriority AS message, CAST(o.o_orderdate AS DATE) AS committed_at
        FROM (SELECT DISTINCT l_linestatus AS repo_id, l_orderkey AS sha FROM {lineitem}) s
        JOIN {orders} o ON s.sha = o.o_orderkey
        JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    # every file of a repository that has history
    "repo_files": """
        SELECT r.repo_id, t.path, t.language, t.loc, concat('f:', t.path) AS key
        FROM (SELECT DISTINCT l_linestatus AS repo_id, l_partkey AS pk FROM {lineitem}) r
        JOIN {tree} t ON r.pk = t.pk""",
    # lines as evidence for imports: a link needs at least four supporting lines
    "import_keys": """
        SELECT l_linestatus AS repo_id, l_partkey AS spk,
               CAST(floor(l_partkey / 8) AS BIGINT) * 8 + (l_suppkey + l_linenumber) % 8 AS tpk,
               CAST(count(*) AS DOUBLE) AS weight
        FROM {lineitem} GROUP BY 1, 2, 3 HAVING count(*) >= 4""",
    "file_imports": """
        SELECT i.repo_id, concat('f:', s.path) AS source, concat('f:', t.path) AS target,
               'IMPORTS' AS type, i.weight
        FROM {import_keys} i JOIN {tree} s ON i.spk = s.pk JOIN {tree} t ON i.tpk = t.pk
        WHERE i.spk <> i.tpk""",
    # suppliers as external packages
    "package_imports": """
        SELECT l.repo_id, concat('f:', t.path) AS source, concat('p:', s.s_name) AS target,
               'IMPORTS' AS type, CAST(1 AS DOUBLE) AS weight
        FROM (SELECT DISTINCT l_linestatus AS repo_id, l_partkey AS pk, l_suppkey AS sk
              FROM {lineitem}) l
        JOIN {tree} t ON l.pk = t.pk JOIN {supplier} s ON l.sk = s.s_suppkey""",
    # (part, supplier) pairs as code entities inside the part's file
    "entity_keys": """
        SELECT l_linestatus AS repo_id, l_partkey AS pk, l_suppkey AS sk,
               min(l_linenumber) * 10 + min(l_suppkey) % 7 AS start_line,
               CAST(max(l_quantity) AS BIGINT) * 3 AS span,
               CASE max(l_returnflag) WHEN 'R' THEN 'function' WHEN 'N' THEN 'method'
                                      ELSE 'class' END AS type,
               max(l_discount) >= 0.08 AS exported
        FROM {lineitem} GROUP BY l_linestatus, l_partkey, l_suppkey""",
    "entities": """
        SELECT e.repo_id, concat('e:', t.path, '#unit_', e.sk) AS key,
               concat('f:', t.path) AS file_key, t.path, t.language,
               concat('unit_', e.sk) AS name, concat('unit_', e.sk) AS qualified_name, e.type,
               CAST(e.start_line AS INT) AS start_line,
               CAST(e.start_line + e.span - 1 AS INT) AS end_line, e.exported
        FROM {entity_keys} e JOIN {tree} t ON e.pk = t.pk""",
    # consecutive lines of an order as calls (or inheritance, when both lines carry flag A)
    "call_keys": """
        SELECT repo_id, pk, sk, npk, nsk,
               CASE WHEN flag = 'A' AND nflag = 'A' THEN 'EXTENDS' ELSE 'CALLS' END AS type,
               CAST(count(*) AS DOUBLE) AS weight
        FROM (SELECT l_linestatus AS repo_id, l_partkey AS pk, l_suppkey AS sk,
                     l_returnflag AS flag,
                     lead(l_partkey) OVER w AS npk, lead(l_suppkey) OVER w AS nsk,
                     lead(l_returnflag) OVER w AS nflag
              FROM {lineitem}
              WINDOW w AS (PARTITION BY l_linestatus, l_orderkey
                           ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)) x
        WHERE npk IS NOT NULL AND NOT (pk = npk AND sk = nsk)
        GROUP BY 1, 2, 3, 4, 5, 6""",
    "entity_links": """
        SELECT c.repo_id, concat('e:', s.path, '#unit_', c.sk) AS source,
               concat('e:', t.path, '#unit_', c.nsk) AS target, c.type, c.weight
        FROM {call_keys} c JOIN {tree} s ON c.pk = s.pk JOIN {tree} t ON c.npk = t.pk""",
    "contains": """
        SELECT repo_id, file_key AS source, key AS target, 'CONTAINS' AS type,
               CAST(1 AS DOUBLE) AS weight FROM {entities}""",
    "edges": """
        SELECT * FROM {contains} UNION ALL SELECT * FROM {file_imports}
        UNION ALL SELECT * FROM {package_imports} UNION ALL SELECT * FROM {entity_links}""",
    # import lines of every source file, written the way its language writes them
    "import_lines": """
        SELECT i.repo_id, s.path, s.language, t.path AS target_path, i.tpk,
               CASE s.language
                 WHEN 'typescript' THEN
                   CASE WHEN i.spk % 2 = 0
                        THEN concat(CASE WHEN s.path LIKE '%/tests/%' THEN '../../../' ELSE '../../' END,
                                    regexp_replace(t.path, '[.][a-z]+$', ''))
                        ELSE concat('@/', regexp_replace(regexp_replace(t.path, '^src/', ''),
                                                         '[.][a-z]+$', '')) END
                 WHEN 'python' THEN replace(regexp_replace(t.path, '[.][a-z]+$', ''), '/', '.')
                 WHEN 'java' THEN replace(regexp_replace(regexp_replace(t.path, '^[a-z]+/', ''),
                                                         '[.][a-z]+$', ''), '/', '.')
                 WHEN 'go' THEN concat('example.com/app/', regexp_replace(t.path, '/[^/]*$', ''))
                 WHEN 'rust' THEN concat('crate::', replace(regexp_replace(regexp_replace(
                                    t.path, '^[a-z]+/', ''), '[.][a-z]+$', ''), '/', '::'))
                 ELSE t.path END AS spec
        FROM {import_keys} i JOIN {tree} s ON i.spk = s.pk JOIN {tree} t ON i.tpk = t.pk
        WHERE i.spk <> i.tpk""",
    # source text of every file: import lines, then one unit per entity with its calls
    "import_specs": """
        SELECT repo_id, path, language, spec, min(tpk) AS tpk FROM {import_lines}
        GROUP BY repo_id, path, language, spec""",
    "source_parts": """
        SELECT e.repo_id, t.pk, 0 AS sec, CAST(0 AS BIGINT) AS sk, CAST(e.tpk AS BIGINT) AS ord,
               'import' AS kind, e.spec AS extra
        FROM {import_specs} e JOIN {tree} t ON e.path = t.path
        UNION ALL
        SELECT repo_id, pk, 1, sk, -2, 'head', '' FROM {entity_keys}
        UNION ALL
        SELECT repo_id, pk, 1, sk, -1, 'note', '' FROM {entity_keys}
        UNION ALL
        SELECT DISTINCT repo_id, pk, 1, sk, nsk, 'call', CAST(nsk AS VARCHAR(20)) FROM {call_keys}
        UNION ALL
        SELECT repo_id, pk, 1, sk, 1000000000000, 'foot', '' FROM {entity_keys}""",
    "source_lines": """
        SELECT x.repo_id, t.path, t.language, x.sec, x.sk, x.kind, x.extra,
               CAST(row_number() OVER (PARTITION BY x.repo_id, t.path ORDER BY x.sec, x.sk, x.ord) AS INT) AS line_no,
""" + _LINE_TEXT + """ AS text
        FROM {source_parts} x JOIN {tree} t ON x.pk = t.pk""",
    # the same lines without numbers, for texts put together whole; ``part`` tells paths apart by a number (files without a path are one)
    "source_texts": """
        SELECT CASE WHEN t.path IS NOT NULL THEN x.pk END AS part, x.repo_id, t.path, t.language, x.sec, x.sk, x.ord,
""" + _LINE_TEXT + """ AS text
        FROM {source_parts} x JOIN {tree} t ON x.pk = t.pk""",
    # every line of an order as a hunk of that commit's diff; diff paths lack the first directory
    "hunks": """
        SELECT l.l_linestatus AS repo_id, l.l_orderkey AS request_id,
               regexp_replace(t.path, '^[a-z]+/', '') AS path, CAST(l.l_linenumber * 10 AS INT) AS start,
               CAST(l.l_linenumber * 10 + l.l_quantity - 1 AS INT) AS end_
        FROM {lineitem} l JOIN {tree} t ON l.l_partkey = t.pk""",
    # documents as text files; conversations as a question log
    "texts": """
        SELECT doc_id, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, lang, text
        FROM {documents}""",
    "questions": """
        SELECT concat('q', conv_id, '_', turn) AS query_id, conv_id, turn, text AS question
        FROM {conversations} WHERE role = 'user'""",
    # label centroids as query vectors
    "hrefs": """
        SELECT page_id, url, html FROM {pages}""",
    # user events as a job log
    "jobs": """
        SELECT user_id AS repo_id, event_id AS job_id, event_type AS status, ts AS created_at, value
        FROM {events}""",
}


def _needs(text: str) -> list[str]:
    import string

    return [name for _, name, _, _ in string.Formatter().parse(text) if name]


class Tables:
    """Lazily bound DataFrames: ``t.changes``, ``t.lineitem``, ..."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in SOURCES and name not in BINDINGS and name != "sources"):
            raise AttributeError(name)
        if name not in self._frames:
            if name == "sources":
                frame = self._sources()
            elif name in SOURCES:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = BINDINGS[name]
                frame = self.spark.sql(text, **{n: getattr(self, n) for n in _needs(text)})
            self._frames[name] = frame
        return self._frames[name]

    def stored(self, name: str, build) -> DataFrame:
        """``build(self)`` written once to the shared folder and read from there afterwards."""
        from commitloom.session import cut_lineage

        if name not in self._frames:
            self._frames[name] = cut_lineage(build(self))
        return self._frames[name]

    def _sources(self) -> DataFrame:
        """Source files with their content, one row per file."""
        from pyspark.sql import functions as F

        # the part's number leads: rows are sorted by it instead of by paths, and lines only within their file
        return (
            self.source_texts.groupBy("part", "repo_id", "path", "language")
            .agg(F.array_sort(F.collect_list(F.struct("sec", "sk", "ord", "text"))).alias("_lines"))
            .select(
                "repo_id", "path", "language",
                F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("content"),
            )
        )


def with_bindings(body: str, *names: str) -> str:
    """``WITH`` clause holding the named bindings and what they need, followed by ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in SOURCES or name in ordered:
            return
        for need in _needs(BINDINGS[name]):
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        text = BINDINGS[name]
        parts.append(f"{name} AS ({text.format(**{n: n for n in _needs(text)})})")
    body = body.strip()
    head = "WITH RECURSIVE " if body.upper().startswith("RECURSIVE") else "WITH "
    if body.upper().startswith("RECURSIVE"):
        body = body[len("RECURSIVE"):].strip()
    if not parts:
        return body if not body.upper().startswith("WITH ") and head == "WITH " else body
    if body.startswith("+"):  # more expressions follow the bindings
        return head + ",\n".join(parts) + ",\n" + body[1:].strip()
    return head + ",\n".join(parts) + "\n" + body
