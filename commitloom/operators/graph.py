"""The property graph as node and edge tables: sets, degrees, neighbours, views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom.functions import paths as P
from commitloom.operators.grams import containing
from commitloom.operators.skew import top_per_group
from commitloom.session import cut_lineage

REPO = ("repo_id",)
NODE_COLUMNS = [
    "key", "kind", "name", "qualified_name", "path", "type", "language", "loc", "file_key",
    "start_line", "end_line", "exported", "fan_in", "fan_out",
]


def unique_entity_keys(df: DataFrame, key: str, start_line: str, tie: str | None = None) -> DataFrame:
    """Second and later entities with the same key in a file get ``@<start line>`` appended.

    The first entity per key comes from a pre-aggregated minimum, not from a window over the key.
    """
    place = F.struct(*[F.col(x) for x in [start_line, *([tie] if tie else [])]])
    first = df.groupBy(key).agg(F.min(place).alias("_first"))
    repeated = place != F.col("_first")
    suffixed = F.concat(F.col(key), F.lit("@"), F.col(start_line).cast("string"))
    return df.join(first, key).withColumn(key, F.when(repeated, suffixed).otherwise(F.col(key))).drop("_first")


def merge_edges(edges: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """One edge per (type, source, target) with summed weight; self loops are dropped."""
    return (
        edges.where(F.col("source") != F.col("target"))
        .groupBy(*by, "type", "source", "target")
        .agg(F.sum("weight").alias("weight"))
    )


def edge_union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def co_change_symmetric(edges: DataFrame) -> DataFrame:
    """Every CO_CHANGED edge in both directions."""
    co = edges.where(F.col("type") == "CO_CHANGED")
    swapped = co.withColumns({"source": F.col("target"), "target": F.col("source")})
    return co.unionByName(swapped)


def counted_edges(edges: DataFrame) -> DataFrame:
    """Edges that count for degrees: IMPORTS of files, CALLS and EXTENDS."""
    return edges.where(
        ((F.col("type") == "IMPORTS") & F.col("target").startswith("f:"))
        | F.col("type").isin("CALLS", "EXTENDS")
    )


def degrees(edges: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Unweighted fan-in and fan-out of every node with a counted edge, in one shuffle."""
    ends = counted_edges(edges).select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("source").alias("key"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("target").alias("key"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e"),
    )
    return ends.groupBy(*by, F.col("e.key").alias("key")).agg(
        F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out")
    )


def with_degrees(nodes: DataFrame, degree: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    zero = F.lit(0).cast("long")
    joined = nodes.drop("fan_in", "fan_out").join(degree, [*by, "key"], "left")
    return joined.withColumns(
        {"fan_in": F.coalesce("fan_in", zero), "fan_out": F.coalesce("fan_out", zero)}
    )


def package_usage(edges: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Number of importing files per external package."""
    imported = edges.where((F.col("type") == "IMPORTS") & F.col("target").startswith("p:"))
    return imported.groupBy(*by, F.expr("substring(target, 3)").alias("package")).agg(
        F.count("*").alias("files")
    )


def count_by(df: DataFrame, column: str, by: Sequence[str] = REPO) -> DataFrame:
    return df.groupBy(*by, column).agg(F.count("*").alias("n"))


def _null_columns(df: DataFrame) -> DataFrame:
    types = {
        "qualified_name": "string", "path": "string", "type": "string", "language": "string",
        "loc": "int", "file_key": "string", "start_line": "int", "end_line": "int",
        "exported": "boolean", "fan_in": "long", "fan_out": "long",
    }
    return df.withColumns({k: F.lit(None).cast(v) for k, v in types.items() if k not in df.columns})


def node_set(files: DataFrame, entities: DataFrame, edges: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Files, entities, and packages that appear as edge targets, with their degrees.

    The fan-in of a package counts its importing edges; other degrees follow ``degrees``.
    """
    degree = degrees(edges, by)
    file_nodes = files.select(
        *by, "key", F.lit("file").alias("kind"), P.basename(F.col("path")).alias("name"), "path",
        "language", F.col("loc").cast("int").alias("loc"),
    )
    entity_nodes = entities.select(
        *by, "key", F.lit("entity").alias("kind"), "name", "qualified_name", "path", "type", "language",
        (F.col("end_line") - F.col("start_line") + 1).cast("int").alias("loc"), "file_key",
        "start_line", "end_line", "exported",
    )
    code = with_degrees(
        _null_columns(file_nodes).unionByName(_null_columns(entity_nodes)), degree, by
    )
    packages = (
        edges.where(F.col("target").startswith("p:"))
        .groupBy(*by, F.col("target").alias("key"))
        .agg(F.count("*").alias("fan_in"))
        .withColumns(
            {"kind": F.lit("package"), "name": F.expr("substring(key, 3)"), "fan_out": F.lit(0).cast("long")}
        )
    )
    columns = [*by, *NODE_COLUMNS]
    return code.select(*columns).unionByName(_null_columns(packages).select(*columns))


def endpoints_in(edges: DataFrame, keys: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Edges with both ends among ``keys`` (columns: keys, key)."""
    sources = keys.select(*by, F.col("key").alias("source"))
    targets = keys.select(*by, F.col("key").alias("target"))
    return edges.join(sources, [*by, "source"], "left_semi").join(targets, [*by, "target"], "left_semi")


def neighbours(edges: DataFrame, types: Sequence[str] | None = None, by: Sequence[str] = REPO) -> DataFrame:
    """Both directions of every edge as (key, other, type, dir, weight); CO_CHANGED only as ``out``."""
    chosen = edges.where(F.col("type").isin(list(types))) if types else edges
    views = [
        F.struct(F.col("source").alias("key"), F.col("target").alias("other"), F.lit("out").alias("dir")),
        F.struct(
            F.col("target").alias("key"), F.col("source").alias("other"),
            F.when(F.col("type") == "CO_CHANGED", "out").otherwise("in").alias("dir"),
        ),
    ]
    return chosen.select(*by, "type", "weight", F.explode(F.array(*views)).alias("v")).select(
        *by, "v.key", "v.other", "type", "v.dir", "weight"
    )


def known_neighbours(
    edges: DataFrame, nodes: DataFrame, types: Sequence[str] | None = None, by: Sequence[str] = REPO
) -> DataFrame:
    """Neighbours that are nodes, with the neighbour's fan-in and label."""
    other = nodes.select(
        *by, F.col("key").alias("other"), F.coalesce("fan_in", F.lit(0)).alias("other_fan_in"),
        P.node_label(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("path")).alias("other_label"),
        F.col("kind").alias("other_kind"),
    )
    return neighbours(edges, types, by).join(other, [*by, "other"])


def top_relations(
    near: DataFrame, limits: dict[tuple[str, str], int], by: Sequence[str] = REPO
) -> DataFrame:
    """The heaviest neighbours of every (node, type, direction), up to the limit of that relation."""
    limit = reduce(
        lambda acc, item: acc.when((F.col("type") == item[0][0]) & (F.col("dir") == item[0][1]), item[1]),
        limits.items(), F.when(F.lit(False), 0),
    )
    ranked = top_per_group(
        near.withColumn("_limit", limit).where(F.col("_limit").isNotNull()),
        [*by, "key", "type", "dir"], [F.col("weight").desc(), F.col("other")],
        max(limits.values()), rank="position",
    )
    return ranked.where(F.col("position") <= F.col("_limit")).drop("_limit")


# How many neighbours a fact sentence names per relation.
FACT_LIMITS = {
    ("CONTAINS", "out"): 10, ("CALLS", "out"): 6, ("CALLS", "in"): 6, ("EXTENDS", "out"): 6,
    ("EXTENDS", "in"): 6, ("IMPORTS", "out"): 8, ("IMPORTS", "in"): 8, ("CO_CHANGED", "out"): 5,
}
# Wording and order of the relations in a fact sentence.
FACT_WORDING = [
    (("CONTAINS", "out"), "contains"), (("CALLS", "out"), "calls"), (("CALLS", "in"), "is called by"),
    (("EXTENDS", "out"), "extends/implements"), (("EXTENDS", "in"), "is extended by"),
    (("IMPORTS", "out"), "imports"), (("IMPORTS", "in"), "is imported by"),
    (("CO_CHANGED", "out"), "historically co-changes with"),
]


def graph_facts(nodes: DataFrame, near: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """One sentence per node that lists its strongest neighbours of every relation."""
    best = top_relations(near, FACT_LIMITS, by)
    named = best.groupBy(*by, "key", "type", "dir").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "other_label"))),
                lambda x: x["other_label"],
            ),
            ", ",
        ).alias("names")
    )
    wording = reduce(
        lambda acc, item: acc.when(
            (F.col("type") == item[1][0][0]) & (F.col("dir") == item[1][0][1]),
            F.struct(F.lit(item[0]).alias("i"), F.concat(F.lit(item[1][1] + " "), "names").alias("s")),
        ),
        enumerate(FACT_WORDING), F.when(F.lit(False), F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))),
    )
    body = named.groupBy(*by, "key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(wording)), lambda x: x["s"]), "; ").alias("_body")
    )
    head = P.describe_node(
        F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("path"), F.col("type"), F.col("start_line")
    )
    return nodes.join(body, [*by, "key"]).select(
        *by, "key", F.concat(head, F.lit(" — "), "_body").alias("fact")
    )


def node_relations(near: DataFrame, limit: int = 50, by: Sequence[str] = REPO) -> DataFrame:
    """Up to ``limit`` neighbours of every relation of a node, heaviest then most used first."""
    return top_per_group(
        near, [*by, "key", "type", "dir"],
        [F.col("weight").desc(), F.col("other_fan_in").desc(), F.col("other")], limit, rank="position",
    )


def neighbour_cap(near: DataFrame, limit: int = 4, by: Sequence[str] = REPO) -> DataFrame:
    """The ``limit`` heaviest neighbours of every node over all relations."""
    return top_per_group(
        near, [*by, "key"], [F.col("weight").desc(), F.col("other"), F.col("type"), F.col("dir")], limit,
        rank="position",
    )


def ego_links(
    focus: DataFrame, near: DataFrame, depth: int = 2, with_co_change: bool = False,
    caps: Sequence[int] = (60, 12), by: Sequence[str] = REPO,
) -> DataFrame:
    """Distinct links of the neighbourhood of every focus key (columns: keys, focus).

    Each hop follows a node's neighbours of highest fan-in; the cap applies before CO_CHANGED
    links are left out. A hop expands only nodes that the hops before it had not reached.
    """
    ranked = top_per_group(
        near, [*by, "key"],
        [F.col("other_fan_in").desc(), F.col("other"), F.col("type"), F.col("dir")], max(caps), rank="_p",
    )
    if not with_co_change:
        ranked = ranked.where(F.col("type") != "CO_CHANGED")
    # written once: every hop reads the ranked neighbours, each with its own cap
    ranked = cut_lineage(ranked.select(*by, "key", "other", "type", "dir", "weight", "_p"))
    reached = focus.select(*by, "focus", F.col("focus").alias("key"))
    frontier, levels = reached, []
    for level in range(depth):
        step = frontier.join(ranked.where(F.col("_p") <= caps[min(level, len(caps) - 1)]), [*by, "key"])
        levels.append(step)
        found = step.select(*by, "focus", F.col("other").alias("key")).distinct()
        frontier = found.join(reached, [*by, "focus", "key"], "left_anti")
        reached = reached.unionByName(frontier)
    outward = F.col("dir") == "out"
    return edge_union(*levels).select(
        *by, "focus",
        F.when(outward, F.col("key")).otherwise(F.col("other")).alias("source"),
        F.when(outward, F.col("other")).otherwise(F.col("key")).alias("target"), "type", "weight",
    ).dropDuplicates([*by, "focus", "source", "target", "type"])


def import_neighbourhood(links: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Files and packages tied to a focus by IMPORTS links of its ego graph."""
    imports = links.where(F.col("type") == "IMPORTS")
    ends = imports.select(*by, "focus", F.explode(F.array("focus", "source", "target")).alias("key"))
    return ends.where(F.col("key").rlike("^[fp]:")).distinct()


def edges_to_modules(edges: DataFrame, files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Import counts between the modules of files; imports inside a module do not count."""
    module = files.select(*by, "key", "module")
    imports = edges.where((F.col("type") == "IMPORTS") & F.col("target").startswith("f:"))
    joined = imports.join(
        module.select(*by, F.col("key").alias("source"), F.col("module").alias("source_module")), [*by, "source"]
    ).join(
        module.select(*by, F.col("key").alias("target"), F.col("module").alias("target_module")), [*by, "target"]
    )
    return (
        joined.where(F.col("source_module") != F.col("target_module"))
        .groupBy(*by, F.col("source_module").alias("source"), F.col("target_module").alias("target"))
        .agg(F.count("*").alias("weight"))
    )


def module_stats(files: DataFrame, module_edges: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Files, LOC, import degrees and instability of every module."""
    sizes = files.groupBy(*by, "module").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    ends = module_edges.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("source").alias("module"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")),
                F.struct(F.col("target").alias("module"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")),
            )
        ).alias("e"),
    ).groupBy(*by, F.col("e.module").alias("module")).agg(
        F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out")
    )
    zero = F.lit(0).cast("long")
    joined = sizes.join(ends, [*by, "module"], "left").withColumns(
        {"fan_in": F.coalesce("fan_in", zero), "fan_out": F.coalesce("fan_out", zero)}
    )
    both = F.col("fan_in") + F.col("fan_out")
    return joined.withColumn(
        "instability", F.when(both > 0, F.round(F.col("fan_out") / both, 2)).otherwise(F.lit(0.0))
    )


def module_externals(edges: DataFrame, files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """(keys, module, package, files): how many files of a module import each outside package. ``edges`` are merged."""
    imports = edges.where((F.col("type") == "IMPORTS") & F.col("target").startswith("p:"))
    module = files.select(*by, F.col("key").alias("source"), P.module_of(F.col("path")).alias("module"))
    return imports.join(module, [*by, "source"]).groupBy(*by, "module", F.expr("substring(target, 3)").alias("package")).agg(F.count("*").alias("files"))


def enrich_entities(entities: DataFrame, files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Entities with path and size of their file, and their own lines."""
    homes = files.select(*by, F.col("key").alias("file_key"), "path", "loc")
    own = entities.select(*by, "file_key", "key", "qualified_name", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return own.join(homes, [*by, "file_key"]).select(*by, "key", "qualified_name", "path", "loc", "lines")


def enrich_chunks(chunks: DataFrame, files: DataFrame, entities: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Chunks (keys, path, entity_key, ...) with file key, the entity's name and type, and the node that owns them.

    A chunk without an entity belongs to its file; a chunk of a file that is not there is left out.
    """
    homes = files.select(*by, "path", F.col("key").alias("file_key"))
    named = entities.select(*by, F.col("key").alias("entity_key"), F.col("qualified_name").alias("entity_name"), F.col("type").alias("entity_type"))
    return chunks.join(homes, [*by, "path"]).join(named, [*by, "entity_key"], "left").withColumn("owner", F.coalesce("entity_key", "file_key"))


def directory_rollup(files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """LOC, churn and file count of every directory, the root (``''``) included."""
    return (
        files.select(*by, "loc", "churn", F.explode(P.parent_dirs(F.col("path"))).alias("dir"))
        .groupBy(*by, "dir")
        .agg(F.sum("loc").alias("loc"), F.sum("churn").alias("churn"), F.count("*").alias("files"))
    )


def tree_listing(files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Directories and files with parent and depth; ``sort_key`` orders directories first."""
    dirs = directory_rollup(files, by).where(F.col("dir") != "").select(
        *by, F.col("dir").alias("path"), "loc", "churn", F.lit(True).alias("is_dir")
    )
    leaves = files.select(
        *by, "path", F.col("loc").cast("long").alias("loc"), F.col("churn").cast("long").alias("churn"),
        F.lit(False).alias("is_dir"),
    )
    rows = dirs.unionByName(leaves)
    return rows.select(
        *by, "path", P.dirname(F.col("path")).alias("parent"), P.path_depth(F.col("path")).alias("depth"),
        "is_dir", "loc", "churn",
        F.concat(F.when(F.col("is_dir"), "0").otherwise("1"), P.basename(F.col("path"))).alias("sort_key"),
    )


def directory_summary(files: DataFrame, top: int = 15, by: Sequence[str] = REPO) -> DataFrame:
    grouped = files.groupBy(*by, P.summary_dir(F.col("path")).alias("dir")).agg(
        F.count("*").alias("files"), F.sum("loc").alias("loc")
    )
    return top_per_group(grouped, by, [F.col("loc").desc(), F.col("dir")], top)


def language_stats(files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Files, LOC and share of LOC per language."""
    grouped = files.groupBy(*by, "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    total = F.sum("loc").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return grouped.withColumn("share", F.col("loc") / F.greatest(total, F.lit(1)))


def repo_stats(files: DataFrame, skipped: Column, by: Sequence[str] = REPO) -> DataFrame:
    """Files, code files and LOC of the kept files, and how many were skipped."""
    kept = ~skipped
    return files.groupBy(*by).agg(
        F.count_if(kept).alias("files"),
        F.count_if(kept & P.is_code(F.col("language"))).alias("code_files"),
        F.coalesce(F.sum(F.when(kept, F.col("loc"))), F.lit(0)).alias("loc"),
        F.count_if(skipped).alias("skipped"),
    )


def hottest_files(files: DataFrame, limit: int = 400, by: Sequence[str] = REPO) -> DataFrame:
    """Code files by degree and churn, with the total file count and whether any were left out."""
    total = files.groupBy(*by).agg(F.count("*").alias("total"))
    code = files.where(P.is_code(F.col("language"))).withColumn(
        "rank_score", F.col("fan_in") + F.col("fan_out") + F.col("churn") / 50
    )
    top = top_per_group(code, by, [F.col("rank_score").desc(), F.col("key")], limit)
    sizes = top.groupBy(*by).agg(F.count("*").alias("_shown"))
    bounds = sizes.join(total, list(by)).select(
        *by, "total", (F.col("total") > F.col("_shown")).alias("truncated")
    )
    return top.join(bounds, list(by))


def search_names(nodes: DataFrame, terms: DataFrame, top: int = 25, by: Sequence[str] = REPO) -> DataFrame:
    """Files and entities whose name or path contains a search term, best matches first.

    ``terms`` holds (keys, term) with lower-case terms. Terms find nodes by their rarest gram, see ``grams``.
    """
    hay = F.when(F.col("kind") == "file", F.col("path")).otherwise(F.concat_ws(" ", "qualified_name", "path"))
    searchable = nodes.where(F.col("kind").isin("file", "entity")).select(
        *by, "key", "kind", "fan_in", F.lower("name").alias("_name"), F.lower(hay).alias("_hay")
    ).withColumn("_text", F.concat_ws("\0", "_name", "_hay"))
    found = containing(searchable, terms, "_text", by).join(searchable.drop("_text"), [*by, "key"])
    term = F.col("term")
    base = (
        F.when(F.col("_name") == term, 100)
        .when(F.startswith(F.col("_name"), term), 70)
        .when(F.contains(F.col("_name"), term), 50)
        .when(F.contains(F.col("_hay"), term), 30)
    )
    scored = found.withColumn("_base", base).where(F.col("_base").isNotNull()).select(
        *by, "term", "key",
        (F.col("_base") + F.least(F.lit(20), F.col("fan_in")) + F.when(F.col("kind") == "file", 5).otherwise(0))
        .cast("long").alias("score"),
    )
    return top_per_group(scored, [*by, "term"], [F.col("score").desc(), F.col("key")], top)
