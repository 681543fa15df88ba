"""Resolving names to code entities: calls, references and base types to edges, mentions to nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom import fixed
from commitloom.functions import paths as P
from commitloom.functions import text as X
from commitloom.operators.grams import containing
from commitloom.operators.skew import top_per_group

REPO = ("repo_id",)

# Entity types a use may mean.
WANTED = {
    "call": ["class", "struct", "trait", "type", "function", "method", "module"],
    "reference": ["class", "struct", "trait", "module", "function", "method"],
    "new": ["class", "struct"],
    "base": ["class", "interface", "trait", "struct"],
}


def _wanted(use, type_):
    call = ~type_.isin("interface", "type", "enum")
    return F.when(use == "new", type_.isin(WANTED["new"])).when(use == "base", type_.isin(WANTED["base"])).otherwise(call)


def resolve_names(
    refs: DataFrame, entities: DataFrame, imports: DataFrame, most: int = 2, by: Sequence[str] = REPO
) -> DataFrame:
    """Targets of named uses: (refs columns, target, tier).

    ``refs`` holds (keys, ref_id, file_key, language, name, use, strict) with use one of call, new,
    reference, base. Tiers: 0 same file, 1 files the file imports (keys, source, target), 2 a match in
    the same language family when it has at most ``most`` candidates and the use is not strict. The
    first tier with candidates decides; at most ``most`` of it, by (file, start line), are taken.
    """
    cand = entities.select(
        *by, "name", F.col("key").alias("target"), F.col("file_key").alias("_file"), "type",
        P.language_family(F.col("language")).alias("_family"), F.col("start_line").alias("_line"),
    )
    own = [*by, "ref_id"]
    place = ["_file", "_line", "target"]
    # uses of one name in one file have the same candidates: they are found once, and at most ``most`` meet a use
    uses = F.explode(F.array(F.lit("call"), F.lit("new"), F.lit("base"))).alias("_use")
    per_use = cand.select("*", uses).where(_wanted(F.col("_use"), F.col("type")))
    held = top_per_group(per_use, [*by, "_file", "name", "_use"], [F.col("_line"), F.col("target")], most).select(*by, "name", "_use", *place)
    refs_by = refs.select(
        *own, "file_key", "name", "language", "strict", F.when(F.col("use").isin("new", "base"), F.col("use")).otherwise("call").alias("_use"))
    asked = refs_by.select(*by, "file_key", "name", "_use").distinct()
    local = refs_by.join(held.withColumn("file_key", F.col("_file")), [*by, "file_key", "name", "_use"]).select(
        *own, *place, F.lit(0).alias("tier")
    )
    links = imports.where((F.col("type") == "IMPORTS") & F.col("target").startswith("f:")).select(
        *by, F.col("source").alias("file_key"), F.col("target").alias("_file")
    ).distinct()
    seen = asked.join(links, [*by, "file_key"]).join(held, [*by, "_file", "name", "_use"])
    near = top_per_group(seen, [*by, "file_key", "name", "_use"], [F.col(x) for x in place], most)
    imported = refs_by.join(near, [*by, "file_key", "name", "_use"]).select(*own, *place, F.lit(1).alias("tier"))
    # per (name, family, use kind) only candidate sets of at most `most` count, so the join stays small
    rare = top_per_group(per_use, [*by, "name", "_family", "_use"], [F.col("_file"), F.col("_line"), F.col("target")], most + 1)
    few = (
        rare.groupBy(*by, "name", "_family", "_use")
        .agg(F.collect_list(F.struct(*place)).alias("_c"))
        .where(F.size("_c") <= most)
    )
    anywhere = (
        refs_by.where(~F.col("strict"))
        .select(*own, "name", P.language_family(F.col("language")).alias("_family"), "_use")
        .join(few, [*by, "name", "_family", "_use"])
        .select(*own, F.explode("_c").alias("c"))
        .select(*own, "c.*", F.lit(2).alias("tier"))
    )
    ranked = top_per_group(
        local.unionByName(imported).unionByName(anywhere), own,
        [F.col("tier"), F.col("_file"), F.col("_line"), F.col("target")], most, rank="_n",
    )
    first = ranked.groupBy(*own).agg(F.min("tier").alias("_tier"))
    kept = ranked.join(first, own).where(F.col("tier") == F.col("_tier")).select(*own, "target", "tier")
    return refs.join(kept, own)


def name_edges(resolved: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """CALLS and EXTENDS edges from resolved uses (with ``source`` and ``weight``); self uses dropped."""
    edges = resolved.where(F.col("source") != F.col("target")).select(
        *by, "source", "target", F.when(F.col("use") == "base", "EXTENDS").otherwise("CALLS").alias("type"), "weight"
    )
    return edges.groupBy(*by, "type", "source", "target").agg(F.sum("weight").alias("weight"))


def references_without_calls(refs: DataFrame, calls: DataFrame, on: Sequence[str]) -> DataFrame:
    """References whose name the same body does not also call."""
    return refs.join(calls.select(*on).distinct(), list(on), "left_anti")


def _first_ending(asked: DataFrame, files: DataFrame, by: Sequence[str]) -> DataFrame:
    """(keys, ending, key): of the files whose lower-cased path ends with an asked ending the first in path order.

    An ending with a slash names the whole last segment; others need not begin a segment and are found by their rarest
    gram among the names.
    """
    endings = asked.select(*by, "ending").where(F.length("ending") > 0).distinct()
    lower = files.select(*by, F.col("key"), "path", F.lower("path").alias("_low")).withColumn("_name", F.substring_index("_low", "/", -1))
    deep = endings.where(F.contains("ending", F.lit("/"))).withColumn("_name", F.substring_index("ending", "/", -1))
    flat = containing(lower.select(*by, "_name").distinct().withColumn("_file", F.col("_name")), endings.where(~F.contains("ending", F.lit("/"))), "_name", by, "_file", "ending")
    named = flat.where(F.endswith(F.col("_file"), F.col("ending"))).select(*by, "ending", F.col("_file").alias("_name"))
    # of one name only the first file can answer an ending without a slash
    least = lower.groupBy(*by, "_name").agg(F.min(F.struct("path", "key")).alias("_first"))
    hits = named.join(least, [*by, "_name"]).select(*by, "ending", "_first").unionByName(
        deep.join(lower, [*by, "_name"]).where(F.endswith(F.col("_low"), F.col("ending"))).select(*by, "ending", F.struct("path", "key").alias("_first")))
    return hits.groupBy(*by, "ending").agg(F.min("_first").alias("_first")).select(*by, "ending", F.col("_first.key").alias("key"))


def link_mentions(
    questions: DataFrame, entities: DataFrame, files: DataFrame, text: str = "question", most: int = 8,
    max_candidates: int = 6, taken: int = 3, by: Sequence[str] = (), query: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Graph nodes a question names: (query, key, position), at most ``most`` per question.

    Identifier-like tokens may mean up to ``max_candidates`` symbols and give the first ``taken``; plain
    words count when they are long, uncommon and name exactly one. Path tokens give the first file that
    ends with them. Popular names are cut to ``max_candidates + 1`` rows before the join.
    """
    tokens = questions.select(*by, *query, F.posexplode(X.mention_identifiers(F.col(text))).alias("_at", "token")).where(
        F.length("token") >= 3
    ).withColumn("name", F.lower(F.substring_index("token", ".", -1)))
    symbols = entities.select(*by, F.lower("name").alias("name"), "key")
    few = (
        top_per_group(symbols, [*by, "name"], [F.col("key")], max_candidates + 1)
        .groupBy(*by, "name").agg(F.array_sort(F.collect_list("key")).alias("_keys"))
        .where(F.size("_keys") <= max_candidates)
    )
    token = F.col("token")
    plain = (F.size("_keys") == 1) & (F.length(token) >= 6) & ~F.col("name").isin(fixed.COMMON_WORDS)
    named = tokens.join(few, [*by, "name"]).where(P.is_identifier_like(token) | plain).select(
        *by, *query, F.lit(0).alias("_kind"), "_at", F.posexplode(F.slice("_keys", 1, taken)).alias("_i", "key")
    )
    paths = questions.select(*by, *query, F.posexplode(X.mention_paths(F.col(text))).alias("_at", "token"))
    asked = paths.select(*by, *query, "_at", F.lower("token").alias("ending"))
    first = asked.join(_first_ending(asked, files, by), [*by, "ending"]).select(*by, *query, "_at", "key")
    filed = first.select(*by, *query, F.lit(1).alias("_kind"), "_at", F.lit(0).alias("_i"), "key")
    seen = named.unionByName(filed).groupBy(*by, *query, "key").agg(F.min(F.struct("_kind", "_at", "_i")).alias("_first"))
    return top_per_group(seen, [*by, *query], [F.col("_first"), F.col("key")], most, rank="position").drop("_first")
