"""Import resolution: every import proposes ranked candidates, files answer by equi join.

A candidate is ``(step, rank, kind, value)``. ``kind`` says which key of a file it asks for: its exact
``path``, a lower-cased path ``suffix`` or a lower-cased directory suffix ``dir``. Within an import the
least ``step`` and ``rank`` that hits anything wins; rows with different ``slot`` values are decided
separately, so one import can resolve to several files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom import fixed
from commitloom.functions import paths as P
from commitloom.operators.skew import salted_join, top_per_group

REPO = ("repo_id",)
CANDIDATE = "array<struct<slot:string,step:int,rank:int,kind:string,value:string>>"


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _cands(kind: str, values: Column, step: Column | int = 0, slot: Column | str = "") -> Column:
    """Candidates of one kind from an array of values, ranked in array order."""
    step = step if isinstance(step, Column) else F.lit(step)
    slot = slot if isinstance(slot, Column) else F.lit(slot)
    return F.transform(
        values,
        lambda v, i: F.struct(
            slot.alias("slot"), step.cast("int").alias("step"), i.cast("int").alias("rank"),
            F.lit(kind).alias("kind"), v.alias("value"),
        ),
    ).cast(CANDIDATE)


def script_paths(base: Column) -> Column:
    """Paths a script import may mean: as written, with an extension, its typed twin, an index file."""
    emitted = F.regexp_extract(base, r"^(.*)\.(?:js|jsx|mjs|cjs)$", 1)
    twins = F.when(
        base.rlike(r"\.(js|jsx|mjs|cjs)$"),
        F.transform(_strings(fixed.TYPED_EXTENSIONS), lambda e: F.concat(emitted, e)),
    ).otherwise(_strings([]))
    extensions = _strings(fixed.SCRIPT_EXTENSIONS)
    return F.concat(
        F.array(base),
        F.transform(extensions, lambda e: F.concat(base, e)),
        twins,
        F.transform(extensions, lambda e: F.concat(base, F.lit("/index"), e)),
    )


def python_paths(base_dir: Column, module: Column) -> Column:
    base = P.join_path(base_dir, F.translate(module, ".", "/"))
    return F.transform(_strings([".py", ".pyi", "/__init__.py"]), lambda e: F.concat(base, e))


def candidates_relative(spec: Column, path: Column, language: Column) -> Column:
    """Imports relative to the importing file: scripts, Ruby, Dart, quoted C includes, PHP."""
    base = P.join_path(P.dirname(path), spec)
    rooted = P.normalize_path(spec)
    ruby = F.array(
        base, F.concat(base, F.lit(".rb")), F.concat(base, F.lit("/index.rb"))
    )
    script = language.isin("typescript", "javascript")
    return (
        F.when(script & spec.startswith("."), _cands("path", script_paths(base)))
        .when(script & spec.startswith("/"), _cands("path", script_paths(rooted)))
        .when((language == "ruby") & spec.startswith("."), _cands("path", ruby))
        .when(
            (language.isin("c", "cpp") & ~spec.startswith("<"))
            | ((language == "php") & ~spec.contains("\\"))
            | ((language == "dart") & ~spec.rlike("^(dart|package):")),
            _cands("path", F.array(base)),
        )
        .otherwise(F.array().cast(CANDIDATE))
    )


def candidates_alias_root(spec: Column, aliases: Column, roots: Column) -> Column:
    """Script imports through path aliases (in order), then the repository's source roots.

    ``aliases`` is ``array<struct<prefix, targets array<string>>>``; ``roots`` is ``array<string>``.
    """
    plain = ~spec.rlike(r"^[./]")
    matching = F.filter(aliases, lambda a: F.startswith(spec, a["prefix"]))
    through = F.flatten(
        F.transform(
            matching,
            lambda a: F.flatten(
                F.transform(
                    a["targets"],
                    lambda t: script_paths(
                        P.join_path(t, F.substring(spec, F.length(a["prefix"]) + 1, F.length(spec)))
                    ),
                )
            ),
        )
    )
    below = F.flatten(
        F.transform(F.filter(roots, lambda r: r != ""), lambda r: script_paths(P.join_path(r, spec)))
    )
    return F.when(plain, F.concat(_cands("path", through, 1), _cands("path", below, 2))).otherwise(
        F.array().cast(CANDIDATE)
    )


def candidates_module(spec: Column, names: Column, path: Column, roots: Column) -> Column:
    """Dotted Python modules: leading dots climb, else roots, then the file's own ancestors.

    Every imported name may itself be a submodule, which is a slot of its own.
    """
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    module = F.regexp_replace(spec, r"^\.+", "")
    here = F.split(P.dirname(path), "/")
    climbed = F.array_join(
        F.when(
            F.size(here) - (dots - 1) > 0,
            F.slice(here, F.lit(1), F.greatest(F.size(here) - (dots - 1), F.lit(0))),
        ).otherwise(_strings([])),
        "/",
    )
    known = F.coalesce(names, _strings([]))
    sub = lambda n: F.when(module == "", n).otherwise(F.concat(module, F.lit("."), n))
    relative = F.concat(
        F.when(module != "", _cands("path", python_paths(climbed, module), 0, "module")).otherwise(
            F.array().cast(CANDIDATE)
        ),
        F.flatten(
            F.transform(
                known, lambda n: _cands("path", python_paths(climbed, sub(n)), 0, F.concat(F.lit("name:"), n))
            )
        ),
        # a bare `from . import x` means the package file when nothing else is found
        F.when(
            module == "", _cands("path", F.array(P.join_path(climbed, F.lit("__init__.py"))), 9, "fallback")
        ).otherwise(F.array().cast(CANDIDATE)),
    )
    ancestors = F.reverse(F.filter(P.parent_dirs(path), lambda d: d != ""))
    absolute = F.concat(
        _cands("path", F.flatten(F.transform(roots, lambda r: python_paths(r, module))), 0, "module"),
        _cands("path", F.flatten(F.transform(ancestors, lambda d: python_paths(d, module))), 1, "module"),
        F.flatten(
            F.transform(
                known,
                lambda n: _cands(
                    "path", F.flatten(F.transform(roots, lambda r: python_paths(r, sub(n)))), 0,
                    F.concat(F.lit("name:"), n),
                ),
            )
        ),
    )
    return F.when(dots > 0, relative).otherwise(absolute)


def candidates_suffix(spec: Column, language: Column) -> Column:
    """Imports that name the end of a path: JVM classes, includes, Ruby, PHP namespaces, Dart packages."""
    clean = F.regexp_replace(F.regexp_replace(spec, r"\{.*\}$", ""), r"\.$", "")
    parts = F.split(clean, r"\.")
    # longest prefix of the dotted name first, three file types each
    jvm = F.flatten(
        F.transform(
            F.when(F.size(parts) >= 2, F.sequence(F.size(parts), F.lit(2))).otherwise(F.array().cast("array<int>")),
            lambda n: F.transform(
                _strings([".java", ".kt", ".scala"]),
                lambda e: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), e),
            ),
        )
    )
    include = F.array(P.normalize_path(F.regexp_replace(spec, "^<", "")))
    ruby = F.array(F.when(spec.endswith(".rb"), spec).otherwise(F.concat(spec, F.lit(".rb"))))
    spaces = F.filter(F.split(spec, r"\\"), lambda s: s != "")
    namespace = F.transform(
        F.when(F.size(spaces) > 1, F.sequence(F.lit(1), F.size(spaces) - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.concat(F.array_join(F.slice(spaces, n, F.size(spaces)), "/"), F.lit(".php")),
    )
    dart = F.array(
        F.concat(F.lit("lib/"), F.regexp_replace(F.regexp_replace(spec, "^package:", ""), "^[^/]*/?", ""))
    )
    lowered = lambda values: _cands("suffix", F.transform(values, F.lower), 3)
    return (
        F.when(language.isin("java", "kotlin", "scala") & ~clean.endswith("*"), lowered(jvm))
        .when(language.isin("c", "cpp"), lowered(include))
        .when((language == "ruby") & ~spec.startswith("."), lowered(ruby))
        .when((language == "php") & spec.contains("\\"), lowered(namespace))
        .when(language == "php", lowered(F.array(P.normalize_path(spec))))
        .when((language == "dart") & spec.startswith("package:"), lowered(dart))
        .otherwise(F.array().cast(CANDIDATE))
    )


def candidates_directory(spec: Column, language: Column) -> Column:
    """Imports that name a directory: Go packages, JVM wildcards, C# namespaces.

    ``dir`` asks for a directory ending in the value, ``whole`` for exactly that directory.
    """
    tails = P.path_suffixes(spec)
    clean = F.regexp_replace(F.regexp_replace(spec, r"\{.*\}$", ""), r"\.$", "")
    wild = F.lower(F.translate(F.regexp_replace(clean, r"\.\*$", ""), ".", "/"))
    space = F.lower(F.translate(spec, ".", "/"))
    inner = F.regexp_replace(space, "^[^/]*/?", "")

    def either(name: Column, step: int) -> Column:
        deep = F.filter(P.path_suffixes(name), lambda v: v.contains("/"))
        return F.concat(
            _cands("dir", F.filter(F.array(name), lambda v: v != ""), step), _cands("whole", deep, step)
        )

    return (
        F.when(
            language == "go",
            F.concat(
                _cands("whole", F.array(spec), 4),
                _cands("dir", F.filter(F.slice(tails, 2, F.size(tails)), lambda v: v != ""), 5),
            ),
        )
        .when(language.isin("java", "kotlin", "scala") & clean.endswith("*"), either(wild, 4))
        .when(language == "csharp", F.concat(either(inner, 4), either(space, 5)))
        .otherwise(F.array().cast(CANDIDATE))
    )


def candidates_crate(spec: Column, path: Column) -> Column:
    """Rust paths: ``mod`` declarations next to the file, ``crate``/``super``/``self`` paths."""
    here = P.dirname(path)
    own = F.when(path.rlike(r"(^|/)(main|lib|mod)\.rs$"), here).otherwise(
        P.join_path(here, F.regexp_replace(P.basename(path), r"\.rs$", ""))
    )
    named = P.join_path(own, F.regexp_replace(spec, "^mod:", ""))
    module = F.array(named, F.concat(named, F.lit(".rs")), F.concat(named, F.lit("/index.rs")), F.concat(named, F.lit("/mod.rs")))
    parts = F.filter(F.split(F.regexp_replace(spec, r"\{.*$", ""), "::"), lambda s: s != "")
    head = F.get(parts, F.lit(0))
    source_dir = F.regexp_extract(path, r"^(.*)src/", 1)
    base = (
        F.when(head == "crate", F.when(path.contains("src/"), F.concat(source_dir, F.lit("src"))).otherwise("src"))
        .when(head == "super", P.dirname(here))
        .when(head == "self", here)
    )
    rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    inside = F.flatten(
        F.transform(
            F.when(F.size(rest) >= 1, F.sequence(F.size(rest), F.lit(1))).otherwise(F.array().cast("array<int>")),
            lambda n: F.transform(
                _strings([".rs", "/mod.rs"]),
                lambda e: F.concat(P.join_path(base, F.array_join(F.slice(rest, F.lit(1), n), "/")), e),
            ),
        )
    )
    return (
        F.when(spec.startswith("mod:"), _cands("path", module))
        .when(base.isNotNull(), _cands("path", inside))
        .otherwise(F.array().cast(CANDIDATE))
    )


def source_roots(files: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Roots probed in every repository: the top, then each conventional root that holds files."""
    first = F.substring_index("path", "/", 1)
    held = F.when(F.col("path").contains("/") & first.isin(fixed.SOURCE_ROOTS), first)
    present = files.groupBy(*by).agg(F.collect_set(held).alias("_set"))  # at most one row per root
    in_order = F.filter(_strings(fixed.SOURCE_ROOTS), lambda r: F.array_contains(F.col("_set"), r))
    return present.select(*by, F.concat(F.array(F.lit("")), in_order).alias("roots"))


def _file_index(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first file in path order under every exact path and every lower-cased suffix: one row per value."""
    path = F.col("path")
    every = files.select(
        *by, F.col("path").alias("target"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("path").alias("kind"), path.alias("value"))),
                F.transform(
                    P.path_suffixes(F.lower(path)), lambda s: F.struct(F.lit("suffix").alias("kind"), s.alias("value"))
                ),
            )
        ).alias("k"),
    )
    return every.groupBy(*by, "k.kind", "k.value").agg(F.min("target").alias("target"))


def _directory_index(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first and the longest directory with files under each whole name and suffix, plain and lower-cased.

    One row per value: of the longest directories the first in path order.
    """
    dirs = files.select(*by, P.dirname(F.col("path")).alias("dir")).distinct().where(F.col("dir") != "")
    plain, lowered = F.col("dir"), F.lower("dir")
    whole = F.transform(
        F.array_distinct(F.array(plain, lowered)), lambda v: F.struct(F.lit("whole").alias("kind"), v.alias("value"))
    )
    ends = F.transform(
        F.array_union(P.path_suffixes(plain), P.path_suffixes(lowered)),
        lambda v: F.struct(F.lit("dir").alias("kind"), v.alias("value")),
    )
    every = dirs.select(*by, "dir", F.explode(F.concat(whole, ends)).alias("k"))
    return every.groupBy(*by, "k.kind", "k.value").agg(
        F.min("dir").alias("first"), F.min(F.struct((-F.length("dir")).alias("n"), "dir")).alias("longest")
    ).select(*by, "kind", "value", "first", F.col("longest.dir").alias("longest"))


# Which files of a directory an import brings in, and how many at most.
DIRECTORY_FILES = {
    "go": (r"(?<!_test)\.go$", 8), "java": (r"\.(java|kt|scala)$", 8), "kotlin": (r"\.(java|kt|scala)$", 8),
    "scala": (r"\.(java|kt|scala)$", 8), "csharp": (r"\.cs$", 6),
}


def default_aliases() -> Column:
    targets = F.array(F.lit("src/"), F.lit(""))
    return F.array(
        F.struct(F.lit("@/").alias("prefix"), targets.alias("targets")),
        F.struct(F.lit("~/").alias("prefix"), targets.alias("targets")),
    )


def propose(
    imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, by: Sequence[str] = REPO,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Imports with their candidate array. ``aliases`` holds (keys, prefix, target, priority).

    ``languages`` names the languages that occur, to keep the expression small; None means any.
    """
    roots = source_roots(files, by)
    ready = imports.join(roots, list(by), "left").withColumn(
        "roots", F.coalesce("roots", F.array(F.lit("")))
    )
    configured = F.array().cast("array<struct<prefix:string,targets:array<string>>>")
    if aliases is not None:
        per_prefix = aliases.groupBy(*by, "prefix").agg(
            F.min("priority").alias("_p"),
            F.transform(F.array_sort(F.collect_list(F.struct("priority", "target"))), lambda x: x["target"]).alias("targets"),
        )
        listed = per_prefix.groupBy(*by).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_p", "prefix", "targets"))),
                lambda x: F.struct(x["prefix"].alias("prefix"), x["targets"].alias("targets")),
            ).alias("_aliases")
        )
        ready = ready.join(listed, list(by), "left")
        configured = F.coalesce("_aliases", configured)
    spec, path, language = F.col("spec"), F.col("path"), F.col("language")
    names = F.col("names") if "names" in imports.columns else _strings([])

    def every_kind() -> Column:
        return F.concat(
            candidates_relative(spec, path, language), candidates_suffix(spec, language), candidates_directory(spec, language)
        )

    def script() -> Column:
        known = F.concat(configured, default_aliases())
        return F.concat(candidates_relative(spec, path, language), candidates_alias_root(spec, known, F.col("roots")))

    builders = [
        (("typescript", "javascript"), script),
        (("python",), lambda: candidates_module(spec, names, path, F.col("roots"))),
        (("rust",), lambda: candidates_crate(spec, path)),
        (("go", "csharp"), lambda: candidates_directory(spec, language)),
        (("java", "kotlin", "scala", "c", "cpp", "ruby", "php", "dart"), every_kind),
    ]
    every = F.array().cast(CANDIDATE)
    for group, build in builders:
        if languages is None or set(group) & set(languages):
            every = F.when(language.isin(*group), build()).otherwise(every)
    return ready.withColumn("candidates", every).drop("roots", "_aliases")


def _directory_files(files: DataFrame, by: Sequence[str], first: bool) -> DataFrame:
    """(keys, dir, language, target): the files of each directory that an import of it brings in, all or the first few."""
    members = files.select(*by, F.col("path").alias("target"), P.dirname(F.col("path")).alias("dir"))
    rules = F.array(*[F.struct(F.lit(n).alias("language"), F.lit(p).alias("pattern"), F.lit(m).alias("most")) for n, (p, m) in DIRECTORY_FILES.items()])
    wanted = members.select(*members.columns, F.explode(rules).alias("_rule")).where(F.expr("target rlike _rule.pattern"))
    named = wanted.select(*by, "dir", "target", "_rule.language", "_rule.most")
    if not first:
        return named.drop("most").distinct()
    most = max(m for _, m in DIRECTORY_FILES.values())
    ranked = top_per_group(named, [*by, "dir", "language"], [F.col("target")], most, rank="_n")
    return ranked.where(F.col("_n") <= F.col("most")).select(*by, "dir", "language", "target")


def import_hits(
    imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, by: Sequence[str] = REPO,
    languages: Sequence[str] | None = None, first: bool = False,
) -> DataFrame:
    """Distinct (keys, path, spec, language, target): the files each import means, the importing file itself included.

    Files and directories are reduced to the first per name before they meet imports, so a name that thousands of files
    share costs an import one row. An import of a directory means all its files, with ``first`` the first few of DIRECTORY_FILES.
    """
    key = [*by, "path", "language", "spec"]
    asked = (
        propose(imports, files, aliases, by, languages)
        .select(*key, F.explode_outer("candidates").alias("c"))
        .where(F.col("c").isNotNull())
        .select(*key, "c.slot", "c.step", "c.rank", "c.kind", "c.value")
        .distinct()
    )
    hits = asked.where(F.col("kind").isin("path", "suffix")).join(_file_index(files, by), [*by, "kind", "value"])
    best_file = hits.groupBy(*key, "slot").agg(
        F.min(F.struct("step", "rank", "target")).alias("b")
    ).select(*key, "slot", F.col("b.step").alias("step"), F.col("b.target").alias("target"))
    dir_hits = asked.where(F.col("kind").isin("dir", "whole")).join(
        _directory_index(files, by), [*by, "kind", "value"]
    )
    # Go takes the longest tail that hits, the others the longest directory; then path order
    go = F.col("language") == "go"
    chosen = F.when(go, F.col("first")).otherwise(F.col("longest"))
    preference = F.when(go, F.col("rank")).otherwise(-F.length("longest"))
    best_dir = dir_hits.groupBy(*key).agg(
        F.min(F.struct("step", preference.alias("p"), chosen.alias("dir"))).alias("b")
    ).select(*key, F.col("b.dir").alias("dir"))
    # a directory's imports are spread: each brings in all its files
    listed = salted_join(best_dir, _directory_files(files, by, first), [*by, "dir", "language"], ["path", "spec"])
    found = best_file.select(*key, "slot", "target").unionByName(
        listed.select(*key, F.lit("dir").alias("slot"), "target")
    )
    # a package file only counts when no named slot was found
    named = found.where(F.col("slot") != "fallback").select(*key).distinct()
    fallback = found.where(F.col("slot") == "fallback").join(named, key, "left_anti")
    return (
        found.where(F.col("slot") != "fallback").unionByName(fallback)
        .select(*key, "target")
        .distinct()
    )


def resolve_imports(
    imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, by: Sequence[str] = REPO,
    languages: Sequence[str] | None = None, first: bool = False,
) -> DataFrame:
    """As ``import_hits`` without the importing file itself."""
    return import_hits(imports, files, aliases, by, languages, first).where(F.col("target") != F.col("path"))


def link_imports(
    imports: DataFrame, resolved: DataFrame, hits: DataFrame | None = None, by: Sequence[str] = REPO
) -> DataFrame:
    """IMPORTS edges: to resolved files, else to the external package the import names.

    ``hits`` are those of ``import_hits``: an import that means only the importing file gives no edge, neither to the file
    nor to a package. Where it is left out, every import that is not in ``resolved`` counts as external. Relative imports
    that find nothing give no edge.
    """
    key = [*by, "path", "language", "spec"]
    named = (hits if hits is not None else resolved).select(*key).distinct()
    internal = resolved.select(*by, P.file_key(F.col("path")).alias("source"), P.file_key(F.col("target")).alias("target"))
    outside = imports.select(*key).distinct().join(named, key, "left_anti").select(
        *by, P.file_key(F.col("path")).alias("source"),
        P.package_key(P.top_level_package(F.col("spec"), F.col("language"))).alias("target"),
    ).where(F.col("target").isNotNull())
    return (
        internal.unionByName(outside).distinct()
        .withColumns({"type": F.lit("IMPORTS"), "weight": F.lit(1.0)})
    )
