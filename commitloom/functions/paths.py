"""Column functions over repository paths, keys and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitloom import fixed


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(basename(path)), r"\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    """Language by extension, else by well-known file name; null for what is never indexed."""
    base = basename(path)
    excluded = (
        base.isin(fixed.IGNORED_FILES)
        | base.rlike(r"\.min\.(js|css)$")
        | base.rlike(r"\.(map|snap)$")
    )
    named = F.regexp_replace(F.lower(base), r"\.[^.]*$", "")
    found = F.coalesce(
        F.try_element_at(_lookup(fixed.LANGUAGE_BY_EXTENSION), extension(path)),
        F.try_element_at(_lookup(fixed.LANGUAGE_BY_NAME), named),
    )
    return F.when(~excluded, found)


def is_code(language: Column) -> Column:
    return F.coalesce(language.isin(fixed.CODE_LANGUAGES), F.lit(False))


def language_family(language: Column) -> Column:
    return (
        F.when(language.isin("typescript", "javascript"), "js")
        .when(language.isin("c", "cpp"), "c")
        .otherwise(language)
    )


def is_test_path(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(p) for p in fixed.TEST_PATH_PATTERNS])


def is_entry_point(path: Column) -> Column:
    return path.rlike(fixed.ENTRY_POINT_PATTERN)


def is_special_function(name: Column) -> Column:
    return name.rlike(fixed.SPECIAL_FUNCTION_PATTERN)


def module_of(path: Column) -> Column:
    """First directory, or the first two where the first is a conventional source root."""
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    return (
        F.when(F.size(parts) == 1, "(root)")
        .when(
            first.isin(fixed.CONVENTIONAL_ROOTS) & (F.size(parts) > 2),
            F.concat_ws("/", first, F.get(parts, F.lit(1))),
        )
        .otherwise(first)
    )


def summary_dir(path: Column) -> Column:
    """First two segments without a trailing file name; ``(root)`` at the top level."""
    head = F.substring_index(path, "/", 2)
    return F.when(path.contains("/"), F.regexp_replace(head, r"/[^/]*\.[^/]*$", "")).otherwise(
        "(root)"
    )


def normalize_path(path: Column) -> Column:
    """Drop empty and ``.`` segments and let ``..`` remove the segment before it."""
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda acc, seg: F.when(seg.isin("", "."), acc)
        .when(
            seg == "..",
            F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
                empty
            ),
        )
        .otherwise(F.concat(acc, F.array(seg))),
    )
    return F.array_join(kept, "/")


def join_path(base: Column, rest: Column) -> Column:
    return normalize_path(F.concat_ws("/", base, rest))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def parent_dirs(path: Column) -> Column:
    """Every ancestor directory of a path, the repository root as ``''``."""
    parts = F.split(path, "/")
    return F.concat(
        F.array(F.lit("")),
        F.when(
            F.size(parts) > 1,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def path_suffixes(path: Column) -> Column:
    """Every segment-aligned suffix of a path, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"),
    )


def file_key(path: Column) -> Column:
    return F.concat(F.lit("f:"), path)


def entity_key(path: Column, qualified_name: Column) -> Column:
    return F.concat(F.lit("e:"), path, F.lit("#"), qualified_name)


def package_key(name: Column) -> Column:
    return F.concat(F.lit("p:"), name)


def node_label(kind: Column, name: Column, qualified_name: Column, path: Column) -> Column:
    return (
        F.when(kind == "entity", F.coalesce(qualified_name, name))
        .when(kind == "file", path)
        .otherwise(name)
    )


def describe_node(
    kind: Column, name: Column, qualified_name: Column, path: Column, type_: Column, line: Column
) -> Column:
    return (
        F.when(kind == "file", F.concat(F.lit("file "), path))
        .when(kind == "package", F.concat(F.lit("package "), name))
        .otherwise(
            F.concat(
                type_, F.lit(" "), F.coalesce(qualified_name, name), F.lit(" ("), path, F.lit(":"),
                line.cast("string"), F.lit(")"),
            )
        )
    )


def is_identifier_like(token: Column) -> Column:
    """Dotted, snake_case, camelCase or capitalised tokens name symbols; plain words do not."""
    return token.rlike(r"[._]|^[A-Z]|^.+[A-Z]")


def top_level_package(spec: Column, language: Column) -> Column:
    """Name of the external package an unresolved import refers to, per language."""
    plain = F.regexp_replace(spec, "^node:", "")
    scoped = F.when(plain.startswith("@"), F.substring_index(plain, "/", 2)).otherwise(
        F.substring_index(plain, "/", 1)
    )
    script = F.when(
        ~spec.rlike(r"^[./]"),
        F.when(scoped.isin(fixed.NODE_BUILTINS), F.concat(F.lit("node:"), scoped)).otherwise(scoped),
    )
    jvm = F.regexp_replace(F.regexp_replace(spec, r"\{.*\}$", ""), r"\.$", "")
    include = F.regexp_replace(F.substring_index(F.regexp_replace(spec, "^<", ""), "/", 1), r"\.(h|hpp)$", "")
    crate = F.regexp_extract(F.regexp_replace(spec, r"\{.*$", ""), r"^(?:::)*([^:]+)", 1)
    php_parts = F.filter(F.split(spec, r"\\"), lambda s: s != "")
    dart_pub = F.substring_index(F.regexp_replace(spec, "^package:", ""), "/", 1)
    return (
        F.when(language.isin("typescript", "javascript"), script)
        .when(
            language == "python",
            F.when(~spec.startswith("."), F.substring_index(spec, ".", 1)),
        )
        .when(language.isin("java", "kotlin", "scala"), F.substring_index(jvm, ".", 2))
        .when(language == "csharp", F.substring_index(spec, ".", 2))
        .when(
            language == "go",
            F.when(spec.contains("."), F.substring_index(spec, "/", 3)).otherwise(
                F.concat(F.lit("std:"), F.substring_index(spec, "/", 1))
            ),
        )
        .when(
            language == "rust",
            F.when(~spec.rlike(r"^(mod:|(::)*(crate|super|self)(::|$|\{))"), F.coalesce(F.nullif(crate, F.lit("")), spec)),
        )
        .when(language.isin("c", "cpp"), include)
        .when(language == "ruby", F.when(~spec.startswith("."), F.substring_index(spec, "/", 1)))
        .when(
            language == "php",
            F.when(spec.contains("\\"), F.array_join(F.slice(php_parts, 1, 2), "\\")),
        )
        .when(
            language == "dart",
            F.when(spec.startswith("dart:"), spec).when(spec.startswith("package:"), dart_pub),
        )
        .when(language == "swift", F.substring_index(spec, ".", 1))
    )
