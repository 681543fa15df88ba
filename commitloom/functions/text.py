"""Column functions over text: tokens, questions, hashes, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom import fixed


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n"))


def content_hash(content: Column) -> Column:
    return F.sha1(content)


def chunk_hash(path: Column, content: Column) -> Column:
    return F.sha1(F.concat(path, F.lit("\n"), content))


def text_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start``..``end`` (1-based, inclusive) of a text."""
    lines = F.split(content, "\n")
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n")


def normalize_question(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}]+", " "))


def _identifier_parts(word: Column) -> Column:
    spaced = F.regexp_replace(word, r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.split(spaced, r"[\s_]+")


def tokenize(text: Column) -> Column:
    """Lower-cased identifier words plus their camelCase / snake_case parts, stop words removed."""
    stop = F.array(*[F.lit(w) for w in sorted(set(fixed.STOP_WORDS))])
    words = F.regexp_extract_all(text, F.lit(fixed.SEARCH_WORD_PATTERN), F.lit(0))
    terms = F.flatten(
        F.transform(
            words,
            # a word has parts only where one of these stands, which is quicker to tell than to cut it
            lambda w: F.when(w.rlike(r"[a-z0-9][A-Z]|[A-Z]{2}[a-z]|[\s_]"), F.concat(F.array(w), _identifier_parts(w))).otherwise(F.array(w)),
        )
    )
    lowered = F.transform(terms, F.lower)
    return F.filter(lowered, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def term_rows(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, term): every distinct token of a text. The explode is an outer one: a plain one makes the optimizer test the array's
    size below every earlier step, which cuts the text several times and before it is dealt to the tasks."""
    terms = F.explode_outer(F.array_distinct(tokenize(F.col(text)))).alias("term")
    return rows.select(*keep, terms).where(F.col("term").isNotNull())


def mention_identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.IDENTIFIER_MENTION_PATTERN), F.lit(0))


def mention_paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.PATH_MENTION_PATTERN), F.lit(0))


def chunk_embedding_text(
    path: Column, start: Column, end: Column, type_: Column, name: Column, content: Column
) -> Column:
    """Header line with path, line range and entity, a blank line, then the chunk."""
    head = F.concat(
        F.lit("File: "), path, F.lit(" (lines "), start.cast("string"), F.lit("-"),
        end.cast("string"), F.lit(")"),
    )
    entity = F.when(name.isNotNull(), F.concat(F.lit("\n"), type_, F.lit(" "), name)).otherwise("")
    return F.concat(head, entity, F.lit("\n\n"), content)
