"""Mixing where doc_ids are missing or repeat: every row is drawn for itself, and plan and copies agree."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from commitloom.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, copies string"


def _rows(rng):
    out = []
    for i in range(900):
        text = " ".join("w%d" % rng.randrange(50) for _ in range(rng.randint(1, 30)))
        out.append((None if i % 2 else i, text, rng.choice(["en", None]), rng.choice(["a", "b", "c", None]), 0, i, "x"))
    out += [(None, "same words in many rows", "en", "a", 0, 1, "x")] * 150 + [(7, "same words again", "en", "b", 0, j % 5, "y") for j in range(120)]
    return out + [(None, None, None, "b", 0, 1, "x"), (None, "", None, None, 0, 1, "x")]


def test_missing_and_repeated_ids_are_drawn_one_by_one(spark):
    rows = _rows(random.Random(6))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan = M.mixed(docs).collect()
    assert len(plan) == len(rows)
    targets, taken, largest = {}, Counter(), Counter()
    for r in plan:
        targets[r.source_size] = r.target
        taken[r.source_size] += r.taken
        largest[r.source_size] = max(largest[r.source_size], r.size)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    assert len(targets) == 4
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)
    assert sorted(map(str, plan)) == sorted(map(str, M.mixed(docs).collect()))
    mixed = M.mix(docs).collect()
    words = Counter()
    for r in mixed:
        words[r.source] += len((r.text or "").split())
    sizes = {s: sum(len((x[1] or "").split()) for x in rows if x[3] == s) for s in ("a", "b", "c", None)}
    assert {words[s] for s in words} == {taken[sizes[s]] for s in words} and len(mixed) == sum(r.copies for r in plan)
    given, made = Counter(tuple(r) for r in rows), Counter(tuple(r) for r in mixed)
    assert set(made) <= set(given) and all(made[r] <= 3 * given[r] for r in made)
    assert M.mix(docs).columns == docs.columns and M.mix(docs.where(F.lit(False))).count() == 0
