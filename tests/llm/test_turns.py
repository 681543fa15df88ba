"""Conversation repair against all edit scripts of small conversations and a plain table of whole scripts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from commitloom.llm import turns as T

LEGAL = re.compile(r"(s?(ua)+)?")


def _cost(script, rows):
    """Role initials and cost of a script; None where it breaks a rule."""
    best, at = [("", 0, [])], 0
    for edit in script:
        if edit == "I":
            best = [(i + r[0], c + 2, [*o, r + ":"]) for i, c, o in best for r in ("user", "assistant")]
            continue
        role, text, fault = rows[at]
        at += 1
        if edit == "D":
            best = [(i, c + 3, o) for i, c, o in best]
        elif fault in (T.BLANK, T.DUPLICATE):
            return []
        else:
            names = [role] if edit == "K" else ["user", "assistant"]
            extra = (2 if edit == "R" else 0) + (fault == T.TRUNCATED)
            best = [(i + (r[:1] or "?"), c + extra, [*o, r + ":" + text]) for i, c, o in best for r in names]
    return [x for x in best if LEGAL.fullmatch(x[0])]


def _every(rows):
    found = []
    gaps = ["", "I", "II"]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("KRD", repeat=len(rows)):
            script = "".join(a + b for a, b in zip(inserts, edits)) + inserts[-1]
            found += [(c, script, o) for _, c, o in _cost(script, rows)]
    return min(found, key=lambda x: x[:2])


def _table(rows):
    """Cost and whole script per state, kept as plain strings."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def insert(table):
        for _ in range(3):
            for s, (c, e) in list(table.items()):
                t = moves[s, "a" if s == 2 else "u"]
                table[t] = min(table.get(t, (c + 2, e + "I")), (c + 2, e + "I"))
        return table

    now = {0: (0, "")}
    for role, _, fault in rows:
        then = {}
        for s, (c, e) in insert(now).items():
            options = [(s, c + 3, e + "D")]
            if fault not in (T.BLANK, T.DUPLICATE):
                extra = fault == T.TRUNCATED
                options.append((moves[s, "a" if s == 2 else "u"], c + 2 + extra, e + "R"))
                if (s, role[:1]) in moves:
                    options.append((moves[s, role[:1]], c + extra, e + "K"))
            for t, *found in options:
                then[t] = min(then.get(t, tuple(found)), tuple(found))
        now = then
    return min(v for s, v in insert(now).items() if s in (0, 3))


def _plain(rows):
    """All results by conversation from (conv_id, turn, role, text) rows, the damage included."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = T.BLANK if not words else T.DUPLICATE if (role, text) in seen else T.TRUNCATED if words[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit = _table(marked)
        numbers = [t for t, *_ in own if t is not None]
        lines = next((o for _, c, o in _cost(audit, marked) if c == cost), []) if len(own) < 60 else None
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(sum(f == k for *_, f in marked) for k in (T.BLANK, T.DUPLICATE, T.TRUNCATED)),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
            None if lines is None else hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _marked(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", rng.choice([None, None, T.BLANK, T.DUPLICATE, T.TRUNCATED])) for i in range(n)]


def _decoded(rows):
    script, longest = [], 0
    decoder = T.Decoder(script.append)
    for role, _, fault in rows:
        decoder.step(T.transitions(role, fault))
        longest = max(longest, *(len(decoder.suffix(s)) for s in decoder.leaves))
    cost, end = decoder.close()
    return cost, "".join(script) + end, longest


def test_scripts_equal_the_best_of_all():
    rng = random.Random(1)
    for i in range(60):
        rows = _marked(rng, i % 4)
        cost, audit, lines = _every(rows)
        assert _decoded(rows)[:2] == (cost, audit) == _table(rows)
        assert T.apply_script(audit, [r[0] for r in rows], [r[1] for r in rows]) == lines


def test_long_conversations_keep_little_unresolved():
    rng = random.Random(2)
    for i in range(300):
        rows = _marked(rng, rng.randint(5, 60))
        assert _decoded(rows)[:2] == _table(rows)
    rows = _marked(rng, 20_000)
    cost, _, longest = _decoded(rows)
    assert longest < 200 and cost > 0
    assert _decoded([("user", "x", T.DUPLICATE)] * 5_000)[1:] == ("D" * 5_000, 1)


def test_blocks_joined_equal_the_whole():
    rng = random.Random(3)
    for _ in range(100):
        rows = _marked(rng, rng.randint(0, 40))
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 4)))
        chosen = []
        decoder = T.Decoder(chosen.append)
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            tables = [T.transitions(r, f) for r, _, f in rows[a:b]]
            found = []
            for start in range(4):
                done: list = []
                block = T.Decoder(done.append, start)
                for table in tables:
                    block.step(table)
                found += [(start, end, c, "".join([*done, *block.suffix(end)])) for end, (c, _) in block.leaves.items()]
            decoder.step(found)
        cost, end = decoder.close()
        assert (cost, "".join(chosen) + end) == _table(rows)


def _conversations(rng):
    out = []
    for conv in [None, *range(60)]:
        n = 300 if conv == 7 else rng.randint(1, 9)
        for turn in range(n):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.3 else role
            text = rng.choice(["Yes.", "No!", "", "  \t", None, "so what", f"word {rng.random()}.", f"open {turn}"])
            out.append((conv, turn if rng.random() < 0.95 else None, role if rng.random() < 0.97 else rng.choice([None, "", "tool", "unknown"]), text))
    return [*out, out[0], out[5], (99, 3, None, None), (None, None, None, None)]


@pytest.mark.parametrize(("parts", "block"), [(1, 512), (5, 512), (9, 4)])
def test_repair_equals_a_plain_computation(spark, monkeypatch, parts, block):
    rows = _conversations(random.Random(4))
    monkeypatch.setattr(T, "BLOCK_ROWS", block)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        given = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, lines int")
        got = {r.conv_id: tuple(r)[1:] for r in T.repair(T.damaged(given)).collect()}
        lines: dict = {}
        for r in sorted(T.repaired_lines(T.damaged(given)).collect(), key=lambda r: r.block):
            lines.setdefault(r.conv_id, []).extend(r.lines)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = _plain(rows)
    assert got.keys() == want.keys()
    for conv, row in want.items():
        assert got[conv][:7] == row[:7], conv
        assert row[7] is None or got[conv][7] == row[7], conv
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == got[conv][7]


def test_repair_of_an_empty_table(spark):
    given = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.repair(T.damaged(given)).count() == 0
