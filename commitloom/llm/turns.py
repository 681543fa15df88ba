"""Conversation structure repair by a Viterbi decoder whose survivors coalesce.

The rows of a conversation, by turn, are edited at least cost until their roles read as an optional system row and
then pairs of user and assistant: keep (0), rerole to user or assistant (2), delete (3, required for blank and
duplicate rows), insert an empty user or assistant row (2); a truncated row that stays adds 1. Of equally cheap edit
scripts the ASCII-least of their initials is taken.

The decoder keeps one survivor per state of that pattern as a leaf of a backpointer tree whose nodes count their
children. A survivor no continuation can make best is dropped; edits leave the tree as soon as all survivors descend
from them, so memory follows the unresolved rows only. Ties are decided by the whole unresolved suffixes of both paths.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any size spreads over tasks. One
that lies within a task is decoded there. Of others each task makes blocks: a block is decoded from every state, which
gives a table of costs and scripts between states; a second decoder runs over those thin tables, and each block then
applies the script chosen for it. Only the digest of a repaired conversation has to read its blocks one after another.

Nulls: role and text read as one space (such a row is blank); turns that are null come first; rows without conv_id
form one conversation. Rows of one turn stand by role, then by the first 64 characters and a hash of the text. Repeated
rows are duplicates. A role counts by its first letter; an empty role fits nowhere. An empty table gives an empty
result; columns beyond conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.tables import in_batches, stored

#: Rows and bytes of text of one block of a conversation.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_MOVES = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: What is inserted at the end to reach an accepted state.
_CLOSING = ["", "II", "I", ""]
#: _EXCESS[t][s]: how much more the best continuation from t can cost than the one from s.
_EXCESS = [[0, 0, 2, 0], [4, 0, 2, 4], [5, 2, 0, 2], [3, 0, 2, 0]]

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _wanted(state: int) -> str:
    return "a" if state == _USER else "u"


def _inserted(state: int, edits: str) -> int:
    for _ in edits:
        state = _MOVES[state, _wanted(state)]
    return state


def _transitions(initial: str, forced: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, script) of one row, the best of each two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        for before in ("", "I", "II"):
            state = _inserted(start, before)
            options = [(state, 3, "D")]
            if not forced:
                options.append((_MOVES[state, _wanted(state)], 2 + truncated, "R"))
                if (state, initial) in _MOVES:
                    options.append((_MOVES[state, initial], int(truncated), "K"))
            for to, cost, edit in options:
                found = (cost + 2 * len(before), before + edit)
                best[start, to] = min(best.get((start, to), found), found)
    return [(a, b, cost, script) for (a, b), (cost, script) in sorted(best.items())]


_TABLES = {(i, f, t): _transitions(i, f, t) for i in ("s", "u", "a", "") for f in (False, True) for t in (False, True)}


def transitions(role: str, fault: str | None) -> list[tuple[int, int, int, str]]:
    initial = role[:1]
    return _TABLES[initial if initial in ("s", "u", "a") else "", fault in (BLANK, DUPLICATE), fault == TRUNCATED]


class _Node:
    """A step of a survivor; ``kids`` counts the steps that go on from it."""

    __slots__ = ("parent", "edit", "kids")

    def __init__(self, parent: _Node | None, edit):
        self.parent, self.edit, self.kids = parent, edit, 0


def _before(a: _Node, x, b: _Node, y) -> bool:
    """Whether edit ``x`` after ``a`` sorts before ``y`` after ``b``: the first step at which their paths part decides."""
    while a is not b:
        x, y, a, b = a.edit, b.edit, a.parent, b.parent
    return x < y


class Decoder:
    """Steps over transitions between the four states; ``emit`` takes each edit once it is certain."""

    def __init__(self, emit: Callable, start: int = _START):
        self.root = _Node(None, None)
        self.leaves: dict[int, tuple[int, _Node]] = {start: (0, self.root)}
        self.emit = emit

    def step(self, table: Iterable[tuple]) -> None:
        best: dict[int, tuple[int, _Node, object]] = {}
        for a, b, cost, edit in table:
            if a not in self.leaves:
                continue
            total, leaf = self.leaves[a]
            total += cost
            known = best.get(b)
            if known is None or total < known[0] or (total == known[0] and _before(leaf, edit, known[1], known[2])):
                best[b] = (total, leaf, edit)
        keep = {s: v for s, v in best.items() if all(v[0] <= w[0] + _EXCESS[t][s] for t, w in best.items())}
        old = [leaf for _, leaf in self.leaves.values()]
        self.leaves = {}
        for state, (total, leaf, edit) in keep.items():
            leaf.kids += 1
            self.leaves[state] = (total, _Node(leaf, edit))
        for leaf in old:
            while leaf.kids == 0 and leaf is not self.root:
                leaf = leaf.parent
                leaf.kids -= 1
        self._emit_shared()

    def _emit_shared(self) -> None:
        """Emit the edits between the root and the last step that all survivors share."""
        if self.root.kids != 1:
            return
        node, path = next(iter(self.leaves.values()))[1], []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edit)
            self.root = node
            if node.kids != 1:
                break
        self.root.parent = self.root.edit = None

    def suffix(self, state: int) -> list:
        """Edits of a survivor that were not emitted yet."""
        node, out = self.leaves[state][1], []
        while node is not self.root:
            out.append(node.edit)
            node = node.parent
        return out[::-1]

    def close(self) -> tuple[int, str]:
        """Cost of the best complete script and the edits that end it; emits what was left."""
        ends = [(cost + 2 * len(_CLOSING[s]), [*self.suffix(s), _CLOSING[s]], s) for s, (cost, _) in self.leaves.items()]
        cost, edits, state = min(ends)
        for edit in edits[:-1]:
            self.emit(edit)
        return cost, _CLOSING[state]


def apply_script(script: str, roles: list[str], texts: list[str], state: int = _START) -> list[str]:
    """Lines ``role:text`` that ``script`` makes of the rows, entered in ``state``."""
    names, out, at = {"u": "user", "a": "assistant"}, [], 0
    for edit in script:
        if edit == "D":
            at += 1
            continue
        role = _wanted(state)
        if edit == "I":
            out.append(names[role] + ":")
        else:
            out.append((roles[at] if edit == "K" else names[role]) + ":" + texts[at])
            role = roles[at][:1] if edit == "K" else role
            at += 1
        state = _MOVES[state, role]
    return out


def fault(role: str, text: str, first: bool) -> str | None:
    """The first fault of a row."""
    bare = text.rstrip(_SPACE)
    if not bare:
        return BLANK
    if not first:
        return DUPLICATE
    return None if bare[-1] in ".!?" else TRUNCATED


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of sentence ends, repeated or given to the user, by crc32 of ``conv_id:turn``.

    ``present`` is false for the one row that stands for a conversation's dropped rows.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("__kind"))
    kind = F.col("__kind")
    return rows.select(
        "conv_id", F.when(kind != 0, F.col("turn")).alias("turn"),
        F.when(kind == 4, F.lit("user")).when(kind != 0, F.col("role")).otherwise("").alias("role"),
        F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy")).drop("__copy")


class _Counter:
    """Counts over the rows of a conversation, or of a block of one."""

    def __init__(self) -> None:
        self.n = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = self.distinct = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn: int | None, role: str, found: str | None) -> None:
        if found:
            self.n[found] += 1
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.most:  # rows come by turn
            self.distinct += 1
            self.least, self.most = turn if self.least is None else self.least, turn

    def join(self, other: _Counter) -> None:
        """Count the rows of the block that follows."""
        for k, v in other.n.items():
            self.n[k] += v
        self.illegal += other.illegal
        if other.last is not None:
            if self.last is None:
                self.first = other.first
            elif self.last + other.first not in _LEGAL:
                self.illegal += 1
            self.last = other.last
        if other.least is not None:
            self.distinct += other.distinct - (other.least == self.most)
            self.least, self.most = other.least if self.least is None else self.least, other.most

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.distinct


def repair_rows(turns: list[int | None], roles: list[str], texts: list[str], firsts: Iterable[bool]) -> tuple[_Counter, int, str]:
    """Counts, cost and script of one whole conversation, whose rows come by turn."""
    counter, script = _Counter(), []
    decoder = Decoder(script.append)
    for turn, role, text, first in zip(turns, roles, texts, firsts):
        found = fault(role, text, first)
        counter.add(turn, role, found)
        decoder.step(transitions(role, found))
    cost, end = decoder.close()
    return counter, cost, "".join(script) + end


def first_of_each(roles: list[str], texts: list[str]) -> Iterator[bool]:
    seen: set[tuple[str, str]] = set()
    for pair in zip(roles, texts):
        yield pair not in seen
        seen.add(pair)


def between_states(turns: list, roles: list[str], texts: list[str], firsts: list[bool]) -> tuple[_Counter, list[int | None], list[str | None]]:
    """Counts, and cost and script of a block from each state to each (index 4 * from + to; None where none is useful)."""
    counter, tables = _Counter(), []
    for turn, role, text, first in zip(turns, roles, texts, firsts):
        found = fault(role, text, first)
        counter.add(turn, role, found)
        tables.append(transitions(role, found))
    costs, scripts = [None] * 16, [None] * 16
    for start in range(4):
        done: list[str] = []
        decoder = Decoder(done.append, start)
        for table in tables:
            decoder.step(table)
        for end, (cost, _) in decoder.leaves.items():
            costs[4 * start + end], scripts[4 * start + end] = cost, "".join([*done, *decoder.suffix(end)])
    return counter, costs, scripts


_BLOCK = "block long, turns array<long>, roles array<string>, texts array<string>"
_COUNTED = "blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns_seen long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations repaired, others as blocks, from the sorted rows of one range."""
    part, seq = TaskContext.get().partitionId() << 32, 0
    done: list[tuple] = []
    conv, opened, whole, size = None, False, False, 0
    held: tuple[list, list, list] = ([], [], [])

    def block() -> None:
        nonlocal seq, size, held, whole
        done.append((conv, *[None] * 8, [], part + seq, *held))
        seq, size, whole, held = seq + 1, 0, False, ([], [], [])

    def finish() -> None:
        nonlocal size, held
        turns, roles, texts = held
        counter, cost, script = repair_rows(turns, roles, texts, first_of_each(roles, texts))
        lines = apply_script(script, roles, texts)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        done.append((conv, counter.gaps(), *counter.n.values(), counter.illegal, cost, script, digest, lines, None, [], [], []))
        size, held = 0, ([], [], [])

    def out() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*done)]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], names=_NAMES)

    for batch in batches:
        for key, turn, role, text, present in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if not opened:
                conv, opened = key, True
            elif key != conv:
                # the first conversation of a range may have begun in an earlier one, so it is never whole
                if whole:
                    finish()
                elif held[0] or seq == 0:
                    block()
                conv, whole = key, True
            if present:
                if len(held[0]) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    block()
                for column, value in zip(held, (turn, role, text)):
                    column.append(value)
                size += len(text)
        if done:
            yield out()
    if opened:
        block()
        yield out()


_SCHEMA = RESULT + ", lines array<string>, " + _BLOCK
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_ARROW = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by ranges, in order; equal rows may part, so the number of a row among equals is the last key."""
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    keyed = in_batches(rows).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), "present")
    order = ["conv_id", "turn", "role", "head", "hash"]
    keyed = keyed.withColumns({"head": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(*order, "row").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "present")


def _with_tables(blocks: DataFrame) -> DataFrame:
    """Blocks with their counts and their costs and scripts between states."""
    rows = blocks.select("conv_id", "block", F.posexplode(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.sha2(F.concat_ws(":", F.length(x["roles"]).cast("string"), x["roles"], x["texts"]), 256))).alias("at", "same"))
    firsts = (
        rows.groupBy("conv_id", "same").agg(F.min(F.struct("block", "at")).alias("first"))
        .groupBy(F.col("first.block").alias("block")).agg(F.collect_list("first.at").alias("firsts")))
    joined = blocks.join(firsts, "block", "left").select("conv_id", "block", "turns", "roles", "texts", F.coalesce("firsts", F.array().cast("array<int>")).alias("firsts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns, roles, texts, firsts in zip(*(batch.column(c).to_pylist() for c in ("turns", "roles", "texts", "firsts"))):
                chosen = set(firsts)
                counter, costs, scripts = between_states(turns, roles, texts, [i in chosen for i in range(len(turns))])
                rows.append((*counter.n.values(), counter.illegal, counter.first, counter.last, counter.least, counter.most, counter.distinct, costs, scripts))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.string())]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            kept = ["conv_id", "block", "roles", "texts"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, *[x.split()[0] for x in _COUNTED.split(", ")], "costs", "scripts"])

    return joined.mapInArrow(decode, f"conv_id long, block long, roles array<string>, texts array<string>, {_COUNTED}, costs array<long>, scripts array<string>")


_LAST = (1 << 63) - 1


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states every block is entered and left in, and a closing row per conversation, from sorted block tables."""
    out: list[tuple] = []
    conv: object = None
    decoder: Decoder | None = None
    counter, entered = _Counter(), []

    def chosen(edit: tuple) -> None:
        out.append((conv, entered.pop(0), edit[1], edit[2], *[None] * 7))

    def close() -> None:
        cost, end = decoder.close()
        out.append((conv, _LAST, None, None, counter.gaps(), *counter.n.values(), counter.illegal, cost, end))

    def made() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out)]
        out.clear()
        types = [pa.int64()] * 10 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "block", "entry", "exit", *_COUNTS, "end"])

    for batch in batches:
        for row in batch.to_pylist():
            if decoder is None or row["conv_id"] != conv:
                if decoder is not None:
                    close()
                conv, counter, entered = row["conv_id"], _Counter(), []
                decoder = Decoder(chosen)
            own = _Counter()
            own.n = {BLANK: row["blank"], DUPLICATE: row["duplicate"], TRUNCATED: row["truncated"]}
            own.illegal, own.first, own.last = row["illegal"], row["first"], row["last"]
            own.least, own.most, own.distinct = row["least"], row["most"], row["turns_seen"]
            counter.join(own)
            entered.append(row["block"])
            decoder.step([(i // 4, i % 4, cost, (rank, i // 4, i % 4)) for i, (cost, rank) in enumerate(zip(row["costs"], row["ranks"])) if cost is not None])
        if out:
            yield made()
    if decoder is not None:
        close()
        yield made()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its blocks' scripts and lines, which come in order, the closing row last."""
    audit: list[str] = []
    digest, empty, state = hashlib.sha256(), True, _START

    def add(lines: Iterable[str]) -> None:
        nonlocal empty
        for line in lines:
            digest.update(line.encode() if empty else b"\n" + line.encode())
            empty = False

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["block"] != _LAST:
                audit.append(row["audit"])
                state = row["exit"]
                add(row["lines"])
                continue
            add(apply_script(row["end"], [], [], state))
            out.append((row["conv_id"], *(row[c] for c in _COUNTS), "".join(audit) + row["end"], digest.hexdigest()))
            audit, digest, empty, state = [], hashlib.sha256(), True, _START
        if out:
            columns = [list(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], names=_NAMES[:9])


def _scripted(tables: DataFrame, choices: DataFrame) -> DataFrame:
    """The script chosen for every block and the lines it leaves."""
    joined = tables.select("conv_id", "block", "roles", "texts", "scripts").join(choices.select("block", "entry", "exit"), "block")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scripts, lines = [], []
            for row in batch.to_pylist():
                script = row["scripts"][4 * row["entry"] + row["exit"]]
                scripts.append(script)
                lines.append(apply_script(script, row["roles"], row["texts"], row["entry"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), batch.column("exit"), pa.array(scripts, pa.string()), pa.array(lines, pa.list_(pa.string()))],
                names=["conv_id", "block", "exit", "audit", "lines"])

    return joined.mapInArrow(write, "conv_id long, block long, exit long, audit string, lines array<string>")


def _stages(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations repaired whole; scripts and lines of the blocks of all others; their closing rows."""
    found = stored(_dealt(rows).mapInArrow(_pieces, _SCHEMA))
    tables = stored(_with_tables(found.where(F.col("block").isNotNull()).select("conv_id", *[x.split()[0] for x in _BLOCK.split(", ")])))

    def rank(start: int):
        own = F.slice("scripts", 4 * start + 1, 4)
        return F.transform(own, lambda x: F.array_position(F.array_sort(F.filter(own, lambda y: y.isNotNull())), x))

    thin = tables.select("conv_id", "block", "costs", F.concat(*(rank(s) for s in range(4))).alias("ranks"), *[x.split()[0] for x in _COUNTED.split(", ")])
    chosen = thin.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        _choose, "conv_id long, block long, entry long, exit long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", end string")
    chosen = stored(chosen)
    blocks = _scripted(tables, chosen.where(F.col("block") != _LAST))
    return found.where(F.col("block").isNull()), blocks, chosen.where(F.col("block") == _LAST)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` may carry a column ``present``; a row for which it is false only names its conversation.
    """
    whole, blocks, ends = _stages(rows)
    parts = blocks.unionByName(ends.select("conv_id", "block", *_COUNTS, "end"), allowMissingColumns=True)
    folded = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_folded, RESULT)
    return whole.select(*folded.columns).unionByName(folded)


def repaired_lines(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, block, lines (``role:text``).

    A conversation has one row, or one per block in their order; its closing row, if any, is the last block's.
    """
    whole, blocks, ends = _stages(rows)
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("block", "exit")).alias("last"))
    close = F.udf(lambda end, state: apply_script(end, [], [], state), "array<string>")
    closing = ends.join(last, ends["conv_id"].eqNullSafe(last["conv_id"])).select(ends["conv_id"], ends["block"], close("end", "last.exit").alias("lines"))
    return whole.select("conv_id", F.lit(0).cast("long").alias("block"), "lines").unionByName(blocks.select("conv_id", "block", "lines")).unionByName(closing.where(F.size("lines") > 0))
