"""Repeated byte strings by sorted suffixes: deep-shallow sorting within shards of the corpus.

Texts are UTF-8 bytes. Every 200-byte window belongs to its anchor; the windows of a recurring anchor form a
slice of the text, sent, packed, to the shard of the anchor (equal slices of a batch once). A slice that
stands in two places recurs as a whole. For the others the shard sorts the suffixes that begin at the
anchor, and the reversed prefixes that end there, by multikey quicksort to a shallow depth and blind tries
below it. Walking the common prefixes of the sorted suffixes from long to short, sets of slices that agree to the right
are merged, smaller into larger, in order of their left sides; neighbours in that order agree longest, so
each merge tells exactly which windows recur. No two slices are compared but such neighbours.

Rows are written once with a batch and a number in it; every scan reads these names from the rows, so it does not
matter where a scan cuts its own Arrow batches.

A byte is removed when a window that also starts elsewhere covers it, whichever stands first. Null and
empty texts have no bytes; texts under 200 bytes lose none. Each row is a place of its own: rows that repeat
a text of 200 bytes or more lose all of it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.hashing import LETTER, runs
from commitloom.llm.repeats import anchor_hashes, anchored, batch_number, pack, recurring_filter, recurs, unpack
from commitloom.llm.tables import stored, texts, width

WINDOW = 200
GRAM = 32
#: Letters sorted by multikey quicksort before blind tries take over.
SHALLOW = 12
SHARD_ROWS = 6_000


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Branching places and letters only; an insertion compares with one string it holds."""

    def __init__(self, strings: Sequence[bytes]):
        self.strings = strings
        self.root: list | None = None  # a leaf [-1, members]; a branch [place, {letter: child}]

    @staticmethod
    def _letter(text: bytes, place: int) -> int:
        return text[place] if place < len(text) else -1

    def insert(self, index: int) -> None:
        text = self.strings[index]
        if self.root is None:
            self.root = [-1, [index]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(self._letter(text, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        shared = common(text, other)
        if shared == len(text) == len(other):
            node[1].append(index)
            return
        node, above = self.root, None
        while 0 <= node[0] < shared:
            above, node = node, node[1][self._letter(text, node[0])]
        if node[0] == shared:
            node[1][self._letter(text, shared)] = [-1, [index]]
            return
        branch = [shared, {self._letter(other, shared): node, self._letter(text, shared): [-1, [index]]}]
        if above is None:
            self.root = branch
        else:
            above[1][self._letter(text, above[0])] = branch

    def walk(self, first: int, out: list[tuple[int, int]]) -> None:
        """Members in order, each with its common prefix with the one before; ``first`` is that of the first."""
        stack = [(self.root, first)]
        while stack:
            node, before = stack.pop()
            if node[0] < 0:
                size = len(self.strings[node[1][0]])
                out += [(i, before if k == 0 else size) for k, i in enumerate(node[1])]
                continue
            letters = sorted(node[1])
            stack += [(node[1][c], before if c == letters[0] else node[0]) for c in reversed(letters)]


def deep_shallow(strings: Sequence[bytes]) -> list[tuple[int, int]]:
    """Indices in sorted order, each with its common prefix with the one before (0 for the first)."""
    out: list[tuple[int, int]] = []
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        members, depth, before = stack.pop()
        if len(members) == 1:
            out.append((members[0], before))
            continue
        if depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in members:
                trie.insert(i)
            trie.walk(before, out)
            continue
        letters = [strings[i][depth] if depth < len(strings[i]) else -1 for i in members]
        pivot = letters[len(letters) // 2]
        less = [i for i, c in zip(members, letters) if c < pivot]
        same = [i for i, c in zip(members, letters) if c == pivot]
        more = [i for i, c in zip(members, letters) if c > pivot]
        if more:
            stack.append((more, depth, depth))
        if pivot < 0:
            ended = [(i, before if k == 0 and not less else depth) for k, i in enumerate(same)]
            if less:
                raise AssertionError("no letter is below the end")
            out += ended
        else:
            stack.append((same, depth + 1, depth if less else before))
            if less:
                stack.append((less, depth, before))
    return out


def recurring_windows(slices: list[bytes], lefts: list[int], asked: list[bool]) -> list[list[tuple[int, int]]]:
    """For slices of one anchor (at ``lefts`` in each): byte ranges of the windows that stand in another slice too.

    Only slices marked in ``asked`` get ranges.
    """
    n = len(slices)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    rights = [s[k:] for s, k in zip(slices, lefts)]
    before = [s[:k][::-1] for s, k in zip(slices, lefts)]
    rank = [0] * n
    at_rank = [i for i, _ in deep_shallow(before)]
    for r, i in enumerate(at_rank):
        rank[i] = r
    order = deep_shallow(rights)
    parent = list(range(n))
    sets: list[list[int] | None] = [[rank[i]] for i in range(n)]

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def note(x: int, y: int, right: int) -> None:
        if not (asked[x] or asked[y]):
            return
        left = common(before[x], before[y])
        # windows that begin l bytes before the anchor, WINDOW - right <= l <= left
        low = max(WINDOW - right, 0)
        if low > left:
            return
        for i in (x, y):
            if asked[i]:
                begin, end = lefts[i] - left, lefts[i] - low + WINDOW
                begin, end = max(begin, 0), min(end, len(slices[i]))
                if end - begin >= WINDOW:
                    found[i].append((begin, end))

    joins = sorted(((shared, k) for k, (_, shared) in enumerate(order) if k), reverse=True)
    for shared, k in joins:
        a, b = top(order[k - 1][0]), top(order[k][0])
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for r in sets[b]:
            at = bisect_left(large, r)
            if at:
                note(at_rank[r], at_rank[large[at - 1]], shared)
            if at < len(large):
                note(at_rank[r], at_rank[large[at]], shared)
            large.insert(at, r)
        sets[b] = None
        parent[b] = a
    return found


def _bytes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, data, offsets in runs(column):
        yield LETTER[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _slices(column: pa.Array, bitmap: np.ndarray) -> dict[bytes, list]:
    """Slices of recurring anchors of a batch: bytes -> [anchor, its place in the slice, row, start, row, start ..]."""
    out: dict[bytes, list] = {}
    for first, data, offsets in runs(column):
        raw = data.tobytes()
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        starts, places, grams = anchored(LETTER[data], owner, WINDOW, GRAM)
        if not len(starts):
            continue
        row = owner[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (places[1:] != places[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(starts)) - 1
        hit = recurs(bitmap, grams[places[at]])
        at, last = at[hit], last[hit]
        begin, end, place, row = starts[at], starts[last] + WINDOW, places[at], row[at]
        anchor = grams[place].view(np.int64)
        for a, b, p, h, r, o in zip(begin.tolist(), end.tolist(), place.tolist(), anchor.tolist(), row.tolist(), offsets[row].tolist()):
            known = out.get(key := raw[a:b])
            if known is None:
                out[key] = [h, p - a, r + first, a - o]
            else:
                known += (r + first, a - o)
    return out


def _named(docs: DataFrame) -> DataFrame:
    """Every row with the name of its batch and its number there, as stored columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for position, batch in enumerate(batches):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch_number(position))), pa.array(np.arange(n, dtype=np.int32)), batch.column("doc_id"), batch.column("text")],
                names=["batch", "row", "doc_id", "text"])

    return stored(docs.mapInArrow(run, "batch long, row int, doc_id long, text string"))


def _sent(named: DataFrame, shared: Broadcast, shards: int) -> DataFrame:
    """(shard, batch, blob): the distinct slices of each batch, whether they stand there twice, else where.

    A batch that a scan hands over in parts is sent in parts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("batch").to_numpy()
            rows = batch.column("row").to_numpy()
            bounds = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for begin, end in zip(bounds, bounds[1:]):
                if begin == end:
                    continue
                own = rows[begin:end].tolist()
                parts: dict[int, list] = {}
                for piece, (anchor, left, at, start, *more) in _slices(batch.column("text").slice(begin, end - begin), shared.value).items():
                    parts.setdefault(anchor % shards, []).append((piece, anchor, left, -1 if more else own[at], start))
                blobs = [pack(*zip(*found)) for found in parts.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(parts), pa.int32()), pa.array([int(names[begin])] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "batch", "blob"])

    return named.select("batch", "row", "text").mapInArrow(run, "shard int, batch long, blob binary")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard: for each batch the byte ranges (row, start, length) of windows that recur in other batches."""
    slices: dict[bytes, list] = {}
    for batch in batches:
        for name, blob in zip(batch.column("batch").to_pylist(), batch.column("blob")):
            for piece, anchor, left, row, start in zip(*unpack(blob.as_py())):
                known = slices.get(piece)
                if known is None:
                    slices[piece] = [anchor, left, row < 0, (name, row, start)]
                else:
                    known[2] = True
                    known.append((name, row, start))
    out: dict[int, list] = {}
    groups: dict[int, list[bytes]] = {}
    for piece, (anchor, _, many, *places) in slices.items():
        groups.setdefault(anchor, []).append(piece)
        if many:
            for name, row, start in places:
                if row >= 0:
                    out.setdefault(name, []).append((row, start, len(piece)))
    for pieces in groups.values():
        rows = [slices[p] for p in pieces]
        asked = [not r[2] for r in rows]
        if len(pieces) > 1 and any(asked):
            for (_, _, _, (name, row, start), *_), ranges in zip(rows, recurring_windows(pieces, [r[1] for r in rows], asked)):
                for a, b in ranges:
                    out.setdefault(name, []).append((row, start + a, b - a))
    if out:
        blobs = [pack(np.array(rows, np.int32)) for rows in out.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(blobs, pa.binary())], names=["batch", "blob"])


def _removed(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted by batch with the ranges before the documents; one batch of documents is held at a time."""
    name, rows, blobs = None, [], []

    def out() -> pa.RecordBatch:
        column = pa.array([r[1] for r in rows], pa.large_string())
        ranges = [unpack(b)[0] for b in blobs]
        again = [(r, s, len(piece)) for piece, known in _slices(column, bitmap).items() if len(known) > 4 for r, s in zip(known[2::2], known[3::2])]
        table = np.concatenate([*ranges, np.array(again, np.int32).reshape(-1, 3)])
        table = table[np.argsort(table[:, 0], kind="stable")]
        bounds = np.searchsorted(table[:, 0], np.arange(len(rows) + 1))
        result = []
        for i, (doc_id, text) in enumerate(rows):
            data = np.frombuffer(text.encode(), np.uint8)
            change = np.zeros(len(data) + 1, np.int32)
            own = table[bounds[i]:bounds[i + 1]]
            np.add.at(change, own[:, 1], 1)
            np.add.at(change, own[:, 1] + own[:, 2], -1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            result.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in result], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    for batch in batches:
        for at, blob, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("batch", "blob", "doc_id", "text"))):
            if at != name:
                if rows:
                    yield out()
                name, rows, blobs = at, [], []
            if blob is not None:
                blobs.append(blob)
            else:
                rows.append((doc_id, text))
    if rows:
        yield out()


def repeats_removed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    given = _named(texts(docs))
    shards = width(given, SHARD_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(recurring_filter(anchor_hashes(given, _bytes, WINDOW, GRAM)))
    found = _sent(given, shared, shards).repartition(shards, "shard").mapInArrow(_found, "batch long, blob binary")
    both = given.withColumn("blob", F.lit(None).cast("binary")).unionByName(found, allowMissingColumns=True)
    return (
        both.repartition(shards, "batch").sortWithinPartitions("batch", F.col("row").asc_nulls_first())
        .mapInArrow(lambda batches: _removed(batches, shared.value), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
