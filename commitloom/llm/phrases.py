"""Repeated passages: confirmed recurring phrases, sharded Aho-Corasick automata, and a stream of all texts.

Every window of 20 words that may recur is sent, packed, to the shard of its hash; of equal windows in one
batch only the first is sent. The shard confirms windows that stand in two places or more and finds the
first of all places. Windows that follow each other in a batch and in the first document form a phrase.
Each batch of documents gets an automaton of its own phrases (pyahocorasick over word numbers); all its
documents are streamed through it, and every occurrence other than the phrase's first place is removed.

Words are runs of bytes other than space and control 9-13. First means smaller doc_id (null before all),
then text hash, then earlier start. Rows that repeat doc_id and text are the same document. Null and empty
texts have no words; texts under 20 words lose none.

An empty table gives an empty result; repeated rows are handled one by one, as rows of equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from commitloom.llm.hashing import LETTER, range_hashes, runs, window_hashes, word_spans
from commitloom.llm.repeats import anchor_hashes, anchored, batch_number, id_numbers, pack, recurring_filter, recurs, text_hashes, unpack
from commitloom.llm.tables import texts, width

WINDOW = 20
GRAM = 6
#: Documents whose windows one shard confirms.
SHARD_ROWS = 6_000


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, data, offsets in runs(column):
        starts, ends, owner = word_spans(data, offsets)
        yield range_hashes(LETTER[data], starts, ends), owner


def _candidates(column: pa.Array, bitmap: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a batch: window hash, row and word position of every window with a recurring anchor; text hashes."""
    parts, hashes = [], []
    for first, data, offsets in runs(column):
        starts, ends, owner = word_spans(data, offsets)
        tokens = range_hashes(LETTER[data], starts, ends)
        hashes.append(text_hashes(data, offsets, LETTER))
        begin, places, grams = anchored(tokens, owner, WINDOW, GRAM)
        hit = recurs(bitmap, grams[places])
        begin = begin[hit]
        row = owner[begin]
        parts.append((window_hashes(tokens, WINDOW)[begin], row + first, begin - np.searchsorted(owner, row)))
    return (*(np.concatenate([p[k] for p in parts]) for k in range(3)), np.concatenate(hashes))


def _grouped(ids: np.ndarray, window: np.ndarray, row: np.ndarray, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal windows together, the batch's first one ahead, and the start of each group."""
    order = np.lexsort((place, text[row], ids[row], window))
    new = np.ones(len(order), bool)
    new[1:] = window[order][1:] != window[order][:-1]
    return order, np.flatnonzero(new)


def _sent(docs: DataFrame, shared: Broadcast, shards: int) -> DataFrame:
    """(shard, batch, blob): packed windows of each batch, the first of equal ones only; ``shared`` holds the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            ids = id_numbers(batch.column("doc_id"))
            window, row, place, text = _candidates(batch.column("text"), shared.value)
            order, at = _grouped(ids, window, row, place, text)
            window, row, place = window[order[at]], row[order[at]], place[order[at]]
            shard = (window % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((place, row, shard))
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(bounds)):
                take = order[bounds[s]:bounds[s + 1]]
                own, local = np.unique(row[take], return_inverse=True)
                rows.append((s, pack(window[take], own.astype(np.int32), local.astype(np.int32), place[take].astype(np.int32), ids[own], text[own])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(r[0]) for r in rows], pa.int32()), pa.array([batch_number(number)] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["shard", "batch", "blob"])

    return docs.mapInArrow(run, "shard int, batch long, blob binary")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard: for each batch its windows that stand somewhere before, each with the first place of all."""
    names, blobs = [], []
    for batch in batches:
        names += batch.column("batch").to_pylist()
        blobs += [unpack(b.as_py()) for b in batch.column("blob")]
    if not blobs:
        return
    sizes = [len(b[0]) for b in blobs]
    source = np.repeat(np.arange(len(blobs)), sizes)
    window, place = np.concatenate([b[0] for b in blobs]), np.concatenate([b[3] for b in blobs])
    row = np.concatenate([b[1][b[2]] for b in blobs])
    ids, text = np.concatenate([b[4][b[2]] for b in blobs]), np.concatenate([b[5][b[2]] for b in blobs])
    del blobs
    order = np.lexsort((place, text, ids, window))
    new = np.ones(len(order), bool)
    new[1:] = window[order][1:] != window[order][:-1]
    group = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)][group]
    same = (ids[order] == ids[first]) & (text[order] == text[first]) & (place[order] == place[first])
    mine, first = order[~same], first[~same]
    by = np.argsort(source[mine], kind="stable")
    mine, first = mine[by], first[by]
    bounds = np.searchsorted(source[mine], np.arange(len(sizes) + 1))
    rows = []
    for s in np.flatnonzero(np.diff(bounds)):
        m, f = mine[bounds[s]:bounds[s + 1]], first[bounds[s]:bounds[s + 1]]
        back = np.lexsort((place[m], row[m]))
        m, f = m[back], f[back]
        rows.append((names[s], pack(row[m], place[m], ids[f], text[f], place[f] - place[m])))
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["batch", "blob"])


def _documents(docs: DataFrame) -> DataFrame:
    """Every row with the name of its batch and its number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch_number(number))), pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, pa.binary()), batch.column("doc_id"), batch.column("text")],
                names=["batch", "row", "blob", "doc_id", "text"])

    return docs.mapInArrow(run, "batch long, row int, blob binary, doc_id long, text string")


def _passages(blobs: list[bytes], ids: np.ndarray, candidates: tuple[np.ndarray, ...]) -> list[tuple[int, int, int, tuple]]:
    """(row, start, words, first place) of the phrases of a batch: runs of windows that stand before.

    A window equal to one of its own batch has the first place the shard found for that one, or that one.
    """
    window, row, place, text = candidates
    order, at = _grouped(ids, window, row, place, text)
    first = np.repeat(order[at], np.diff(np.append(at, len(order))))
    firsts = [ids[row[first]], text[row[first]], place[first]]
    if blobs:
        told = [np.concatenate(c) for c in zip(*map(unpack, blobs))]
        key = told[0].astype(np.int64) << 32 | told[1]
        by = np.argsort(key)
        wanted = row[first].astype(np.int64) << 32 | place[first]
        found = by[np.minimum(np.searchsorted(key[by], wanted), len(key) - 1)]
        hit = key[found] == wanted
        for k, values in enumerate((told[2], told[3], told[4] + told[1])):
            firsts[k] = np.where(hit, values[found], firsts[k])
    later = (ids[row[order]] != firsts[0]) | (text[row[order]] != firsts[1]) | (place[order] != firsts[2])
    by = np.flatnonzero(later)
    by = by[np.lexsort((place[order[by]], row[order[by]]))]
    if not len(by):
        return []
    row, place = row[order[by]], place[order[by]]
    ids, text, ahead = firsts[0][by], firsts[1][by], firsts[2][by] - place
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (ids[1:] != ids[:-1]) | (text[1:] != text[:-1]) | (ahead[1:] != ahead[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(row))) + WINDOW - 1
    return [(int(row[i]), int(place[i]), int(n), (int(ids[i]), int(text[i]), int(place[i] + ahead[i]))) for i, n in zip(at, length)]


def _streamed(rows: list[tuple], blobs: list[bytes], bitmap: np.ndarray) -> Iterator[tuple]:
    """Streams the documents of one batch through the automaton of its phrases."""
    cut: dict[int, list[bytes]] = {}
    hashes: dict[int, int] = {}
    ids: dict[int, int] = {}
    column = pa.array([r[2] for r in rows], pa.large_string())
    found = _passages(blobs, id_numbers(pa.array([r[1] for r in rows], pa.int64())), _candidates(column, bitmap))
    for first, data, offsets in runs(column):
        raw = data.tobytes()
        starts, ends, owner = word_spans(data, offsets)
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        text = text_hashes(data, offsets, LETTER)
        s, e = starts.tolist(), ends.tolist()
        for i in range(len(offsets) - 1):
            number = rows[first + i][0]
            cut[number] = [raw[a:b] for a, b in zip(s[bounds[i]:bounds[i + 1]], e[bounds[i]:bounds[i + 1]])]
            hashes[number] = int(text[i])
            ids[number] = -(1 << 63) if rows[first + i][1] is None else rows[first + i][1]
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for row, start, n, place in found:
        key = tuple([numbers.setdefault(w, len(numbers) + 1) for w in cut[row][start:start + n]])
        if not automaton.exists(key):
            automaton.add_word(key, (n, place))
    if found:
        automaton.make_automaton()
    for number, doc_id, _ in rows:
        words = cut[number]
        gone = np.zeros(len(words) + 1, np.int32)
        if found and len(words) >= WINDOW:
            for end, (n, place) in automaton.iter(tuple([numbers.get(w, 0) for w in words])):
                start = end - n + 1
                if (ids[number], hashes[number], start) != place:
                    gone[start] += 1
                    gone[end + 1] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        yield doc_id, words, covered


def _removed(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted by batch with the phrases before the documents; one batch of documents is held at a time."""
    name, rows, blobs = None, [], []

    def out() -> pa.RecordBatch:
        result = [(d, len(w), int(c.sum()), hashlib.sha256(b" ".join([x for x, g in zip(w, c.tolist()) if not g])).hexdigest()) for d, w, c in _streamed(rows, blobs, bitmap)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in result], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    for batch in batches:
        for at, row, blob, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("batch", "row", "blob", "doc_id", "text"))):
            if at != name:
                if rows:
                    yield out()
                name, rows, blobs = at, [], []
            if blob is not None:
                blobs.append(blob)
            else:
                rows.append((row, doc_id, text))
    if rows:
        yield out()


def passages_removed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space)."""
    given = texts(docs)
    shards = width(given, SHARD_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(recurring_filter(anchor_hashes(given, _words, WINDOW, GRAM)))
    confirmed = _sent(given, shared, shards).repartition(shards, "shard").mapInArrow(_confirmed, "batch long, blob binary")
    both = _documents(given).unionByName(confirmed, allowMissingColumns=True)
    return (
        both.repartition(shards, "batch").sortWithinPartitions("batch", "row")
        .mapInArrow(lambda batches: _removed(batches, shared.value), "doc_id long, n_words long, n_removed long, kept_sha256 string"))
