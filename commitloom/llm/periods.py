"""Periodic runs of words by multi-scale minimizers.

A run is a longest stretch of consecutive words that repeats with a smallest period q, at least LEAST words and
CUBES periods long. Periods up to DIRECT are found by comparing every word with the one q places before it. Longer ones
fall into scales [low, high]: within a run of such a period the grams of ``high`` words recur at q places and no fewer,
and the leftmost least gram of each window is the same one q places on. So two neighbouring equal minimizers whose
distance lies in the scale are a seed; each run has one, since its windows reach at most three periods. Seeds are
extended both ways by bisection on hashes of ranges; every run found is compared word by word, and extended word by
word should a hash have deceived. Words are numbered exactly, so no two words count as equal by a hash.

Texts of like length are laid end to end with a number of its own between them, which no run can span. All steps are
linear or n log n in a text; a text is read whole by one task, and nothing is shuffled.

A null text is empty; texts without words have no run. Rows without doc_id are not damaged. Rows that repeat are
handled one by one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from commitloom.llm.hashing import least_places, range_hashes, window_hashes
from commitloom.llm.tables import per_batch, texts

LEAST, CUBES = 24, 3
#: Periods compared lag by lag.
DIRECT = 16
#: Words laid end to end at once; a longer text is handled alone.
RUN_WORDS = 1 << 16
#: Words split and held at once; a longer text is held alone.
HELD_WORDS = 1 << 20
_VALUES = np.random.default_rng(13).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """Ranges of periods, up to the longest one a text of ``longest`` words can hold."""
    low = DIRECT + 1
    while CUBES * low <= longest:
        high = max(low, low * 5 // 4)
        yield low, high
        low = high + 1


def _values(ids: np.ndarray) -> np.ndarray:
    """A wide value per word number."""
    ids = ids.astype(np.uint64)
    return _VALUES[ids & np.uint64(0xFFFF)] * (ids * np.uint64(2) + np.uint64(1))


def _direct(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches that repeat at ``period``, by comparing all words."""
    breaks = np.flatnonzero(x[period:] != x[:-period])
    edges = np.concatenate([[-1], breaks, [max(0, len(x) - period)]])
    lengths = np.diff(edges) - 1 + period
    at = np.flatnonzero(lengths >= max(LEAST, CUBES * period))
    return edges[at] + 1, lengths[at]


def _seeds(values: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of neighbouring equal minimizers of a scale."""
    grams = window_hashes(values, high)
    least = least_places(grams, 2 * low - high + 1)
    if len(least) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = least[np.append(True, least[1:] != least[:-1])]
    order = np.argsort(grams[chosen], kind="stable")  # equal grams stay in the order of their places
    sorted_, place = grams[chosen][order], chosen[order]
    apart = np.diff(place)
    at = np.flatnonzero((sorted_[1:] == sorted_[:-1]) & (apart >= low) & (apart <= high))
    return place[at], apart[at]


def _reach(sums_equal, most: np.ndarray) -> np.ndarray:
    """For each seed the greatest reach up to ``most`` that ``sums_equal(reach)`` accepts; 0 always counts."""
    good, bad = np.zeros(len(most), np.int64), most + 1
    while True:
        open_ = bad - good > 1
        if not open_.any():
            return good
        middle = np.where(open_, (good + bad) // 2, good)
        equal = sums_equal(middle)
        good, bad = np.where(open_ & equal, middle, good), np.where(open_ & ~equal, middle, bad)


def _extended(x: np.ndarray, values: np.ndarray, place: np.ndarray, period: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of the stretches around the seeds, each exact."""
    n = len(x)

    def right(reach: np.ndarray) -> np.ndarray:
        return range_hashes(values, place, place + reach) == range_hashes(values, place + period, place + period + reach)

    def left(reach: np.ndarray) -> np.ndarray:
        return range_hashes(values, place - reach, place) == range_hashes(values, place + period - reach, place + period)

    starts = place - _reach(left, place)
    ends = place + period + _reach(right, n - place - period)
    out = set()
    for start, end, p in {*zip(starts.tolist(), ends.tolist(), period.tolist())}:
        if end - start < max(LEAST, CUBES * p):
            continue
        if not np.array_equal(x[start:end - p], x[start + p:end]):  # a hash deceived
            out |= {(int(s), int(k), p) for s, k in zip(*_direct(x, p)) if s < end and s + k > start}
        else:
            out.add((start, end - start, p))
    return out


def runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers ``x``, by start, then period; texts hold up to ``longest``."""
    found: dict[tuple[int, int], int] = {}

    def add(start: int, length: int, period: int) -> None:
        found[start, length] = min(period, found.get((start, length), period))

    for period in range(1, min(DIRECT, longest // CUBES, len(x) - 1) + 1):
        for start, length in zip(*_direct(x, period)):
            add(int(start), int(length), period)
    wider = list(scales(longest))
    if wider:
        values = _values(x)
        seeds = [_seeds(values, low, high) for low, high in wider]
        place, period = np.concatenate([s[0] for s in seeds]), np.concatenate([s[1] for s in seeds])
        for run in _extended(x, values, place, period) if len(place) else ():
            add(*run)
    # a stretch that also repeats at a multiple of its period was found under both; the least is its period
    return sorted((start, length, period) for (start, length), period in found.items())


def damaged_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a damaged text; None where the text stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % period
    return places


def runs_of_texts(numbers: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts given as word numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in numbers]
    order = sorted(range(len(numbers)), key=lambda i: len(numbers[i]))
    spare = 1 + max((int(x.max()) for x in numbers if len(x)), default=0)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            laid = np.empty(size + len(group), np.int64)
            begins, at = [], 0
            for k, i in enumerate(group):
                begins.append(at)
                laid[at:at + len(numbers[i])] = numbers[i]
                at += len(numbers[i]) + 1
                laid[at - 1] = spare + k
            edges = np.array(begins)
            for start, length, period in runs(laid, len(numbers[group[-1]])):
                k = int(np.searchsorted(edges, start, "right")) - 1
                out[group[k]].append((start - begins[k], length, period))
        group, size = [], 0

    for i in order:
        if len(numbers[i]) < LEAST:
            continue
        if group and size + len(numbers[i]) > RUN_WORDS:
            flush()
        group.append(i)
        size += len(numbers[i])
    flush()
    return out


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, the earliest and then shortest period of equals."""
    best = None
    for run in found:  # by start, then period, so an equal later one never wins
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"


def _numbered(batch: pa.RecordBatch, damage: bool) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
    """Words and word numbers of each text, so many texts at a time as hold HELD_WORDS words."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words, ids, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        own = text.as_py().encode().split()  # bytes are split at exactly the six ASCII blanks
        found = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
        places = damaged_places(doc_id, len(own)) if damage else None
        if places is not None:
            own, found = [own[i] for i in places], found[places]
        words.append(own)
        ids.append(found)
        size += len(own)
        if size >= HELD_WORDS:
            yield words, ids
            words, ids, size = [], [], 0
            numbers.clear()
    yield words, ids


def _results(docs: DataFrame, damage: bool, digests: bool) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for words, ids in _numbered(batch, damage):
            for own, found in zip(words, runs_of_texts(ids)):
                best = strongest(found)
                lines = "".join([f"{s},{k},{p}\n" for s, k, p in found]).encode()
                kept = b" ".join([own[i] for i in np.flatnonzero(kept_words(len(own), found))] if found else own)
                written = [hashlib.sha256(x).hexdigest() for x in (lines, kept)] if digests else [lines.decode(), kept.decode()]
                rows.append((len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *written))
        columns = zip(*rows)
        names = [f"{x.split()[0]}" for x in schema.split(", ")]
        made = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string()] * 2)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=names)

    schema = _SCHEMA.replace("runs string, collapsed", "runs_sha256 string, collapsed_sha256") if digests else _SCHEMA
    return texts(docs).mapInArrow(per_batch(step), schema)


def periodic_runs(docs: DataFrame, damage: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the strongest run, all runs as lines, and the text with runs collapsed.

    ``damage`` first makes the tail of about a tenth of the texts periodic, chosen by crc32 of the doc_id.
    """
    return _results(docs, damage, False)


def run_digests(docs: DataFrame, damage: bool = False) -> DataFrame:
    """As ``periodic_runs`` with SHA-256 digests in place of the two texts, made where the text is read."""
    return _results(docs, damage, True)
