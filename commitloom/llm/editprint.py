"""Fingerprints by randomised edit embedding: shared random walks turn edit distance into Hamming distance.

A walk reads a text letter by letter: at step j it writes the letter it stands on and moves on, or stays, by
a coin shared by all texts for (j, letter). Texts that differ by few edits write strings that differ in few
places. The fingerprint samples SLOTS places of the written string; each slot's place is the least of a
random order over the places written, so texts of other lengths agree on most places and one scheme serves
all lengths. Equal texts have equal fingerprints. Likeness is the share of slots that agree.

An empty or null text writes nothing: its fingerprint is all zeros. The document after the last is the
first. Rows are ordered by doc_id (null first) and then by text, so repeated rows follow each other.

An empty table gives an empty result; repeated rows are handled one by one, as rows of equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.hashing import mixed
from commitloom.llm.tables import per_batch, texts

SLOTS = 64
#: Letters written per slot sample; longer samples tell unlike texts apart better.
SAMPLE = 4
#: Walks advanced together, steps between looks at their ends, and rows taken up at once.
TOGETHER = 1024
BLOCK = 32
AT_ONCE = 4096
#: Bands of the candidate search and the slots each takes.
BANDS, BAND_SLOTS = 16, 3
LIKE = 0.8
#: Documents of one range; one number per range reaches the driver.
RANGE_ROWS = 20_000


@lru_cache(maxsize=None)
def _places(slot: int) -> np.ndarray:
    """Rising record places of a slot: the last one below a length is the slot's place for that length."""
    rng, at, out = np.random.default_rng([11, slot]), 0, [0]
    while at < 1 << 40:
        at = int((at + 1) / max(rng.random(), 1e-12))
        out.append(at)
    return np.array(out)


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """The only steps whose letters any fingerprint reads."""
    return np.unique(np.concatenate([_places(s)[:, None] + np.arange(SAMPLE) for s in range(SLOTS)]))


def fingerprints(given: list[str]) -> np.ndarray:
    """SLOTS bytes for each text."""
    out = np.zeros((len(given), SLOTS), np.uint8)
    order = np.array(sorted((i for i in range(len(given)) if given[i]), key=lambda i: len(given[i])), np.int64)
    for begin in range(0, len(order), TOGETHER):
        group = order[begin:begin + TOGETHER]
        out[group] = _walked([given[i] for i in group])
    return out


def _walked(group: list[str]) -> np.ndarray:
    """Walks of a few texts side by side; only the letters that can be sampled are stored."""
    lengths = np.array([len(t) for t in group])
    letters = np.frombuffer(("".join(group) + "\0" * BLOCK).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    kept = _kept()
    store = np.zeros((int(np.searchsorted(kept, 4 * lengths.max() + 64 * BLOCK)), len(group)), np.uint32)
    counts = np.zeros(len(group), np.int64)
    live, at, step, row = np.arange(len(group)), ends - lengths, 0, 0
    while len(live):
        passed = np.empty((BLOCK, len(live)), np.int64)
        for k in range(BLOCK):
            letter = letters[at]
            if row < len(store) and kept[row] == step + k:
                store[row, live] = letter
                row += 1
            coin = letter * np.uint32(2654435761)
            coin += np.uint32((step + k) * 2246822519 & 0xFFFFFFFF)
            coin ^= coin >> np.uint32(15)
            coin *= np.uint32(3266489917)
            at = at + (coin >> np.uint32(31))
            passed[k] = at
        over = at >= ends[live]
        if over.any():
            counts[live[over]] = step + 1 + (passed[:, over] >= ends[live[over]]).argmax(0)
            live, at = live[~over], at[~over]
        step += BLOCK
    total = np.zeros((len(group), SLOTS), np.uint64)
    column = np.arange(len(group))
    for slot in range(SLOTS):
        places = _places(slot)
        place = places[np.searchsorted(places, counts) - 1]
        for k in range(SAMPLE):
            at = np.minimum(np.searchsorted(kept, place + k), len(store) - 1)
            letter = np.where(place + k < counts, store[at, column], 0).astype(np.uint64)
            total[:, slot] = mixed(total[:, slot] * np.uint64(0x9E3779B97F4A7C15) + letter + np.uint64(1))
    return (total >> np.uint64(40)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first letters of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbour_prints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with its print, its edited text's print and their likeness.

    Texts are dealt once by ranges of doc_id; the first document of each range is also sent to the range
    before it (that of the first range to the last), so every row meets the one that follows it.
    """
    spark = docs.sparkSession
    given = texts(docs)
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    total = given.count()
    if not total:
        return spark.createDataFrame([], _PRINTS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    shares = [i / parts for i in range(1, parts)]
    bounds = np.unique(np.array(given.select(order.alias("order")).approxQuantile("order", shares, 0.1 / parts), np.int64))
    numbered = given.select("doc_id").mapInArrow(per_batch(lambda b: _numbered(b, bounds)), "doc_id long, range int")
    least = numbered.groupBy("range").agg(F.min(order).alias("least")).orderBy("range").toPandas()  # one row per range
    guests = {int(x): int(r) for x, r in zip(least["least"], np.roll(least["range"], 1))}

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _ids(batch)
        rows = np.searchsorted(bounds, ids, "right")
        sent = np.flatnonzero([int(i) in guests for i in ids])
        take = np.concatenate([np.arange(len(ids)), sent])
        place = np.concatenate([rows, [guests[int(i)] for i in ids[sent]]]).astype(np.int32)
        guest = np.arange(len(take)) >= len(ids)
        both = batch.take(pa.array(take))
        return pa.RecordBatch.from_arrays([*both.columns, pa.array(ids[take]), pa.array(place), pa.array(guest)], names=["doc_id", "text", "order", "range", "guest"])

    return (
        given.mapInArrow(per_batch(dealt), "doc_id long, text string, order long, range int, guest boolean")
        .repartition(len(least), "range")
        .sortWithinPartitions("range", "guest", "order", F.xxhash64("text"))
        .mapInArrow(_printed, _PRINTS))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _numbered(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.searchsorted(bounds, _ids(batch), "right").astype(np.int32))], names=["doc_id", "range"])


_PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range, its guests last; a row waits for the next one. Only one guest is used."""
    waiting: tuple | None = None
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("range").to_pylist(), batch.column("guest").to_pylist(), batch.column("text").to_pylist()))
        for begin in range(0, len(rows), AT_ONCE):
            pairs = []
            for row in rows[begin:begin + AT_ONCE]:
                if waiting is not None and waiting[1] == row[1] and not waiting[2]:
                    pairs.append((waiting[0], waiting[3], row[3]))
                waiting = row
            if pairs:
                yield _rows(pairs)


def _rows(pairs: list[tuple]) -> pa.RecordBatch:
    changed = [edited(t, f) for _, t, f in pairs]
    prints = fingerprints([t for _, t, _ in pairs] + changed)
    n = len(pairs)
    own, other = prints[:n], prints[n:]
    # the text that follows a row is the next pair's own text, but where a range ends
    after = [own[i + 1] if i + 1 < n and pairs[i + 1][1] is pairs[i][2] else None for i in range(n)]
    missing = [i for i in range(n) if after[i] is None]
    for i, p in zip(missing, fingerprints([pairs[i][2] for i in missing])):
        after[i] = p
    return pa.RecordBatch.from_arrays([
        pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()),
        pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
        pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in other]),
        pa.array([likeness(a, b) for a, b in zip(own, other)]), pa.array([likeness(a, b) for a, b in zip(own, after)]),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def near_prints(prints: DataFrame, like: float = LIKE) -> DataFrame:
    """Pairs (hub, doc_id, likeness) of texts whose prints agree in a band and then in ``like`` of all slots.

    ``prints`` has doc_id and fingerprint. Equal prints are one node; each band group is compared with the
    print of its least doc_id, so a group gives one row per member.
    """
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    picked = np.random.default_rng(3).permutation(SLOTS)[: BANDS * BAND_SLOTS].reshape(BANDS, BAND_SLOTS)
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.substring("fingerprint", 2 * int(s) + 1, 2) for s in band]) for b, band in enumerate(picked)])
    banded = nodes.select("doc_id", "fingerprint", F.explode(keys).alias("key"))
    hubs = banded.groupBy("key").agg(F.min(F.struct("doc_id", "fingerprint")).alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1)
    pairs = banded.join(hubs, "key").where(F.col("doc_id") != F.col("hub.doc_id")).select(F.col("hub.doc_id").alias("hub"), "doc_id", F.col("hub.fingerprint").alias("a"), F.col("fingerprint").alias("b")).distinct()
    same = sum(((F.substring("a", 2 * s + 1, 2) == F.substring("b", 2 * s + 1, 2)).cast("int") for s in range(SLOTS)), F.lit(0))
    return pairs.select("hub", "doc_id", (same / SLOTS).alias("likeness")).where(F.col("likeness") >= like)
