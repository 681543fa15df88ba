"""What both repeat removers share: anchors of windows, the filter of recurring anchors, packed rows.

A window of W tokens contains W - K + 1 runs of K tokens; the one with the least hash is its anchor. Equal
windows have equal anchors at equal places, so a window can only recur if its anchor does, and there are
far fewer anchors than windows. Anchors are counted over all documents; the recurring ones become a bitmap
that all tasks get: a filter whose size follows their number up to MOST_BITS, beyond which it only filters
less. Results never depend on it.

Documents are handled in the batches in which Spark hands them over; a batch is named by its partition and
number. The same plan gives the same batches, so ``docs`` must come from files or a stored table.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.hashing import least_places, mixed, range_hashes, window_hashes
from commitloom.llm.tables import stored

BITS_PER_ANCHOR = 16
MOST_BITS = 1 << 29
#: Bits of one piece of the bitmap as tasks hand it to the driver.
CHUNK_BITS = 1 << 24
NO_ID = -(1 << 63)


def batch_number(position: int) -> int:
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 20) + position


def anchored(tokens: np.ndarray, owner: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows that lie within one text, their anchors' places, and the hashes of all grams."""
    grams = window_hashes(tokens, gram)
    places = least_places(grams, size - gram + 1)
    starts = np.flatnonzero(owner[: len(places)] == owner[size - 1: size - 1 + len(places)]) if len(places) else np.zeros(0, np.int64)
    return starts, places[starts], grams


def anchor_hashes(docs: DataFrame, walk: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]], size: int, gram: int) -> DataFrame:
    """One row (anchor) for each anchor place of every text; ``walk`` gives (tokens, owner) of runs of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, owner in walk(batch.column("text")):
                _, places, grams = anchored(tokens, owner, size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(grams[np.unique(places)].view(np.int64))], names=["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


def _bytes_of(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words (at, word), sorted by place, as one row of bytes per ``words`` places that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, table = -1, np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["chunk", "bytes"])
        for batch in batches:
            at, word = batch.column("at").to_numpy(), batch.column("word").to_numpy()
            for number in np.unique(at // words).tolist():
                if number != chunk:
                    if chunk >= 0:
                        yield out()
                    chunk, table = number, np.zeros(words, np.int64)
                own = at // words == number
                table[at[own] % words] = word[own]
        if chunk >= 0:
            yield out()

    return run


def recurring_filter(anchors: DataFrame) -> np.ndarray:
    """Bitmap (bytes, a power of two) of the anchors that stand in two places or more.

    Tasks put it together in pieces of CHUNK_BITS; the driver holds it and a task's pieces, not the words as rows.
    """
    found = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("anchor"))
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_PER_ANCHOR * found.count()):
        bits *= 2
    words = min(bits, CHUNK_BITS) // 64
    place = found.select(F.expr(f"cast(anchor & {bits - 1}L as int)").alias("place"))
    rows = place.groupBy(F.expr("place div 64").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("word"))
    dealt = rows.repartition(bits // 64 // words, F.expr(f"at div {words}")).sortWithinPartitions("at")
    pieces = dealt.mapInArrow(_bytes_of(words), "chunk int, bytes binary")
    table = np.zeros(bits // 64, np.int64)
    for chunk, piece in pieces.toLocalIterator():  # a task's pieces at once
        table[chunk * words: (chunk + 1) * words] = np.frombuffer(piece, np.int64)
    return table.view(np.uint8)


def recurs(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def pack(*arrays: object) -> bytes:
    return zlib.compress(pickle.dumps(arrays, 5), 1)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zlib.decompress(blob))


def text_hashes(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return mixed(range_hashes(letter[data], offsets[:-1], offsets[1:])).view(np.int64)


def id_numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)
