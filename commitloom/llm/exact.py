"""Exact duplicates through an index of cuckoo filters over bucketed keys.

The corpus is spread over buckets by digest. Each bucket keeps the full digests it holds ("bucketed
content") and a cuckoo filter of the live ones. A digest the filter does not know is new without looking
at the content; a hit is verified against the stored keys. A newer row of a known text deletes the old
live entry and inserts its own. When an insertion finds no place, the filter is built anew at twice the
size from the stored keys.

Null texts equal empty ones. Only A-Z are lowered. Rows that repeat doc_id and text share one decision.
Rows without doc_id come before all others; a group of only such rows keeps them.

An empty table gives an empty result; repeated rows are handled one by one, as rows of equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.tables import in_batches, per_batch, text_of, texts, width

SLOTS = 4
MAX_KICKS = 200
#: Distinct digests that one bucket of the index is meant to hold.
BUCKET_KEYS = 20_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class CuckooFilter:
    """16-bit fingerprints in buckets of four; partial-key cuckoo hashing with deletion."""

    def __init__(self, capacity: int = 64):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.9)))))
        self.table: list[list[int]] = [[] for _ in range(self.buckets)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[10:18], "little") & (self.buckets - 1)
        return print_, first, self._other(first, print_)

    def _other(self, place: int, print_: int) -> int:
        return place ^ (print_ * 0x5BD1E995 & (self.buckets - 1))

    def __contains__(self, key: bytes) -> bool:
        print_, a, b = self._places(key)
        return print_ in self.table[a] or print_ in self.table[b]

    def insert(self, key: bytes) -> bool:
        """False when no place was found; the caller then resizes from its stored keys."""
        print_, a, b = self._places(key)
        for place in (a, b):
            if len(self.table[place]) < SLOTS:
                self.table[place].append(print_)
                return True
        place = b
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            print_, self.table[place][slot] = self.table[place][slot], print_
            place = self._other(place, print_)
            if len(self.table[place]) < SLOTS:
                self.table[place].append(print_)
                return True
        return False

    def delete(self, key: bytes) -> bool:
        print_, a, b = self._places(key)
        for place in (a, b):
            if print_ in self.table[place]:
                self.table[place].remove(print_)
                return True
        return False


class LiveIndex:
    """One bucket: stored keys with (kept id, size) and the filter of the live keys."""

    def __init__(self) -> None:
        self.content: dict[bytes, tuple[int | None, int]] = {}
        self.filter = CuckooFilter()

    def _add(self, key: bytes) -> None:
        size = SLOTS * self.filter.buckets
        while not self.filter.insert(key):
            size *= 2
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(k) for k in self.content if k != key):
                continue
        return

    def put(self, key: bytes, doc_id: int | None, size: int) -> None:
        if key in self.filter and key in self.content:
            kept, known = self.content[key]
            if doc_id is not None and (kept is None or doc_id > kept):
                self.filter.delete(key)
                self.content[key] = (doc_id, known + size)
                self._add(key)
            else:
                self.content[key] = (kept, known + size)
            return
        self.content[key] = (doc_id, size)
        self._add(key)

    def remove(self, key: bytes) -> bool:
        """Takes a live digest out; False if it is not there."""
        if key not in self.filter or key not in self.content:
            return False
        del self.content[key]
        return self.filter.delete(key)

    def rows(self) -> Iterable[tuple[bytes, int | None, int]]:
        return ((k, v[0], v[1]) for k, v in self.content.items())


def _digest(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_py().translate(_LOWER)).digest() for x in column.cast(pa.large_binary())], pa.binary())


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each whole text after lowering A-Z."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), _digest(batch.column("text"))], names=["doc_id", "digest"])

    return texts(docs).mapInArrow(per_batch(step), "doc_id long, digest binary")


def live_groups(keys: DataFrame) -> DataFrame:
    """One row per digest: keep_id (largest doc_id) and group_size, from the bucketed index.

    Rows are first merged within a task's batches, so a text with a third of all rows sends a few rows.
    """

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[bytes, list] = {}
        for key, doc_id in zip(batch.column("digest").to_pylist(), batch.column("doc_id").to_pylist()):
            row = rows.setdefault(key, [None, 0])
            row[1] += 1
            if doc_id is not None and (row[0] is None or doc_id > row[0]):
                row[0] = doc_id
        return pa.RecordBatch.from_arrays(
            [pa.array(list(rows), pa.binary()), pa.array([r[0] for r in rows.values()], pa.int64()), pa.array([r[1] for r in rows.values()], pa.int64())],
            names=["digest", "doc_id", "n"],
        )

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live: dict[int, LiveIndex] = {}
        for batch in batches:
            for bucket, key, doc_id, n in zip(batch["bucket"], batch["digest"], batch["doc_id"], batch["n"]):
                live.setdefault(bucket, LiveIndex()).put(bytes(key), None if pd.isna(doc_id) else int(doc_id), int(n))
        for one in live.values():
            found = list(one.rows())
            yield pd.DataFrame({"digest": [r[0] for r in found], "keep_id": pd.array([r[1] for r in found], "Int64"), "group_size": [r[2] for r in found]})

    buckets = width(keys, BUCKET_KEYS)
    return (
        keys.mapInArrow(per_batch(merge), "digest binary, doc_id long, n long")
        .withColumn("bucket", F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
        .repartition(buckets, "bucket")
        .mapInPandas(index, "digest binary, keep_id long, group_size long")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = digests(docs)
    joined = keys.join(live_groups(keys), "digest")
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest doc_id.

    A row goes by doc_id and digest, so rows of other texts under the same doc_id, or without one, stay.
    """
    gone = exact_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.unhex("text_sha256").alias("__digest")).distinct()
    named = in_batches(docs).withColumn("__own", F.arrow_udf(_digest, "binary")(text_of()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.col("__own") == F.col("__digest"))
    return named.join(gone, same, "left_anti").drop("__own")
