"""Quality by supervised subword embeddings: hashed vectors of words and character n-grams, averaged per document.

Words stand between blanks, framed by a mark on either side; the opening mark differs for a word that repeats the word
before it. A word gives itself, its opening mark and its n-grams of 3 to 5 bytes, each hashed into one table of learned
vectors. A text is the mean of the vectors of all its words and n-grams, a
softmax layer turns it into the probabilities of both labels. Table and layer are trained together with numpy by
stochastic gradient descent with a falling rate, on a bounded sample of labelled rows that are not held out. Features
are counted where texts are read, so the fitting task gets thin rows, however long the texts.

Since the mean is linear, a table entry's share in the difference of both outputs is one number; scoring looks that
number up for every word and n-gram of a whole text.

A null, empty or blank text has no features and gets the bias alone. Labels that are null are ignored; a doc_id that
is labelled twice counts as good only if all its labels say so; of rows that share a labelled doc_id the one with
the least text hash is learned. Without labels of both classes every score is the share of good labels (0 without
labels). An empty table gives an empty result; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom.llm.hashing import LETTER, mixed, range_hashes, runs, window_hashes, word_spans
from commitloom.llm.tables import per_batch, texts

#: Labelled rows the classifier is fitted on, in one task: its bound.
SAMPLE_ROWS = 8_000
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS, RATE, BATCH = 4, 0.5, 16
#: Every feature moves by its share in a text, which is small; the table's rate makes up for it.
SPREAD = 8.0
THRESHOLD = 0.5
_EDGE = np.random.default_rng(12).integers(1, 1 << 63, 3, dtype=np.uint64)
_SALT = np.random.default_rng(21).integers(1, 1 << 63, 1 + max(GRAMS), dtype=np.uint64)


@dataclass
class Subwords:
    """Vectors of the table's buckets and the softmax layer above their mean."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    fixed: float | None = None

    @classmethod
    def fresh(cls, seed: int) -> Subwords:
        rng = np.random.default_rng(seed)
        table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        return cls(table, np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32))

    def shares(self) -> np.ndarray:
        """What a feature of each bucket adds to output 1 less output 0."""
        return (self.table @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every word and n-gram of the texts."""
    starts, ends, text = word_spans(data, offsets)
    letters = LETTER[data]
    words = range_hashes(letters, starts, ends)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    buckets, owners = [words ^ _SALT[0], _EDGE[again]], [text, text]
    # words laid end to end with a mark before and after each
    lengths = ends - starts
    begins = np.cumsum(lengths + 2) - lengths - 2
    total = int((lengths + 2).sum())
    framed = np.empty(total, np.uint64)
    framed[begins] = _EDGE[again]
    framed[begins + lengths + 1] = _EDGE[2]
    word = np.repeat(np.arange(len(starts)), lengths)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    framed[begins[word] + 1 + inside] = letters[starts[word] + inside]
    of_word = np.repeat(np.arange(len(starts)), lengths + 2)
    for size in GRAMS:
        found = window_hashes(framed, size)
        whole = of_word[:len(found)] == of_word[size - 1:] if len(found) else np.zeros(0, bool)
        buckets.append(found[whole] ^ _SALT[size])
        owners.append(text[of_word[:len(found)][whole]])
    hashes = mixed(np.concatenate(buckets))
    return (hashes >> np.uint64(64 - 17)).astype(np.int32), np.concatenate(owners)


def scores(model: Subwords, shares: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if model.fixed is not None:
        return np.full(n, model.fixed)
    buckets, owner = features(data, offsets)
    counts = np.bincount(owner, minlength=n)
    mean = np.bincount(owner, weights=shares[buckets], minlength=n) / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(mean + float(model.bias[1] - model.bias[0]), -30, 30)))


def _probabilities(model: Subwords, means: np.ndarray) -> np.ndarray:
    outputs = means @ model.layer + model.bias
    outputs = np.exp(outputs - outputs.max(1, keepdims=True))
    return outputs / outputs.sum(1, keepdims=True)


def gradients(model: Subwords, batch: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the summed cross entropy: layer, bias, and the mean vector of each text; the means themselves."""
    means = np.stack([weights @ model.table[buckets] for buckets, weights in batch])
    wrong = _probabilities(model, means)
    wrong[np.arange(len(labels)), labels] -= 1
    return means.T @ wrong, wrong.sum(0), wrong @ model.layer.T, means


def fit(samples: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, seed: int = 12) -> Subwords:
    """``samples`` are (distinct buckets, their shares in the text) of each text."""
    model = Subwords.fresh(seed)
    if len(set(good.tolist())) < 2:
        model.fixed = float(good.mean()) if len(good) else 0.0
        return model
    rng = np.random.default_rng(seed)
    labels = good.astype(np.int64)
    epochs = max(EPOCHS, min(10 * EPOCHS, 20_000 // len(samples)))  # few rows are seen more often
    steps, done = epochs * -(-len(samples) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for i in range(0, len(order), BATCH):
            chosen = order[i:i + BATCH]
            batch = [samples[j] for j in chosen]
            rate = RATE * (1 - done / steps)
            done += 1
            layer, bias, vectors, _ = gradients(model, batch, labels[chosen])
            model.layer -= rate * layer.astype(np.float32)
            model.bias -= rate * bias.astype(np.float32) / BATCH
            for (buckets, weights), vector in zip(batch, vectors):
                model.table[buckets] -= rate * np.outer(weights, vector).astype(np.float32) * SPREAD
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct buckets of each text and their shares in all its features."""
    buckets, shares = [], []
    for _, data, offsets in runs(batch.column("text")):
        found, owner = features(data, offsets)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            at, n = np.unique(found[order[bounds[i]:bounds[i + 1]]], return_counts=True)
            buckets.append(at)
            shares.append((n / max(1, n.sum())).astype(np.float32))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("good"), batch.column("hash"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
        names=["doc_id", "good", "hash", "buckets", "shares"])


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Subwords:
    """A classifier fitted on at most ``rows`` labelled rows, none of them held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
        .where(F.col("doc_id").isNotNull() & F.col("good").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = texts(docs).join(F.broadcast(known), "doc_id")  # at most ``rows`` ids are broadcast
    found = found.withColumn("hash", F.xxhash64("text")).select("doc_id", "good", "hash", "text")
    thin = found.mapInArrow(per_batch(counted), "doc_id long, good int, hash long, buckets array<int>, shares array<float>")
    one = thin.groupBy("doc_id").agg(F.min_by(F.struct("good", "buckets", "shares"), "hash").alias("row")).select("doc_id", "row.*")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([pd.DataFrame({"doc_id": [], "good": [], "buckets": [], "shares": []}), *batches]).sort_values("doc_id")
        made = fit(list(zip(sample["buckets"], sample["shares"])), (sample["good"].to_numpy(np.int64) > 0).astype(np.int64))
        yield pd.DataFrame({"model": [pickle.dumps(made)]})

    made = one.repartition(1).mapInPandas(learn, "model binary").first()
    return pickle.loads(made[0]) if made else fit([], np.zeros(0, np.int64))


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    model = trained(docs, labels, rows)
    # what workers get has a fixed size: one number per bucket
    shared = docs.sparkSession.sparkContext.broadcast((model.shares(), model.bias, model.fixed))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        shares, bias, fixed = shared.value
        out = np.zeros(batch.num_rows)
        for first, data, offsets in runs(batch.column("text")):
            out[first:first + len(offsets) - 1] = scores(Subwords(shares, shares, bias, fixed), shares, data, offsets)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(per_batch(step), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
