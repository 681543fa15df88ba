"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

Words are runs of letters and digits with A-Z lowered; each looks up two hashed halves of its embedding, so
a rare word that shares one half with a telling word does not share the other. The network is trained with
numpy on all labelled rows that are not held out and scores every word of every text. The rows are dealt to
tasks by doc_id; in each round every task goes on from the same network over its own rows, and what they made
is averaged: a table row over the tasks that moved it, the filters over all. Thresholds are calibrated
by language on labelled rows kept out of the fit; they act on the decision ``rejected`` only, never on the
score, which sees nothing but the text.

A null or empty text is scored like any other (one empty word). Labels that are null are ignored; a doc_id
labelled twice counts as toxic if any label says so; of rows that share a labelled doc_id the one with the
least text hash is learned. Without labels of both classes every score is the
share of toxic labels (0 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from commitloom.llm.hashing import LETTER, range_hashes, runs, word_spans
from commitloom.llm.tables import forget, in_batches, per_batch, stored

#: Labelled rows one task fits and calibrates on, about; there are as many tasks as all of them need.
PART_ROWS = 8_000
#: Labels of so many documents at most are broadcast to find their texts.
BROADCAST_LABELS = 500_000
#: Share of the labelled rows used for thresholds only.
CALIBRATION_SHARE = 0.2
EPOCHS = 6
#: The tasks' networks are averaged so often; each goes over its rows EPOCHS / ROUNDS times in between.
ROUNDS = 3
SEED = 7
THRESHOLD = 0.3
#: A language needs so many toxic calibration rows for a threshold of its own.
LEAST_TOXIC = 20
WIDTHS = (1, 2, 3)
FILTERS = 16
HALF = 8
BUCKETS = 1 << 17
#: Rows of both tables, numbered through, that are averaged together.
BLOCK = 1 << 14
#: Cuts among which a language's threshold is chosen.
CUTS = [round(0.2 + 0.05 * i, 2) for i in range(9)]
_PAD = max(WIDTHS) - 1

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Network:
    """Tables of both embedding halves, a filter bank per width and the output layer."""

    halves: np.ndarray
    banks: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)
    fixed: float | None = None

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        halves = rng.normal(0, 0.02, (2, BUCKETS, HALF)).astype(np.float32)
        halves[:, 0] = 0
        banks = [rng.normal(0, 0.3 / w, (w, 2 * HALF, FILTERS)).astype(np.float32) for w in WIDTHS]
        shifts = [np.full(FILTERS, 0.01, np.float32) for _ in WIDTHS]
        return cls(halves, banks, shifts, rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.full(1, -1.5, np.float32))


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the embedding halves, laid out text by text with padding, and where each text begins.

    Every text has at least one (empty) word; id 0 is the zero vector.
    """
    lowered = _LOWER[data]
    starts, ends, text = word_spans(lowered, offsets, _APART)
    hashes = range_hashes(LETTER[lowered], starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    begins = np.concatenate([[0], np.cumsum(np.maximum(counts, 1) + _PAD)])
    ids = np.zeros((2, begins[-1]), np.int32)
    place = begins[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    ids[0, place] = hashes % np.uint64(BUCKETS - 1) + np.uint64(1)
    ids[1, place] = (hashes >> np.uint64(32)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return ids, begins


def _filtered(net: Network, words: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Responses of every filter at every word, padding places at a value no pooling picks."""
    out, n = [], len(words)
    for bank, shift in zip(net.banks, net.shifts):
        response = words @ bank[0]
        for j in range(1, len(bank)):
            response[: n - j] += words[j:] @ bank[j]
        response += shift
        for k in range(1, _PAD + 1):
            response[begins[1:] - k] = -1e9
        out.append(response)
    return out


def _embedded(net: Network, ids: np.ndarray) -> np.ndarray:
    return np.concatenate([net.halves[0][ids[0]], net.halves[1][ids[1]]], axis=1)


def scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if net.fixed is not None:
        return np.full(len(offsets) - 1, net.fixed)
    ids, begins = word_ids(data, offsets)
    pooled = [np.maximum(np.maximum.reduceat(r, begins[:-1], axis=0), 0) for r in _filtered(net, _embedded(net, ids), begins)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate(pooled, axis=1) @ net.out + net.bias, -30, 30)))


def _step(net: Network, memory: dict, ids: np.ndarray, begins: np.ndarray, labels: np.ndarray, rate: float) -> None:
    """One batch: forward, gradients at the pooled places only, Adagrad update."""
    words = _embedded(net, ids)
    responses = _filtered(net, words, begins)
    best = [np.stack([r[a:b].argmax(0) + a for a, b in zip(begins[:-1], begins[1:])]) for r in responses]
    pooled = np.concatenate([np.take_along_axis(r, p, 0) for r, p in zip(responses, best)], axis=1)
    active = np.maximum(pooled, 0)
    wrong = (1 / (1 + np.exp(-np.clip(active @ net.out + net.bias, -30, 30))) - labels).astype(np.float32)
    grads = {"out": active.T @ wrong / len(labels), "bias": np.array([wrong.mean()], np.float32)}
    back = np.outer(wrong, net.out) * (pooled > 0)
    rows, values = [], []
    for k, bank in enumerate(net.banks):
        g, p = back[:, k * FILTERS:(k + 1) * FILTERS], best[k]
        grads["shift", k] = g.mean(0)
        grad = np.zeros_like(bank)
        for j in range(len(bank)):
            grad[j] = np.einsum("dfe,df->ef", words[p + j], g) / len(labels)
            rows.append((p + j).ravel())
            values.append((g[:, :, None] * bank[j].T[None]).reshape(-1, 2 * HALF))
        grads["bank", k] = grad
    for name, grad in grads.items():
        target = net.out if name == "out" else net.bias if name == "bias" else (net.shifts if name[0] == "shift" else net.banks)[name[1]]
        seen = memory.setdefault(name, np.full_like(target, 1e-6))
        seen += grad * grad
        target -= rate * grad / np.sqrt(seen)
    rows_, values_ = np.concatenate(rows), np.concatenate(values)
    for half in (0, 1):
        at, inverse = np.unique(ids[half][rows_], return_inverse=True)
        grad = np.zeros((len(at), HALF), np.float32)
        np.add.at(grad, inverse, values_[:, half * HALF:(half + 1) * HALF])
        grad[at == 0] = 0
        seen = memory.setdefault(("half", half), np.full((BUCKETS, 1), 1e-4, np.float32))
        seen[at] += (grad * grad).mean(1, keepdims=True)
        net.halves[half][at] -= rate * grad / np.sqrt(seen[at])


def _memory(net: Network) -> dict:
    """Adagrad's sums of squares before the first step."""
    dense = {"out": net.out, "bias": net.bias}
    dense |= {("shift", k): shift for k, shift in enumerate(net.shifts)} | {("bank", k): bank for k, bank in enumerate(net.banks)}
    return {k: np.full_like(v, 1e-6) for k, v in dense.items()} | {("half", h): np.full((BUCKETS, 1), 1e-4, np.float32) for h in (0, 1)}


def _dense(net: Network, memory: dict) -> list[np.ndarray]:
    """All that is not a table, with its sums of squares."""
    return [net.out, net.bias, *net.shifts, *net.banks, *(memory[k] for k in sorted((k for k in memory if k[0] != "half"), key=str))]


def _tables(net: Network, memory: dict) -> np.ndarray:
    """Both tables one below the other, each row followed by its sum of squares."""
    return np.concatenate([np.concatenate([net.halves[h], memory["half", h]], axis=1) for h in (0, 1)])


def _split(n: int, part: int) -> tuple[np.random.Generator, np.ndarray]:
    """A part's random numbers, and which of its rows are for thresholds only."""
    rng = np.random.default_rng(SEED + part)
    return rng, rng.random(n) < CALIBRATION_SHARE


def improve(net: Network, memory: dict, texts: list[str], toxic: np.ndarray, part: int, epochs: range | None) -> bool:
    """Trains ``net`` on a part's rows for some of EPOCHS, all by default; whether there were any."""
    rng, held = _split(len(texts), part)
    data = [np.frombuffer(t.encode(), np.uint8) for t, h in zip(texts, held) if not h]
    train = [(word_ids(d, np.array([0, len(d)]))[0], y) for d, y in zip(data, toxic[~held])]
    epochs = range(EPOCHS if len(train) > 2000 else 3 * EPOCHS) if epochs is None else epochs
    for epoch in range(epochs.stop):
        order = rng.permutation(len(train))
        for i in range(0, len(order) if epoch in epochs else 0, 32):
            batch = [train[j] for j in order[i:i + 32]]
            begins = np.concatenate([[0], np.cumsum([b[0].shape[1] for b in batch])])
            _step(net, memory, np.concatenate([b[0] for b in batch], axis=1), begins, np.array([b[1] for b in batch], np.float32), 0.05 / (1 + 0.3 * epoch))
    return bool(train)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each part in order of doc_id; a part's rows follow one another."""
    part, held = None, []
    for batch in batches:
        for number, rows in batch.groupby("part", sort=False):
            if number != part and held:
                yield part, pd.concat(held).sort_values("doc_id")
                held = []
            part = number
            held.append(rows)
    if held:
        yield part, pd.concat(held).sort_values("doc_id")


def _averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mean of each block over the parts, a table's row over those that moved it; rows come by block and part."""
    def mean() -> pd.DataFrame:
        at = np.flatnonzero(seen)
        return pd.DataFrame({"block": [block], "part": [0], "at": [at.astype(np.int32).tobytes()], "values": [(total[at] / seen[at, None]).astype(np.float32).tobytes()]})

    block, total, seen = None, np.zeros((0, 0)), np.zeros(0)
    for batch in batches:
        for number, at, values in zip(batch["block"], batch["at"], batch["values"]):
            at = np.frombuffer(at, np.int32)
            values = np.frombuffer(values, np.float32).reshape(len(at), -1)
            if number != block:
                if block is not None:
                    yield mean()
                block, total, seen = number, np.zeros((BLOCK, values.shape[1])), np.zeros(BLOCK)
            total[at] += values
            seen[at] += 1
    if block is not None:
        yield mean()


def _round(dealt: DataFrame, net: Network, memory: dict, epochs: range | None) -> None:
    """Every part goes on from ``net``; both it and ``memory`` become the mean of what the parts made."""
    shared = dealt.sparkSession.sparkContext.broadcast((net, memory))  # fixed size

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget(None)
        for part, rows in _parts(batches):
            own, sums = copy.deepcopy(shared.value)
            if not improve(own, sums, list(rows["text"]), rows["toxic"].to_numpy(np.float32), int(part), epochs):
                continue
            tables = _tables(own, sums)
            moved = np.flatnonzero(tables[:, -1] != _tables(*shared.value)[:, -1])
            blocks = [(b, moved[moved // BLOCK == b]) for b in range(len(tables) // BLOCK)]
            found = [(b, at % BLOCK, tables[at]) for b, at in blocks if len(at)]
            found.append((-1, np.zeros(1), np.concatenate([x.ravel() for x in _dense(own, sums)])))
            yield pd.DataFrame([(b, part, at.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()) for b, at, v in found], columns=["block", "part", "at", "values"])

    schema = "block int, part int, at binary, values binary"
    made = dealt.mapInPandas(learn, schema).repartition(2 * 2 * BUCKETS // BLOCK, "block").sortWithinPartitions("block", "part")
    for block, _, at, values in made.mapInPandas(_averaged, schema).collect():  # fixed size: at most one network
        at = np.frombuffer(at, np.int32)
        values = np.frombuffer(values, np.float32).reshape(len(at), -1)
        if block < 0:
            start = 0
            for target in _dense(net, memory):
                target[...] = values[0, start:start + target.size].reshape(target.shape)
                start += target.size
        else:
            half, first = divmod(block * BLOCK, BUCKETS)
            net.halves[half][first + at] = values[:, :-1]
            memory["half", half][first + at] = values[:, -1:]
    shared.unpersist()


def _thresholds(dealt: DataFrame, net: Network) -> dict[str, float]:
    """Each language's best cut on the calibration rows of all parts."""
    shared = dealt.sparkSession.sparkContext.broadcast(net)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, rows in _parts(batches):
            rows = rows[_split(len(rows), int(part))[1]]
            data = [np.frombuffer(t.encode(), np.uint8) for t in rows["text"]]
            score = np.array([scores(shared.value, d, np.array([0, len(d)]))[0] for d in data])
            for lang in {x for x in rows["lang"] if isinstance(x, str) and x}:
                own = (rows["lang"] == lang).to_numpy()
                toxic = rows["toxic"].to_numpy()[own] == 1
                above = [score[own] >= c for c in CUTS]
                yield pd.DataFrame({"lang": [lang] * len(CUTS), "cut": CUTS, "toxic": int(toxic.sum()), "above": [int(a.sum()) for a in above], "hits": [int((a & toxic).sum()) for a in above]})

    counts = dealt.mapInPandas(tell, "lang string, cut double, toxic long, above long, hits long").groupBy("lang", "cut").agg(*(F.sum(c).alias(c) for c in ("toxic", "above", "hits")))
    best: dict[str, tuple] = {}
    for r in counts.where(F.col("toxic") >= LEAST_TOXIC).collect():
        best[r.lang] = max(best.get(r.lang, (-1.0,)), _worth(r.cut, r.hits, r.above, r.toxic))
    return {lang: -worth[-1] for lang, worth in best.items()}


def _worth(cut: float, hits: int, above: int, toxic: int) -> tuple[float, float, float]:
    """Larger for a better balanced cut (F1); of equals the one nearest the general threshold, then the lower one."""
    return round(2 * hits / max(1, above + toxic), 4), -abs(cut - THRESHOLD), -cut


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def dealt_rows(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, int, float | None]:
    """All labelled rows that are not held out, written once as parts of about ``rows`` rows dealt by doc_id; their number, and the label if all have one."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = known.count()
    parts = max(1, math.ceil(n / rows))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("doc_id").isNotNull() & ~held_out())
    if n <= BROADCAST_LABELS:
        found = own.join(F.broadcast(known), "doc_id").repartition(parts, "doc_id")
    else:  # both sides meet where the parts are
        found = own.repartition(parts, "doc_id").join(known.repartition(parts, "doc_id").hint("merge"), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "lang", "text"), F.struct(F.xxhash64("text"), "lang")).alias("row"))
    seen = Observation()
    one = one.select("doc_id", "row.*").observe(seen, F.min("toxic").alias("least"), F.max("toxic").alias("most"))
    dealt = in_batches(stored(one.withColumn("part", F.spark_partition_id())))
    least, most = seen.get["least"], seen.get["most"]
    return dealt, parts, float(least or 0) if least == most else None


def trained(docs: DataFrame, labels: DataFrame, rows: int = PART_ROWS) -> Network:
    """A network fitted on all labelled rows but held out ones, about ``rows`` of them in a task."""
    net = Network.fresh(SEED)
    dealt, parts, net.fixed = dealt_rows(docs, labels, rows)
    if net.fixed is not None:
        return net
    memory, each = _memory(net), EPOCHS // ROUNDS
    for epochs in [None] if parts == 1 else [range(i, i + each) for i in range(0, EPOCHS, each)]:
        _round(dealt, net, memory, epochs)
    net.thresholds = _thresholds(dealt, net)
    return net


def scored(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and __score, the network's answer for the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: two tables of BUCKETS rows

    given = in_batches(docs).select(*keep, *([] if "text" in keep else ["text"]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros(batch.num_rows)
        for first, data, offsets in runs(batch.column("text").fill_null("")):
            out[first: first + len(offsets) - 1] = scores(shared.value, data, offsets)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out)], names=[*keep, "__score"])

    return given.mapInArrow(per_batch(step), given.select(*keep).withColumn("__score", F.lit(0.0)).schema)


def cut(net: Network) -> Column:
    """The threshold of a row's language."""
    pairs = [x for k, v in sorted(net.thresholds.items()) for x in (F.lit(k), F.lit(v))]
    own = F.try_element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(None)
    return F.coalesce(own, F.lit(THRESHOLD))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, threshold, rejected."""
    net = trained(docs, labels, rows)
    return scored(docs.withColumn("lang", F.col("lang").cast("string")), net, ["doc_id", "lang"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
        cut(net).alias("threshold"), (F.col("__score") >= cut(net)).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """The rows of ``docs`` the network does not reject."""
    net = trained(docs, labels, rows)
    return scored(docs, net, docs.columns).where(F.col("__score") < cut(net)).select(*docs.columns)
