"""Subword embeddings: features by plain loops, gradients by differences, held-out accuracy, awkward tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from commitloom.llm import quality as Q
from commitloom.llm.hashing import LETTER, mixed, range_hashes


def _plain_features(text):
    """Buckets of all features of one text, one word and one n-gram at a time."""
    def hashed(values):
        return range_hashes(np.array(values, np.uint64), np.array([0]), np.array([len(values)]))[0]

    out, before = Counter(), None
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        letters = [int(LETTER[b]) for b in word]
        mark = Q._EDGE[1 if word == before else 0]
        framed = [int(mark), *letters, int(Q._EDGE[2])]
        found = [hashed(letters) ^ Q._SALT[0], mark]
        found += [hashed(framed[i:i + n]) ^ Q._SALT[n] for n in Q.GRAMS for i in range(len(framed) - n + 1)]
        out.update((mixed(np.array(found, np.uint64)) >> np.uint64(47)).tolist())
        before = word
    return out


def test_features_equal_plain_loops():
    texts = ["the the cat", "", " \n", "é ü ü 漢字漢字", "a", "the", "x" * 50 + " end"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    buckets, owner = Q.features(data, offsets)
    for i, text in enumerate(texts):
        assert Counter(buckets[owner == i].tolist()) == _plain_features(text)


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(1)
    model = Q.Subwords(rng.normal(size=(40, Q.DIMENSIONS)), rng.normal(size=(Q.DIMENSIONS, 2)), rng.normal(size=2))
    batch = [(rng.choice(40, 6, replace=False), np.full(6, 1 / 6)) for _ in range(5)]
    labels = np.array([0, 1, 1, 0, 1])

    def loss():
        means = np.stack([w @ model.table[b] for b, w in batch])
        return -np.log(Q._probabilities(model, means)[np.arange(5), labels]).sum()

    layer, bias, vectors, _ = Q.gradients(model, batch, labels)
    table = np.zeros_like(model.table)
    for (b, w), v in zip(batch, vectors):
        table[b] += np.outer(w, v)
    for values, grad in ((model.layer, layer), (model.bias, bias), (model.table, table)):
        for at in [tuple(rng.integers(0, n) for n in values.shape) for _ in range(12)]:
            values[at] += 1e-5
            more = loss()
            values[at] -= 2e-5
            less = loss()
            values[at] += 1e-5
            assert abs((more - less) / 2e-5 - grad[at]) < 1e-4


def test_scores_are_the_softmax_of_the_mean():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cd") for _ in range(80)) for _ in range(60)]
    samples = []
    for t in texts:
        n = _plain_features(t)
        at = np.array(sorted(n))
        samples.append((at, np.array([n[b] for b in at]) / sum(n.values())))
    model = Q.fit(samples, np.array([i % 2 for i in range(60)]))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = Q.scores(model, model.shares(), data, np.cumsum([0, *(len(t) for t in texts)]))
    want = Q._probabilities(model, np.stack([w @ model.table[b] for b, w in samples]))[:, 1]
    assert np.abs(got - want).max() < 1e-4


def _rows(rng):
    out = []
    for i in range(400):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        kind = i % 4
        if kind == 1:
            words = [w + rng.choice(["###", "$$"]) for w in words]
        if kind == 2:
            words = [w for w in words[:8] for _ in range(6)]
        out.append((i, " ".join(words), kind in (0, 3)))
    return out


def test_held_out_rows_are_told_apart(spark):
    rows = _rows(random.Random(3))
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows] + [(900, None, "x", 0.0), (901, "", "x", 0.0), (None, "abc", "x", 0.0), (5, rows[5][1], "x", 0.0), (5, rows[5][1], "x", 0.0)], "doc_id long, text string, good string, score double")
    # labels of held-out rows are turned round: a classifier that learned them would be wrong
    labels = spark.createDataFrame([(i, int(g != (zlib.crc32(str(i).encode()) % 3 == 1)), None) for i, _, g in rows] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert Q.quality(docs, labels).count() == len(rows) + 5
    held = [(got[i], g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and len(held) > 80
    assert np.mean([r.predicted == int(g) for r, g in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[900].score == got[901].score and not got[None].held_out
    again = {r.doc_id: r.score for r in Q.quality(docs.repartition(7), labels).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.quality(docs, labels).collect()} == {0.0}
    good = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    assert {r.score for r in Q.quality(docs, good).collect()} <= {0.0, 1.0}
    assert Q.quality(docs.limit(0), good).count() == 0
