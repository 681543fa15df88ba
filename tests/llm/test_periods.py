"""Periodic runs against a direct search of every period of every text."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from commitloom.llm import periods as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain_runs(words):
    """Every stretch of every period, kept where no smaller period holds over the whole stretch."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        start = None
        for i in range(q, n + 1):
            same = i < n and words[i] == words[i - q]
            if same and start is None:
                start = i - q
            if not same and start is not None:
                if i - start >= max(24, 3 * q):
                    found.setdefault((start, i - start), q)
                start = None
    return sorted((s, k, q) for (s, k), q in found.items())


def _plain(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def _text(rng, n, letters):
    out = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):  # runs, some broken, some within others
        q = rng.choice([1, 2, 5, 16, 17, 18, 20, 21, 25, 26, 33, 60, 100])
        unit = [rng.choice(letters) for _ in range(q)]
        if q > 8 and rng.random() < 0.4:
            unit[: q // 2] = unit[:2] * (q // 4) + unit[: q // 2 - 2 * (q // 4)]
        k = rng.randint(2 * q, 5 * q + 30)
        at = rng.randrange(len(out) + 1)
        out[at:at] = (unit * (k // q + 1))[:k]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = "odd"
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_a_direct_search(seed):
    rng = random.Random(seed)
    texts = []
    for i in range(60):
        letters = [f"w{j}" for j in range(rng.choice([1, 2, 3, 30, 1000]))]
        texts.append(_text(rng, rng.randint(0, 150), letters))
    names: dict = {}
    numbers = [np.array([names.setdefault(w, len(names)) for w in t], np.int64) for t in texts]
    for text, found in zip(texts, P.runs_of_texts(numbers)):
        assert found == _plain_runs(text)


def test_long_periods_and_words_of_sturmian_and_square_rich_texts():
    a, b = ["x"], ["x", "y"]
    while len(b) < 3_000:
        a, b = b, b + a  # Fibonacci word: rich in cubes of many periods
    rng = random.Random(9)
    unit = [rng.choice("ab") for _ in range(700)]
    block = "".join(rng.choice("ab") for _ in range(90))
    nested = list(block * 3 + "c") * 5
    for text in (b[:2_500], unit * 3 + unit[:1], unit * 3 + unit[:650], nested, ["z"] * 2_000):
        names = {w: i for i, w in enumerate(sorted(set(text)))}
        assert P.runs_of_texts([np.array([names[w] for w in text])])[0] == _plain_runs(text)


def test_a_deceived_hash_is_noticed(monkeypatch):
    rng = random.Random(3)
    text = _text(rng, 100, list("abcdefghij")) + (["p%d" % i for i in range(30)] * 4)
    names = {w: i for i, w in enumerate(sorted(set(text)))}
    numbers = np.array([names[w] for w in text])
    monkeypatch.setattr(P, "range_hashes", lambda values, a, b: np.zeros(len(a), np.uint64))
    assert P.runs_of_texts([numbers])[0] == _plain_runs(text)


def test_queries_equal_a_plain_computation(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(_text(rng, rng.randint(0, 200), [f"w{j}" for j in range(40)])), "x", 1) for i in range(150)]
    rows += [(500, None, "x", 1), (501, "", "x", 1), (502, " \t\n", "x", 1), (None, "a " * 50, "x", 1), rows[3], (503, "a\x0bb\x1cc d " * 40, "x", 1), (504, "é " * 3000, "x", 1), (-7, "q " * 90, "x", 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, start string, period int").repartition(3)
    got = sorted(map(tuple, P.run_digests(given, damage=True).collect()), key=str)
    assert got == sorted((_plain(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 30
    plain = {r.doc_id: r for r in P.periodic_runs(given.where("doc_id = 504")).collect()}
    assert plain[504].runs == "0,3000,1\n" and plain[504].collapsed == "é"
    assert P.run_digests(given.limit(0)).count() == 0


def test_a_very_long_text_ends_in_seconds():
    rng = random.Random(8)
    words = np.array([rng.randrange(3) for _ in range(50_000)] * 6 + [7] * 100_000, np.int64)
    found = P.runs_of_texts([words])[0]
    assert (0, 300_000, 50_000) in found and any(r[1:] == (100_000, 1) for r in found)
