"""Thresholds of the toxicity classifier are cuts, and documents below them stay."""

from __future__ import annotations

import random


def test_clean_documents_are_kept_below_their_languages_cut(spark):
    from commitloom.llm import toxicity as T

    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)]
    text = lambda i: " ".join(rng.choice(plain) for _ in range(12)) + (" vile" if i % 3 == 0 else "")
    docs = spark.createDataFrame([(i, text(i), "en" if i % 2 else "de") for i in range(1200)], "doc_id long, text string, lang string")
    marked = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1200)], "doc_id long, toxic int")
    net = T.trained(docs, marked)
    assert set(net.thresholds) == {"en", "de"} and set(net.thresholds.values()) <= set(T.CUTS)
    kept = {r.doc_id for r in T.without_toxic(docs, marked).collect()}
    assert len(kept & {i for i in range(1200) if i % 3}) > 760 and len(kept & {i for i in range(1200) if i % 3 == 0}) < 40
