"""The filter of recurring anchors comes to the driver as bytes."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np


def test_filter_is_put_together_by_tasks(spark, monkeypatch):
    """the driver gets pieces of the bitmap, never its words as rows of a table."""
    from pyspark.sql.classic.dataframe import DataFrame

    from commitloom.llm import repeats as R

    def refused(self):
        raise AssertionError("rows of words came to the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(R, "CHUNK_BITS", 1 << 14, raising=False)
    rng = random.Random(2)
    anchors = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    given = anchors + anchors[:1000] + [-1, -1, (1 << 63) - 1, 0, 0]
    table = R.recurring_filter(spark.createDataFrame([(a,) for a in given], "anchor long"))
    assert len(table) * 8 == 1 << 16
    want = {a & 0xFFFF for a, n in Counter(given).items() if n > 1}
    assert set(np.flatnonzero(np.unpackbits(table, bitorder="little")).tolist()) == want
    hashes = np.array(anchors[:1000], np.int64).view(np.uint64)
    assert R.recurs(table, hashes).all()
    assert not R.recurring_filter(spark.createDataFrame([(1,), (2,)], "anchor long")).any()
