"""The stored index and the pruned vector search against plain computations."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitloom.functions import text as X
from commitloom.operators import index as I
from commitloom.operators import vectors as V

WORDS = [f"word{a}{b}" for a in "abcdefgh" for b in "xyz"] + ["common", "fileReader", "snake_case"]


def _texts(rng, n):
    return {f"d{i:03d}": " ".join(["common"] * (i % 3) + [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]) for i in range(n)}


def _tokens(spark, texts):
    rows = spark.createDataFrame(sorted(texts.items()), "id string, text string")
    return {r.id: list(r.t) for r in rows.select("id", X.tokenize(F.col("text")).alias("t")).collect()}


def _plain(tokens, asked, k):
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = set()
    for query, terms in asked.items():
        scores = []
        for doc, ts in tokens.items():
            tf = Counter(ts)
            score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.4 / (tf[t] + 1.4 * (1 - 0.72 + 0.72 * len(ts) / average)) for t in set(terms) if tf[t])
            if score > 0:
                scores.append((-round(score, 9), doc))
        out |= {(query, doc, i + 1, -s) for i, (s, doc) in enumerate(sorted(scores)[:k])}
    return out


def _got(df):
    return {(r.query_id, r.doc_id, r.position, round(r.score, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(2)
    texts = {f"q{i}": " ".join(rng.choice(WORDS) for _ in range(i % 6)) for i in range(30)}
    texts["q0"] = "common fileReader nothing"
    return texts, spark.createDataFrame(sorted(texts.items()), "query_id string, question string")


@pytest.mark.parametrize(("block_terms", "block_docs"), [(200_000, 512), (10, 7)])
def test_bm25_equals_a_plain_computation(spark, questions, block_terms, block_docs):
    texts = _texts(random.Random(1), 90)
    index = I.TextIndex.fresh(spark, buckets=5)
    assert index.update(spark.createDataFrame(sorted(texts.items()), "doc_id string, text string")) == 90
    got = _got(I.rank(questions[1], index, 4, block_terms=block_terms, block_docs=block_docs))
    assert got == _plain(_tokens(spark, texts), _tokens(spark, questions[0]), 4)


def test_an_update_tokenises_only_what_changed(spark, questions):
    texts = _texts(random.Random(1), 60)
    index = I.TextIndex.fresh(spark, buckets=5)
    index.update(spark.createDataFrame(sorted(texts.items()), "doc_id string, text string"))
    new = dict(texts)
    new["d003"], new["d004"], new["n1"] = "common wordax", "", "wordbz " * 9
    del new["d010"]
    gone = spark.createDataFrame([("d010",), ("never",)], "doc_id string")
    assert index.update(spark.createDataFrame(sorted(new.items()), "doc_id string, text string"), gone) == 3
    want = _plain(_tokens(spark, new), _tokens(spark, questions[0]), 5)
    assert _got(I.rank(questions[1], index, 5)) == want
    full = I.TextIndex.fresh(spark, buckets=3)
    full.update(spark.createDataFrame(sorted(new.items()), "doc_id string, text string"))
    assert full.totals() == index.totals()
    cols = ["doc_id", "term", "tf", "doc_len"]
    assert sorted(map(tuple, full.read().select(cols).collect())) == sorted(map(tuple, index.read().select(cols).collect()))
    assert index.update(spark.createDataFrame(sorted(texts.items()), "doc_id string, text string").where("doc_id = 'd010'")) == 1
    assert index.totals()[0] == len(new) + 1


def test_a_question_reads_only_its_buckets(spark):
    index = I.TextIndex.fresh(spark, buckets=16)
    index.update(spark.createDataFrame(sorted(_texts(random.Random(1), 60).items()), "doc_id string, text string"))
    one = spark.createDataFrame([("common",)], "term string")
    buckets = index.buckets_of(one)
    read = index._stored(index._state()[1]["batches"], buckets).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(buckets) == 1 and {r.f.split("bucket=")[1].split("/")[0] for r in read} == {str(buckets[0])}
    assert "bucket#" in index.read(one)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:300]
    assert index.read(one).count() == sum("common" in t.split() for t in _texts(random.Random(1), 60).values())
    assert index.read(spark.createDataFrame([("absent",)], "term string")).count() == 0


def _vectors(rng, n, dims, groups):
    centres = rng.normal(size=(groups, dims)) * 3
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.3


@pytest.mark.parametrize("block_queries", [2_048, 3])
def test_topk_equals_brute_force_and_skips_blocks(spark, block_queries):
    rng = np.random.default_rng(4)
    a, b = _vectors(rng, 700, 8, 12), _vectors(rng, 40, 3, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(1000 + i, v.tolist()) for i, v in enumerate(b)]
    rows += [(2000, a[0].tolist()), (2001, a[0].tolist()), (2002, None), (2003, []), (2004, [0.0] * 8)]
    stored = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    asked = [(f"q{i}", v.tolist()) for i, v in enumerate([*a[:6] * 2, *b[:2], -a[9], np.zeros(8)])] + [("none", [1.0, 2.0])]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>")
    want = set()
    for name, q in asked:
        scores = sorted((-round(float(np.dot(q, v)), 9), i) for i, v in rows if v and len(v) == len(q))
        want |= {(name, i, p + 1, -s) for p, (s, i) in enumerate(scores[:5])}
    got, share = V.topk(queries, V.build(stored, centres=16, block=30), 5, block_queries=block_queries)
    assert _got(got) == want
    assert share < 0.7


def test_topk_by_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(f"r{i % 3}", i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))]
    stored = spark.createDataFrame(rows, "repo_id string, doc_id long, vector array<double>")
    queries = stored.where("doc_id < 6").select("repo_id", F.concat(F.lit("q"), "doc_id").alias("query_id"), "vector")
    got, _ = V.topk(queries, V.build(stored, ["repo_id"], centres=4, block=8), 3, ["repo_id"])
    want = set()
    for repo, i, q in rows[:6]:
        scores = sorted((-round(float(np.dot(q, v)), 9), j) for r, j, v in rows if r == repo)
        want |= {(repo, f"q{i}", j, p + 1) for p, (_, j) in enumerate(scores[:3])}
    assert {(r.repo_id, r.query_id, r.doc_id, r.position) for r in got.collect()} == want
    assert V.topk(queries.limit(0), V.build(stored.limit(0)), 3)[0].count() == 0


def test_seeds_come_from_the_first_documents_of_every_term(spark, rows):
    from types import SimpleNamespace

    from commitloom.operators import skew
    from commitloom.plans import searches

    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    texts += [(i, rng.choice(WORDS) + " common") for i in range(5)] + [(None, "common common")]  # repeated and missing ids
    asked = [(f"q{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))) for i in range(30)] + [("all", "common")]
    tables = SimpleNamespace(
        texts=spark.createDataFrame(texts, "doc_id long, text string"), questions=spark.createDataFrame(asked, "query_id string, question string"))
    terms = _tokens(spark, dict(asked))
    words = _tokens(spark, {str(n): text for n, (_, text) in enumerate(texts)})
    lengths = {n: len(words[str(n)]) for n in range(len(texts))}
    held = Counter((doc, term, lengths[n]) for n, (doc, _) in enumerate(texts) for term in words[str(n)])
    expected = set()
    for query in terms:
        best: dict = {}
        for (doc, term, _), tf in held.items():
            if term in terms[query]:
                best[doc] = max(best.get(doc, 0), tf)
        first = sorted(best, key=lambda d: (-best[d], d is not None, d or 0))[:3]
        expected |= {(query, doc, i + 1, best[doc]) for i, doc in enumerate(first)}
    met: list = []
    join = skew.salted_join
    skew.salted_join = lambda *a, **k: met.append(join(*a, **k)) or met[-1]
    try:
        found = {(r.query_id, r.doc_id, r.position, r.tf) for r in searches.seed_list(tables).collect()}
    finally:
        skew.salted_join = join
    assert found == expected
    # "common" is in most texts: its question meets three of them
    assert met[0].where("query_id = 'all'").count() == 3
