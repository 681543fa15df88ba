from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from commitloom.sources import snapshots as S
from commitloom.sources import versions as V

FILES, EDGES = "repo_id string, path string", "repo_id string, source string, target string"


def _state(view, rows):
    return rows(view.table("files"), "repo_id", "path"), rows(view.table("edges"), "repo_id", "source", "target")


@pytest.fixture
def store(spark, tmp_path):
    store = S.SnapshotStore(spark, str(tmp_path / "store"))
    store.replace({
        "files": spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("1", "n")], FILES),
        "edges": spark.createDataFrame([("a", "x", "y"), ("b", "z", "z")], EDGES)})
    return store


OLD = ([("1", "n"), ("a", "x"), ("a", "y"), ("b", "z")], [("a", "x", "y"), ("b", "z", "z")])
NEW = ([("1", "n"), ("a", "new"), ("b", "z")], [("b", "z", "z")])


def test_a_reader_sees_old_or_new_rows_of_all_tables(spark, rows, store, monkeypatch):
    before = store.view()
    publish, seen = V.publish, []

    def watched(*args):
        seen.append(_state(store.view(), rows))  # all rows are written, nothing is published yet
        return publish(*args)

    monkeypatch.setattr(V, "publish", watched)
    store.replace({"files": spark.createDataFrame([("a", "new")], FILES), "edges": spark.createDataFrame([], EDGES)})
    assert seen == [OLD] and _state(store.view(), rows) == NEW
    assert _state(before, rows) == OLD  # a reader that began earlier goes on


def test_deleting_twice_and_by_rows(spark, rows, store):
    store.delete("a")
    store.delete("a")
    assert _state(store.view(), rows) == ([("1", "n"), ("b", "z")], [("b", "z", "z")])
    store.replace({"files": spark.createDataFrame([("a", "p"), ("a", "q"), ("a", None)], FILES)})
    store.delete_rows("files", "a", F.col("path") == "p")
    assert _state(store.view(), lambda df, *c: sorted(map(str, df.select(*c).collect())))[0] == sorted(
        str(r) for r in spark.createDataFrame([("1", "n"), ("a", None), ("a", "q"), ("b", "z")], FILES).collect())
    assert rows(store.view().table("files", "b"), "path") == [("z",)]
    assert store.vacuum() > 0
    assert rows(store.view().table("files", "a").where("path is not null"), "path") == [("q",)]
    for repo in ("a", "b", "1"):
        store.delete(repo)
    with pytest.raises(KeyError):
        store.view().table("files")


def test_a_writer_that_was_overtaken_fails(spark, store):
    base = store.view()
    store.delete("b")
    with pytest.raises(V.ConcurrentChange):
        store._publish(base.entries, base.version)


def test_an_unfinished_version_is_passed_over(spark, rows, store, tmp_path):
    (tmp_path / "store/manifest/version=1/_temporary").mkdir(parents=True)
    assert store.delete("a") == 2
    assert rows(store.view().table("files"), "repo_id") == [("1",), ("b",)]


def test_large_repositories_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(5_000).select(F.lit("a").alias("repo_id"), F.col("id").cast("string").alias("path"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = S.SnapshotStore(spark, str(tmp_path / "s"))
        store.replace({"files": rows})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "s/data/files").glob("write=*/repo_id=a/*.parquet"))) > 1
    assert store.view().table("files").count() == 5_000
