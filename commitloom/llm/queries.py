"""The corpus queries: each applies one operator with its production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitloom.llm import bpe, editprint, exact, licenses, minhash, mixing, periods, personal, phrases, quality, suffixes, toxicity, turns
from commitloom.llm.tables import documents

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(documents(spark, sf_dir))


def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal.personal_data(documents(spark, sf_dir))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.passages_removed(documents(spark, sf_dir))


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(documents(spark, sf_dir), vocabulary())


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def repeated_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats_removed(documents(spark, sf_dir))


def edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.neighbour_prints(documents(spark, sf_dir))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(documents(spark, sf_dir), damage=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licence_scan,
    "op2_pareto_mixing": mixing_sources,
    "op3_information_sanitisation": personal_data,
    "op4_phrase_automata": repeated_phrases,
    "op5_convolutional_toxicity": toxic_scores,
    "op6_cuckoo_exact_dedup": exact_copies,
    "op7_forced_boundary_bpe": bpe_round_trip,
    "op8_weighted_minhash": near_copies,
    "op9_deep_shallow_suffixes": repeated_suffixes,
    "op10_edit_embedding": edit_fingerprints,
    "op11_conversation_repair": conversation_repair,
    "op12_subword_quality": quality_scores,
    "op13_periodic_runs": periodic_runs,
}

ORACLES = {
    "op6_cuckoo_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
}
