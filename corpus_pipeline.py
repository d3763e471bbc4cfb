"""A corpus pipeline of five stages, each over all that its predecessor kept.

Every stage takes documents with null ids, null, empty and very long texts, malformed UTF-8, repeated rows, further columns of
any name, and no rows at all; what each does with them stands in its docstring. All but the last return the given columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from rootspan.llm import decontaminate, packing, quality, secrets, simhash
from rootspan.llm.common import table
from rootspan.scratch import materialize_alone


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's threshold rejects go.

    Null and empty texts stay, as nothing speaks against them; repeats are judged alike; a null language counts as one of its
    own. Without trusted documents all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id, with its repeats.

    Texts without words are one group. Rows with a null doc_id stay.
    """
    return simhash.near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go.

    Rows that share a doc_id, null or not, are judged together. Null and empty texts stay, and all do without a benchmark.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets give way to a mark, and n_chars follows the text.

    Null texts stay null; bytes that are no UTF-8 become U+FFFD.
    """
    return secrets.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens.

    A null or empty text is one end id; null ids and repeats keep their rows; other columns are not kept.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", masked_secrets),
    ("best_fit_packing", packed),
]

#: A trained model, fingerprints and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread; what a stage wrote on its way is deleted when it ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize_alone(spark, partial(stage, spark, docs, sf_dir), name)
    return docs
