"""Documents in, clean token-ready documents out: one stage after another, each on all that the last one kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nimbora.llm import decontamination, jaccard_join, pieces, quality, secret_scan
from nimbora.llm.common import let_go_driver, new_folder, table
from nimbora.session import ship


def rested(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun when the driver has let go of what the stages before it left there."""

    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go_driver(spark)
        return stage(spark, docs, sf_dir)

    return begin


@rested
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Rows with null ids are scored like others; a null text scores as an empty one; repeated rows are kept or go together.
    An empty table stays empty. All columns stay as they were, whatever their names.
    """
    return quality.keep_good(docs, table(ship(spark), sf_dir, "labels"))


@rested
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id, a null id after all others.

    Null, empty and wordless texts are copies of nothing and all stay. Repeated rows become one. All columns stay as they were.
    """
    ship(spark)
    return jaccard_join.keep_one_of_each(docs)


@rested
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Null and empty texts hold none; repeated rows stay or go together. All columns stay as they were, also those
    that are named like the operator's results.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@rested
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in all texts; n_chars follows a text that changes. Every row and column stays, a null text too."""
    return secret_scan.redact_secrets(docs)


@rested
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the piece ids of their texts; null and empty texts have none. Raises where a column `ids` exists already."""
    ship(spark)
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_quality), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact), ("SentencePiece encoding", encode),
]

#: The classifier's and the forest's scores can't be had in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
