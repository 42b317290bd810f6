"""The corpus pipeline: toxic documents go, poor documents go, one document of each group of near copies stays, and what
is left is tokenised and packed.

Each stage works on all rows that its predecessor kept. The models of the first two are fitted on bounded samples of the
labelled rows of `labels` among the stage's own input (see the operators' FIT_ROWS). A document is toxic from a score
of 0.7 on, poor up to 0.3; near copies share 80 % of their five-word shingles, and the smallest doc_id stays.

Rows: null and empty texts are scored and kept like others, link with nothing, and pack as the end id alone; other
columns pass through to the packing, which returns only pieces; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import jaccard, packing, subword, toxicity
from tallyspark.llm.common import discard, materialize, table

NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return subword.reject_poor(docs, subword.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

#: Fitted models and tokenizers aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
