"""A training-data pipeline over ``documents``: five stages, each a table.

Each stage is one operator of ``vecshelf.llm`` on all that the stage before it
kept; its rows are written as Parquet and read again as the next one's docs.
The filters judge each row by its own text, so repeated rows, NULL keys and
further columns pass through unchanged; empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecshelf.llm import quality_model, toxicity
from vecshelf.llm.common import fold, table
from vecshelf.llm.decontaminate import drop_contaminated
from vecshelf.llm.packing import pack
from vecshelf.llm.queries import GOOD, TOKENIZER, TOXIC
from vecshelf.llm.simhash import drop_near_duplicates
from vecshelf.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from
    the labelled ones of fold 1 to 4."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return docs.where(quality_model.score_column(model) >= GOOD)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; learned likewise."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return docs.where(toxicity.score_column(machine) < TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
