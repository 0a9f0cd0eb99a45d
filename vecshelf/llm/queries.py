"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshelf.llm import collocations, decontaminate, language, line_dedup, lm_score, quality_model, quality_rules, toxicity
from vecshelf.llm.chat import chat_digests
from vecshelf.llm.common import fold, table
from vecshelf.llm.packing import pack
from vecshelf.llm.repair import damaged_and_repaired
from vecshelf.llm.simhash import simhash_components
from vecshelf.llm.token_files import token_files

TOKENIZER = "byte_bpe_50k.json"
#: From which score on a document is toxic, and good.
TOXIC, GOOD = 0.5, 0.3


def _scored(docs: DataFrame, score, least: float) -> DataFrame:
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    return _scored(docs, toxicity.score_column(machine), TOXIC)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language.train(docs, ~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), language.predict_column(model).alias("x")).select("doc_id", "held_out", "x.*")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat_digests(rows.union(more))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm_score.score_texts(docs, fold("doc_id", 5) != 1, F.col("lang"))
    return found.withColumn("held_out", ~F.col("train")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.train(docs, labels, fold("doc_id", 5) != 0)
    return _scored(docs, quality_model.score_column(model), GOOD)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_language": op4_language,
    "op5_token_files": op5_token_files,
    "op6_chat": op6_chat,
    "op7_lm_score": op7_lm_score,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_repair": op12_repair,
    "op13_line_dedup": op13_line_dedup,
}
ORACLE: dict[str, str] = {
    "op2_decontaminate": decontaminate.SQL,
    "op11_collocations": collocations.SQL,
    "op13_line_dedup": line_dedup.SQL,
}
