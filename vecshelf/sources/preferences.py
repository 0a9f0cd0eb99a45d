"""Preference files: one ``Author|Title`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """``(author, title)``, both trimmed; identical lines are one preference."""
    lines = spark.read.csv(path, sep="|", quote="", schema="author string, title string")
    return lines.select(F.trim("author").alias("author"), F.trim("title").alias("title")).distinct()
