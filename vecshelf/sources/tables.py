"""Writing curated tables, materialized working sets and row-count reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_curated(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Rebuild each table under ``path``; running it again replaces the last run."""
    return {name: materialize(df, f"{path}/{name}") for name, df in tables.items()}


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a working set once so that queries scan the result, not its plan."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(t, n)`` for every named table."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def write_query_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Keep named vectors ``(label, vec)`` as a table; a later run replaces it."""
    return materialize(vectors.select("label", F.col("vec").cast("array<double>").alias("vec")), path)


def read_query_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Named vectors kept before, ``(label, vec)``."""
    return spark.read.schema("label string, vec array<double>").parquet(path)


def query_vectors(spark: SparkSession, vectors: dict[str, list[float]]) -> DataFrame:
    """Named vectors given by the caller as ``(label, vec)``."""
    rows = [(label, [float(x) for x in vec]) for label, vec in vectors.items()]
    return spark.createDataFrame(rows, "label string, vec array<double>")
