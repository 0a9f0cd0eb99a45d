"""Grouping that neither hot groups nor an earlier partitioning can slow down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """``groupBy(*by).agg(...)``, always spread over all of ``by``.

    Rows already partitioned on one of several keys (after a join, say) would
    otherwise be aggregated where they are, a hot key in a single task. Grouping
    on the keys as one struct asks for a shuffle on all of them, after the
    map-side combine.
    """
    if len(by) == 1:
        return df.groupBy(*by).agg(*aggregates)
    return df.groupBy(F.struct(*by).alias("_key")).agg(*aggregates).select("_key.*", "*").drop("_key")


def canonical(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row per ``by`` in ascending ``order`` with NULLs last.

    An aggregate, not a window: each map task sends on one row per group, so a
    group holding most of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in by]
    ranks = [part for c in order for part in (c.isNull(), c)]
    first = aggregate(df, by, F.min_by(F.struct(*rest), F.struct(*ranks)).alias("_first"))
    return first.select(*[F.col(f"_first.{c}") if c in rest else F.col(c) for c in df.columns])


def top_ranked(df: DataFrame, by: str | list[str], n: int, order: list[Column]) -> DataFrame:
    """First ``n`` rows per ``by`` with their 1-based ``rank``; each map task
    keeps only its own first ``n`` before the shuffle."""
    by = [by] if isinstance(by, str) else by
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))
