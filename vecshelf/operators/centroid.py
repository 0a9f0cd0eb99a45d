"""Sums of vectors per group, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshelf.functions.vector import l2_normalize, scale
from vecshelf.operators.grouping import aggregate
from vecshelf.operators.scoring import to_matrix


def vector_sum(df: DataFrame, by: list[str], vec: Column | str = "vec", *extra: Column) -> DataFrame:
    """Element-wise sum per group as ``vec``, combined map-side first."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    summed = Summarizer.sum(array_to_vector(vec))
    return aggregate(df, by, vector_to_array(summed).alias("vec"), *extra)


def _batch_sums(by: str):
    """Rows (by, vec, weight, n) -> the weighted sum of each ``by`` in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode("encode")
            codes = keys.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            weight = batch.column(2).to_numpy()[order]
            sums = np.add.reduceat(to_matrix(batch.column(1))[order] * weight[:, None], first)
            n = np.add.reduceat(batch.column(3).to_numpy()[order], first)
            own = keys.dictionary.take(pa.array(codes[order][first]))
            yield pa.RecordBatch.from_arrays([own, _lists(sums), pa.array(n)], [by, "vec", "n_terms"])

    return run


def _key_sums(by: str, normalize: bool):
    """Partial sums in order of ``by`` -> one row of each; the last key of a batch may go on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def out(rows: pa.RecordBatch) -> pa.RecordBatch:
            lengths = np.linalg.norm(to_matrix(rows.column(1)), axis=1)
            vec = rows.column(1)
            if normalize:
                vec = _lists(to_matrix(vec) / np.where(lengths == 0, 1, lengths)[:, None])
            return pa.RecordBatch.from_arrays([rows.column(0), vec, rows.column(2), pa.array(lengths)], [by, "vec", "n_terms", "norm"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            codes = batch.column(0).dictionary_encode("encode").indices.to_numpy()
            first = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
            sums = np.add.reduceat(to_matrix(batch.column(1)), first)
            n = np.add.reduceat(batch.column(2).to_numpy(), first)
            rows = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), _lists(sums), pa.array(n)], batch.schema.names)
            yield out(rows.slice(0, rows.num_rows - 1))
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield out(held)

    return run


def _lists(matrix: np.ndarray) -> pa.ListArray:
    rows, size = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * size, pa.int32()), pa.array(matrix.ravel()))


def weighted_centroid(
    ratings: DataFrame, vectors: DataFrame, normalize: bool = False, by: str = "user"
) -> DataFrame:
    """Signed sum of rated vectors: ``(user, vec, n_terms, norm)``.

    ``ratings`` is ``(user, input_text, rating)`` and ``vectors`` is
    ``(input_text, vec)`` with one row per text. Ratings of one text by one
    user are added up before the vectors join in. Vectors are added up where
    they are joined, batch by batch, so what is shuffled of a user with very
    many ratings is a few sums.
    """
    weights = aggregate(
        ratings,
        [by, "input_text"],
        F.sum(F.col("rating").cast("double")).alias("weight"),
        F.count("*").alias("n_terms"),
    )
    terms = weights.join(vectors.where("vec is not null").select("input_text", "vec"), "input_text")
    key = ratings.schema[by].dataType.simpleString()
    name = f"`{by}`"
    parts = terms.select(by, "vec", "weight", "n_terms").mapInArrow(_batch_sums(by), f"{name} {key}, vec array<double>, n_terms long")
    dealt = parts.repartition(by).sortWithinPartitions(by)
    return dealt.mapInArrow(_key_sums(by, normalize), f"{name} {key}, vec array<double>, n_terms long, norm double")


def vector_arithmetic(vectors: DataFrame, terms: DataFrame, normalize: bool = True) -> DataFrame:
    """Linear combinations: ``terms`` is ``(expr_id, label, coef)``, ``vectors``
    is ``(label, vec)``; one ``(expr_id, vec)`` per expression whose terms all
    have a vector."""
    wanted = terms.groupBy("expr_id").agg(F.count("*").alias("wanted"))
    scaled = terms.join(vectors.select("label", "vec"), "label")
    sums = vector_sum(
        scaled, ["expr_id"], scale("vec", F.col("coef")), F.count("*").alias("found")
    )
    whole = sums.join(wanted, "expr_id").where("found = wanted").select("expr_id", "vec")
    return whole.withColumn("vec", l2_normalize("vec")) if normalize else whole
