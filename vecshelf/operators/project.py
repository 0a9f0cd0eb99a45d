"""Linear maps learned over a whole table of vectors: principal components, and
a ridge regression from one vector space to another. Spark adds up products of
vectors; only a matrix of dimensions by dimensions comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecshelf.functions.vector import cosine
from vecshelf.operators.partial import MOST_BYTES, summed
from vecshelf.operators.scoring import to_matrix


def _products(df: DataFrame, *columns: str) -> tuple[float, list[np.ndarray], np.ndarray] | None:
    """Row count, sums of the vectors of each column, and the products of the
    first column's vectors with those of all columns side by side."""
    rows = df.where(" and ".join(f"{c} is not null" for c in columns)).select(*columns)
    sizes = [rows.agg(F.max(F.size(c))).first()[0] for c in columns]
    if sizes[0] is None:
        return None
    d, width = sizes[0], sum(sizes)
    if 8 * d * width > MOST_BYTES:
        raise ValueError(f"{d} x {width} products are more than the driver takes")

    def add(total, batch):
        wide = np.hstack([to_matrix(batch.column(i)) for i in range(batch.num_columns)])
        part = np.concatenate([[len(wide)], wide.sum(0), (wide[:, :d].T @ wide).ravel()])
        return part if total is None else total + part

    total = summed(rows, add)
    sums = np.split(total[1 : 1 + width], np.cumsum(sizes)[:-1])
    return float(total[0]), sums, total[1 + width :].reshape(d, width)


@dataclass
class LinearMap:
    """``x -> (x - center) @ matrix + offset``; ``explained`` has the variance of
    each output of principal components."""

    center: np.ndarray
    matrix: np.ndarray
    offset: np.ndarray
    explained: np.ndarray | None = None

    def apply(self, df: DataFrame, vec: str = "vec", out: str = "vec") -> DataFrame:
        """``df`` with the mapped vectors as ``out``; NULL vectors stay NULL."""
        sent = df.sparkSession.sparkContext.broadcast((self.center, self.matrix, self.offset))
        at, types = df.columns.index(vec), [f for f in df.schema.fields if f.name != out]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            center, matrix, offset = sent.value
            for batch in batches:
                column = batch.column(at)
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                mapped = (to_matrix(column.drop_null()) - center) @ matrix + offset if len(there) else np.zeros((0, 0))
                values = np.full(len(column), None, object)
                for i, row in zip(there, mapped, strict=True):
                    values[i] = row
                rest = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != out]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(values, pa.list_(pa.float64()))], [*(f.name for f in types), out])

        return df.mapInArrow(run, T.StructType([*types, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def reduce_dims(df: DataFrame, dims: int, vec: str = "vec") -> LinearMap | None:
    """The first ``dims`` principal components of all vectors (None without any).

    The covariance is the population's. A component's sign makes its largest
    coefficient positive. ``dims`` beyond the vectors' size means all of them.
    """
    found = _products(df, vec)
    if found is None:
        return None
    n, (total,), products = found
    mean = total / n
    values, vectors = np.linalg.eigh(products / n - np.outer(mean, mean))
    order = np.argsort(-values)[: min(dims, len(values))]
    matrix = vectors[:, order]
    matrix = matrix * np.sign(matrix[np.abs(matrix).argmax(0), np.arange(matrix.shape[1])])
    return LinearMap(mean, matrix, np.zeros(matrix.shape[1]), np.maximum(values[order], 0))


def fit_projection(pairs: DataFrame, lam: float = 1.0, intercept: bool = True, source: str = "source", target: str = "target") -> LinearMap | None:
    """The ridge regression from ``source`` to ``target`` vectors of ``pairs``;
    ``lam`` weighs the squared coefficients against the sum of squared errors,
    the intercept is free. Pairs with a NULL side are passed over; None without any."""
    found = _products(pairs, source, target)
    if found is None:
        return None
    n, (x, y), products = found
    d = len(x)
    gram, cross = products[:, :d], products[:, d:]
    mean_x, mean_y = (x / n, y / n) if intercept else (np.zeros(d), np.zeros(len(y)))
    if intercept:
        gram, cross = gram - n * np.outer(mean_x, mean_x), cross - n * np.outer(mean_x, mean_y)
    return LinearMap(mean_x, np.linalg.solve(gram + lam * np.eye(d), cross), mean_y)


def projection_quality(projection: LinearMap, pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``(n, mean_cosine)`` of mapped source vectors with their targets; pairs with a zero side count as 0."""
    mapped = projection.apply(pairs.select(source, target), source, "_mapped")
    score = F.coalesce(cosine("_mapped", target), F.lit(0.0))
    return mapped.where(F.col("_mapped").isNotNull() & F.col(target).isNotNull()).agg(F.count("*").alias("n"), F.avg(score).alias("mean_cosine"))
