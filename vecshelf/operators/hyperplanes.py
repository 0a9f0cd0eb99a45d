"""Near-duplicate vectors by random hyperplanes, every candidate verified.

A vector's signs towards random hyperplanes agree with those of a near vector
mostly. Some bits make a band key; vectors that share a key in any of several
tables are compared. Keys with many rows are cut into blocks that meet pairwise,
so a task holds one block whatever a key holds. A pair is reported by the first
table in which it meets, so none is found twice and nothing is made distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vecshelf.operators.scoring import SCORE_DIGITS, to_keys, to_matrix, unit_rows
from vecshelf.session import written

# Vectors of one key that a task holds, and those compared at a time.
BLOCK_ROWS = 16_384
SLICE = 512


def banding(threshold: float, rows: int, recall: float) -> tuple[int, int]:
    """(bits, tables) so that a pair at ``threshold`` meets with probability
    ``recall`` at least; more bits for more rows, as far as the tables stay few."""
    if not -1 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be a cosine and recall below 1")
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(1, min(60, math.ceil(math.log2(max(rows, 2) / 16))))
    tables = 0
    while bits:
        met = agree**bits
        tables = 1 if met >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-met)))
        if tables <= 64 or bits == 1:
            break
        bits -= 1
    return bits, tables


def _keyed(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = to_matrix(batch.column(1))
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(matrix.shape[1], bits * tables))
            signs = (matrix @ planes >= 0).reshape(len(matrix), tables, bits)
            keys = (signs << np.arange(bits, dtype=np.int64)).sum(2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["key", "vec", "bands"])

    return run


def _compare(threshold: float, ktype: pa.DataType, names: list[str]):
    """Rows by (table, band, i, j): side 0 is held, side 1 streams past; where
    i = j there is side 0 alone, compared within itself."""

    def found(left, right, table: int, within: bool) -> Iterator[pa.RecordBatch]:
        lk, lv, lb = left
        rk, rv, rb = right
        for a in range(0, len(rk), SLICE):
            scores = np.round(rv[a : a + SLICE] @ lv.T, SCORE_DIGITS)
            near = scores >= threshold
            if within:
                near &= np.arange(len(lk)) < np.arange(a, a + len(near))[:, None]
            r, c = np.nonzero(near)
            if table and len(r):
                # met in an earlier table already
                fresh = ~(rb[a + r, :table] == lb[c, :table]).any(axis=1)
                r, c = r[fresh], c[fresh]
            if len(r):
                x, y = rk[a + r], lk[c]
                low, high = np.where(x < y, x, y), np.where(x < y, y, x)
                yield pa.RecordBatch.from_arrays([pa.array(low.tolist(), ktype), pa.array(high.tolist(), ktype), pa.array(scores[r, c])], names)

    def rows(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        keys, matrix = to_keys(table["key"]), unit_rows(to_matrix(table["vec"]), np.nan)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        return keys, matrix, bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None

        def close():
            # a cell without a second side is compared within itself
            if parts and held is None and now[2] == now[3]:
                own = rows(parts)
                yield from found(own, own, now[0], True)

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.column_stack([batch.column(i).to_numpy() for i in range(5)])
            edges = [0, *(np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1).tolist(), len(place)]
            for a, b in zip(edges, edges[1:], strict=False):
                part, cell = batch.slice(a, b - a), tuple(place[a, :4])
                if cell != now:
                    yield from close()
                    now, parts, held = cell, [], None
                if place[a, 4] == 0:
                    parts.append(part)
                elif parts:
                    held = rows(parts) if held is None else held
                    yield from found(held, rows([part]), now[0], False)
        yield from close()

    return run


def banded_pairs(vectors: DataFrame, threshold: float, recall: float = 0.999, seed: int = 17, key: str = "work_key") -> DataFrame:
    """``(key_a, key_b, score)`` with ``key_a < key_b`` of rows of ``(key, vec)``
    whose cosine reaches ``threshold``.

    Every row given is right; a pair at the threshold is found with probability
    ``recall`` at least, a nearer one with a higher. Keys must be distinct;
    NULL keys and vectors and zero vectors pair with nothing. ``key`` values
    are compared by Spark's order of numbers or by code points of strings.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col("vec").isNotNull()).select(F.col(key).alias("key"), "vec")
    bits, tables = banding(threshold, rows.count(), recall)
    schema = T.StructType([*rows.schema.fields, T.StructField("bands", T.ArrayType(T.LongType()))])
    keyed = written(rows.mapInArrow(_keyed(bits, tables, seed), schema), "bands")
    each = keyed.select("*", F.posexplode("bands").alias("t", "band"))
    sizes = each.groupBy("t", "band").count().where("count > 1")
    sizes = sizes.select("t", "band", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    met = each.join(sizes, ["t", "band"]).withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    last = F.col("blocks") - 1
    others = F.sequence(F.lit(0), last)
    # a row is held where its block comes first, and streams past all earlier blocks
    cells = F.transform(others, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), (o < F.col("own")).cast("int").alias("side")))
    met = met.select("key", "vec", "bands", "t", "band", F.explode(cells).alias("c"))
    met = met.select("t", "band", "c.i", "c.j", "c.side", "key", "vec", "bands")
    dealt = met.repartition("t", "band", "i", "j").sortWithinPartitions("t", "band", "i", "j", "side")
    ktype = keyed.schema["key"].dataType
    out = T.StructType([T.StructField("key_a", ktype), T.StructField("key_b", ktype), T.StructField("score", T.DoubleType())])
    return dealt.mapInArrow(_compare(threshold, to_arrow_type(ktype), out.names), out)
