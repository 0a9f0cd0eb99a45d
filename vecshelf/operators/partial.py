"""Sums of arrays over a whole table: each task adds up what it reads, and the
parts of the tasks are added in two steps, cut into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numbers in one block of a sum that travels.
BLOCK = 1 << 18
# Tasks whose parts meet first.
FAN_IN = 32
# What may come to the driver as one sum.
MOST_BYTES = 1 << 30

_ROW = "part long, block long, size long, sums binary"


def _rows(part: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, total.size, BLOCK):
        data = total[i : i + BLOCK].tobytes()
        values = ([part], [i // BLOCK], [total.size], [data])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "size", "sums"]
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and block -> one row of each (part, block)."""
    held = None

    def out():
        values = ([held[0]], [held[1]], [held[2]], [held[3].tobytes()])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "size", "sums"]
        )

    for batch in batches:
        for part, block, size, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums = np.frombuffer(sums, np.float64)
            if held is not None and held[:2] == (part, block):
                held[3][:] += sums
                continue
            if held is not None:
                yield out()
            held = (part, block, size, sums.copy())
    if held is not None:
        yield out()


def summed(df: DataFrame, add: Callable[[np.ndarray | None, pa.RecordBatch], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all tasks of a flat float64 array. ``add`` takes a task's sum
    so far (None at first) and a batch, and returns the new sum; tasks that
    return None have nothing to add. None if no task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = add(total, batch)
        if total is not None:
            yield from _rows(TaskContext.get().partitionId() // FAN_IN, total)

    parts = df.mapInArrow(run, _ROW)
    for last in (False, True):
        if last:
            parts = parts.withColumn("part", F.lit(0).cast("long"))
        parts = parts.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(_added, _ROW)
    pieces, total = {}, None
    for row in parts.toLocalIterator():
        if row["size"] * 8 > MOST_BYTES:
            raise ValueError(f"a sum of {row['size']} numbers is more than the driver takes")
        pieces[row["block"]] = np.frombuffer(row["sums"], np.float64)
    if pieces:
        total = np.concatenate([pieces[b] for b in sorted(pieces)])
    return total
