"""Best-fit packing of token pieces with exact-complement hashing.

Only the lengths matter, and there are at most ``capacity`` of them, so the
plan is made from their counts: at most ``capacity`` rows, whatever the data.
For each length, longest first, the gap it leaves is filled exactly by one
length, by two, or by three, found in tables of single lengths and of pair
sums that hold what is still available. Each pattern found is consumed as
often as the counts allow, which uses up a length, so there are at most about
``capacity`` patterns. What no combination fills exactly goes best-fit,
longest first, again by counts. Pieces then take their places by their rank
among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecshelf.llm.tokens import encoder, read_spec
from vecshelf.session import written

Pattern = tuple[tuple[int, ...], int]  # lengths side by side, times


class Sums:
    """What is left of each length, and the number of pairs for each sum."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of {length} doesn't fit {capacity}")
            self.left[length] = n
        self.here = self.left > 0
        self.pairs = np.zeros(capacity + 1, np.int64)  # unordered pairs b < c, by sum
        self.doubles = np.zeros(capacity + 1, bool)  # b + b, where two are left
        for length in np.flatnonzero(self.here).tolist():
            self.here[length] = False
            self._count(length, 1, below=length)
            self.here[length] = True
            self._double(length)

    def _count(self, length: int, sign: int, below: int | None = None) -> None:
        top = len(self.pairs) - length
        other = self.here[:top].copy()
        other[length : length + 1] = False
        if below is not None:
            other[below:] = False
        self.pairs[length:][other] += sign

    def _double(self, length: int) -> None:
        if 2 * length < len(self.doubles):
            self.doubles[2 * length] = self.left[length] >= 2

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
        for x in set(lengths):
            self._double(x)
            if self.here[x] and not self.left[x]:
                self._count(x, -1)
                self.here[x] = False

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.here[gap] else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """The pair with this sum whose longer part is longest."""
        if self.pairs[gap] > 0:
            low = np.arange(1, (gap + 1) // 2)
            at = np.flatnonzero(self.here[low] & self.here[gap - low])
            if at.size:
                b = int(low[at[0]])
                return (gap - b, b)
        return (gap // 2, gap // 2) if self.doubles[gap] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """A triple with this sum, its longest part as long as possible."""
        long = np.flatnonzero(self.here[: gap - 1])[::-1]
        rest = gap - long
        for d in long[(self.pairs[rest] > 0) | self.doubles[rest]].tolist():
            found = self._pair_beside(gap - d, d)
            if found:
                return (d, *found)
        return None

    def _pair_beside(self, gap: int, d: int) -> tuple[int, ...] | None:
        low = np.arange(1, gap // 2 + 1)
        good = self.here[low] & self.here[gap - low]
        for b in low[good].tolist():
            pair = (gap - b, b)
            if self.times((d, *pair)) > 0:
                return pair
        return None


def exact_patterns(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that fill a sequence exactly, and what is left over."""
    sums, found = Sums(counts, capacity), []

    def consume(lengths: tuple[int, ...]) -> bool:
        times = sums.times(lengths)
        if times:
            sums.take(lengths, times)
            found.append((lengths, times))
        return bool(times)

    for size in range(capacity, 0, -1):
        while sums.left[size]:
            gap = capacity - size
            if not gap:
                consume((size,))
                continue
            for search in (sums.single, sums.pair, sums.triple):
                rest = search(gap) if gap > 0 else None
                if rest and consume((size, *rest)):
                    break
            else:
                break
    left = {int(x): int(sums.left[x]) for x in np.flatnonzero(sums.left)}
    return found, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Longest first, each to the fullest sequence that has room; equal
    sequences are kept as one entry with a count."""
    open_at: dict[int, list[Pattern]] = {}  # by room left
    room = np.zeros(capacity + 1, bool)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = np.flatnonzero(room[size:])
            if not fits.size:
                # as many as fit beside each other share a sequence
                each = capacity // size
                full, odd = divmod(left, each)
                for lengths, times in (((size,) * each, full), ((size,) * odd, 1 if odd else 0)):
                    if times:
                        gap = capacity - size * len(lengths)
                        open_at.setdefault(gap, []).append((lengths, times))
                        room[gap] = True
                break
            gap = int(fits[0]) + size
            lengths, times = open_at[gap].pop()
            used = min(left, times)
            if used < times:
                open_at[gap].append((lengths, times - used))
            room[gap] = bool(open_at[gap])
            open_at.setdefault(gap - size, []).append(((*lengths, size), used))
            room[gap - size] = True
            left -= used
    return [p for at in sorted(open_at) for p in open_at[at]]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """The lengths of each sequence, equal sequences counted."""
    patterns, left = exact_patterns(counts, capacity)
    return patterns + best_fit(left, capacity)


def _places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of each place of each pattern."""
    rows, used, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            at = used.get(x, 0)
            rows.append((x, at, times, sequence, offset))
            used[x] = at + times
            offset += x
        sequence += times
    return rows


def _cut(spec: str, end: int, capacity: int):
    """Texts to pieces: only a document beyond the capacity is cut, so that all
    pieces but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(spec, end), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = coder.encode(text).astype("<u4")
                first = len(ids) % capacity or capacity
                ends = range(first, len(ids) + 1, capacity)
                start = 0
                for piece, stop in enumerate(ends):
                    n = stop - start
                    for column, value in zip(rows, (i, piece, start, n, zlib.crc32(ids[start:stop].tobytes()), seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
                    start = stop
            keys = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:]), pa.array([task] * len(rows[0]), pa.int32())],
                ["key", "piece", "start", "length", "ids_crc32", "nth", "task"],
            )

    return run


def pieces_of(docs: DataFrame, spec_path: str, capacity: int, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document, numbered per task and length, as a written table."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(spec_path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        yield from _cut(spec.value, end, capacity)(batches)

    cut = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids_crc32 long, nth long, task int"
    )
    return written(cut, "pieces")


def pack(docs: DataFrame, spec_path: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    NULL and empty texts have one piece, the end id. Repeated rows are packed
    each on its own, and a NULL key is kept. No rows: no sequences.

    The texts are read once and only narrow rows go on. A piece's rank among
    those of its length is its number within its task plus the counts of the
    tasks before, so one very common length needs no task of its own.
    """
    spark = docs.sparkSession
    pieces = pieces_of(docs, spec_path, capacity, end, key, text)
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_task = written(per_task, "lengths")
    # at most one row for each length, so bounded by the capacity
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    places = _places(plan(counts, capacity))
    table = spark.createDataFrame(
        pa.table(
            [pa.array([r[i] for r in places], pa.int64()) for i in range(5)],
            names=["length", "rank", "ranks", "sequence", "offset"],
        )
    )
    # a length's places in the order of their ranks, to be searched by rank
    steps = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "sequence", "offset"))).alias("steps"))
    # both sides of both joins are bounded by lengths and tasks, not by rows
    ranked = pieces.join(F.broadcast(steps), "length").join(bases, ["length", "task"])
    rank = F.col("base") + F.col("nth")
    ranked = ranked.withColumn("rank", rank)
    step = F.expr("element_at(filter(steps, s -> s.rank <= rank), -1)")
    return ranked.withColumn("step", step).select(
        F.col("key").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("step.sequence") + F.col("rank") - F.col("step.rank")).alias("sequence_id"),
        F.col("step.offset").alias("offset"),
    )
