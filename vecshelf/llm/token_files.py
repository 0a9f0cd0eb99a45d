"""Token ids in binary shards, with document boundaries in Elias-Fano code.

A shard holds the ids of consecutive documents as one array, and where each
document starts as an Elias-Fano sequence: of every boundary the low bits are
stored as they are, the high bits in unary, about 2 + log2(n_ids / n_docs)
bits a document in all. A sample of the unary bits' positions answers
``select``, so a reader finds any document without a table of 64-bit offsets.
Document keys ascend, so they are coded the same way.

Layout, little-endian: magic ``EFT1``, id width (u32), documents, ids, NULL
keys, first key, ids before the shard in its task (i64 each), then the
sequence of the boundaries, the sequence of the keys less the first, and the
ids. A sequence is: values, low bits, bytes of low bits, bytes of high bits
(i64 each), the two, and the select samples (u32 each).

Shards travel as rows of a Parquet table, one binary value each: Spark's
writer then commits a task's shards whole or not at all, on any store.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecshelf.llm.common import drawn, within_bound
from vecshelf.llm.tokens import Encoder, encoder, read_spec
from vecshelf.session import new_path

MAGIC = b"EFT1"
#: A shard is closed once it holds so many ids; a document is never split.
SHARD_IDS = 2_000_000
#: One position of the unary bits is kept for so many values.
SAMPLE = 64
#: Rows drawn for each range of keys.
SAMPLED = 100
_HEAD, _SEQUENCE = "<4sI5q", "<4q"


@dataclass
class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    size: int
    low_bits: int
    low: np.ndarray  # packed bits
    high: np.ndarray  # packed bits
    samples: np.ndarray  # position of every SAMPLE-th set bit of high

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = ((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return EliasFano(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def span(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last - 1`` as int64, from the nearest sample on,
        without decoding what comes before or after."""
        if not 0 <= first < last <= self.size:
            return np.zeros(0, np.int64)
        start = int(self.samples[first // SAMPLE])
        end = int(self.samples[(last - 1) // SAMPLE + 1]) if (last - 1) // SAMPLE + 1 < len(self.samples) else 8 * len(self.high)
        byte = start // 8
        bits = np.unpackbits(self.high[byte : -(-end // 8)], bitorder="little")
        bits[: start % 8] = 0
        skipped = first % SAMPLE
        at = np.flatnonzero(bits)[skipped : skipped + last - first] + 8 * byte
        return (((at - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(first, last)).astype(np.int64)

    def select(self, i: int) -> int:
        """Value ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        return int(self.span(i, i + 1)[0])

    def dump(self) -> bytes:
        low, high = self.low.tobytes(), self.high.tobytes()
        return struct.pack(_SEQUENCE, self.size, self.low_bits, len(low), len(high)) + low + high + self.samples.tobytes()

    @staticmethod
    def load(blob: memoryview, at: int) -> tuple[EliasFano, int]:
        size, bits, low, high = struct.unpack_from(_SEQUENCE, blob, at)
        at += struct.calcsize(_SEQUENCE)
        kept = -(-size // SAMPLE)
        cut = [at, at + low, at + low + high, at + low + high + 4 * kept]
        parts = [np.frombuffer(blob[a:b], t) for a, b, t in zip(cut, cut[1:], (np.uint8, np.uint8, "<u4"), strict=False)]
        return EliasFano(size, bits, *parts), cut[-1]


@dataclass
class Shard:
    """Consecutive documents; ``starts`` has one boundary more than documents."""

    ids: np.ndarray
    starts: EliasFano
    keys_above: EliasFano
    nulls: int
    first_key: int
    before: int

    @staticmethod
    def of(keys: list[int | None], docs: list[np.ndarray], before: int) -> Shard:
        lengths = np.array([len(d) for d in docs], np.int64)
        known = [k for k in keys if k is not None]
        first = known[0] if known else 0
        above = np.array([k - first for k in known], np.uint64)
        return Shard(np.concatenate(docs), EliasFano.of(np.concatenate(([0], np.cumsum(lengths)))), EliasFano.of(above), len(keys) - len(known), first, before)

    def dump(self) -> bytes:
        head = struct.pack(_HEAD, MAGIC, self.ids.itemsize, self.starts.size - 1, len(self.ids), self.nulls, self.first_key, self.before)
        return head + self.starts.dump() + self.keys_above.dump() + self.ids.tobytes()

    @staticmethod
    def load(blob: bytes) -> Shard:
        magic, width, _, n, nulls, first, before = struct.unpack_from(_HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        view = memoryview(blob)
        starts, at = EliasFano.load(view, struct.calcsize(_HEAD))
        above, at = EliasFano.load(view, at)
        return Shard(np.frombuffer(view[at : at + width * n], f"<u{width}"), starts, above, nulls, first, before)

    def keys(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys_above.span(0, self.keys_above.size) + self.first_key).tolist()

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` of the shard."""
        return self.ids[self.starts.select(i) : self.starts.select(i + 1)]


def _order(key: int | None, tie: int) -> tuple[bool, int, int]:
    """NULL keys first, then by key; rows of one key by the hash of their text."""
    return key is not None, key or 0, tie


def _encoded(spec, end: int, bounds):
    """(range, key, tie, ids) of texts; ``ids`` are bytes, in the tokenizer's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, cuts = encoder(spec.value, end), bounds.value
        for batch in batches:
            keys, ties = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            places = [bisect_right(cuts, _order(k, t)) for k, t in zip(keys, ties, strict=True)]
            ids = [coder.encode(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), batch.column(0), batch.column(2), pa.array(ids, pa.binary())], ["range", "key", "tie", "ids"]
            )

    return run


def _shards(width: int):
    """Rows (key, ids) in order -> shards. A task holds the ids of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, dtype = TaskContext.get().partitionId(), np.dtype(f"<u{width}")
        keys, docs, held, before, number = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            blob = Shard.of(keys, docs, before).dump()
            values = ([task], [number], [len(docs)], [held], [blob])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["task", "number", "n_docs", "n_ids", "shard"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                docs.append(np.frombuffer(ids, dtype))
                held += len(docs[-1])
                if held >= SHARD_IDS:
                    yield closed()
                    before, number = before + held, number + 1
                    keys, docs, held = [], [], 0
        if docs:
            yield closed()

    return run


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """``parts - 1`` cuts of the rows' order, from about ``SAMPLED`` keys a part
    drawn by hash. Only keys and hashes of the drawn rows come to the driver."""
    total = rows.count()
    sample = rows.where(drawn(5, within_bound(SAMPLED * parts, total), "key", "tie")).select("key", "tie").limit(2 * SAMPLED * parts).toArrow()
    found = sorted(map(_order, sample["key"].to_pylist(), sample["tie"].to_pylist()))
    return [found[len(found) * i // parts] for i in range(1, parts)] if found else []


def write_token_files(docs: DataFrame, path: str, spec_path: str, end: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Writes the shards of all documents, by ascending key, NULL keys first.

    NULL and empty texts have the end id alone; rows with the same key follow
    each other in a fixed order. The key must be an integer. Texts are encoded
    where they are read; ids go on, by ranges of the key, and of a hash of the
    text where one key has very many rows. The ranges come from a sample of
    the keys and only decide how even the tasks are.
    """
    spark = docs.sparkSession
    text_of_spec = read_spec(spec_path)
    width = Encoder(text_of_spec, end).dtype.itemsize
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    sent = [spark.sparkContext.broadcast(x) for x in (text_of_spec, _bounds(rows, parts))]
    coded = rows.mapInArrow(_encoded(sent[0], end, sent[1]), "range int, key long, tie long, ids binary")
    # copies of one row are equal, so their order among each other doesn't matter
    dealt = coded.repartitionById(parts, F.col("range")).sortWithinPartitions("key", "tie")
    dealt.select("key", "ids").mapInArrow(_shards(width), "task int, number int, n_docs long, n_ids long, shard binary").write.parquet(path)


#: Documents whose boundaries are looked up at a time when a shard is read.
DOCS = 4096


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard.load(blob)
            keys = shard.keys()
            for first in range(0, len(keys), DOCS):
                last = min(first + DOCS, len(keys))
                bounds = shard.starts.span(first, last + 1)
                wide = memoryview(shard.ids[bounds[0] : bounds[-1]].astype("<u4")).cast("B")
                cuts = (4 * (bounds - bounds[0])).tolist()
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[first:last], pa.int64()),
                        pa.array(bounds[:-1] + base + shard.before),
                        pa.array(np.diff(bounds)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["key", "start", "n_tokens", "ids_crc32"],
                )


def read_token_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the shards.

    A shard knows the ids before it in its task; the ids of the tasks before
    come from one narrow row a task."""
    shards = spark.read.parquet(path)
    sizes = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = shards.join(F.broadcast(bases), "task").select("base", "shard")
    rows = found.mapInArrow(_read, "key long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumnRenamed("key", key)


def token_files(docs: DataFrame, spec_path: str, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards to the shared folder and reads their index back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, spec_path, end, key, text)
    return read_token_index(docs.sparkSession, path, key)
