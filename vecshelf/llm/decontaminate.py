"""Benchmark items inside documents, by MinHash containment search.

Items and documents are sets of word shingles. If at least a share t of an
item's n shingles is in a document, at most n - ceil(t * n) of them are
missing; so of any n - ceil(t * n) + 1 of an item's shingles one at least is
in the document. The sketch of an item is that many of its shingles, those
with the least hash values. Items are partitioned by size, all items of a
partition take the sketch length of its largest, and a partition is only held
against documents large enough for it. What a sketch finds is then verified on
the shingles themselves, so the search misses nothing and reports nothing else.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecshelf.llm.common import raw, text_udf

#: Items are held against all documents in blocks of so many bytes of text at most (or one item).
BLOCK_BYTES = 4_000_000
#: Words of a document whose shingles are hashed at a time.
SLICE = 1 << 18
#: Words whose hashes are kept per task; at more, the task starts a new table.
KEPT = 300_000

_APART = bytes.maketrans(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""", b" " * 32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, ASCII punctuation as space, then cut at white space."""
    return (text or b"").lower().translate(_APART).split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles; fewer words than ``size`` are one shingle."""
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(size)), strict=False)) or {tuple(words)}


class Hashes:
    """64-bit hashes of shingles, from hashes of words that are kept per task."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.known: dict[bytes, int] = {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > KEPT:
            known.clear()
            fresh = set(words)
        known.update((w, zlib.crc32(w) | zlib.adler32(w) << 32) for w in fresh)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hash of each shingle in order."""
        if not words:
            return np.zeros(0, np.uint64)
        w = self._words(words)
        size = min(self.size, len(words))
        n = len(words) - size + 1
        h = np.full(n, len(words) if size < self.size else self.size, np.uint64)
        for i in range(size):
            h = (h ^ w[i : i + n]) * _MIX
            h ^= h >> np.uint64(29)
        return h


@dataclass
class Partition:
    """Items of similar size."""

    least: int  # distinct shingles that a document needs
    sketch: np.ndarray  # sorted hash values
    owner: np.ndarray  # item of each


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[bytes | None], size: int, share: float) -> None:
        self.ids, self.share, self.size = ids, share, size
        words = [words_of(t) for t in texts]
        self.sets = [shingles(w, size) for w in words]
        hashes, by_size = Hashes(size), {}
        for i, (w, s) in enumerate(zip(words, self.sets, strict=True)):
            if s:
                by_size.setdefault(len(s).bit_length(), []).append((i, np.unique(hashes.of(w))))
        self.partitions = []
        for found in by_size.values():
            counts = [len(self.sets[i]) for i, _ in found]
            length = max(n - self.needed(n) for n in counts) + 1
            values = [(h[:length], i) for i, h in found]
            sketch = np.concatenate([h for h, _ in values])
            owner = np.concatenate([np.full(len(h), i) for h, i in values])
            order = np.argsort(sketch, kind="stable")
            self.partitions.append(Partition(self.needed(min(counts)), sketch[order], owner[order]))

    def needed(self, n: int) -> int:
        """Shared shingles that an item of ``n`` needs."""
        return max(1, math.ceil(self.share * n - 1e-9))

    def candidates(self, hashes: np.ndarray, total: int) -> set[int]:
        """Items with a sketch value among the hashes of a document, or of a
        part of it, that has ``total`` shingles."""
        found: set[int] = set()
        if hashes.size:
            for p in self.partitions:
                if total >= p.least:
                    at = np.searchsorted(p.sketch, hashes)
                    at[at == len(p.sketch)] = 0
                    hit = np.unique(p.sketch[at[p.sketch[at] == hashes]])
                    if hit.size:
                        found.update(p.owner[np.isin(p.sketch, hit)].tolist())
        return found

    def search(self, text: bytes | None, hashes: Hashes) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that a document holds."""
        words = words_of(text)
        found: set[int] = set()
        total = max(1, len(words) - self.size + 1)
        for first in range(0, len(words), SLICE):
            found |= self.candidates(hashes.of(words[first : first + SLICE + self.size - 1]), total)
        if not found:
            return []
        wanted = set().union(*(self.sets[i] for i in found))
        held = wanted & shingles(words, self.size)
        counts = [(i, len(self.sets[i] & held)) for i in sorted(found)]
        return [(i, n) for i, n in counts if n >= self.needed(len(self.sets[i]))]


Block = tuple[list, list[bytes | None]]  # keys and texts, plain values that any worker can read


def blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    """The items in blocks of bounded size, so that any number of them can be
    sent to the tasks; documents are read once for each block."""
    ids, texts, held = [], [], 0
    for row in items.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).toLocalIterator():
        value = bytes(row["text"]) if row["text"] is not None else None
        if ids and held + len(value or b"") > BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["key"])
        texts.append(value)
        held += len(value or b"")
    if ids:
        yield ids, texts


def contained(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    share: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, item_key, n_shared, n_shingles): each document that holds at least
    ``share`` of an item's distinct shingles.

    NULL and empty items and documents have no shingles and match nothing;
    items shorter than a shingle are one shingle, which only an equal document
    has. Repeated rows on either side give a row each. NULL keys are kept.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    item_type = to_arrow_type(item_kind)
    schema = f"key {doc_kind.simpleString()}, item {item_kind.simpleString()}, n_shared long, n_shingles long"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    for block in blocks(items, item_key, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            block, hashes = Items(*sent.value, size, share), Hashes(size)
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(raw(batch.column(1))):
                    hits = block.search(t, hashes)
                    at += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array([block.ids[i] for i, _ in found], item_type),
                        pa.array([n for _, n in found], pa.int64()),
                        pa.array([len(block.sets[i]) for i, _ in found], pa.int64()),
                    ],
                    ["key", "item", "n_shared", "n_shingles"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "n_shared", "n_shingles")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, size: int = 5, share: float = 0.8, text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no item; each decided on its own text, so
    repeated rows and NULL keys need no join."""
    spark = docs.sparkSession
    for block in blocks(items, item_key, item_text):
        docs = docs.where(~_holds(spark.sparkContext.broadcast(block), size, share, text))
    return docs


def _holds(sent, size: int, share: float, text: str) -> Column:
    state: dict[str, tuple] = {}

    def run(texts: list[bytes | None]) -> pa.Array:
        if not state:
            state["of the task"] = Items(*sent.value, size, share), Hashes(size)
        items, hashes = state["of the task"]
        return pa.array([bool(items.search(t, hashes)) for t in texts], pa.bool_())

    return text_udf(run, "boolean")(F.col(text))


#: The same pairs in DuckDB: every shingle of every text, joined.
SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(regexp_replace(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
b as (select item_id, list_filter(string_split_regex(regexp_replace(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from benchmark),
ds as (select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from d where len(w) > 0),
bs as (select distinct item_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from b where len(w) > 0),
n as (select item_id, count(*) n_shingles from bs group by item_id)
select doc_id, item_id, count(*) n_shared, n_shingles
from ds join bs using (s) join n using (item_id)
group by doc_id, item_id, n_shingles having count(*) >= 0.8 * n_shingles
"""
