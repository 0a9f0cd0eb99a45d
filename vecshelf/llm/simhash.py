"""Near duplicates by SimHash, with pigeonring filtering of the candidates.

A 64-bit fingerprint is cut into ``segments`` that lie on a ring. If two
fingerprints differ in at most ``distance`` bits, then from some segment on,
each chain of l consecutive segments differs in at most l * distance / segments
bits. With 4 bits and 5 segments that means: one segment agrees, with the next
it differs in at most 1 bit, with the third in 2, with the fourth in 3. Chains
of two segments are the index (25 or 26 bits of key); the longer chains prune
what meets there, and the full Hamming distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshelf.llm.common import fresh, text_udf
from vecshelf.llm.components import connected
from vecshelf.session import written

BITS = 64
#: Words whose shingles are hashed at a time, so a very long text stays small.
SLICE = 200_000
#: Rows of one key up to which all pairs are looked at side by side.
FEW = 64
#: Rows of one key that a task holds; a key with more is put off and cut into blocks of so many.
HELD = 100_000


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if it is set in over half
    the shingles' hashes. No words: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones, total = np.zeros(BITS, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for first in range(0, total, SLICE):
        part = words[first : first + SLICE + shingle - 1]
        line = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        begins = np.cumsum(lengths + 1) - lengths - 1
        ends = begins + lengths
        n = len(part) - shingle + 1
        hashes = [digest(line[a:b], 42) for a, b in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint_column(column: str, shingle: int = 4):
    """The fingerprint of a text column, as a signed long with the same bits."""

    def run(texts: list[bytes | None]) -> pa.Array:
        found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return pa.array(found.view(np.int64))

    return text_udf(run, "long")(F.col(column))


class Ring:
    """Segments, chain budgets and index keys for one distance."""

    def __init__(self, distance: int, segments: int) -> None:
        if not 0 <= distance < segments <= BITS // 2:
            raise ValueError("pigeonring needs more segments than differing bits")
        self.distance, self.segments = distance, segments
        cuts = [BITS * i // segments for i in range(segments + 1)]
        self.starts, self.sizes = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        self.flips = 2 * distance // segments

    def _turned(self, x: np.ndarray, i: int) -> np.ndarray:
        """The bits rotated so that segment i comes first (lowest)."""
        s = np.uint64(self.starts[i])
        return x if not s else (x >> s) | (x << (np.uint64(BITS) - s))

    def _width(self, i: int, length: int) -> int:
        return sum(self.sizes[(i + j) % self.segments] for j in range(length))

    def keys(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, fingerprint) rows: for each start the chain of two segments as
        it is, and with each clear bit of its second segment set. Two chains
        that differ in one bit there meet where the clear one is set."""
        keys, of = [], []
        for i in range(self.segments):
            wide, first = self._width(i, 2), self.sizes[i]
            own = self._turned(prints, i) & np.uint64((1 << wide) - 1)
            mark = np.uint64(i << 40)
            keys.append(own | mark)
            of.append(prints)
            for bit in range(first, wide) if self.flips else ():
                clear = (own >> np.uint64(bit)) & np.uint64(1) == 0
                keys.append(own[clear] | np.uint64(1 << bit) | mark)
                of.append(prints[clear])
        return np.concatenate(keys), np.concatenate(of)

    def near(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs that met under a key pass its chains and the distance."""
        ok = np.zeros(len(a), bool)
        start = (keys >> np.uint64(40)).astype(np.int64)
        for i in np.unique(start).tolist():
            at = np.flatnonzero(start == i)
            x = self._turned(a[at] ^ b[at], i)
            good = np.ones(len(at), bool)
            for length in range(2, self.segments):
                part = np.uint64((1 << self._width(i, length)) - 1)
                # both rows of a pair may be flipped ones: those pairs show up under another key too
                good[good] = np.bitwise_count(x[good] & part) <= length * self.distance // self.segments
            good[good] = np.bitwise_count(x[good]) <= self.distance
            ok[at] = good
        return ok


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``distance`` among distinct
    fingerprints: a breadth-first search that takes out what it reaches, so a
    dense group of n costs about n comparisons and gives n - 1 links."""
    found, rest = [], prints
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                reached = rest[near]
                rest = rest[~near]
                queue.extend(reached)
                found += [(int(at), int(x)) for x in reached]
    return found


def _links_of(keys: np.ndarray, prints: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, whole keys only."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(cuts)
    large = np.repeat(sizes > FEW, sizes)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    k, p = keys[~large], prints[~large]
    for lag in range(1, FEW):
        at = np.flatnonzero(k[lag:] == k[:-lag])
        if not at.size:
            break
        good = at[ring.near(k[at], p[at], p[at + lag])]
        a.append(p[good])
        b.append(p[good + lag])
    for run in np.flatnonzero(sizes > FEW).tolist():
        pairs = forest(np.unique(prints[cuts[run] : cuts[run + 1]]), ring.distance)
        if pairs:
            found = np.array(pairs, np.uint64)
            a.append(found[:, 0])
            b.append(found[:, 1])
    return np.concatenate(a), np.concatenate(b)


def _expand(ring: Ring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = ring.keys(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints.view(np.int64))], ["key", "print"])

    return run


_LINKS = ["a", "b", "put_off"]


def _rows(a: np.ndarray, b: np.ndarray, put_off: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), put_off))], _LINKS
    )


def _link(ring: Ring, most: int):
    """(key, print) rows sorted by key -> links. Rows of a key that has more
    than ``most`` come out as they are, ``put_off``, so nothing grows with a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = prints = np.zeros(0, np.uint64)
        large = None
        for batch in chain(batches, [None]):
            if batch is not None:
                k, p = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
                if large is not None and len(k):
                    more = int(np.searchsorted(k.view(np.int64), large, "right"))
                    yield _rows(k[:more], p[:more], True)
                    k, p = k[more:], p[more:]
                keys, prints = np.concatenate((keys, k)), np.concatenate((prints, p))
                if not keys.size:
                    continue
                # the last key may go on in the next batch; Spark sorts keys as signed numbers
                large, done = None, int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
            else:
                done = keys.size
            if done:
                yield _rows(*_links_of(keys[:done], prints[:done], ring), False)
                keys, prints = keys[done:], prints[done:]
            if keys.size > most:
                yield _rows(keys, prints, True)
                large, keys, prints = keys.view(np.int64)[0], keys[:0], prints[:0]

    return run


def _forests(distance: int):
    """(key, i, j, print) rows in order of the first three -> links that connect each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            links = np.array(forest(np.unique(np.concatenate(held)), distance), np.uint64).reshape(-1, 2)
            return _rows(links[:, 0].copy(), links[:, 1].copy(), False)

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            prints = batch.column(3).to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1).tolist(), len(place)]
            for a, b in zip(edges, edges[1:], strict=False):
                if tuple(place[a]) != now:
                    if held:
                        yield out()
                    now, held = tuple(place[a]), []
                held.append(prints[a:b])
        if held:
            yield out()

    return run


def _large_keys(rows: DataFrame, ring: Ring) -> DataFrame:
    """Links of the keys that were put off: their rows are cut into blocks by hash
    of the fingerprint, and each pair of blocks meets in a cell of its own, which
    gives a spanning forest. What is linked within a cell is linked, and any two
    fingerprints of a key share a cell."""
    sizes = rows.groupBy("key").count().select("key", F.ceil(F.col("count") / HELD).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("print"), "blocks").cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    placed = rows.join(sizes, "key").withColumn("own", own).select("key", "print", F.explode(cells).alias("c"))
    dealt = placed.select("key", "c.i", "c.j", "print").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_forests(ring.distance), "a long, b long, put_off boolean").select("a", "b")


def link_fingerprints(prints: DataFrame, distance: int = 4, segments: int = 5) -> DataFrame:
    """(a, b) links that connect exactly the distinct fingerprints (one long
    column) which chains of steps of at most ``distance`` bits connect.

    Each fingerprint is sent out under about 37 narrow keys; the rows of a key
    are read in sort order as a stream. A key's rows give links between
    neighbours, or a spanning forest where they are many, never all pairs. A
    key with more than ``HELD`` rows is taken apart into pairs of blocks, so
    that no task holds more than two blocks, whatever a key holds.
    """
    ring = Ring(distance, segments)
    spark = prints.sparkSession
    keyed = prints.mapInArrow(_expand(ring), "key long, print long")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_link(ring, HELD), "a long, b long, put_off boolean"), "met")
    links, large = found.where("not put_off").select("a", "b"), found.where("put_off").select(F.col("a").alias("key"), F.col("b").alias("print"))
    if large.isEmpty():
        return links
    return links.union(_large_keys(large, ring))


def group_fingerprints(rows: DataFrame, distance: int = 4, segments: int = 5) -> DataFrame:
    """(print, group): the distinct fingerprints of ``rows(print)`` with the
    smallest fingerprint of their component."""
    distinct = rows.select("print").distinct()
    links = link_fingerprints(distinct, distance, segments)
    roots = connected(links)
    return distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", F.coalesce("root", "print").alias("group")
    )


def simhash_components(
    docs: DataFrame, distance: int = 4, segments: int = 5, shingle: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, print, component_id) of each row of ``docs``.

    ``component_id`` is the smallest key that can be reached over links of at
    most ``distance`` differing bits. Equal fingerprints are one node, so
    copies cost one narrow row each. NULL and empty texts have fingerprint
    zero and link like any other. A NULL key is kept; it is a component's id
    only where the component has no other. Repeated rows are all returned.
    """
    prints = written(docs.select(F.col(key).alias("key"), fingerprint_column(text, shingle).alias("print")), "prints")
    first = prints.groupBy("print").agg(F.min("key").alias("least"))
    classes = first.join(group_fingerprints(prints, distance, segments), "print")
    classes = written(classes, "classes")
    ids = classes.groupBy("group").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "group").select("print", "component_id")
    return prints.join(named, "print").select(F.col("key").alias(key), "print", "component_id")


def drop_near_duplicates(
    docs: DataFrame, distance: int = 4, segments: int = 5, shingle: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest key
    (NULL last). Of repeated rows with that key any one stays, the rest go."""
    columns = docs.columns
    own, mark = fresh(columns, "print"), fresh(columns, "row")
    marked = docs.withColumn(own, fingerprint_column(text, shingle))
    marked = written(marked.withColumn(mark, F.monotonically_increasing_id()), "marked")
    narrow = marked.select(F.col(own).alias("print"), F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(mark).alias("row")).alias("at"))
    first = narrow.groupBy("print").agg(F.min("at").alias("at"))
    classes = first.join(group_fingerprints(narrow, distance, segments), "print")
    chosen = classes.groupBy("group").agg(F.min("at").alias("at")).select(F.col("at.row").alias(mark))
    return marked.join(chosen, mark, "left_semi").select(*columns)
