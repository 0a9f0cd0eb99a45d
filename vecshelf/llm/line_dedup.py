"""Incremental, reversible deduplication of lines.

An index holds which document has which line: postings, exact reference counts
for each line, and for each shard of the lines a cuckoo filter over those that
are referenced at all. A batch of documents asks the filters first. A line they
don't know is new for certain: it is appended to the counts without a look at
them. Only the others are joined with the exact table, which decides. Documents
can be taken out again: their postings end, the counts of their lines are made
anew from the postings left, and a line without references leaves its filter.

Lines are known by a 128-bit BLAKE2 hash; a shard is a range of it, so shards
are even however often a line occurs. Every change is a set of new Parquet
files under a version, valid once the version's state is written.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecshelf.llm.common import fresh, raw
from vecshelf.session import exists, new_path

#: Code points from which on a line counts.
SHORTEST = 10
#: Lines a shard's filter is made for; its table has twice as many places.
SHARD = 1 << 13
SLOTS, KICKS = 4, 500


def line_keys(text: bytes, shortest: int = SHORTEST) -> list[bytes | None]:
    """For each line its 16-byte key, or None where it is too short to count.

    >>> line_keys(b" A long enough line\\r\\nshort")[1] is None
    True
    """
    found = []
    for line in text.split(b"\n"):
        line = line.strip().lower()
        long = len(line) >= 4 * shortest or len(line) >= shortest and len(line.decode()) >= shortest
        found.append(hashlib.blake2b(line, digest_size=16).digest() if long else None)
    return found


def _halves(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


class Cuckoo:
    """A cuckoo filter of 16-bit marks, four to a bucket. ``add`` once for each
    key that comes, ``remove`` once for each that goes. One that cannot place a
    mark is ``full`` and from then on says maybe to all, which is never wrong."""

    def __init__(self, buckets: int, table: bytes | None = None) -> None:
        self.mask, self.full = buckets - 1, table == b""
        self.table = array("H", table if table else bytes(2 * SLOTS * buckets))

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key & 0xFFFF) or 1
        first = (key >> 16) & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, key: int) -> bool:
        mark, i, j = self._places(key)
        t = self.table
        return self.full or mark in t[SLOTS * i : SLOTS * i + SLOTS] or mark in t[SLOTS * j : SLOTS * j + SLOTS]

    def _put(self, mark: int, bucket: int, old: int = 0) -> bool:
        """Puts ``mark`` where ``old`` is in the bucket."""
        t = self.table
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if t[at] == old:
                t[at] = mark
                return True
        return False

    def add(self, key: int) -> None:
        mark, i, j = self._places(key)
        if self.full or self._put(mark, i) or self._put(mark, j):
            return
        for kick in range(KICKS):
            at = SLOTS * j + (kick + mark) % SLOTS
            mark, self.table[at] = self.table[at], mark
            j ^= mark * 0x5BD1E995 & self.mask
            if self._put(mark, j):
                return
        self.full = True

    def remove(self, key: int) -> None:
        mark, i, j = self._places(key)
        if not self.full and not self._put(0, i, mark):
            self._put(0, j, mark)

    def tobytes(self) -> bytes:
        return b"" if self.full else self.table.tobytes()


#: Kinds of rows a shard's task reads, in this order: its filter, keys that
#: lost their last reference, keys to look up (added where unknown), keys to add.
FILTER, GONE, ASKED, ADDED = range(4)


def _through_filters(buckets: int):
    """Rows (shard, kind, hi, lo, refs, least, filter) of whole shards in order
    -> looked-up keys with ``maybe``, and the filters as they are then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = now = None

        def state(like: pa.RecordBatch) -> pa.RecordBatch:
            values = {"shard": now, "kind": FILTER, "filter": held.tobytes()}
            columns = [pa.array([values.get(f.name)], f.type) for f in like.schema]
            return pa.RecordBatch.from_arrays([*columns, pa.array([None], pa.bool_())], [*like.schema.names, "maybe"])

        for batch in batches:
            maybe, passed, last = [], [], batch
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)
            for i, (shard, kind, lo) in enumerate(rows):
                if shard != now:
                    if held is not None:
                        yield state(batch)
                    now, held = shard, Cuckoo(buckets)
                known = None
                if kind == FILTER:
                    held = Cuckoo(buckets, batch.column(6)[i].as_py())
                elif kind == GONE:
                    held.remove(lo)
                elif kind == ADDED:
                    held.add(lo)
                else:
                    known = lo in held
                    if not known:
                        held.add(lo)
                maybe.append(known)
                passed.append(kind == ASKED)
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe, pa.bool_())], [*batch.schema.names, "maybe"])
            yield whole.filter(pa.array(passed, pa.bool_()))
        if held is not None:
            yield state(last)

    return run


def _postings(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for i, text in enumerate(raw(batch.column(2))):
                own = {k for k in line_keys(text or b"", shortest) if k is not None}
                at += [i] * len(own)
                keys += map(_halves, own)
            at = pa.array(at, pa.int32())
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(at), batch.column(1).take(at)], ["hi", "lo", "doc", "row"])

    return run


def _kept(shortest: int):
    """(text, keys to drop) -> what is left of the text, its lines before, and those dropped."""

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        left, lines, dropped = [], [], []
        for text, gone in zip(raw(texts), keys.to_pylist(), strict=True):
            text = text or b""
            parts = n = text.count(b"\n") + 1
            if gone:
                gone = {(g["hi"], g["lo"]) for g in gone}
                kept = [p for p, k in zip(text.split(b"\n"), line_keys(text, shortest), strict=True) if k is None or _halves(k) not in gone]
                parts, text = len(kept), b"\n".join(kept)
            left.append(text)
            lines.append(n)
            dropped.append(n - parts)
        columns = [pa.array(left, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.StructArray.from_arrays(columns, ["text", "n_lines", "n_dropped"])

    run.__annotations__ = {"texts": pa.Array, "keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "text string, n_lines long, n_dropped long")


class LineIndex:
    """The index at ``path``, in a folder that all executors reach.

    ``key`` and ``text`` name the columns of the documents. A NULL text is an
    empty one. Rows with a NULL key are one document, after all others. Rows
    of one key are one document, whose lines may stand in several rows; ``refs``
    counts rows, ``least`` is the smallest document of a line.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, shard: int = SHARD) -> None:
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text
        self.shortest, self.shard = shortest, shard
        #: version of the last change, log2 of the number of shards, lines ever counted
        self.version, self.bits, self.lines = 0, 0, 0
        if exists(spark, f"{self.path}/state"):
            last = spark.read.parquet(f"{self.path}/state").orderBy(F.desc("version")).first()
            self.version, self.bits, self.lines = last["version"], last["bits"], last["lines"]

    # -- files ---------------------------------------------------------------

    def _read(self, kind: str) -> DataFrame | None:
        """All rows of a kind that valid versions wrote, with their version."""
        found = [v for v in range(1, self.version + 1) if exists(self.spark, f"{self.path}/{kind}/{v}")]
        frames = [self.spark.read.parquet(f"{self.path}/{kind}/{v}").withColumn("version", F.lit(v)) for v in found]
        out = None
        for frame in frames:
            out = frame if out is None else out.unionByName(frame)
        return out

    def _write(self, kind: str, rows: DataFrame) -> DataFrame:
        """Files of the change being made; overwrites those of one that failed."""
        path = f"{self.path}/{kind}/{self.version + 1}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _commit(self) -> None:
        self.version += 1
        state = self.spark.createDataFrame([(self.version, self.bits, self.lines)], "version int, bits int, lines long")
        state.write.mode("append").parquet(f"{self.path}/state")

    # -- parts ---------------------------------------------------------------

    def _shard_of(self, hi: str) -> Column:
        return (F.shiftrightunsigned(hi, 64 - self.bits) if self.bits else F.lit(0)).cast("int")

    def postings(self) -> DataFrame | None:
        """(hi, lo, doc, row) of documents that are in the index."""
        rows, gone = self._read("postings"), self._read("gone")
        if rows is None or gone is None:
            return rows
        gone = gone.groupBy("gone").agg(F.max("version").alias("until"))
        joined = rows.join(gone, F.col("doc").eqNullSafe(F.col("gone")) & (F.col("version") < F.col("until")), "left_anti")
        return joined

    def counts(self) -> DataFrame | None:
        """(hi, lo, refs, least): the exact references of each line."""
        rows = self._read("counts")
        if rows is None:
            return None
        if self.version > 1:
            rows = rows.groupBy("hi", "lo").agg(F.max_by("refs", "version").alias("refs"), F.max_by("least", "version").alias("least"))
        return rows.where("refs > 0").select("hi", "lo", "refs", "least")

    def filters(self) -> DataFrame | None:
        """(shard, filter) as of the last change that wrote filters; each writes all."""
        for v in range(self.version, 0, -1):
            if exists(self.spark, f"{self.path}/filters/{v}"):
                return self.spark.read.parquet(f"{self.path}/filters/{v}")
        return None

    def _run(self, filters: DataFrame | None, keys: DataFrame) -> DataFrame:
        """``keys(kind, hi, lo, refs, least)`` through their shards' filters."""
        least = keys.schema["least"].dataType
        rows = keys.select(self._shard_of("hi").alias("shard"), "kind", "hi", "lo", "refs", "least", F.lit(None).cast("binary").alias("filter"))
        if filters is not None:
            none = [F.lit(None).cast(t).alias(c) for c, t in (("hi", "long"), ("lo", "long"), ("refs", "long"), ("least", least))]
            rows = rows.union(filters.select("shard", F.lit(FILTER).alias("kind"), *none, "filter"))
        dealt = rows.repartition(1 << self.bits if self.bits < 12 else 4096, "shard").sortWithinPartitions("shard", "kind", "hi", "lo")
        schema = f"shard int, kind int, hi long, lo long, refs long, least {least.simpleString()}, filter binary, maybe boolean"
        return dealt.mapInArrow(_through_filters(max(1, self.shard // 2)), schema)

    def _save_filters(self, *parts: DataFrame) -> None:
        rows = [p.where(F.col("kind") == FILTER).select("shard", "filter") for p in parts]
        self._write("filters", rows[0] if len(rows) == 1 else rows[0].union(rows[1]))

    # -- changes -------------------------------------------------------------

    def insert(self, docs: DataFrame) -> None:
        """Takes documents in. A document that is there already must be deleted first."""
        doc = docs.schema[self.key].dataType.simpleString()
        rows = docs.select(F.col(self.key), F.xxhash64(self.text).alias("row"), F.col(self.text))
        postings = self._write("postings", rows.mapInArrow(_postings(self.shortest), f"hi long, lo long, doc {doc}, row long"))
        batch = postings.groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.min("doc").alias("least"))
        old = self.counts()
        expected = self.lines + postings.count()
        bits = max(0, (-(-expected // self.shard) - 1).bit_length())
        filters = self.filters()
        if bits > self.bits and filters is not None:
            # more shards: the filters are made anew from the exact table
            self.bits = bits
            keys = old.select(F.lit(ADDED).alias("kind"), "hi", "lo", "refs", "least")
            filters = self._temporary(self._run(None, keys)).where(F.col("kind") == FILTER).select("shard", "filter")
        self.bits = max(bits, self.bits)
        asked = self._temporary(self._run(filters, batch.select(F.lit(ASKED).alias("kind"), "hi", "lo", "refs", "least")))
        found = asked.where(F.col("kind") == ASKED)
        fresh_keys = found.where(~F.col("maybe")).select("hi", "lo", "refs", "least")
        if old is None:
            counts, wrong = found.select("hi", "lo", "refs", "least"), found.where(F.col("maybe"))
        else:
            maybe = found.where(F.col("maybe")).select("hi", "lo", F.col("refs").alias("more"), F.col("least").alias("new"))
            known = maybe.join(old, ["hi", "lo"], "left")
            known = self._temporary(known.select("hi", "lo", "more", "new", "refs", "least"))
            wrong = known.where(F.col("refs").isNull()).select("hi", "lo", F.col("more").alias("refs"), F.col("new").alias("least"))
            sums = known.select("hi", "lo", (F.col("more") + F.coalesce("refs", F.lit(0))).alias("refs"), F.least("new", "least").alias("least"))
            counts = fresh_keys.union(sums)
        counts = self._write("counts", counts)
        # lines that a filter took for known ones are new as well: their marks come after
        after = asked.where(F.col("kind") == FILTER).select("shard", "filter")
        if wrong.isEmpty():
            self._save_filters(asked)
        else:
            self._save_filters(self._run(after, wrong.select(F.lit(ADDED).alias("kind"), "hi", "lo", "refs", "least")))
        self.lines = expected
        self._commit()

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents of ``ids`` (one column) out; unknown ids change nothing."""
        live = self.postings()
        if live is None:
            return
        ids = ids.select(F.col(ids.columns[0]).alias("gone")).distinct()
        ids = self._write("gone", ids)
        match = F.col("doc").eqNullSafe(F.col("gone"))
        touched = self._temporary(live.join(ids, match, "left_semi").select("hi", "lo").distinct())
        left = live.join(ids, match, "left_anti").join(touched, ["hi", "lo"], "left_semi")
        left = left.groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.min("doc").alias("least"))
        counts = touched.join(left, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("refs", F.lit(0)).alias("refs"), "least")
        counts = self._write("counts", counts)
        dead = counts.where("refs = 0").select(F.lit(GONE).alias("kind"), "hi", "lo", "refs", "least")
        self._save_filters(self._run(self.filters(), dead))
        self._commit()

    def _temporary(self, rows: DataFrame) -> DataFrame:
        path = new_path(self.spark, "lines")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # -- result --------------------------------------------------------------

    def kept(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the lines that a smaller document has as well.

        Other lines stay as they are, joined by line feeds; a NULL text gives an
        empty one. ``n_lines`` and ``n_dropped`` are added (columns of these
        names are replaced), all else passes through. Rows whose document is
        not in the index stay whole. The lines a row loses are found per row,
        so neither a line nor a document that is everywhere is gathered; joins
        have a shuffle of their own before them, which adaptive execution may split.
        """
        others = [c for c in docs.columns if c.lower() not in (self.text.lower(), "n_lines", "n_dropped")]
        own, row, gone, cut = (fresh(docs.columns, n) for n in ("doc", "row", "gone", "cut"))
        counts, live = self.counts(), self.postings()
        marked = docs.withColumn(row, F.xxhash64(self.text))
        if counts is None or live is None:
            lists = marked.withColumn(gone, F.lit(None).cast("array<struct<hi:long,lo:long>>"))
        else:
            shared = counts.where("refs > 1").select("hi", "lo", "least")
            lost = live.join(shared, ["hi", "lo"]).where((F.col("least") < F.col("doc")) | F.col("doc").isNull() & F.col("least").isNotNull())
            lost = lost.select("doc", "row", "hi", "lo").distinct()
            lost = lost.groupBy(F.col("doc").alias(own), F.col("row").alias("_r")).agg(F.collect_list(F.struct("hi", "lo")).alias(gone))
            lists = marked.join(lost, F.col(self.key).eqNullSafe(F.col(own)) & (F.col(row) == F.col("_r")), "left")
        out = lists.withColumn(cut, _kept(self.shortest)(F.col(self.text), F.col(gone)))
        return out.select(*others, F.col(f"{cut}.text").alias(self.text), F.col(f"{cut}.n_lines"), F.col(f"{cut}.n_dropped"))


def dedup_lines(docs: DataFrame, batches: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated lines, over a new index fed in ``batches`` by
    hash of the key, as a corpus that grows would be. An empty table stays empty."""
    spark = docs.sparkSession
    index = LineIndex(spark, new_path(spark, "line-index"), key, text)
    part = F.pmod(F.xxhash64(key), F.lit(batches))
    for i in range(batches):
        index.insert(docs.where(part == i))
    return index.kept(docs)


SQL = r"""
with lines as (
  select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key
  from (select doc_id, unnest(l) line, unnest(range(len(l))) i from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents))),
firsts as (select key, min(doc_id) least from lines where length(key) >= 10 group by key),
marked as (select l.*, coalesce(f.least < l.doc_id, false) dropped from lines l left join firsts f on f.key = l.key)
select doc_id, count(*) n_lines, (count(*) filter (dropped))::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) kept_sha256
from marked group by doc_id
"""
