"""Exact nearest neighbours of many queries over a corpus.

Neither side is joined to the other row by row. The side that fits a checked
bound travels to the partitions of the other: few queries to the corpus, which
is scored in place, or a small corpus to the queries, which are dealt out once.
Beyond both bounds the two sides are cut into a grid of cells; a cell holds one
bounded block of queries in memory and streams its corpus rows past it. Either
way a task emits only its best ``n`` per query, and one window merges those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecshelf.operators.grouping import aggregate, top_ranked
from vecshelf.operators.scoring import SCORE_DIGITS, QueryBlock, row_scores, to_keys, to_matrix, unit_rows
from vecshelf.session import written

METRICS = ("cosine", "dot", "mean_cosine", "l2")

# Size bounds for sending one side to every task. A first look takes at most
# FIRST_LOOK queries; more are written out and measured before they are read.
FIRST_LOOK = 4096
BROADCAST_BYTES = 64 << 20
BROADCAST_EXCLUSIONS, EXCLUSION_BYTES = 1_000_000, 64 << 20
# A corpus up to this size is sent to the queries where those are too many.
CORPUS_BYTES = 128 << 20
# A grid cell holds this many bytes of query vectors, and about this many
# corpus rows pass through it.
CELL_QUERY_BYTES = 128 << 20
CELL_CORPUS_ROWS = 250_000

_QUERY, _GROUP_OUT, _KEY_OUT, _CORPUS = range(4)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    n: int = 10,
    *,
    exclude: DataFrame | None = None,
    exclude_groups: DataFrame | None = None,
    key: str = "work_key",
    group: str = "author",
    where=None,
    metric: str = "cosine",
    against: DataFrame | None = None,
    lam: float = 0.0,
    avoid: float | None = None,
    min_near: tuple[int, float] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    corpus_bytes: int | None = None,
) -> DataFrame:
    """The ``n`` best corpus rows per query: ``(qid, key, score, rank)``.

    A ``qid`` with several vectors scores a corpus row by the nearest of them.

    ``queries`` is ``(qid, vec)``; ``exclude`` is ``(qid, key)`` and
    ``exclude_groups`` is ``(qid, group)``, both taken out before ranking.
    ``where`` filters the corpus before scoring. Order is score descending,
    then key. Metrics: ``cosine``, ``dot``, ``mean_cosine`` (unit corpus rows
    against the query as given) and ``l2`` (negated distance).

    ``against`` is ``(qid, vec)`` of what a query should keep away from: a row
    loses ``lam`` times its highest cosine to any of them, and is left out where
    that cosine reaches ``avoid``. ``min_near=(m, floor)`` asks for at least ``m``
    of the query's vectors at ``floor`` or nearer. These two look at each corpus
    row with all of a query's vectors at once, so they stream the queries past
    the corpus, which is dealt out in blocks if it is large, and no pair leaves
    the kernel.
    """
    if against is not None or min_near is not None:
        found = _past_corpus(
            corpus, queries, n, exclude, exclude_groups, key, group, where, metric,
            _Extra(against, lam, avoid, min_near), corpus_bytes or CORPUS_BYTES,
        )
        return top_ranked(found, "qid", n, [F.col("score").desc(), F.col(key).asc()])
    hits = _search(
        corpus, queries, n, None, exclude, exclude_groups, key, group, where, metric,
        broadcast_bytes, CORPUS_BYTES if corpus_bytes is None else corpus_bytes,
    )
    return top_ranked(hits, "qid", n, [F.col("score").desc(), F.col(key).asc()])


def within(
    corpus: DataFrame,
    queries: DataFrame,
    floor: float,
    *,
    key: str = "work_key",
    where=None,
    metric: str = "cosine",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every ``(qid, key, score, near)`` whose score reaches the finite ``floor``.

    A query with several vectors has one row per key: the score of the nearest of
    them, and in ``near`` how many are at the floor or nearer.
    """
    return _search(
        corpus, queries, None, floor, None, None, key, "author", where, metric, broadcast_bytes, 0
    )


def _search(
    corpus, queries, n, floor, exclude, exclude_groups, key, group, where, metric, broadcast_bytes,
    corpus_bytes,
) -> DataFrame:
    given = corpus, queries, exclude, exclude_groups
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if where is not None:
        corpus = corpus.where(where)
    columns = [F.col(key).alias("key"), F.col("vec")]
    if exclude_groups is not None:
        columns.append(F.col(group).alias("group"))
    corpus = corpus.where(F.col(key).isNotNull() & F.col("vec").isNotNull()).select(*columns)
    queries = queries.where("qid is not null and vec is not null").select("qid", "vec")
    if exclude is not None:
        exclude = exclude.select("qid", F.col(key).alias("key")).where("qid is not null and key is not null")
    if exclude_groups is not None:
        exclude_groups = exclude_groups.select("qid", F.col(group).alias("group")).where(
            "qid is not null and group is not null"
        )
    schema = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField(key, corpus.schema["key"].dataType),
            T.StructField("score", T.DoubleType()),
            *([] if floor is None else [T.StructField("near", T.LongType())]),
        ]
    )
    small = _bounded(queries, FIRST_LOOK) if broadcast_bytes else None
    if small is None:
        queries = written(queries, "knn-queries")
        size = _vector_bytes(queries)
        small = queries.toArrow() if size <= broadcast_bytes else None
    elif small.nbytes > broadcast_bytes:
        queries, small = written(queries, "knn-queries"), None
    if small is not None:
        keys_out = _pairs(exclude, "key")
        groups_out = _pairs(exclude_groups, "group")
        if keys_out is not None and groups_out is not None:
            return _by_broadcast(corpus, small, n, floor, keys_out, groups_out, metric, schema)
    if floor is None and corpus_bytes and _vector_bytes(corpus) <= corpus_bytes:
        return _past_corpus(
            given[0], queries, n, given[2], given[3], key, group, where, metric, _Extra(), corpus_bytes
        )
    return _by_grid(corpus, queries, n, floor, exclude, exclude_groups, metric, schema)


def _bounded(df: DataFrame, rows: int) -> pa.Table | None:
    """The whole of ``df`` if it has at most ``rows`` rows, else None."""
    if rows <= 0:
        return None
    table = df.limit(rows + 1).toArrow()
    return table if table.num_rows <= rows else None


def _vector_bytes(queries: DataFrame) -> int:
    """Bytes the vectors take up as a float64 matrix."""
    return 8 * (queries.agg(F.sum(F.size("vec").cast("long"))).first()[0] or 0)


def _pairs(df: DataFrame | None, column: str):
    """All (query, value) pairs, if their number and bytes are counted to be few."""
    if df is None:
        return np.empty(0, object), np.empty(0, object)
    pairs = df.select("qid", column)
    size = F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in pairs.columns), F.lit(0)))
    count, size = pairs.agg(F.count("*"), size).first()
    if count > BROADCAST_EXCLUSIONS or (size or 0) > EXCLUSION_BYTES:
        return None
    table = pairs.toArrow()
    return to_keys(table["qid"]), to_keys(table[column])


def _emit(block: QueryBlock, found, schema: pa.Schema) -> pa.RecordBatch:
    columns = [block.owners[found[0]].tolist(), found[1].tolist(), *found[2:]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _by_broadcast(corpus, queries: pa.Table, n, floor, keys_out, groups_out, metric, schema):
    out = _arrow_schema(schema)
    shared = corpus.sparkSession.sparkContext.broadcast(
        (to_keys(queries["qid"]), to_matrix(queries["vec"]), keys_out, groups_out)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix, keys_out, groups_out = shared.value
        if not len(qids):
            return
        block = QueryBlock(qids, matrix, n, metric, floor)
        by_key, by_group = block.exclusions(*keys_out), block.exclusions(*groups_out)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = to_keys(batch["group"]) if "group" in batch.schema.names else None
            found = block.feed(to_keys(batch["key"]), groups, to_matrix(batch["vec"]), by_key, by_group)
            for hit in found:
                yield _emit(block, hit, out)
        if n is not None:
            yield _emit(block, block.best(), out)

    return corpus.mapInArrow(score, schema)


def _by_grid(corpus, queries, n, floor, exclude, exclude_groups, metric, schema):
    spark = corpus.sparkSession
    n_queries, dim = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    n_corpus = corpus.count()
    per_block = max(1, CELL_QUERY_BYTES // (8 * max(dim or 1, 1)))
    q_blocks = max(1, -(-n_queries // per_block))
    cores = spark.sparkContext.defaultParallelism
    c_blocks = max(1, -(-n_corpus // CELL_CORPUS_ROWS), -(-cores // q_blocks))

    def block_of(blocks: int, *columns):
        return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")

    # A query with more vectors than a cell holds is salted over several.
    large = (
        queries.groupBy("qid")
        .count()
        .where(F.col("count") > per_block)
        .select("qid", F.ceil(F.col("count") / per_block).alias("salts"))
    )
    salt = F.coalesce(F.pmod(F.xxhash64("vec"), "salts"), F.lit(0))
    queries = queries.join(large, "qid", "left").withColumn("qb", block_of(q_blocks, "qid", salt))
    homes = queries.select("qid", "qb").distinct()
    c_block = block_of(c_blocks, "key")
    every_q = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    every_c = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    types = {
        "qid": queries.schema["qid"].dataType,
        "key": corpus.schema["key"].dataType,
        "group": corpus.schema["group"].dataType if "group" in corpus.columns else T.StringType(),
        # corpus rows are copied once a block, in the type they have; queries once
        "vec": corpus.schema["vec"].dataType,
        "wish": T.ArrayType(T.DoubleType()),
    }

    def rows(df, side):
        present = {
            name: F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
            for name, kind in types.items()
        }
        return df.select(
            (F.col("qb").cast("long") * c_blocks + F.col("cb")).alias("cell"),
            F.lit(side).alias("side"),
            *[c.alias(name) for name, c in present.items()],
        )

    parts = [
        rows(queries.withColumnRenamed("vec", "wish").withColumn("cb", every_c), _QUERY),
        rows(corpus.withColumn("cb", c_block).withColumn("qb", every_q), _CORPUS),
    ]
    if exclude_groups is not None:
        parts.append(
            rows(
                exclude_groups.distinct().join(homes, "qid").withColumn("cb", every_c),
                _GROUP_OUT,
            )
        )
    if exclude is not None:
        # Only keys that the corpus has, each beside its group in the sort order.
        known = exclude.distinct().join(corpus.drop("vec"), "key")
        parts.append(rows(known.join(homes, "qid").withColumn("cb", c_block), _KEY_OUT))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    parts = grid_partitions(q_blocks * c_blocks, cores)
    home = F.pmod("cell", F.lit(parts)).cast("int")
    cells = cells.repartitionById(parts, home).sortWithinPartitions(
        "cell", F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "side"
    )
    out = _arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Cell(n, floor, metric)
        for batch in batches:
            for segment in _runs(batch, "cell"):
                if state.cell != segment["cell"][0].as_py():
                    yield from state.close(out)
                    state = _Cell(n, floor, metric, segment["cell"][0].as_py())
                yield from state.take(segment, out)
        yield from state.close(out)

    hits = cells.mapInArrow(score, schema)
    if large.isEmpty():
        return hits
    # Vectors of a salted query were scored in several cells.
    merged = [F.max("score").alias("score")]
    if n is None:
        merged.append(F.sum("near").alias("near"))
    return aggregate(hits, ["qid", schema.fieldNames()[1]], *merged)


def grid_partitions(cells: int, cores: int) -> int:
    """Shuffle partitions of a grid: one a cell, but no more than keep the cores
    busy for a while; a partition reads several cells one after the other."""
    return max(1, min(cells, 32 * cores))


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    values = to_keys(batch[column])
    if not len(values):
        return
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)]
    for start, stop in zip(edges, edges[1:]):
        yield batch.slice(start, stop - start)


class _Cell:
    """One grid cell read in sort order: its queries, then corpus rows by group
    and key, every exclusion directly ahead of the rows it applies to. Only the
    exclusions of the group and key being read are carried between batches."""

    def __init__(self, n, floor, metric, cell=None):
        self.n, self.floor, self.metric, self.cell = n, floor, metric, cell
        self.qids: list[np.ndarray] = []
        self.vecs: list[np.ndarray] = []
        self.block: QueryBlock | None = None
        self.key_out = (np.empty(0, object), np.empty(0, object))
        self.group_out = (np.empty(0, object), np.empty(0, object))

    def take(self, segment: pa.RecordBatch, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        side = to_keys(segment["side"])
        is_query = np.flatnonzero(side == _QUERY)
        if len(is_query):
            mine = segment.take(pa.array(is_query))
            self.qids.append(to_keys(mine["qid"]))
            self.vecs.append(to_matrix(mine["wish"]))
        if len(is_query) == len(side) or not self.qids:
            return
        if self.block is None:
            self.block = QueryBlock(
                np.concatenate(self.qids), np.concatenate(self.vecs), self.n, self.metric, self.floor
            )
        self.key_out = self._extend(self.key_out, segment, side == _KEY_OUT, "key")
        self.group_out = self._extend(self.group_out, segment, side == _GROUP_OUT, "group")
        rows = segment.take(pa.array(np.flatnonzero(side == _CORPUS)))
        if rows.num_rows:
            found = self.block.feed(
                to_keys(rows["key"]),
                to_keys(rows["group"]),
                to_matrix(rows["vec"]),
                self.block.exclusions(*self.key_out),
                self.block.exclusions(*self.group_out),
            )
            for hit in found:
                yield _emit(self.block, hit, out)
        self.key_out = self._carry(self.key_out, segment["key"][-1].as_py())
        self.group_out = self._carry(self.group_out, segment["group"][-1].as_py())

    @staticmethod
    def _extend(pairs, segment, chosen, column):
        rows = segment.take(pa.array(np.flatnonzero(chosen)))
        fresh = to_keys(rows["qid"]), to_keys(rows[column])
        if not len(pairs[0]):
            return fresh
        return tuple(np.concatenate(both) for both in zip(pairs, fresh)) if rows.num_rows else pairs

    @staticmethod
    def _carry(pairs, last):
        keep = pairs[1] == last
        return pairs[0][keep], pairs[1][keep]

    def close(self, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.block is not None and self.n is not None:
            yield _emit(self.block, self.block.best(), out)


@dataclass
class _Extra:
    """What a query asks for beyond its score."""

    against: DataFrame | None = None
    lam: float = 0.0
    avoid: float | None = None
    min_near: tuple[int, float] | None = None

    def plain(self) -> tuple:
        return self.lam, self.avoid, self.min_near


_WISH, _AGAINST, _NO_KEY, _NO_GROUP = range(4)


def _past_corpus(
    corpus, queries, n, exclude, exclude_groups, key, group, where, metric, extra, corpus_bytes
) -> DataFrame:
    """Streams the queries, with all that concerns them beside them, past the
    corpus: every task holds all of it if it takes ``corpus_bytes`` at most,
    else one block of it (see ``_past_blocks``)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = corpus.sparkSession
    if where is not None:
        corpus = corpus.where(where)
    groups = F.col(group) if exclude_groups is not None else F.lit(None).cast("string")
    corpus = corpus.where(F.col(key).isNotNull() & F.col("vec").isNotNull()).select(
        F.col(key).alias("key"), groups.alias("group"), "vec"
    )
    types = {
        "qid": queries.schema["qid"].dataType,
        "key": corpus.schema["key"].dataType,
        "group": corpus.schema["group"].dataType,
        "vec": T.ArrayType(T.DoubleType()),
    }

    def rows(df, side, **columns):
        named = {name: F.col(columns[name]) if name in columns else F.lit(None) for name in types if name != "qid"}
        known = df.where(" and ".join(f"`{c}` is not null" for c in ("qid", *columns.values())))
        return known.select(
            F.col("qid").cast(types["qid"]).alias("qid"),
            F.lit(side).alias("side"),
            *[c.cast(types[name]).alias(name) for name, c in named.items()],
        )

    parts = [rows(queries, _WISH, vec="vec")]
    if extra.against is not None:
        parts.append(rows(extra.against, _AGAINST, vec="vec"))
    if exclude is not None:
        parts.append(rows(exclude, _NO_KEY, key=key).distinct())
    if exclude_groups is not None:
        parts.append(rows(exclude_groups, _NO_GROUP, group=group).distinct())
    dealt = parts[0]
    for part in parts[1:]:
        dealt = dealt.unionByName(part)
    schema = T.StructType(
        [
            T.StructField("qid", types["qid"]),
            T.StructField(key, types["key"]),
            T.StructField("score", T.DoubleType()),
        ]
    )
    asked = (n, metric, *extra.plain())
    size, cores = _vector_bytes(corpus), spark.sparkContext.defaultParallelism
    if size > corpus_bytes:
        return _past_blocks(corpus, dealt, -(-2 * size // corpus_bytes), cores, asked, schema)
    if not size:
        return spark.createDataFrame([], schema)
    dealt = dealt.repartition(4 * cores, "qid").sortWithinPartitions("qid", "side")
    out = _arrow_schema(schema)
    # measured just above
    shared = spark.sparkContext.broadcast(_block([corpus.toArrow()]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(shared.value, *asked)
        for batch in batches:
            for segment in _runs(batch, "qid"):
                yield from sweep.next(segment, out)
        yield from sweep.end(out)

    return dealt.mapInArrow(score, schema)


def _block(tables: list) -> tuple:
    """Corpus rows as (keys, groups, vectors)."""
    return tuple(
        np.concatenate([read(t[name]) for t in tables])
        for name, read in (("key", to_keys), ("group", to_keys), ("vec", to_matrix))
    )


def _past_blocks(corpus, dealt, blocks: int, cores: int, asked: tuple, schema) -> DataFrame:
    """The corpus and the queries in a grid of cells. A cell holds one block of
    the corpus, by hash of the key, and streams its share of the queries past
    it; all rows of a query meet the block in one cell, so a corpus row has its
    nearest wish, nearest dislike and count of near ones there. A block's
    vectors take about half of the bytes that gave ``blocks``."""
    shares = max(1, -(-4 * cores // blocks))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))

    def cell(row_block, row_share):
        return (row_share.cast("long") * blocks + row_block).alias("cell")

    held = corpus.select("*", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("b"), every_share.alias("s"))
    asking = dealt.select("*", every_block.alias("b"), F.pmod(F.xxhash64("qid"), F.lit(shares)).alias("s"))
    # wishes travel in their own column: corpus rows keep the type they have
    asking = asking.select(cell(F.col("b"), F.col("s")), "qid", "side", "key", "group", F.col("vec").alias("wish"))
    held = held.select(cell(F.col("b"), F.col("s")), F.lit(-1).alias("side"), "key", "group", "vec")
    cells = asking.unionByName(held, allowMissingColumns=True)
    parts = grid_partitions(blocks * shares, cores)
    home = F.pmod("cell", F.lit(parts)).cast("int")
    # a cell's corpus rows have no qid, so they come first
    cells = cells.repartitionById(parts, home).sortWithinPartitions("cell", F.col("qid").asc_nulls_first(), "side")
    out = _arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, sweep = None, [], None
        for batch in batches:
            for segment in _runs(batch, "cell"):
                if segment["cell"][0].as_py() != number:
                    if sweep is not None:
                        yield from sweep.end(out)
                    number, rows, sweep = segment["cell"][0].as_py(), [], None
                mine = to_keys(segment["side"]) < 0
                if mine.any():
                    kept = segment.take(pa.array(np.flatnonzero(mine)))
                    rows.append({"key": kept["key"], "group": kept["group"], "vec": kept["vec"]})
                asks = segment.take(pa.array(np.flatnonzero(~mine)))
                if not asks.num_rows or (sweep is None and not rows):
                    continue
                if sweep is None:
                    sweep, rows = _Sweep(_block(rows), *asked), []
                asks = asks.drop_columns(["vec"]).rename_columns({"wish": "vec"})
                for part in _runs(asks, "qid"):
                    yield from sweep.next(part, out)
        if sweep is not None:
            yield from sweep.end(out)

    return cells.mapInArrow(score, schema)


class _Sweep:
    """Scores one query after the other against a block of the corpus; a query's
    rows come in the order of their sides, over any number of batches."""

    def __init__(self, block, n, metric, lam, avoid, min_near):
        self.keys, self.groups, self.corpus = block
        self.units = unit_rows(self.corpus, np.nan)
        self.n, self.metric, self.lam, self.avoid, self.min_near = n, metric, lam, avoid, min_near
        self.key_at = {k: i for i, k in enumerate(self.keys.tolist())}
        self.group_at: dict = {}
        for i, g in enumerate(self.groups.tolist()):
            self.group_at.setdefault(g, []).append(i)
        self.qid = None
        self.held = 0
        self.found: list[tuple] = []

    def take(self, segment: pa.RecordBatch) -> None:
        if self.qid is None:
            self.qid = segment["qid"][0].as_py()
            self.best = np.full(len(self.keys), -np.inf)
            self.near = np.zeros(len(self.keys), np.int64)
            self.close_to = np.full(len(self.keys), -np.inf)
            self.out = np.zeros(len(self.keys), bool)
        side = to_keys(segment["side"])

        def mine(wanted: int) -> pa.RecordBatch:
            return segment.take(pa.array(np.flatnonzero(side == wanted)))

        for start in range(0, len(wishes := to_matrix(mine(_WISH)["vec"])), 256):
            scores = row_scores(wishes[start : start + 256], self.corpus, self.metric)
            self.best = np.maximum(self.best, scores.max(axis=0))
            if self.min_near:
                self.near += (scores >= self.min_near[1]).sum(axis=0)
        for start in range(0, len(others := to_matrix(mine(_AGAINST)["vec"])), 256):
            scores = np.round(unit_rows(others[start : start + 256], np.nan) @ self.units.T, SCORE_DIGITS)
            scores[np.isnan(scores)] = -np.inf
            self.close_to = np.maximum(self.close_to, scores.max(axis=0))
        for k in mine(_NO_KEY)["key"].to_pylist():
            if k in self.key_at:
                self.out[self.key_at[k]] = True
        for g in mine(_NO_GROUP)["group"].to_pylist():
            self.out[self.group_at.get(g, [])] = True

    def close(self) -> None:
        if self.qid is None:
            return
        scores, touched = self.best, self.close_to > -np.inf
        if self.lam:
            scores = np.where(touched, scores - self.lam * np.where(touched, self.close_to, 0), scores)
            scores = np.round(scores, SCORE_DIGITS)
        drop = self.out.copy()
        if self.avoid is not None:
            drop |= touched & (self.close_to >= self.avoid)
        if self.min_near:
            drop |= self.near < self.min_near[0]
        at = np.flatnonzero(~drop & (scores > -np.inf))
        if len(at) > self.n:
            # all that tie with the n-th stay in, the key decides later
            bound = np.partition(scores[at], len(at) - self.n)[len(at) - self.n]
            at = at[scores[at] >= bound]
            named = self.keys[at]
            place = np.unique(named, return_inverse=True)[1] if named.dtype == object else named
            order = np.lexsort((place, -scores[at]))[: self.n]
            at = at[order]
        self.found.append((self.qid, self.keys[at], scores[at]))
        self.held += len(at)
        self.qid = None

    def next(self, segment: pa.RecordBatch, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Takes rows of one query; sends on what earlier ones found, if it is much."""
        if self.qid is not None and self.qid != segment["qid"][0].as_py():
            self.close()
            if self.held >= 1 << 16:
                yield self.flush(out)
        self.take(segment)

    def end(self, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.close()
        yield self.flush(out)

    def flush(self, out: pa.Schema) -> pa.RecordBatch:
        qids = [q for q, keys, _ in self.found for _ in range(len(keys))]
        keys = [k for _, keys, _ in self.found for k in keys.tolist()]
        scores = [s for _, _, scores in self.found for s in scores.tolist()]
        self.found, self.held = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip((qids, keys, scores), out)], schema=out
        )
