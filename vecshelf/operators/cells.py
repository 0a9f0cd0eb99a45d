"""An inverted index of vectors: corpus-wide clusters as cells, and neighbours
looked for in the cells nearest to a query.

The centroids are few and checked to be small, so they travel to the rows. A
round of k-means adds up one vector a centroid in each task; only those sums
are shuffled. The index holds every row under its nearest centroid. A query is
sent to the cells it probes and meets their rows there; a cell with many rows
is cut by hash of the key, one with many queries by hash of the query, so no
task holds more than a bounded block of queries whatever the cells look like.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vecshelf.operators.grouping import top_ranked
from vecshelf.operators.knn import knn
from vecshelf.operators.partial import summed
from vecshelf.operators.scoring import SCORE_DIGITS, QueryBlock, to_keys, to_matrix, unit_rows
from vecshelf.session import written

# All centroids as doubles; they go to every task.
CENTROID_BYTES = 64 << 20
# Rows for each cell that the centroids are learned from, about.
LEARN_ROWS = 256
# Rows of a cell that one task reads, and query vectors it holds, in bytes.
CELL_ROWS = 250_000
QUERY_BYTES = 64 << 20
# Queries whose exact neighbours say how many cells are needed.
SAMPLE_QUERIES = 256


def nearest(centroids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Scores of unit rows with unit centroids, at the digits that decide."""
    return np.round(unit_rows(matrix) @ centroids.T, SCORE_DIGITS)


def _vectors(corpus: DataFrame, key: str) -> DataFrame:
    return corpus.where(F.col(key).isNotNull() & F.col("vec").isNotNull()).select(F.col(key).alias("key"), "vec")


def first_seeds(corpus: DataFrame, k: int, key: str = "work_key") -> DataFrame:
    """``(key, vec)``: ``k`` rows by hash of the key."""
    return _vectors(corpus, key).orderBy(F.xxhash64("key"), "key").limit(k)


def corpus_centroids(
    corpus: DataFrame,
    k: int,
    rounds: int = 10,
    seeds: DataFrame | None = None,
    learn_rows: int | None = None,
    key: str = "work_key",
) -> np.ndarray:
    """Unit centroids of ``k`` clusters of one corpus, by spherical k-means.

    ``seeds`` is ``(key, vec)``, taken in order of the key; without it ``k``
    rows are drawn by hash. The centroids are learned from rows drawn by hash
    of the key, ``LEARN_ROWS`` a cluster about (``learn_rows`` in all; 0: every
    row). An empty cluster keeps its centroid. Ends after ``rounds``, or once
    no centroid moves. Equal scores go to the lower cluster.
    """
    seeds = first_seeds(corpus, k, key) if seeds is None else seeds
    table = seeds.toDF("key", "vec").orderBy("key").limit(k).toArrow()
    if not table.num_rows:
        return np.zeros((0, 0))
    centroids = unit_rows(to_matrix(table["vec"]))
    if centroids.nbytes > CENTROID_BYTES:
        raise ValueError(f"{centroids.shape} centroids are more than a task is sent; ask for fewer clusters")
    rows = _vectors(corpus, key)
    bound = LEARN_ROWS * k if learn_rows is None else learn_rows
    total = rows.count() if bound else 0
    if bound and total > bound:
        share = bound / total
        rows = rows.where(F.xxhash64("key", F.lit(1)) < F.lit(int(-(1 << 63) + share * (1 << 64))))
    rows = written(rows.select("vec"), "learn")
    spark, size = corpus.sparkSession, centroids.shape[1]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)

        def add(total, batch):
            matrix = to_matrix(batch.column(0))
            unit = unit_rows(matrix)
            best = nearest(sent.value, matrix).argmax(1)
            total = np.zeros((len(sent.value), size)) if total is None else total.reshape(-1, size)
            np.add.at(total, best, unit)
            return total.ravel()

        sums = summed(rows, add)
        if sums is None:
            break
        sums = sums.reshape(-1, size)
        lengths = np.linalg.norm(sums, axis=1)
        moved = centroids.copy()
        moved[lengths > 0] = sums[lengths > 0] / lengths[lengths > 0, None]
        sent.unpersist()
        done = np.abs(moved - centroids).max() <= 1e-12
        centroids = moved
        if done:
            break
    return centroids


def in_cells(corpus: DataFrame, centroids: np.ndarray, key: str = "work_key") -> DataFrame:
    """``(key, vec, cell, score)``: each row with its nearest centroid and the cosine to it."""
    rows = _vectors(corpus, key)
    sent = corpus.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = nearest(sent.value, to_matrix(batch.column(1)))
            best = scores.argmax(1)
            columns = [*batch.columns, pa.array(best, pa.int64()), pa.array(scores[np.arange(len(best)), best])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "vec", "cell", "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def cluster_corpus(
    corpus: DataFrame, k: int, rounds: int = 10, seeds: DataFrame | None = None, key: str = "work_key"
) -> tuple[DataFrame, DataFrame]:
    """``(members, centroids)`` of the whole corpus as one group: ``(key, cell,
    score)`` of every row, and ``(cell, vec)``. Every row is learned from."""
    centroids = corpus_centroids(corpus, k, rounds, seeds, 0, key)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    table = corpus.sparkSession.createDataFrame(rows, "cell long, vec array<double>")
    return in_cells(corpus, centroids, key).select(key, "cell", "score"), table


@dataclass
class CellIndex:
    """Rows of a corpus stored by cell. ``sizes`` is the number of rows of each cell."""

    spark: SparkSession
    path: str
    key: str
    centroids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def build(
        cls, corpus: DataFrame, path: str, cells: int | None = None, rounds: int = 10, seeds: DataFrame | None = None, key: str = "work_key"
    ) -> CellIndex:
        """Stores every row with a key and a vector. Without ``cells`` there are
        about as many as the square root of the number of rows, within bounds."""
        if cells is None:
            n, size = _vectors(corpus, key).agg(F.count("*"), F.max(F.size("vec"))).first()
            cells = int(max(1, min(round(n**0.5), CENTROID_BYTES // (8 * max(size or 1, 1)))))
        centroids = corpus_centroids(corpus, cells, rounds, seeds, None, key)
        spark = corpus.sparkSession
        if not len(centroids):
            rows = _vectors(corpus, key).withColumn("cell", F.lit(0).cast("long")).withColumnRenamed("key", key)
        else:
            rows = in_cells(corpus, centroids, key).drop("score")
        # rows of a cell lie together, many cells to a file, so a reader skips what it doesn't probe
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        salt = F.pmod(F.xxhash64(key), F.lit(16))
        rows.repartitionByRange(parts, "cell", salt).sortWithinPartitions("cell").write.parquet(f"{path}/rows")
        found = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell long, vec array<double>")
        found.coalesce(1).write.parquet(f"{path}/centroids")
        return cls.open(spark, path, key)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str = "work_key") -> CellIndex:
        table = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
        centroids = to_matrix(table["vec"])
        sizes = np.zeros(len(centroids), np.int64)
        for row in spark.read.parquet(f"{path}/rows").groupBy("cell").count().toLocalIterator():
            if row["cell"] < len(sizes):
                sizes[row["cell"]] = row["count"]
        return cls(spark, path, key, centroids, sizes)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def probes(self, queries: DataFrame, nprobe: int | None) -> DataFrame:
        """``(qid, vec, cell)``: each query vector with its ``nprobe`` nearest cells (None: all)."""
        sent = self.spark.sparkContext.broadcast(self.centroids)
        most = len(self.centroids) if nprobe is None else min(nprobe, len(self.centroids))
        queries = queries.where("qid is not null and vec is not null").select("qid", F.col("vec").cast("array<double>").alias("vec"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    scores = nearest(sent.value, to_matrix(part.column(1)))
                    chosen = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                    again = pa.array(np.repeat(np.arange(part.num_rows), most))
                    columns = [c.take(again) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(chosen.ravel(), pa.int64())], ["qid", "vec", "cell"])

        if not most:
            return queries.withColumn("cell", F.lit(0).cast("long")).limit(0)
        return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("cell", T.LongType())]))

    def needed(self, queries: DataFrame, n: int, recall: float = 0.9) -> int:
        """How many cells to probe so that ``recall`` of the exact ``n`` best are
        seen, measured on up to ``SAMPLE_QUERIES`` of the queries."""
        sample = queries.where("qid is not null and vec is not null").orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE_QUERIES)
        sample = written(sample.select("qid", "vec"), "sample-queries")
        exact = knn(self.rows, sample, n, key=self.key).select("qid", self.key)
        exact = exact.join(self.rows.select(self.key, "cell"), self.key)
        table = sample.toArrow()
        if not table.num_rows or not len(self.centroids):
            return 1
        scores = nearest(self.centroids, to_matrix(table["vec"]))
        places = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
        best: dict = {}
        for qid, row in zip(table["qid"].to_pylist(), places, strict=True):
            best[qid] = np.minimum(best[qid], row) if qid in best else row
        ranks = np.sort([best[r["qid"]][r["cell"]] for r in exact.toLocalIterator()])
        if not len(ranks):
            return 1
        return int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1

    def search(self, queries: DataFrame, n: int = 10, nprobe: int | None = 8) -> DataFrame:
        """``(qid, key, score, rank)``: the best rows of the probed cells by cosine.

        ``nprobe=None`` probes all cells, which is exact. A ``qid`` with several
        vectors scores a row by the nearest of them. Order is score
        descending, then key.
        """
        key, rows = self.key, self.rows
        probes = written(self.probes(queries, nprobe), "probes")
        size = self.centroids.shape[1] if len(self.centroids) else 1
        per_block = max(1, QUERY_BYTES // (8 * size))
        plan = [
            (cell, max(1, -(-int(self.sizes[cell]) // CELL_ROWS)), max(1, -(-asked // per_block)))
            for cell, asked in ((r["cell"], r["count"]) for r in probes.groupBy("cell").count().toLocalIterator())
        ]
        plan = self.spark.createDataFrame(plan, "cell long, salts int, blocks int")
        # one narrow row a cell, and cells are bounded by the bytes of their centroids
        plan = F.broadcast(plan)
        qtype, ktype = probes.schema["qid"].dataType, rows.schema[key].dataType

        def side(df: DataFrame, number: int, salt, block) -> DataFrame:
            return df.join(plan, "cell").select(
                "cell",
                salt.alias("salt"),
                block.alias("block"),
                F.lit(number).alias("side"),
                (F.col("qid") if number == 0 else F.lit(None).cast(qtype)).alias("qid"),
                (F.col(key) if number else F.lit(None).cast(ktype)).alias("key"),
                F.col("vec").cast("array<double>").alias("vec"),
            )

        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        asking = side(probes, 0, every("salts"), F.pmod(F.xxhash64("qid"), "blocks").cast("int"))
        asked = side(rows, 1, F.pmod(F.xxhash64(key), "salts").cast("int"), every("blocks"))
        both = asking.unionByName(asked).repartition("cell", "salt", "block")
        both = both.sortWithinPartitions("cell", "salt", "block", "side", "qid")
        schema = T.StructType([T.StructField("qid", qtype), T.StructField(key, ktype), T.StructField("score", T.DoubleType())])
        hits = both.mapInArrow(_meet(n, to_arrow_type(qtype), to_arrow_type(ktype), key), schema)
        # a query with several vectors meets a row once in each cell, at its best
        return top_ranked(hits, "qid", n, [F.col("score").desc(), F.col(key).asc()])


def _meet(n: int, qtype: pa.DataType, ktype: pa.DataType, key: str):
    """Rows by cell: a block of queries, then the rows that they are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = block = None
        qids: list = []
        vecs: list = []

        def out() -> pa.RecordBatch:
            owner, keys, scores = block.best()
            columns = [pa.array(block.owners[owner].tolist(), qtype), pa.array(list(keys), ktype), pa.array(scores)]
            return pa.RecordBatch.from_arrays(columns, ["qid", key, "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            edges = [0, *(np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1).tolist(), len(place)]
            for a, b in zip(edges, edges[1:], strict=False):
                part, cell = batch.slice(a, b - a), tuple(place[a, :3])
                if cell != now:
                    if block is not None:
                        yield out()
                    now, block, qids, vecs = cell, None, [], []
                if place[a, 3] == 0:
                    qids.append(to_keys(part.column(4)))
                    vecs.append(to_matrix(part.column(6)))
                elif qids:
                    if block is None:
                        block = QueryBlock(np.concatenate(qids), np.concatenate(vecs), n, "cosine", None)
                        none = block.exclusions(np.empty(0, object), np.empty(0, object))
                    for _ in block.feed(to_keys(part.column(5)), None, to_matrix(part.column(6)), none, none):
                        pass
        if block is not None:
            yield out()

    return run


def recall(found: DataFrame, exact: DataFrame, key: str = "work_key") -> DataFrame:
    """``(qid, recall)``: the share of the exact neighbours of each query that were found."""
    hits = exact.select("qid", key).join(found.select("qid", key, F.lit(1).alias("hit")), ["qid", key], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def knn_approx(
    corpus: DataFrame, queries: DataFrame, path: str, n: int = 10, nprobe: int | None = None, least: float = 0.9, cells: int | None = None, key: str = "work_key"
) -> DataFrame:
    """Builds an index of ``corpus`` under ``path`` and searches it; without
    ``nprobe`` as many cells are probed as ``least`` recall asks for."""
    index = CellIndex.build(corpus, path, cells, key=key)
    return index.search(queries, n, index.needed(queries, n, least) if nprobe is None else nprobe)
