"""Taste clusters: spherical k-means over every user's liked vectors at once.

The likes are dealt out by user once. A user whose vectors fit a cell is
clustered from seeds to convergence inside one task. Only a user with very many
likes is salted over several cells and goes round by round: a cell sees the
user's few centroids and streams its points past them, sending on one partial
sum per centroid instead of its points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecshelf.functions.vector import dot, l2_normalize
from vecshelf.operators.centroid import vector_sum
from vecshelf.operators.grouping import aggregate, canonical, top_ranked
from vecshelf.operators.knn import knn
from vecshelf.operators.recommend import rated_authors, rated_exclusions
from vecshelf.operators.scoring import SCORE_DIGITS, to_keys, to_matrix, unit_rows
from vecshelf.session import written

# A user with more likes than this, or more bytes of vectors, is salted.
CELL_POINTS = 50_000
CELL_BYTES = 64 << 20
# Rounds after which k-means gives up; it has always settled long before.
ROUNDS = 200


def liked_points(ratings: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(user, input_text, rating)``: positively rated texts that have a vector."""
    liked = aggregate(
        ratings.where("rating > 0"), ["user", "input_text"], F.max("rating").alias("rating")
    )
    return liked.join(vectors.select("input_text"), "input_text", "left_semi")


@dataclass
class Likes:
    """Every user's liked vectors with the number of the user's ``likes`` and
    the number of cells (``salts``) they are dealt over."""

    points: DataFrame
    sizes: DataFrame

    @classmethod
    def of(cls, ratings: DataFrame, vectors: DataFrame) -> "Likes":
        liked = liked_points(ratings, vectors)
        dim = vectors.agg(F.max(F.size("vec"))).first()[0] or 1
        most = max(1, min(CELL_POINTS, CELL_BYTES // (8 * dim)))
        sizes = written(
            liked.groupBy("user")
            .agg(F.count("*").alias("likes"))
            .withColumn("salts", F.ceil(F.col("likes") / most)),
            "like-sizes",
        )
        points = (
            liked.join(vectors.select("input_text", "vec"), "input_text")
            .join(sizes, "user")
            .select(
                "user",
                "input_text",
                "rating",
                "likes",
                "salts",
                F.pmod(F.xxhash64("input_text"), "salts").alias("salt"),
                "vec",
            )
        )
        return cls(written(points, "likes"), sizes)

    def salted(self) -> "Likes":
        return Likes(self.points.where("salts > 1"), self.sizes.where("salts > 1"))


def cluster_preferences(
    ratings: DataFrame,
    vectors: DataFrame,
    k: int = 3,
    iters: int = ROUNDS,
    min_size: int = 2,
    tolerance: float = 1e-9,
) -> tuple[DataFrame, DataFrame]:
    """``(members, centroids)`` of up to ``k`` clusters per user.

    Members are ``(user, cluster, input_text, score, next_score)`` with the
    cosine to the own and to the next centroid; centroids are
    ``(user, cluster, vec)``. Seeds are farthest-first from the strongest like,
    and ``k`` is lowered so that a cluster has ``min_size`` likes on average. A
    centroid that loses all points stays where it is. Rounds go on until no
    centroid moves; it is an error if ``iters`` of them are not enough.
    """
    members, centroids = _clustered(ratings, vectors, (k,), iters, min_size, tolerance)
    return members.drop("k"), centroids.drop("k")


def _clustered(ratings, vectors, ks, iters, min_size, tolerance) -> tuple[DataFrame, DataFrame]:
    """Members and centroids for each of ``ks``, told apart by a column ``k``."""
    likes = Likes.of(ratings, vectors)
    both = written(_whole_users(likes, ks, iters, min_size, tolerance), "clusters")
    members = both.where("vec is null").drop("vec")
    centroids = both.where("vec is not null").select("user", "k", "cluster", "vec")
    salted = likes.salted()
    if salted.sizes.head(1):
        seeds = _seeds(salted, max(ks), min_size)
        for k in ks:
            found, heads = _rounds(salted, seeds, k, iters, min_size, tolerance)
            members = members.unionByName(found.withColumn("k", F.lit(k)))
            centroids = centroids.unionByName(heads.withColumn("k", F.lit(k)))
    return members, centroids


def own_k(k: int, min_size: int):
    """Clusters that a user with so many ``likes`` gets of ``k``."""
    return F.greatest(F.lit(1), F.least(F.lit(k), F.floor(F.col("likes") / min_size)))


def _whole_users(likes: Likes, ks, iters, min_size, tolerance) -> DataFrame:
    """Users that fit a cell: members, and centroids in rows with a ``vec``."""
    points = likes.points.where("salts = 1").select("user", "input_text", "rating", "vec")
    schema = T.StructType(
        [
            points.schema["user"],
            T.StructField("k", T.IntegerType()),
            T.StructField("cluster", T.IntegerType()),
            points.schema["input_text"],
            T.StructField("score", T.DoubleType()),
            T.StructField("next_score", T.DoubleType()),
            T.StructField("vec", _VEC),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        user, held = None, []

        def settled() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            vectors = unit_rows(to_matrix(table["vec"]))
            strength, texts = to_keys(table["rating"]), table["input_text"]
            seeds = _seed_rows(vectors, strength, max(ks))
            for k in ks:
                mine = max(1, min(k, len(vectors) // min_size))
                heads = _settle(vectors, vectors[seeds[:mine]], iters, tolerance)
                ids, rows, own, following = _assignments(np.arange(len(heads)), heads, vectors, np.arange(len(vectors)))
                n, m = len(vectors), len(heads)
                columns = [
                    [user] * (n + m),
                    [k] * (n + m),
                    [*ids.tolist(), *range(m)],
                    [*texts.to_pylist(), *[None] * m],
                    [*own.tolist(), *[None] * m],
                    [*(None if np.isnan(x) else x for x in following.tolist()), *[None] * m],
                    [*[None] * n, *heads.tolist()],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            owners = to_keys(batch["user"])
            cuts = np.flatnonzero(owners[1:] != owners[:-1]) + 1 if len(owners) else []
            edges = [0, *list(cuts), len(owners)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if held and owners[start] != user:
                    yield from settled()
                    held = []
                user = owners[start] if not hasattr(owners[start], "item") else owners[start].item()
                held.append(batch.slice(start, stop - start))
        if held:
            yield from settled()

    dealt = points.repartition("user").sortWithinPartitions("user", "input_text")
    return dealt.mapInArrow(run, schema)


def _seed_rows(vectors: np.ndarray, strength: np.ndarray, k: int) -> list[int]:
    """Rows in text order: the strongest, then each time the one farthest from
    all so far. The seeds of fewer clusters are the first of these."""
    seeds = [int(np.argmax(strength))]
    closest = np.round(vectors @ vectors[seeds[0]], SCORE_DIGITS)
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(np.argmin(closest)))
        closest = np.maximum(closest, np.round(vectors @ vectors[seeds[-1]], SCORE_DIGITS))
    return seeds


def _settle(vectors: np.ndarray, heads: np.ndarray, iters: int, tolerance: float) -> np.ndarray:
    for _ in range(iters):
        _, best = _nearest(heads, vectors)
        moved = heads.copy()
        for c in np.unique(best):
            total = vectors[best == c].sum(0)
            length = np.linalg.norm(total)
            moved[c] = total / length if length else heads[c]
        still = (1 - np.einsum("ij,ij->i", heads, moved)).max() <= tolerance
        heads = moved
        if still:
            return heads
    raise RuntimeError(f"k-means has not settled after {iters} rounds")


def _rounds(likes: Likes, seeds: DataFrame, k: int, iters: int, min_size: int, tolerance: float):
    """Members and centroids of salted users, round by round."""
    ranks = likes.sizes.select("user", own_k(k, min_size).alias("own"))
    centroids = seeds.join(ranks, "user").where("cluster < own").select("user", "cluster", "vec")
    for _ in range(iters):
        step = _per_cell(likes.points, likes.sizes, centroids, _partial_sums, _SUMS)
        moved = vector_sum(step, ["user", "cluster"]).withColumnRenamed("vec", "sum")
        centroids = written(
            centroids.select("user", "cluster", "vec")
            .join(moved, ["user", "cluster"], "left")
            .withColumn("next", F.coalesce(l2_normalize("sum"), "vec"))
            .select(
                "user", "cluster", F.col("next").alias("vec"), (1 - dot("vec", "next")).alias("shift")
            ),
            "centroids",
        )
        if not centroids.where(F.col("shift") > tolerance).head(1):
            break
    else:
        raise RuntimeError(f"k-means has not settled after {iters} rounds")
    centroids = centroids.select("user", "cluster", "vec")
    return _per_cell(likes.points, likes.sizes, centroids, _assignments, _MEMBERS), centroids


def _seeds(likes: Likes, k: int, min_size: int) -> DataFrame:
    """Start at each user's strongest like, then add the like farthest from all seeds."""
    order = [-F.col("rating"), F.col("input_text")]
    first = canonical(likes.points.select("user", "input_text", "rating", "vec"), ["user"], order)
    start = first.select("user", F.lit(0).alias("cluster"), l2_normalize("vec").alias("vec"))
    seeds = written(start, "seeds")
    for number in range(1, k):
        open_points = likes.points.where(own_k(k, min_size) > number)
        far = _per_cell(open_points, likes.sizes, seeds, _farthest, _FAR)
        pick = canonical(far, ["user"], [F.col("score"), F.col("input_text")])
        added = pick.select("user", F.lit(number).alias("cluster"), "vec")
        seeds = seeds.unionByName(written(added, "seeds"))
    return seeds


_VEC = T.ArrayType(T.DoubleType())
_SUMS = [("cluster", T.IntegerType()), ("vec", _VEC)]
_FAR = [("input_text", T.StringType()), ("score", T.DoubleType()), ("vec", _VEC)]
_MEMBERS = [
    ("cluster", T.IntegerType()),
    ("input_text", T.StringType()),
    ("score", T.DoubleType()),
    ("next_score", T.DoubleType()),
]


def _per_cell(
    points: DataFrame, sizes: DataFrame, centroids: DataFrame, visit: Callable, fields: list
) -> DataFrame:
    """Run ``visit(centroid ids, centroids, unit vectors, row numbers)`` on the points
    of each cell, batch by batch, with the user's centroids read ahead of them.
    ``input_text`` is returned as row numbers and filled in from the batch."""
    user = points.schema["user"]
    schema = T.StructType([user, *[T.StructField(name, kind) for name, kind in fields]])
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    heads = centroids.join(sizes, "user").select(
        "user", salt, F.lit(0).alias("side"), "cluster", F.col("vec").alias("centroid")
    )
    body = points.select("user", "salt", F.lit(1).alias("side"), "input_text", "vec")
    cells = (
        heads.unionByName(body, allowMissingColumns=True)
        .repartition("user", "salt")
        .sortWithinPartitions("user", "salt", "side", "cluster", "input_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        cell, ids, heads = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, salts, side = (to_keys(batch[c]) for c in ("user", "salt", "side"))
            clusters = batch["cluster"].drop_null().to_numpy(zero_copy_only=False)
            centroid = to_matrix(batch["centroid"].drop_null())
            vectors = unit_rows(to_matrix(batch["vec"].drop_null()))
            # Number of centroid rows before each row; the others are points.
            before = np.concatenate([[0], np.cumsum(side == 0)])
            cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (salts[1:] != salts[:-1])) + 1
            edges = [0, *cuts.tolist(), len(side)]
            found, owners = [], []
            for start, stop in zip(edges, edges[1:]):
                here = (owner[start], salts[start])
                first, last = before[start], before[stop]
                if here != cell:
                    cell, ids, heads = here, clusters[first:last], centroid[first:last]
                elif last > first:
                    ids = np.concatenate([ids, clusters[first:last]])
                    heads = np.concatenate([heads, centroid[first:last]])
                split = start + last - first
                if split < stop and len(ids):
                    rows = np.arange(split, stop)
                    found.append(visit(ids, heads, vectors[split - last : stop - last], rows))
                    owners.extend([here[0]] * len(found[-1][0]))
            if found:
                columns = [_arrow(column, f, batch) for column, f in zip(zip(*found), list(out)[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners, type=out.field(0).type), *columns], schema=out
                )

    return cells.mapInArrow(run, schema)


def _arrow(parts: tuple, field: pa.Field, batch: pa.RecordBatch) -> pa.Array:
    values = np.concatenate(parts)
    if field.name == "input_text":
        return batch["input_text"].take(pa.array(values)).cast(field.type)
    if values.ndim == 2:
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())).cast(field.type)
    return pa.array(values, type=field.type, from_pandas=True)


def _nearest(heads: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # Equal scores go to the lowest cluster: centroids are read in that order.
    scores = np.round(vectors @ heads.T, SCORE_DIGITS)
    return scores, scores.argmax(1)


def _partial_sums(ids, heads, vectors, rows):
    _, best = _nearest(heads, vectors)
    used = np.unique(best)
    return ids[used], np.stack([vectors[best == c].sum(0) for c in used])


def _assignments(ids, heads, vectors, rows):
    scores, best = _nearest(heads, vectors)
    at = np.arange(len(best))
    own = scores[at, best]
    scores[at, best] = -np.inf
    following = scores.max(1)
    return ids[best], rows, own, np.where(np.isfinite(following), following, np.nan)


def _farthest(ids, heads, vectors, rows):
    closest = _nearest(heads, vectors)[0].max(1)
    at = closest.argmin()
    return rows[[at]], closest[[at]], vectors[[at]]


def label_clusters(members: DataFrame, meta: DataFrame, m: int = 3) -> DataFrame:
    """``(user, cluster, label, size)``: titles of the ``m`` members nearest the centroid."""
    order = [F.col("score").desc(), F.col("input_text").asc()]
    near = top_ranked(members, ["user", "cluster"], m, order).join(
        meta.select("input_text", "title"), "input_text", "left"
    )
    titles = F.array_sort(F.collect_list(F.struct("rank", "title")))["title"]
    labels = near.groupBy("user", "cluster").agg(F.concat_ws(", ", titles).alias("label"))
    sizes = members.groupBy("user", "cluster").agg(F.count("*").alias("size"))
    return labels.join(sizes, ["user", "cluster"])


def silhouette_widths(members: DataFrame, vectors: DataFrame, *by: str) -> DataFrame:
    """``(user, *by, cluster, input_text, width)``: each member's silhouette by
    cosine distance, 0 for a cluster of one and a user with a single cluster.

    The mean distance of a unit vector to a cluster is 1 less its product with
    the sum of the cluster's unit vectors over their number, so no pair of
    members is formed: a member meets its user's few cluster sums.
    """
    unit = vectors.select("input_text", l2_normalize("vec").alias("vec"))
    placed = members.select("user", *by, "cluster", "input_text").join(unit, "input_text")
    sums = vector_sum(placed, ["user", *by, "cluster"], "vec", F.count("*").alias("n"))
    groups = sums.groupBy("user", *by).agg(F.collect_list(F.struct("cluster", "n", "vec")).alias("groups"))
    seen = placed.join(groups, ["user", *by]).withColumn(
        "near",
        F.transform(
            "groups",
            lambda g: F.struct(
                (g["cluster"] == F.col("cluster")).alias("own"), g["n"].cast("double").alias("n"), dot("vec", g["vec"]).alias("s")
            ),
        ),
    )
    own = F.element_at(F.filter("near", lambda g: g["own"]), 1)
    others = F.transform(F.filter("near", lambda g: ~g["own"]), lambda g: 1 - g["s"] / g["n"])
    mine = F.try_divide(own["n"] - 1 - (own["s"] - dot("vec", "vec")), own["n"] - 1)
    measured = seen.select("user", *by, "cluster", "input_text", mine.alias("a"), F.array_min(others).alias("b"))
    width = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    # try_divide and array_min are NULL for a cluster of one and without another cluster
    whole = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.coalesce(width, F.lit(0.0))).otherwise(F.lit(0.0))
    return measured.select("user", *by, "cluster", "input_text", whole.alias("width"))


def cluster_quality(members: DataFrame, vectors: DataFrame, *by: str) -> DataFrame:
    """``(user, *by, clusters, smallest, silhouette)``: the mean silhouette of
    a user's members, 0 for a user with a single cluster."""
    widths = silhouette_widths(members, vectors, *by)
    per_cluster = aggregate(
        widths, ["user", *by, "cluster"], F.count("*").alias("size"), F.sum("width").alias("width")
    )
    return per_cluster.groupBy("user", *by).agg(
        F.count("*").alias("clusters"),
        F.min("size").alias("smallest"),
        (F.sum("width") / F.sum("size")).alias("silhouette"),
    )


def choose_k(
    ratings: DataFrame,
    vectors: DataFrame,
    ks: tuple[int, ...] = (2, 3, 4, 5),
    iters: int = ROUNDS,
    min_size: int = 2,
    tolerance: float = 1e-9,
) -> DataFrame:
    """``(user, k, silhouette)``: per user the best of ``ks``, preferring choices
    without clusters below ``min_size`` and then the smaller ``k``. All of
    ``ks`` are tried on the same loaded points, each until it has settled."""
    members, _ = _clustered(ratings, vectors, tuple(ks), iters, min_size, tolerance)
    order = [
        (F.col("smallest") < min_size).cast("int"),
        -F.round("silhouette", SCORE_DIGITS),
        F.col("k"),
    ]
    trials = cluster_quality(written(members, "trials"), vectors, "k")
    return canonical(trials, ["user"], order).select("user", "k", "silhouette")


def disliked_vectors(ratings: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(qid, vec)``: vectors of each user's negatively rated texts."""
    texts = ratings.where("rating < 0").select(F.col("user").alias("qid"), "input_text").distinct()
    return texts.join(vectors.select("input_text", "vec"), "input_text").select("qid", "vec")


def recommend_clustered(
    ratings: DataFrame,
    catalog: DataFrame,
    corpus: DataFrame,
    vectors: DataFrame,
    centroids: DataFrame,
    n: int = 10,
    exclude_rated_authors: bool = False,
    dislikes: str = "none",
    lam: float = 0.5,
    threshold: float = 0.9,
) -> DataFrame:
    """The ``n`` best works for each cluster, ``(user, cluster, work_key, score, rank)``.

    ``dislikes`` is ``none``, ``penalty`` (scores lose ``lam`` times the highest
    cosine to a disliked work) or ``filter`` (works within ``threshold`` of a
    disliked one are left out).
    """
    if dislikes not in ("none", "penalty", "filter"):
        raise ValueError("dislikes must be none, penalty or filter")
    # Clusters travel under a number of their own, whatever users are called.
    homes = written(
        centroids.select("user", "cluster", "vec").withColumn("qid", F.monotonically_increasing_id()),
        "cluster-numbers",
    )
    numbers = homes.select("qid", "user", "cluster")

    def per_cluster(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("qid", "user").join(numbers.drop("cluster"), "user").drop("user")

    wishes = {}
    if dislikes != "none":
        wishes["against"] = per_cluster(disliked_vectors(ratings, vectors))
        wishes.update(lam=lam) if dislikes == "penalty" else wishes.update(avoid=threshold)
    hits = knn(
        corpus,
        homes.select("qid", "vec"),
        n,
        exclude=per_cluster(rated_exclusions(ratings, corpus)),
        exclude_groups=per_cluster(rated_authors(ratings, catalog)) if exclude_rated_authors else None,
        **wishes,
    )
    return hits.join(numbers, "qid").select("user", "cluster", "work_key", "score", "rank")


def merge_clusters(recs: DataFrame, n: int = 20, order: str = "round_robin") -> DataFrame:
    """One list per user: a work claimed by several clusters stays with the one
    that scores it highest; clusters take turns, or ``order='score'`` sorts all."""
    if order not in ("round_robin", "score"):
        raise ValueError("order must be round_robin or score")
    claimed = canonical(recs, ["user", "work_key"], [-F.col("score"), F.col("cluster")])
    turn = Window.partitionBy("user", "cluster").orderBy(F.col("score").desc(), "work_key")
    by_score = [F.col("score").desc(), F.col("work_key").asc()]
    if order == "score":
        return top_ranked(claimed.drop("rank"), "user", n, by_score)
    taken = claimed.withColumn("turn", F.row_number().over(turn))
    ranked = top_ranked(taken.drop("rank"), "user", n, [F.col("turn").asc(), F.col("cluster").asc()])
    return ranked.drop("turn")
