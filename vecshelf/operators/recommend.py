"""Recommendations for one liked set or for all users in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshelf.functions.vector import l2_normalize
from vecshelf.operators.centroid import vector_sum, weighted_centroid
from vecshelf.operators.knn import knn
from vecshelf.operators.search import described, match_preferences


def _liked(corpus: DataFrame, liked: list[str] | DataFrame) -> DataFrame:
    """``(qid, work_key, author, input_text, vec)`` of the liked texts in the corpus."""
    columns = ["work_key", "author", "input_text", "vec"]
    if not isinstance(liked, DataFrame):
        return corpus.where(F.col("input_text").isin(liked)).select(F.lit(0).alias("qid"), *columns)
    texts = liked.select("qid", "input_text").distinct()
    return texts.join(corpus.select(*columns), "input_text").select("qid", *columns)


def _mean_queries(hits: DataFrame) -> DataFrame:
    """Mean of unit vectors per ``qid``. The dot product of a unit candidate with
    it is the candidate's mean cosine to the set."""
    sums = vector_sum(hits, ["qid"], l2_normalize("vec"), F.count("*").alias("terms"))
    return sums.select(
        "qid", F.expr("transform(vec, x -> x / cast(terms as double))").alias("vec")
    )


def recommend_mean(corpus: DataFrame, liked: list[str] | DataFrame, n: int = 10) -> DataFrame:
    """Works by mean cosine to the liked set, the set itself left out.

    ``liked`` is a list of input texts or ``(qid, input_text)`` for many sets.
    """
    hits = _liked(corpus, liked)
    ranked = knn(corpus, _mean_queries(hits), n, exclude=hits, metric="mean_cosine")
    return described(ranked, corpus)


def recommend_nearest(
    corpus: DataFrame,
    liked: list[str] | DataFrame,
    n: int = 10,
    min_near: tuple[int, float] | None = None,
) -> DataFrame:
    """Works by cosine to the closest liked work.

    ``min_near=(m, floor)`` asks for at least ``m`` liked works at ``floor`` or
    closer.
    """
    hits = _liked(corpus, liked)
    return described(knn(corpus, hits, n, exclude=hits, min_near=min_near), corpus)


def recommend_from_preferences(
    corpus: DataFrame,
    prefs: DataFrame,
    n: int = 20,
    exclude_pref_authors: bool = False,
    agg: str = "mean",
) -> DataFrame:
    """Recommendations from ``(author, title)`` preference lines.

    Two lines that match one work weigh it twice. ``agg`` is ``mean`` or ``max``.
    """
    if agg not in ("mean", "max"):
        raise ValueError("agg must be mean or max")
    matched = match_preferences(prefs, corpus.drop("vec")).select("work_key", "author")
    hits = matched.join(corpus.select("work_key", "vec"), "work_key").withColumn("qid", F.lit(0))
    ranked = knn(
        corpus,
        _mean_queries(hits) if agg == "mean" else hits,
        n,
        exclude=hits,
        exclude_groups=hits if exclude_pref_authors else None,
        metric="mean_cosine" if agg == "mean" else "cosine",
    )
    return described(ranked, corpus).drop("qid")


def rated_exclusions(
    ratings: DataFrame, corpus: DataFrame, exclude_same_text: bool = False
) -> DataFrame:
    """``(qid, work_key)`` not to recommend: the rated keys, and with
    ``exclude_same_text`` also the corpus work that carries a rated text."""
    rated = ratings.select(F.col("user").alias("qid"), "work_key")
    if not exclude_same_text:
        return rated
    twins = ratings.select(F.col("user").alias("qid"), "input_text").join(
        corpus.select("input_text", "work_key"), "input_text"
    )
    return rated.unionByName(twins.select("qid", "work_key"))


def rated_authors(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(qid, author)`` of every rated work, as the catalog names the author."""
    return (
        ratings.select(F.col("user").alias("qid"), "work_key")
        .join(catalog.select("work_key", "author"), "work_key")
        .select("qid", "author")
        .distinct()
    )


def recommend_signed(
    ratings: DataFrame,
    catalog: DataFrame,
    corpus: DataFrame,
    vectors: DataFrame,
    n: int = 20,
    exclude_rated_authors: bool = False,
    exclude_same_text: bool = False,
    exclude_authors: DataFrame | None = None,
    eps: float = 1e-9,
) -> DataFrame:
    """Works by cosine to each user's signed sum of rated vectors, all users at once.

    ``ratings`` is ``(user, work_key, input_text, rating)``. Rated works are left
    out, on request also every work by an author the user has rated, and works by
    the authors in ``exclude_authors(user, author)``; they are gone before the
    ranking, so a list is short only if too few works are left. Users whose sum
    is shorter than ``eps`` get no rows (see ``user_status``).
    """
    centroids = weighted_centroid(ratings, vectors).where(F.col("norm") > eps)
    authors = rated_authors(ratings, catalog) if exclude_rated_authors else None
    if exclude_authors is not None:
        named = exclude_authors.select(F.col("user").alias("qid"), "author")
        authors = named if authors is None else authors.unionByName(named)
    ranked = knn(
        corpus,
        centroids.select(F.col("user").alias("qid"), "vec"),
        n,
        exclude=rated_exclusions(ratings, corpus, exclude_same_text),
        exclude_groups=authors,
    )
    return described(ranked, corpus).withColumnRenamed("qid", "user")


def user_status(
    ratings: DataFrame, vectors: DataFrame, recs: DataFrame, eps: float = 1e-9
) -> DataFrame:
    """``(user, status)``: ``no_ratings`` if no rated work has a vector,
    ``degenerate`` if the ratings cancel out or nothing is left to rank, else ``ok``."""
    users = ratings.select("user").distinct()
    norms = weighted_centroid(ratings, vectors).select("user", "norm")
    served = recs.select("user", F.lit(True).alias("served")).distinct()
    status = (
        F.when(F.col("norm").isNull(), "no_ratings")
        .when((F.col("norm") <= eps) | F.col("served").isNull(), "degenerate")
        .otherwise("ok")
    )
    return (
        users.join(norms, "user", "left")
        .join(served, "user", "left")
        .select("user", status.alias("status"))
    )
