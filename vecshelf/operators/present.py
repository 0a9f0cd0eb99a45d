"""What a recommendation list goes through before it is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecshelf.operators.grouping import aggregate, top_ranked
from vecshelf.operators.hyperplanes import banded_pairs
from vecshelf.operators.knn import within
from vecshelf.session import written

NEAR_DUPLICATE = 0.92


def exclude_authors(candidates: DataFrame, authors: DataFrame | list[str]) -> DataFrame:
    """Candidates not by any of ``authors``, a list or ``([user,] author)``."""
    if not isinstance(authors, DataFrame):
        return candidates.where(~F.coalesce(F.col("author").isin(authors), F.lit(False)))
    on = [c for c in ("user", "author") if c in authors.columns]
    return candidates.join(authors.select(*on).distinct(), on, "left_anti")


def filter_backfill(pool: DataFrame, authors: DataFrame | list[str], n: int = 20) -> DataFrame:
    """The first ``n`` of each user's ranked pool once ``authors`` are gone, so
    lower-ranked works move up; ``rank`` is the new place."""
    order = [F.col("score").desc(), F.col("work_key").asc()]
    return top_ranked(exclude_authors(pool, authors).drop("rank"), "user", n, order)


def author_facet(shown: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Sorted distinct ``(user, author)`` of the visible lists and the authors filtered out."""
    facet = shown.select("user", "author")
    if excluded is not None:
        facet = facet.unionByName(excluded.select("user", "author"))
    return facet.distinct().orderBy("user", "author")


def relative_score(shown: DataFrame) -> DataFrame:
    """Score as a share of the best shown one; the best counts as 1 if none is positive."""
    best = F.max("score").over(Window.partitionBy("user"))
    top = F.when(best > 0, best).otherwise(F.lit(1.0))
    return shown.withColumn("relative", F.col("score") / top)


def vector_classes(corpus: DataFrame, key: str = "work_key") -> DataFrame:
    """``(key, class_key)``: works with equal vectors share the smallest key."""
    named = corpus.where("vec is not null").select(key, "vec", F.xxhash64("vec").alias("print"))
    first = aggregate(named, ["print", "vec"], F.min(key).alias("class_key"))
    return named.join(first, ["print", "vec"]).select(key, "class_key")


def near_duplicates(
    corpus: DataFrame, threshold: float = NEAR_DUPLICATE, key: str = "work_key", recall: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, classes)`` of works whose cosine reaches ``threshold``.

    ``pairs`` is ``(key_a, key_b, score)`` with ``key_a < key_b`` between the
    first works of different classes, each pair once; ``classes`` is
    ``(key, class_key)`` with all works of equal vectors in one class, which
    need no pair each. Every pair is found: blocks of the corpus are scored
    against each other, and only what reaches the threshold leaves a task.
    With ``recall`` (0.999, say) only works that random hyperplanes put together
    are compared, and a pair is found with that probability at least.
    """
    classes = written(vector_classes(corpus, key), "vector-classes")
    heads = classes.where(F.col(key) == F.col("class_key")).select(key)
    first = corpus.select(key, "vec").join(heads, key, "left_semi")
    if recall is not None:
        return banded_pairs(first, threshold, recall, key=key), classes
    found = within(first, first.select(F.col(key).alias("qid"), "vec"), threshold, key=key)
    pairs = found.where(F.col("qid") < F.col(key)).select(
        F.col("qid").alias("key_a"), F.col(key).alias("key_b"), "score"
    )
    return pairs, classes


def flag_near_duplicates(ranked: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Marks hits so close that they are most likely another edition or adaptation."""
    return ranked.withColumn("near_duplicate", F.col("score") >= threshold)
