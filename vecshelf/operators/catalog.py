"""Metadata of embedded strings, the corpus, and the searchable catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshelf.functions.text import input_text
from vecshelf.operators.grouping import canonical


def popularity_order(key: str = "work_key") -> list[Column]:
    """Most editions first, then the earliest year, then the key."""
    return [-F.col("editions"), F.col("year"), F.col(key)]


def _described(books: DataFrame, authors: DataFrame, prefix: str) -> DataFrame:
    names = authors.select("author_key", F.col("name").alias("author"))
    return books.join(names, books.primary_author_key == names.author_key).select(
        input_text("author", "title", prefix).alias("input_text"),
        "work_key",
        "author",
        "title",
        F.col("first_publish_year").alias("year"),
        F.col("edition_count").alias("editions"),
    )


def book_meta(books: DataFrame, authors: DataFrame, prefix: str = "Book") -> DataFrame:
    """One row per embedded string: its most reprinted work."""
    rows = _described(books, authors, prefix).where("input_text is not null")
    return canonical(rows, ["input_text"], popularity_order())


def build_catalog(books: DataFrame, authors: DataFrame, prefix: str = "Book") -> DataFrame:
    """Every work with an author and a year, with lower-cased search columns."""
    rows = _described(books, authors, prefix).where("year is not null")
    return canonical(rows, ["work_key"], popularity_order()).select(
        "work_key",
        "author",
        "title",
        "year",
        "editions",
        "input_text",
        F.lower("author").alias("author_lc"),
        F.lower("title").alias("title_lc"),
    )


def build_corpus(meta: DataFrame, vectors: DataFrame, model_id: str | None = None) -> DataFrame:
    """Metadata with vectors. ``vectors`` holds one row per text and model;
    ``model_id`` picks the model when it holds several."""
    if model_id is not None:
        vectors = vectors.where(F.col("model_id") == model_id)
    return meta.join(vectors.select("input_text", "vec"), "input_text")


def all_vectors(corpus: DataFrame, ondemand: DataFrame) -> DataFrame:
    """``(input_text, vec)`` of both sources; the corpus wins where both have a text."""
    columns = ["input_text", "vec"]
    extra = ondemand.join(corpus.select("input_text"), "input_text", "left_anti")
    return corpus.select(*columns).unionByName(
        canonical(extra.select(*columns), ["input_text"], [F.xxhash64("vec")])
    )


def lookup(catalog: DataFrame, keys: list | DataFrame) -> DataFrame:
    """Catalog entries of the given keys; a list becomes a pushed-down filter."""
    if isinstance(keys, DataFrame):
        return catalog.join(keys.select("work_key").distinct(), "work_key", "left_semi")
    return catalog.where(F.col("work_key").isin(keys))


def popularity_join(catalog: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every work with how readers rated it: ``n_ratings``, ``n_liked`` and
    ``mean_rating``, 0, 0 and NULL for a work nobody rated."""
    counted = ratings.groupBy("work_key").agg(
        F.count("rating").alias("n_ratings"),
        F.count_if(F.col("rating") > 0).alias("n_liked"),
        F.avg("rating").alias("mean_rating"),
    )
    return catalog.join(counted, "work_key", "left").fillna(0, ["n_ratings", "n_liked"])


def popularity_tiers(books: DataFrame, tiers: tuple[int, ...] = (2, 3, 5, 10)) -> DataFrame:
    """``(min_editions, n_with_description)`` in one pass over the books."""
    described = F.col("description").isNotNull()
    counts = books.agg(
        *[F.count_if(described & (F.col("edition_count") >= t)).alias(str(t)) for t in tiers]
    )
    return counts.unpivot([], [str(t) for t in tiers], "min_editions", "n_with_description").select(
        F.col("min_editions").cast("long"), "n_with_description"
    )
