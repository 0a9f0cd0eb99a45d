"""From landed typed records to the curated books, authors and junction tables.

Frames with the JSON alone are taken as well; their fields are parsed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshelf.functions.records import typed
from vecshelf.functions.text import extract_year, strip_prefix, subject_in

# The fields of editions that their aggregates and their facets read.
AGGREGATED = ["work_key", "publish_date", "subjects_text", "isbn13", "description"]
FACETS = ["work_key", "languages", "genres"]


def edition_aggregates(
    editions: DataFrame, subject: str = "fiction", whole_word: bool = False
) -> DataFrame:
    """``(work_key, edition_count, min_year, ed_fiction, isbn13, ed_desc)`` per work."""
    rows = typed(editions, "editions", AGGREGATED).where("work_key is not null").select(
        "work_key",
        extract_year("publish_date").alias("year"),
        subject_in("subjects_text", subject, whole_word).alias("fiction"),
        "isbn13",
        "description",
    )
    return rows.groupBy("work_key").agg(
        F.count("*").alias("edition_count"),
        F.min("year").alias("min_year"),
        F.max("fiction").alias("ed_fiction"),
        F.max("isbn13").alias("isbn13"),
        F.max("description").alias("ed_desc"),
    )


def edition_facets(editions: DataFrame) -> DataFrame:
    """``(work_key, facet, value, n)``: in how many editions of a work each
    ``language`` and each ``genre`` is named."""

    def named(facet: str, column: str):
        each = F.transform(column, lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value")))
        return F.coalesce(each, F.array().cast("array<struct<facet:string,value:string>>"))

    facets = F.array_distinct(F.concat(named("language", "languages"), named("genre", "genres")))
    named_works = typed(editions, "editions", FACETS).where("work_key is not null")
    rows = named_works.select("work_key", F.inline(facets))
    return (
        rows.where("value is not null").groupBy("work_key", "facet", "value").agg(F.count("*").alias("n"))
    )


def select_works(
    works: DataFrame,
    ed_agg: DataFrame,
    min_editions: int = 2,
    subject: str = "fiction",
    whole_word: bool = False,
) -> DataFrame:
    """Works on the subject, by their own subjects or an edition's, with enough
    editions: the works' typed fields beside the aggregates of their editions."""
    on_subject = subject_in("subjects_text", subject, whole_word).alias("fiction")
    kept = typed(works, "works").select(
        F.col("key").alias("work_key"),
        "title",
        "subtitle",
        "first_publish_date",
        "description",
        "subjects",
        "author_keys",
        "cover_id",
        on_subject,
    )
    counted = ed_agg.where(F.col("edition_count") >= min_editions)
    return kept.join(counted, "work_key").where("fiction or ed_fiction").drop("fiction")


def build_books(selected: DataFrame) -> DataFrame:
    """One flat row per selected work."""
    return selected.select(
        "work_key",
        strip_prefix("work_key").alias("ol_id"),
        "title",
        "subtitle",
        F.coalesce(extract_year("first_publish_date"), "min_year").alias("first_publish_year"),
        "edition_count",
        F.coalesce("description", "ed_desc").alias("description"),
        "subjects",
        F.get("author_keys", F.lit(0)).alias("primary_author_key"),
        "cover_id",
        "isbn13",
    )


def build_book_authors(selected: DataFrame) -> DataFrame:
    """``(work_key, author_key, position)``; positions count from 1 and entries
    without a key leave a gap."""
    return (
        selected.select("work_key", F.posexplode("author_keys").alias("at", "author_key"))
        .select("work_key", "author_key", (F.col("at") + 1).cast("long").alias("position"))
        .where("author_key is not null")
    )


def build_authors(authors: DataFrame, book_authors: DataFrame) -> DataFrame:
    """Authors named by at least one selected work."""
    named = typed(authors, "authors").withColumnRenamed("key", "author_key").join(
        book_authors.select("author_key").distinct(), "author_key", "left_semi"
    )
    return named.select("author_key", "name", "birth_date", "death_date", "bio", "alternate_names")
