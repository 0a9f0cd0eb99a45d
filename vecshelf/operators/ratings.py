"""Rating state as a change log: validation, the latest-per-key fold, listings.

A change is ``(event_id, ts, user, work_key, rating)``; a NULL rating deletes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshelf.operators.grouping import aggregate

# The ratings a user can give.
RATINGS = (-2, -1, 1, 2)


def validate_ratings(changes: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: accepted changes carry the ``input_text`` of the
    work (NULL where it has none), rejected ones a reason. A delete needs neither
    a rating nor a work that is still listed."""
    marked = judged_ratings(changes, catalog)
    accepted = marked.where("reason is null").select(*changes.columns, "input_text")
    return accepted, marked.where("reason is not null").select(*changes.columns, "reason")


def judged_ratings(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """``changes``, batch or stream, with ``input_text`` and the ``reason`` to
    reject a change, NULL if there is none."""
    known = catalog.select("work_key", "input_text", F.lit(True).alias("_listed"))
    given = F.col("rating").isNotNull()
    bad = given & ~F.col("rating").isin(*RATINGS)
    reason = F.when(bad, "bad_rating").when(given & F.col("_listed").isNull(), "unknown_work")
    return changes.join(known, "work_key", "left").withColumn("reason", reason).drop("_listed")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The latest change per ``(user, work_key)``, deletes among them.

    Event time then event id order the changes, so replayed and late rows lead
    to the same result. The pick is an aggregate and combines map-side.
    """
    carried = [c for c in ("rating", "input_text", "ts", "event_id") if c in changes.columns]
    last = F.max_by(F.struct(*carried), F.struct("ts", "event_id")).alias("last")
    return aggregate(changes, ["user", "work_key"], last).select("user", "work_key", "last.*")


def fold_ratings(changes: DataFrame) -> DataFrame:
    """The current ratings: the latest changes, deletes dropped after the pick."""
    folded = latest_changes(changes).drop("event_id")
    return folded.where("rating is not null").withColumnRenamed("ts", "updated_at")


def derive_users(changes: DataFrame) -> DataFrame:
    """``(user, created_at)``: each user from their first change on."""
    return changes.groupBy("user").agg(F.min("ts").alias("created_at"))


def list_ratings(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every user's ratings, newest first, with metadata where the catalog has it.

    One range-partitioned sort over (user, time), so a long list spans tasks.
    """
    meta = catalog.select("work_key", "author", "title", "year")
    return (
        ratings.join(meta, "work_key", "left")
        .select("user", "work_key", "author", "title", "year", "rating", "updated_at")
        .orderBy("user", F.col("updated_at").desc(), "work_key")
    )


def overlay_ratings(results: DataFrame, ratings: DataFrame) -> DataFrame:
    """Any ``(user, work_key, ...)`` list with the user's own ``rating``, NULL if none."""
    own = ratings.select("user", "work_key", "rating")
    return results.join(own, ["user", "work_key"], "left")
