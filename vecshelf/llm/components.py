"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshelf.session import written

#: Links of a file of a round, about.
LINKS_A_FILE = 20_000


def _large_star(links: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the smallest of node and neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them; a > b in ``links``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links(a, b)`` names; root is the
    smallest node reachable.

    Alternating large and small stars: each round is a few joins and groupings
    on narrow rows, written to the shared folder, until a round changes
    nothing. The number of rounds grows with the logarithm of the node count.
    A round has no more links than the one before, so its table gets as many
    files as those are worth, however many partitions the session shuffles to.
    A node with very many neighbours is a hot join key only beside one row, so
    adaptive execution can split it.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(ordered(links), "links")
    seen = mark(now)
    while True:
        files = max(1, -(-seen[0] // LINKS_A_FILE))
        now = written(ordered(_small_star(ordered(_large_star(now)))).coalesce(files), "stars")
        if (at := mark(now)) == seen:
            break
        seen = at
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b")).distinct())
