"""What the operators of this folder share: input tables, folds, word rules,
and the wrapping of a function over whole texts as an Arrow UDF.

Texts reach Python as UTF-8 bytes. ``bytes.split()`` splits at exactly the
bytes 0x20 and 0x09-0x0D, so it yields the words ``[^\\x20\\x09-\\x0D]+``, and
``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A column name that ``columns`` doesn't hold."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a NULL key falls in fold 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.coalesce(F.crc32(key.cast("string")), F.lit(0)), F.lit(n))


def raw(texts: pa.Array) -> list[bytes | None]:
    """An Arrow array of strings as UTF-8 bytes."""
    return texts.cast(pa.binary()).to_pylist()


def text_udf(function: Callable[[list[bytes | None]], pa.Array], returns: str):
    """A UDF from a text column; ``function`` gets a batch of whole texts as bytes."""

    def run(texts: pa.Array) -> pa.Array:
        return function(raw(texts))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def drawn(seed: int, share: float, *columns: str | Column) -> Column:
    """Whether the hash of some columns is among the lowest ``share`` of all hashes."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(F.lit(seed), *columns) < F.lit(int((max(share, 0.0) - 0.5) * (1 << 64)))


def within_bound(bound: int, total: int) -> float:
    """The share to draw of ``total`` so that at most ``bound`` come out, five deviations sure."""
    return 1.0 if total <= bound else max(0.0, bound - 5 * bound**0.5) / total


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, where: Column | None = None
) -> DataFrame:
    """(label, text) of labelled documents, ``bound`` rows at most.

    Where more are labelled, ids are drawn by hash, the same on each run, and
    after that rows by hash of id and text: an id with very many rows gives no
    more than its share. Equal rows of an id are one row. A repeated id in
    ``labels`` counts once, with its highest label; rows with a NULL id or
    label are no labels. The drawn ids are narrow and bounded, so they are broadcast.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = ids if where is None else ids.where(where)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    ids = ids.where(drawn(1, within_bound(bound, ids.count()), "doc_id"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).join(F.broadcast(ids), "doc_id")
    kinds = rows.groupBy("doc_id", "_text").count().agg(F.count("*").alias("kinds"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    rows = rows.where(drawn(2, within_bound(bound, kinds["kinds"]), "doc_id", "_text"))
    if kinds["rows"] > kinds["kinds"]:
        rows = rows.dropDuplicates(["doc_id", "_text"])
    return rows.select("_label", "text")
