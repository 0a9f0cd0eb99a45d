"""The raw dump: one tab-separated record per line, JSON in the last column."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshelf.functions.records import FIELDS, landed_fields
from vecshelf.session import lean_writes

COLUMNS = ["type", "key", "revision", "ts", "json"]

# The record types of the dump and the short names used here.
RECORD_TYPES = {
    "/type/author": "authors",
    "/type/work": "works",
    "/type/edition": "editions",
}

# The columns that a table of landed records has beside its key.
ALL_COLUMNS = {table: [*FIELDS[table], "json"] for table in RECORD_TYPES.values()}

# Bytes of a row group of landed records: a task has one open for each type.
ROW_GROUP = 32 << 20


def _shares(scan: DataFrame) -> list[int]:
    """Bytes of the files that each task of a file scan reads."""
    parts = scan._jdf.queryExecution().toRdd().partitions()
    return [sum(file.length() for file in part.files()) for part in parts]


def _dealt(lines: DataFrame, partitions: int | None) -> DataFrame:
    """``lines`` of a scan over so many tasks. The lines of files that deal them
    out already, none of the tasks with over twice its share, stay where they
    are; others are shuffled by their number, which no task has to sort for."""
    if not partitions:
        return lines
    shares = _shares(lines)
    if shares and max(shares) * partitions <= 2 * sum(shares):
        return lines
    return lines.withColumn("at", F.monotonically_increasing_id()).repartition(partitions, "at").drop("at")


def _parsed_lines(spark: SparkSession, path: str, partitions: int | None) -> DataFrame:
    """The dump's columns, the parsed ``doc``, and the ``reason`` a line is unusable."""
    lines = _dealt(spark.read.text(path, lineSep="\n"), partitions).where("value != ''")
    line = F.rtrim("value", F.lit("\r"))
    parts = F.split(line, "\t", len(COLUMNS))
    rows = lines.select(
        line.alias("line"), *[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(COLUMNS)]
    )
    return _judged(rows)


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` with the parsed ``doc`` and a ``reason``, NULL for a good line.

    A document that repeats a key is no VARIANT but readable all the same; its
    reason is ``repeated_key``, and ``_first_of_repeated`` mends it.
    """
    rows = rows.withColumn("doc", F.try_parse_json("json"))
    reason = (
        F.when(F.col("json").isNull(), "missing_columns")
        .when(F.col("doc").isNotNull(), None)
        .when(F.get_json_object("json", "$").isNotNull(), "repeated_key")
        .otherwise("bad_json")
    )
    return rows.withColumn("reason", reason)


def _first_of_repeated(rows: DataFrame) -> DataFrame:
    """``rows`` with each JSON text cut down to the first of any repeated keys.
    Meant for the few lines that need it: the text goes through Python."""

    def first(pairs: list[tuple]) -> dict:
        return dict(reversed(pairs))

    def mend(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text, object_pairs_hook=first), ensure_ascii=False)
        except (ValueError, RecursionError):
            return text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(json=frame["json"].map(mend))

    return rows.mapInPandas(run, rows.schema)


def read_dump(
    spark: SparkSession, path: str, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(records, quarantine)`` of a plain or gzipped dump.

    Records are ``(type, key, revision, ts, json)``, all strings, quoting off.
    Lines of fewer columns or with unreadable JSON go to the quarantine as
    ``(line, reason)``; a document that repeats a key is readable. A gzip file is read by one task, so ``partitions``
    deals its lines out evenly right after the scan, whatever they hold.
    """
    rows = _parsed_lines(spark, path, partitions)
    readable = F.col("reason").isNull() | (F.col("reason") == "repeated_key")
    return rows.where(readable).select(*COLUMNS), rows.where(~readable).select("line", "reason")


def split_by_type(
    headed: DataFrame, columns: Mapping[str, Sequence[str]] | None = None
) -> dict[str, DataFrame]:
    """Authors, works and editions of a landed dump, each with its key and typed
    fields beside the JSON, or the tables and columns that ``columns`` names;
    records of other types are left out."""
    columns = ALL_COLUMNS if columns is None else columns
    return {
        table: headed.where(F.col("type") == record_type).select("key", *columns[table])
        for record_type, table in RECORD_TYPES.items()
        if table in columns
    }


def land_dump(
    spark: SparkSession,
    path: str,
    out: str,
    partitions: int | None = None,
    columns: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """Write the three record types and the quarantine in one scan, a folder each,
    and read them back: ``authors``, ``works``, ``editions`` and ``quarantine``.

    Each line is parsed once, and all fields that later steps read are landed as
    columns, so none of them parses JSON again. With ``columns``, which names columns
    (typed fields, ``json``) by table, only these are written beside the key, and only
    records of these tables; the quarantine is whole. Unusable lines are not filtered
    out but written under a type of their own. So are documents that repeat a key; these few are
    then mended, with the first value of the key, and added to their type.
    """
    columns = ALL_COLUMNS if columns is None else columns
    headed = _headed(_parsed_lines(spark, path, partitions), columns)
    _land(headed, out, "overwrite")
    landed = spark.read.schema(headed.schema).parquet(out)
    repeated = landed.where("type = 'quarantine' and reason = 'repeated_key'")
    if repeated.head(1):
        parts = F.split("line", "\t", len(COLUMNS))
        named = [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(COLUMNS)]
        mended = _first_of_repeated(repeated.select("line", *named))
        judged = _judged(mended).replace("repeated_key", "bad_json", ["reason"])
        _land(_headed(judged, columns), out, "append")
        landed = spark.read.schema(headed.schema).parquet(out)
    unusable = landed.where("type = 'quarantine' and reason <> 'repeated_key'").select("line", "reason")
    return {**split_by_type(landed, columns), "quarantine": unusable}


def _land(headed: DataFrame, out: str, mode: str) -> None:
    writer = headed.write.mode(mode).partitionBy("type")
    with lean_writes(headed.sparkSession):
        writer.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(out)


def _headed(rows: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """The landed columns of judged lines; those with a reason go under ``quarantine``."""

    good = F.col("reason").isNull()
    kept = F.col("type").isin(*[name for name, table in RECORD_TYPES.items() if table in columns])
    wanted = kept | (F.col("type").isin(*RECORD_TYPES) & ~good) | F.col("json").isNull()
    tables = F.create_map(*[F.lit(x) for pair in RECORD_TYPES.items() for x in pair])
    kind = F.when(good, tables[F.col("type")])
    with_json = [table for table, names in columns.items() if "json" in names]
    return rows.where(wanted).select(
        "key",
        *landed_fields(kind, columns),
        *([F.when(kind.isin(*with_json), F.col("json")).alias("json")] if with_json else []),
        F.when(~good, F.col("line")).alias("line"),
        "reason",
        F.when(good, F.col("type")).otherwise("quarantine").alias("type"),
    )
