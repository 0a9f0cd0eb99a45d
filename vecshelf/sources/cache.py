"""The content-addressed vector cache: append-only Parquet, a folder per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshelf.functions.text import content_key
from vecshelf.operators.grouping import aggregate
from vecshelf.session import exists, written

SCHEMA = (
    "input_text string, input_sha256 string, vec array<float>, created_at timestamp, "
    "model_id string"
)
RECORDS_PER_FILE = 100_000


class VectorCache:
    """Vectors of one model, identified by the hash of the embedded text.

    A stream writes to a folder of its own: readers of a folder with a stream's
    log see only the files in that log.
    """

    def __init__(self, spark: SparkSession, path: str, model_id: str):
        self.spark, self.model_id = spark, model_id
        self.appended, self.streamed = f"{path}/appended", f"{path}/streamed"

    def scan(self) -> DataFrame:
        """All rows as stored; no rows where nothing was written yet."""
        rows = self.spark.createDataFrame([], SCHEMA)
        for folder in (self.appended, self.streamed):
            if exists(self.spark, folder):
                rows = rows.unionByName(self.spark.read.schema(SCHEMA).parquet(folder))
        return rows.where(F.col("model_id") == self.model_id)

    def read(self) -> DataFrame:
        """One row per text: the first one written.

        The keys are looked at first. Only texts stored twice, which an append
        avoids, are reduced; the vectors of all others are not shuffled.
        """
        rows = self.scan()
        twice = rows.groupBy("input_sha256").count().where("count > 1").select("input_sha256")
        if not twice.head(1):
            return rows
        twice = written(twice, "cache-twice")
        once = rows.join(twice, "input_sha256", "left_anti").select(*rows.columns)
        more = rows.join(twice, "input_sha256", "left_semi").select(*rows.columns)
        return once.unionByName(first_written(more))

    def keys(self) -> DataFrame:
        return self.scan().select("input_sha256").distinct()

    def append(self, vectors: DataFrame) -> None:
        """Add ``(input_text, vec)`` rows whose text is not cached yet."""
        fresh = (
            vectors.select("input_text", F.col("vec").cast("array<float>").alias("vec"))
            .withColumn("input_sha256", content_key("input_text"))
            .dropDuplicates(["input_sha256"])
            .join(self.keys(), "input_sha256", "left_anti")
        )
        self.write(fresh)

    def write(self, rows: DataFrame) -> None:
        """Append rows known to be missing; one file batch per call."""
        rows.select(
            "input_text",
            "input_sha256",
            F.col("vec").cast("array<float>").alias("vec"),
            F.current_timestamp().alias("created_at"),
            F.lit(self.model_id).alias("model_id"),
        ).write.mode("append").option("maxRecordsPerFile", RECORDS_PER_FILE).partitionBy(
            "model_id"
        ).parquet(self.appended)

    def profile(self) -> DataFrame:
        return cache_profile(self.scan())


def first_written(vectors: DataFrame) -> DataFrame:
    """One row per ``(input_sha256, model_id)``."""
    rest = [c for c in vectors.columns if c not in ("input_sha256", "model_id")]
    first = F.min_by(F.struct(*rest), F.struct("created_at", F.xxhash64("vec")))
    picked = aggregate(vectors, ["input_sha256", "model_id"], first.alias("first"))
    return picked.select(*[c if c not in rest else F.col(f"first.{c}") for c in vectors.columns])


def cache_profile(vectors: DataFrame) -> DataFrame:
    """``(model_id, n, n_texts, dim)`` per model; ``dim`` is NULL if lengths differ."""
    low, high = F.min(F.size("vec")), F.max(F.size("vec"))
    return vectors.groupBy("model_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("input_sha256").alias("n_texts"),
        F.when(low == high, low).cast("long").alias("dim"),
    )


def validate_vectors(df: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a vector of ``dim`` elements, and the rest with a reason."""
    reason = F.when(F.col("vec").isNull(), "missing").when(F.size("vec") != dim, "dimension")
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
