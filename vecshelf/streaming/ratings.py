"""The rating change log fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecshelf.operators.ratings import fold_ratings, judged_ratings, latest_changes
from vecshelf.session import children

LOG_SCHEMA = (
    "event_id long, ts timestamp, user long, work_key long, rating int, "
    "input_text string, reason string, status string"
)


def stream_ratings(
    changes: DataFrame, catalog: DataFrame, log_dir: str, checkpoint: str
) -> StreamingQuery:
    """Append the changes of a streaming frame to the log, as far as the source has data.

    Each change is judged as in a batch and written once, under
    ``status=accepted`` or, with its reason, ``status=rejected``. The stream
    holds no state: the fold orders changes by event time and id, so late and
    repeated rows need no watermark and no de-duplication here.
    """
    status = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    return (
        judged_ratings(changes, catalog)
        .withColumn("status", status)
        .writeStream.format("parquet")
        .option("path", log_dir)
        .option("checkpointLocation", checkpoint)
        .partitionBy("status")
        .trigger(availableNow=True)
        .start()
    )


def _logged(spark: SparkSession, log_dir: str, schema, status: str) -> DataFrame:
    return spark.read.schema(schema).parquet(log_dir).where(F.col("status") == status).drop("status")


def snapshot(spark: SparkSession, log_dir: str, schema=LOG_SCHEMA) -> DataFrame:
    """The current ratings, folded from the accepted changes of the log."""
    return fold_ratings(_logged(spark, log_dir, schema, "accepted").drop("reason"))


def rejected(spark: SparkSession, log_dir: str, schema=LOG_SCHEMA) -> DataFrame:
    """The changes that were not accepted, each with its reason."""
    return _logged(spark, log_dir, schema, "rejected").drop("input_text")


# --- a folded state that keeps up with the log -------------------------------------------

STATE_SCHEMA = "user long, work_key long, rating int, input_text string, ts timestamp, event_id long"


def _versions(spark: SparkSession, state_dir: str) -> list[int]:
    """Versions written whole, ascending; a version that was broken off has no mark."""
    found = [int(n[1:]) for n in children(spark, state_dir) if n[:1] == "v" and n[1:].isdigit()]
    return sorted(n for n in found if "_SUCCESS" in children(spark, f"{state_dir}/v{n}"))


def keep_snapshot(spark: SparkSession, log_dir: str, state_dir: str, checkpoint: str, schema=LOG_SCHEMA) -> StreamingQuery:
    """Brings the folded state under ``state_dir`` up to the log, as far as it goes now.

    The log is read as a stream, so each of its files is read once, whatever
    number of snapshots is taken. A micro-batch is folded with the last version
    into the next one: the latest change of each rating, deletes included, so
    a late older change cannot bring a deleted rating back. A version counts
    once it is complete; a batch that is run again writes its version anew
    from the same predecessor. Earlier versions stay for their readers.
    """

    def fold(part: DataFrame, number: int) -> None:
        accepted = part.where(F.col("status") == "accepted").select("user", "work_key", "rating", "input_text", "ts", "event_id")
        before = [v for v in _versions(spark, state_dir) if v < number + 1]
        if before:
            accepted = accepted.unionByName(_state(spark, state_dir, before[-1]))
        latest_changes(accepted).write.mode("overwrite").parquet(f"{state_dir}/v{number + 1}")

    return (
        spark.readStream.schema(schema)
        .parquet(log_dir)
        .writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _state(spark: SparkSession, state_dir: str, version: int) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(f"{state_dir}/v{version}")


def kept_ratings(spark: SparkSession, state_dir: str) -> DataFrame:
    """The current ratings as of the last complete version; none before the first."""
    versions = _versions(spark, state_dir)
    rows = _state(spark, state_dir, versions[-1]) if versions else spark.createDataFrame([], STATE_SCHEMA)
    return rows.where("rating is not null").drop("event_id").withColumnRenamed("ts", "updated_at")
