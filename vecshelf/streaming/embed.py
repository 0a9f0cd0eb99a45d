"""Filling the vector cache from a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecshelf.operators.embed import BATCH, Embedder, embed_missing, keyed
from vecshelf.sources.cache import VectorCache


def stream_embed(
    texts: DataFrame,
    cache: VectorCache,
    embedder: Embedder,
    checkpoint: str,
    batch: int = BATCH,
    dim: int | None = None,
) -> StreamingQuery:
    """Embed each ``input_text`` of a streaming frame that the cache does not hold.

    Each micro-batch is compared with the cache's keys as they are then, so the
    stream keeps no state however many texts have passed, and a batch that is
    run again after a failure finds what it appended before and adds the rest.
    """

    def absorb(part: DataFrame, _number: int) -> None:
        embed_missing(keyed(part.select("input_text")), cache, embedder, batch, dim)

    return (
        texts.select("input_text")
        .writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
