"""Embedding what the vector cache does not hold yet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vecshelf.functions.text import content_key, input_text
from vecshelf.session import written
from vecshelf.sources.cache import VectorCache

BATCH = 32
# Texts embedded between two appends: what a stopped run loses at most.
ROUND_TEXTS = 1_000_000

Embedder = Callable[[list[str]], np.ndarray]


def embedding_inputs(
    books: DataFrame,
    authors: DataFrame,
    min_editions: int = 10,
    before_year: int = 2025,
    prefix: str = "Book",
) -> DataFrame:
    """Distinct ``(input_text, input_sha256)`` of the books worth embedding."""
    chosen = books.where(
        F.col("description").isNotNull()
        & F.col("first_publish_year").isNotNull()
        & (F.col("edition_count") >= min_editions)
        & (F.col("first_publish_year") < before_year)
    ).select("primary_author_key", "title")
    names = authors.select(F.col("author_key").alias("primary_author_key"), "name")
    return keyed(
        chosen.join(names, "primary_author_key").select(
            input_text("name", "title", prefix).alias("input_text")
        )
    )


def keyed(texts: DataFrame) -> DataFrame:
    """Distinct non-null ``input_text`` with its content key, partitioned by the
    key as the anti-join with the cache needs it."""
    return (
        texts.where("input_text is not null")
        .select("input_text", content_key("input_text").alias("input_sha256"))
        # text and key determine each other
        .distinct()
    )


def missing_vectors(inputs: DataFrame, cache: VectorCache | DataFrame) -> DataFrame:
    """Inputs without a cached vector; ``cache`` is a cache or its ``input_sha256`` keys."""
    keys = cache.keys() if isinstance(cache, VectorCache) else cache
    return inputs.join(keys.select("input_sha256"), "input_sha256", "left_anti").select(
        "input_text", "input_sha256"
    )


def embed_texts(
    texts: DataFrame, embedder: Embedder, batch: int = BATCH, dim: int | None = None
) -> DataFrame:
    """``(input_text, input_sha256, vec)`` with unit vectors, ``batch`` texts per call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = np.asarray(embedder(part["input_text"].tolist()), dtype=np.float64)
                if len(vectors) != len(part) or (dim is not None and vectors.shape[1] != dim):
                    raise ValueError(f"embedder returned shape {vectors.shape}")
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = vectors / np.where(norms == 0, 1, norms)
                yield part.assign(vec=list(unit.astype(np.float32)))

    return texts.select("input_text", "input_sha256").mapInPandas(
        run, "input_text string, input_sha256 string, vec array<float>"
    )


def embed_missing(
    inputs: DataFrame,
    cache: VectorCache,
    embedder: Embedder,
    batch: int = BATCH,
    dim: int | None = None,
    concurrency: int | None = None,
    round_texts: int = ROUND_TEXTS,
) -> int:
    """Embed and append the inputs the cache lacks; the number appended.

    The missing texts are dealt by hash into rounds of about ``round_texts``,
    each appended before the next begins, so a run that is stopped keeps its
    finished rounds and the next one embeds the rest. ``concurrency`` bounds
    how many tasks call the embedder at once. A second run over the same inputs
    appends nothing.
    """
    misses = written(missing_vectors(inputs, cache), "to-embed")
    rounds = max(1, -(-misses.count() // round_texts))
    total = 0
    for number in range(rounds):
        part = misses
        if rounds > 1:
            part = misses.where(F.pmod(F.xxhash64("input_sha256"), F.lit(rounds)) == number)
        if concurrency:
            part = part.repartition(concurrency, "input_sha256")
        seen = Observation()
        cache.write(embed_texts(part, embedder, batch, dim).observe(seen, F.count("*").alias("n")))
        total += seen.get["n"]
    return total


def ensure_rated_vectors(
    ratings: DataFrame,
    corpus: DataFrame,
    cache: VectorCache,
    embedder: Embedder,
    batch: int = BATCH,
    dim: int | None = None,
) -> int:
    """Give every rated text a vector, from the corpus or through the cache."""
    texts = ratings.select("input_text").join(
        corpus.select("input_text"), "input_text", "left_anti"
    )
    return embed_missing(keyed(texts), cache, embedder, batch, dim)


def hash_embedder(texts: list[str]) -> np.ndarray:
    """A stand-in for a model: the 32 bytes of the text's SHA-256, centred."""
    digests = [np.frombuffer(hashlib.sha256(t.encode()).digest(), dtype=np.uint8) for t in texts]
    return np.stack(digests).astype(np.float32) - 127.5
