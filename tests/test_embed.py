import hashlib

import numpy as np
import pytest

from vecshelf.operators import embed
from vecshelf.sources.cache import VectorCache, cache_profile, validate_vectors
from vecshelf.streaming.embed import stream_embed


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "input_text string")


def test_embed_missing_is_idempotent(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"), "m1")
    assert cache.keys().count() == 0
    inputs = embed.keyed(texts(spark, "a", "b", "b", None, "c"))
    assert embed.embed_missing(inputs, cache, embed.hash_embedder, batch=2, dim=32) == 3
    assert embed.embed_missing(inputs, cache, embed.hash_embedder) == 0
    assert embed.embed_missing(embed.keyed(texts(spark, "c", "d")), cache, embed.hash_embedder, concurrency=2) == 1
    rows = {r.input_text: r for r in cache.read().collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert rows["a"].input_sha256 == hashlib.sha256(b"a").hexdigest()
    assert np.isclose(np.linalg.norm(rows["a"].vec), 1.0)
    other = VectorCache(spark, str(tmp_path / "cache"), "m2")
    assert embed.embed_missing(embed.keyed(texts(spark, "a")), other, embed.hash_embedder) == 1
    assert cache.read().count() == 4


def test_finished_rounds_outlive_a_failure(spark, tmp_path):
    from pyspark.sql import functions as F

    cache = VectorCache(spark, str(tmp_path / "cache"), "m")
    inputs = embed.keyed(texts(spark, *[f"text {i}" for i in range(40)]))
    number = F.pmod(F.xxhash64("input_sha256"), F.lit(4))
    rounds = {r.input_text: r.n for r in inputs.select("input_text", number.alias("n")).collect()}
    poison = max(rounds, key=rounds.get)

    def failing(batch):
        if poison in batch:
            raise ValueError("model went away")
        return embed.hash_embedder(batch)

    with pytest.raises(Exception, match="went away"):
        embed.embed_missing(inputs, cache, failing, round_texts=10)
    done = {r.input_text for r in cache.scan().collect()}
    assert done == {t for t, n in rounds.items() if n < rounds[poison]} and done
    assert embed.embed_missing(inputs, cache, embed.hash_embedder, round_texts=10) == 40 - len(done)
    assert cache.read().count() == 40


def test_first_written_row_wins(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"), "m")
    first = spark.createDataFrame([("a", [1.0])], "input_text string, vec array<double>")
    cache.append(first)
    cache.append(spark.createDataFrame([("a", [2.0]), ("b", [3.0])], first.schema))
    assert {r.input_text: r.vec for r in cache.read().collect()} == {"a": [1.0], "b": [3.0]}
    # A second writer that raced past the anti-join leaves a duplicate row.
    cache.write(embed.keyed(first).join(first, "input_text"))
    assert cache.scan().count() == 3 and cache.read().count() == 2
    profile = cache.profile().first()
    assert (profile.model_id, profile.n, profile.n_texts, profile.dim) == ("m", 3, 2, 1)


def test_embedder_shape_is_checked(spark):
    keyed = embed.keyed(texts(spark, "a"))
    with pytest.raises(Exception, match="shape"):
        embed.embed_texts(keyed, embed.hash_embedder, dim=7).collect()


def test_zero_vector_stays(spark):
    zero = lambda batch: np.zeros((len(batch), 3))
    assert embed.embed_texts(embed.keyed(texts(spark, "a")), zero).first().vec == [0.0, 0.0, 0.0]


def test_validate_and_profile(spark):
    rows = spark.createDataFrame(
        [("a", "m", [1.0, 2.0]), ("b", "m", [1.0]), ("c", "m", None)],
        "input_sha256 string, model_id string, vec array<double>",
    )
    ok, rejected = validate_vectors(rows, 2)
    assert [r.input_sha256 for r in ok.collect()] == ["a"]
    assert {r.input_sha256: r.reason for r in rejected.collect()} == {"b": "dimension", "c": "missing"}
    assert cache_profile(rows.where("vec is not null")).first().dim is None


def test_embedding_inputs(spark):
    books = spark.createDataFrame(
        [
            ("A", "T", "d", 2000, 10),
            ("A", "T", "d", 1990, 12),
            ("A", "few", "d", 2000, 9),
            ("A", "none", None, 2000, 10),
            ("A", "undated", "d", None, 10),
            ("A", "new", "d", 2025, 10),
        ],
        "primary_author_key string, title string, description string, first_publish_year int, edition_count long",
    )
    authors = spark.createDataFrame([("A", "Name")], "author_key string, name string")
    got = embed.embedding_inputs(books, authors).collect()
    assert [r.input_text for r in got] == ["Book|Name|T"]


def test_ensure_rated_vectors(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"), "m")
    corpus, rated = texts(spark, "a"), texts(spark, "a", "b", "b")
    assert embed.ensure_rated_vectors(rated, corpus, cache, embed.hash_embedder) == 1
    assert [r.input_text for r in cache.read().collect()] == ["b"]


def test_stream_embed(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"), "m")
    embed.embed_missing(embed.keyed(texts(spark, "cached")), cache, embed.hash_embedder)
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema("input_text string").parquet(source)
        stream_embed(stream, cache, embed.hash_embedder, checkpoint, dim=32).awaitTermination()

    texts(spark, "cached", "x", "x", None).write.parquet(source)
    run()
    texts(spark, "x", "y").write.mode("append").parquet(source)
    run()
    assert sorted(r.input_text for r in cache.scan().collect()) == ["cached", "x", "y"]
