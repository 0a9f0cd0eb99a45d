import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshelf import sql
from vecshelf.operators import search
from vecshelf.operators.centroid import weighted_centroid
from vecshelf.operators.embed import hash_embedder
from vecshelf.operators.ratings import fold_ratings
from vecshelf.session import children, new_path
from vecshelf.sources.cache import VectorCache
from vecshelf.streaming.embed import stream_embed
from vecshelf.streaming.ratings import keep_snapshot, kept_ratings, snapshot, stream_ratings


def test_table_functions(spark, shelf):
    corpus, _ = shelf
    names = sql.register(corpus)
    assert set(names) >= {"similar_to", "recommend", "find_book"}
    got = spark.sql("select work_key, rank from similar_to('TITLE 17', n => 4, same_author => false) order by rank").collect()
    want = search.similar_to(corpus, "title 17", 4, same_author=False).orderBy("rank").collect()
    assert [r["work_key"] for r in got] == [r["work_key"] for r in want]
    assert spark.sql("select * from similar_to('title 17')").count() == 10
    assert spark.sql("select * from similar_to('no such book')").count() == 0
    assert spark.sql("select * from find_book('%')").count() == 0  # no wildcards
    assert spark.sql("select * from pref_matches()").count() == 0
    row = spark.sql("select sim from similar_between('title 1', 'title 1')").first()
    assert row["sim"] == pytest.approx(1)
    assert spark.sql("select * from search_books('author 3', n => 2)").count() == 2


def test_automaton_finds_what_grams_find(spark, monkeypatch):
    texts = ["abc abd", "ABC", "x" * 50 + "needle" + "y", None, "", "Straße", "İstanbul", "a\nb"]
    rows = spark.createDataFrame([(i, t, (t or "")[::-1] or None) for i, t in enumerate(texts)], "id long, a string, b string")
    needles = ["ab", "abc", "b", "needle", "ße", "x" * 51, "İ", "\n", "zzz", "", "NEEDLE"] + [f"filler {i}" for i in range(2000)]
    needles = spark.createDataFrame([(n,) for n in needles], "query string")
    monkeypatch.setattr(search, "AUTOMATON_BYTES", 60_000)  # several blocks
    key = lambda df: sorted(map(tuple, df.select("id", "query").collect()))
    grams = key(search.substring_pairs(rows, ["a", "b"], needles, 0))
    assert key(search.substring_pairs(rows, ["a", "b"], needles)) == grams and len(grams) >= 20
    monkeypatch.setattr(search, "MOST_BLOCKS", 1)
    assert key(search.substring_pairs(rows, ["a", "b"], needles)) == grams


def test_centroids_of_hot_and_odd_users(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(400, 5))
    vectors = spark.createDataFrame([(f"t{i}", [float(x) for x in v]) for i, v in enumerate(vecs)] + [("none", None)], "input_text string, vec array<float>")
    rows = [("hot" if i % 3 else (None if i % 2 else f"u{i}"), f"t{i % 400}", int(rng.choice([-2, -1, 1, 2]))) for i in range(3000)]
    rows += [("hot", "none", 1), ("only", "missing", 2)]
    ratings = spark.createDataFrame(rows, "user string, input_text string, rating int").repartition(8)
    want: dict = {}
    for user, text, rating in rows:
        if text not in ("none", "missing"):
            s, n = want.get(user, (np.zeros(5), 0))
            want[user] = (s + rating * vecs[int(text[1:])].astype("float32"), n + 1)
    for normalize in (False, True):
        got = {r["user"]: r for r in weighted_centroid(ratings, vectors, normalize).collect()}
        assert got.keys() == want.keys()
        for user, (s, n) in want.items():
            assert got[user]["n_terms"] == n and got[user]["norm"] == pytest.approx(np.linalg.norm(s))
            assert np.allclose(got[user]["vec"], s / np.linalg.norm(s) if normalize else s)
    assert weighted_centroid(ratings.where("false"), vectors).count() == 0


CHANGES = "event_id long, ts timestamp, user long, work_key long, rating int"


def arrive(spark, source, rows):
    made = spark.createDataFrame(rows, "event_id long, s long, user long, work_key long, rating int")
    made.withColumn("ts", F.timestamp_seconds("s")).drop("s").select("event_id", "ts", "user", "work_key", "rating").coalesce(1).write.mode("append").parquet(source)


def test_each_snapshot_reads_only_new_files(spark):
    source, log, state, a, b = (new_path(spark, n) for n in ("source", "log", "state", "a", "b"))
    catalog = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "work_key long, input_text string")

    def step(rows):
        arrive(spark, source, rows)
        stream_ratings(spark.readStream.schema(CHANGES).parquet(source), catalog, log, a).awaitTermination()
        query = keep_snapshot(spark, log, state, b)
        query.awaitTermination()
        got, want = kept_ratings(spark, state), snapshot(spark, log)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert kept_ratings(spark, state).count() == 0
    assert step([(i, i, i % 3, i % 20, 2) for i in range(60)]) == 60
    # a delete, an older change of the same work that comes late, and one of nobody's work
    assert step([(100, 100, 0, 0, None), (101, 101, 1, 1, -2), (102, 102, 1, 99, 1)]) == 3
    assert step([(103, 99, 0, 0, 1), (104, 50, 1, 1, 2)]) == 2
    assert kept_ratings(spark, state).where("user = 0 and work_key = 0").count() == 0
    # a version that was broken off isn't read
    spark.range(3).write.parquet(f"{state}/v99")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/v99/_SUCCESS")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
    assert "v99" in children(spark, state) and kept_ratings(spark, state).count() > 0


def test_fold_keeps_its_columns(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, 2), (2, 2, 1, 1, None), (3, 3, 1, 2, 1)], "event_id long, s long, user long, work_key long, rating int")
    got = fold_ratings(rows.withColumn("ts", F.timestamp_seconds("s")).drop("s"))
    assert got.columns == ["user", "work_key", "rating", "updated_at"] and got.count() == 1


def test_embedding_stream_has_no_state_and_repeats_nothing(spark):
    source, mark = new_path(spark, "texts"), new_path(spark, "mark")
    cache = VectorCache(spark, new_path(spark, "cache"), "m")
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "input_text string").coalesce(1)

    def run(checkpoint):
        stream = spark.readStream.schema("input_text string").parquet(source)
        query = stream_embed(stream, cache, hash_embedder, checkpoint, dim=32)
        query.awaitTermination()
        return query

    texts("a", "b", "a", None).write.parquet(source)
    query = run(mark)
    assert cache.scan().count() == 2
    assert all(not p["stateOperators"] for p in query.recentProgress)
    texts("b", "c").write.mode("append").parquet(source)
    run(mark)
    assert sorted(r[0] for r in cache.scan().select("input_text").collect()) == ["a", "b", "c"]
    # every batch again, as after a lost checkpoint
    run(new_path(spark, "mark"))
    assert cache.scan().count() == 3
