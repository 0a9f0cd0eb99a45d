import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshelf.operators import present, recommend
from vecshelf.operators.centroid import weighted_centroid

RATED = "user string, work_key long, input_text string, rating int"


def ratings_of(spark, rows):
    return spark.createDataFrame(
        [(u, k, f"Book|author {k % 12}|title {k}", r) for u, k, r in rows], RATED
    )


def catalog_of(corpus):
    return corpus.drop("vec")


def signed(spark, shelf, rows, n=5, **options):
    corpus, _ = shelf
    ratings = ratings_of(spark, rows)
    recs = recommend.recommend_signed(
        ratings, catalog_of(corpus), corpus, corpus.select("input_text", "vec"), n, **options
    )
    return ratings, recs


def stored(shelf):
    return {r.work_key: np.array(r.vec, dtype=float) for r in shelf[0].collect()}


def test_signed_centroid_against_numpy(spark, shelf):
    vecs = stored(shelf)
    rows = [("u", 1, 2), ("u", 2, 1), ("u", 3, -1), ("u", 4, -2), ("v", 9, 1)]
    _, recs = signed(spark, shelf, rows)
    for user in ("u", "v"):
        rated = {k: r for u, k, r in rows if u == user}
        taste = sum(r * vecs[k] for k, r in rated.items())
        score = {k: v @ taste / np.linalg.norm(v) / np.linalg.norm(taste) for k, v in vecs.items()}
        best = sorted((k for k in vecs if k not in rated), key=lambda k: (-score[k], k))[:5]
        got = recs.where(F.col("user") == user).orderBy("rank").collect()
        assert [r.work_key for r in got] == best
        assert np.allclose([r.score for r in got], [score[k] for k in best])
        assert all(abs(r.score) <= 1 + 1e-9 for r in got)


def test_scaling_ratings_keeps_the_ranking(spark, shelf):
    _, once = signed(spark, shelf, [("u", 1, 1), ("u", 2, -1)])
    _, twice = signed(spark, shelf, [("u", 1, 2), ("u", 2, -2)])
    order = lambda df: [r.work_key for r in df.orderBy("rank").collect()]
    assert order(once) == order(twice)


def test_author_exclusion_uses_the_catalog(spark, shelf):
    _, recs = signed(spark, shelf, [("u", 1, 2), ("u", 14, -1)], 300, exclude_rated_authors=True)
    authors = {r.author for r in recs.collect()}
    assert authors == {f"author {i}" for i in range(12)} - {"author 1", "author 2"}


def test_lists_are_full_without_unwanted_authors(spark, shelf):
    corpus, _ = shelf
    ratings = ratings_of(spark, [("u", 1, 2), ("v", 2, 1)])
    out = spark.createDataFrame([("u", f"author {i}") for i in range(11)], "user string, author string")
    parts = (ratings, catalog_of(corpus), corpus, corpus.select("input_text", "vec"), 20)
    recs = recommend.recommend_signed(*parts, exclude_authors=out).collect()
    assert [r.author for r in recs if r.user == "u"] == ["author 11"] * 20
    plain = recommend.recommend_signed(*parts).where("user = 'v'").orderBy("rank").collect()
    assert [r.work_key for r in sorted((r for r in recs if r.user == "v"), key=lambda r: r["rank"])] == [r.work_key for r in plain]


def test_rated_twin_text(spark, shelf):
    corpus, _ = shelf
    text = "Book|author 1|title 1"
    ratings = spark.createDataFrame([("u", 5000, text, 2)], RATED)
    parts = (ratings, catalog_of(corpus), corpus, corpus.select("input_text", "vec"), 1)
    assert recommend.recommend_signed(*parts).first().work_key == 1
    assert recommend.recommend_signed(*parts, exclude_same_text=True).first().work_key != 1


def test_user_status(spark, shelf):
    corpus, _ = shelf
    vectors = corpus.select("input_text", "vec").unionByName(
        corpus.where("work_key = 7").select(F.lit("copy").alias("input_text"), "vec")
    )
    ratings = ratings_of(spark, [("ok", 1, 2), ("cancel", 7, 1), ("blind", 9000, 2)])
    ratings = ratings.unionByName(spark.createDataFrame([("cancel", 9001, "copy", -1)], RATED))
    every = spark.createDataFrame([("all", i, f"Book|author {i % 12}|title {i}", 1) for i in range(12)], RATED)
    ratings = ratings.unionByName(every)
    recs = recommend.recommend_signed(
        ratings, catalog_of(corpus), corpus, vectors, 3, exclude_rated_authors=True
    )
    status = {r.user: r.status for r in recommend.user_status(ratings, vectors, recs).collect()}
    assert status == {"ok": "ok", "cancel": "degenerate", "blind": "no_ratings", "all": "degenerate"}


def test_mean_ranking_is_mean_cosine(spark, shelf):
    corpus, unit = shelf
    liked = [3, 77, 150]
    texts = [f"Book|author {i % 12}|title {i}" for i in liked]
    got = recommend.recommend_mean(corpus, texts, 7).orderBy("rank").collect()
    mean = (unit @ unit[liked].T).mean(1)
    best = sorted((i for i in range(300) if i not in liked), key=lambda i: (-round(mean[i], 12), i))[:7]
    assert [r.work_key for r in got] == best
    assert np.allclose([r.score for r in got], mean[best])


def test_nearest_and_min_near(spark, shelf):
    corpus, unit = shelf
    liked = [3, 77, 150, 201, 9]
    texts = spark.createDataFrame(
        [("q", f"Book|author {i % 12}|title {i}") for i in liked], "qid string, input_text string"
    )
    scores = np.round(unit @ unit[liked].T, 12)
    free = [i for i in range(300) if i not in liked]
    best = sorted(free, key=lambda i: (-scores[i].max(), i))[:6]
    got = recommend.recommend_nearest(corpus, texts, 6).orderBy("rank").collect()
    assert [r.work_key for r in got] == best
    near = [i for i in free if (scores[i] >= 0.3).sum() >= 2]
    best = sorted(near, key=lambda i: (-scores[i].max(), i))[:6]
    got = recommend.recommend_nearest(corpus, texts, 6, min_near=(2, 0.3)).orderBy("rank").collect()
    assert [r.work_key for r in got] == best


def test_preferences_weigh_a_work_twice(spark, shelf):
    corpus, unit = shelf
    lines = [("author 3", "title 3"), ("AUTHOR 3", "title 3"), ("author 8", "title 20"), ("no", "such")]
    prefs = spark.createDataFrame(lines, "author string, title string")
    liked = {}
    for author, title in lines[:3]:
        found = [
            i for i in range(300)
            if title in f"title {i}" and author.lower() in f"author {i % 12}"
        ]
        best = min(found, key=lambda i: (-(i % 17), 1900 + i % 90, i))
        liked[(author, title)] = best
    weights = list(liked.values())
    mean = (unit @ unit[weights].T).mean(1)
    best = sorted((i for i in range(300) if i not in weights), key=lambda i: (-round(mean[i], 12), i))[:5]
    got = recommend.recommend_from_preferences(corpus, prefs, 5).orderBy("rank").collect()
    assert [r.work_key for r in got] == best
    others = recommend.recommend_from_preferences(corpus, prefs, 50, exclude_pref_authors=True)
    assert not {r.author for r in others.collect()} & {f"author {i % 12}" for i in weights}
    with pytest.raises(ValueError):
        recommend.recommend_from_preferences(corpus, prefs, agg="median")


def test_centroid_with_a_hot_user_and_text(spark, shelf):
    corpus, _ = shelf
    vecs = stored(shelf)
    rows = [("hot", i, 1 + i % 2) for i in range(200)] + [(f"u{i}", 5, -1) for i in range(100)]
    got = {r.user: r for r in weighted_centroid(ratings_of(spark, rows), corpus.select("input_text", "vec")).collect()}
    assert got["hot"].n_terms == 200
    assert np.allclose(got["hot"].vec, sum((1 + i % 2) * vecs[i] for i in range(200)))
    assert np.allclose(got["u3"].vec, -vecs[5])


POOL = "user string, work_key long, author string, score double, rank long"


def test_backfill_facet_and_relative_score(spark):
    rows = [("u", i, f"a{i % 3}", 1.0 - i / 10, i + 1) for i in range(9)] + [("v", 1, "a1", -0.5, 1)]
    pool = spark.createDataFrame(rows, POOL)
    out = spark.createDataFrame([("u", "a0")], "user string, author string")
    shown = present.filter_backfill(pool, out, 4)
    got = sorted((r.user, r["rank"], r.work_key) for r in shown.collect())
    assert got == [("u", 1, 1), ("u", 2, 2), ("u", 3, 4), ("u", 4, 5), ("v", 1, 1)]
    assert [tuple(r) for r in present.author_facet(shown, out).collect()] == [
        ("u", "a0"), ("u", "a1"), ("u", "a2"), ("v", "a1"),
    ]
    shares = {(r.user, r.work_key): r.relative for r in present.relative_score(shown).collect()}
    assert shares[("u", 1)] == 1.0 and shares[("u", 2)] == pytest.approx(0.8 / 0.9) and shares[("v", 1)] == -0.5
    assert present.exclude_authors(pool, ["a1"]).where("user = 'v'").count() == 0
    flagged = present.flag_near_duplicates(pool, 0.95).where("near_duplicate").collect()
    assert [r.work_key for r in flagged] == [0]
