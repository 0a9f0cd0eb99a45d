import numpy as np
import pytest
from pyspark.sql import functions as F

import vecshelf.operators.cluster as cluster

AXES = np.eye(6)


@pytest.fixture(scope="module")
def planted(spark):
    """Each user likes works near two or three axes; noise is small."""
    rng = np.random.default_rng(2)
    vectors, ratings, truth = [], [], {}
    for axis in range(6):
        for i in range(20):
            v = AXES[axis] + rng.normal(scale=0.08, size=6)
            vectors.append((f"t{axis}-{i}", [float(x) for x in v]))
    for user, axes in {"two": (0, 1), "three": (2, 3, 4)}.items():
        for axis in axes:
            for i in range(8):
                ratings.append((user, axis * 100 + i, f"t{axis}-{i}", 1 + i % 2))
                truth[(user, f"t{axis}-{i}")] = axis
    ratings += [("two", 500, "t5-0", -2), ("two", 501, "t5-1", -1)]
    ratings += [("single", 0, "t0-0", 2), ("hater", 1, "t0-1", -2), ("blind", 9, "unknown", 2)]
    vecs = spark.createDataFrame(vectors, "input_text string, vec array<double>")
    corpus = vecs.withColumn("parts", F.split(F.substring("input_text", 2, 10), "-")).select(
        "input_text",
        (F.col("parts")[0].cast("long") * 100 + F.col("parts")[1].cast("long")).alias("work_key"),
        F.concat(F.lit("a"), F.col("parts")[0]).alias("author"),
        F.col("input_text").alias("title"),
        "vec",
    )
    rated = spark.createDataFrame(ratings, "user string, work_key long, input_text string, rating int")
    return rated, vecs, corpus, truth


def grouping(members, user):
    sets = {}
    for r in members.where(F.col("user") == user).collect():
        sets.setdefault(r.cluster, set()).add(r.input_text.split("-")[0])
    return sorted(sorted(s) for s in sets.values())


@pytest.mark.parametrize("cell", [50_000, 3])
def test_planted_groups(planted, monkeypatch, cell):
    # With tiny cells a user's likes are salted over many of them.
    monkeypatch.setattr(cluster, "CELL_POINTS", cell)
    ratings, vectors, _, truth = planted
    members, centroids = cluster.cluster_preferences(ratings, vectors, 3, min_size=2)
    members = members.cache()
    assert grouping(members, "three") == [["t2"], ["t3"], ["t4"]]
    assert members.where("user in ('hater', 'blind')").count() == 0
    assert [r.cluster for r in members.where("user = 'single'").collect()] == [0]
    assert members.where("user = 'single'").first().next_score is None
    two, _ = cluster.cluster_preferences(ratings, vectors, 2)
    assert grouping(two, "two") == [["t0"], ["t1"]]
    for r in centroids.collect():
        assert np.isclose(np.linalg.norm(r.vec), 1.0)


def test_labels_and_choice_of_k(planted):
    ratings, vectors, corpus, _ = planted
    members, _ = cluster.cluster_preferences(ratings, vectors, 2)
    labels = cluster.label_clusters(members, corpus, 2).where("user = 'two'").collect()
    assert sorted(r["size"] for r in labels) == [8, 8]
    for r in labels:
        titles = r.label.split(", ")
        assert len(titles) == 2 and titles[0][:2] == titles[1][:2]
    chosen = {r.user: r.k for r in cluster.choose_k(ratings, vectors, (2, 3)).collect()}
    assert chosen["two"] == 2 and chosen["three"] == 3


def test_clustered_recommendations(planted):
    ratings, vectors, corpus, _ = planted
    _, centroids = cluster.cluster_preferences(ratings.where("user = 'two'"), vectors, 2)
    parts = (ratings, corpus, corpus, vectors, centroids)
    recs = cluster.recommend_clustered(*parts, n=5).collect()
    rated = {r.work_key for r in ratings.where("user = 'two'").collect()}
    by_cluster = {}
    for r in recs:
        assert r.work_key not in rated
        by_cluster.setdefault(r.cluster, set()).add(r.work_key // 100)
    assert sorted(map(sorted, by_cluster.values())) == [[0], [1]]
    # Works near the disliked axis 5 are dropped, others stay.
    everything = cluster.recommend_clustered(*parts, n=200)
    filtered = cluster.recommend_clustered(*parts, n=200, dislikes="filter", threshold=0.8)
    assert everything.where("work_key >= 500").count() == 2 * 18
    assert filtered.where("work_key >= 500").count() == 0
    assert filtered.where("work_key < 500").count() == everything.where("work_key < 500").count()
    fresh = cluster.recommend_clustered(*parts, n=200, exclude_rated_authors=True)
    assert {r.work_key // 100 for r in fresh.collect()} == {2, 3, 4}
    with pytest.raises(ValueError):
        cluster.recommend_clustered(*parts, dislikes="other")


def test_unsettled_rounds_are_an_error(planted, monkeypatch):
    ratings, vectors, _, _ = planted
    with pytest.raises(Exception, match="not settled"):
        cluster.cluster_preferences(ratings, vectors, 3, iters=1, tolerance=-1)
    monkeypatch.setattr(cluster, "CELL_POINTS", 3)
    with pytest.raises(Exception, match="not settled"):
        cluster.cluster_preferences(ratings, vectors, 3, iters=1, tolerance=-1)


def test_both_ways_give_the_same_clusters(planted, monkeypatch):
    ratings, vectors, _, _ = planted
    chosen = lambda: {r.user: (r.k, round(r.silhouette, 9)) for r in cluster.choose_k(ratings, vectors, (2, 3, 4)).collect()}
    whole = chosen()
    monkeypatch.setattr(cluster, "CELL_POINTS", 5)
    assert chosen() == whole


def test_users_of_any_name_come_back(planted):
    ratings, vectors, corpus, _ = planted
    odd = ratings.where("user = 'two'").withColumn("user", F.lit("a\x1fb"))
    _, centroids = cluster.cluster_preferences(odd, vectors, 2)
    recs = cluster.recommend_clustered(odd, corpus, corpus, vectors, centroids, n=3).collect()
    assert {r.user for r in recs} == {"a\x1fb"} and {r.cluster for r in recs} == {0, 1}


def test_penalty_is_highest_cosine_to_dislikes(planted):
    ratings, vectors, corpus, _ = planted
    _, centroids = cluster.cluster_preferences(ratings.where("user = 'two'"), vectors, 2)
    recs = cluster.recommend_clustered(ratings, corpus, corpus, vectors, centroids, n=200, dislikes="penalty", lam=0.5)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    vec = {r.work_key: unit(r.vec) for r in corpus.collect()}
    heads = {r.cluster: np.array(r.vec) for r in centroids.collect()}
    for r in recs.collect():
        push = max(vec[500] @ vec[r.work_key], vec[501] @ vec[r.work_key])
        assert r.score == pytest.approx(heads[r.cluster] @ vec[r.work_key] - 0.5 * push)


RECS = "user string, cluster int, work_key long, score double, rank long"


def test_merge(spark):
    recs = spark.createDataFrame(
        [
            ("u", 0, 1, 0.9, 1), ("u", 0, 2, 0.8, 2), ("u", 0, 3, 0.7, 3),
            ("u", 1, 1, 0.95, 1), ("u", 1, 4, 0.2, 2), ("u", 1, 2, 0.8, 3),
        ],
        RECS,
    )
    turns = cluster.merge_clusters(recs, 4).orderBy("rank").collect()
    assert [(r.cluster, r.work_key) for r in turns] == [(0, 2), (1, 1), (0, 3), (1, 4)]
    sorted_ = cluster.merge_clusters(recs, 3, order="score").orderBy("rank").collect()
    assert [(r.cluster, r.work_key) for r in sorted_] == [(1, 1), (0, 2), (0, 3)]
