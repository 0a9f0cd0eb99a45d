"""Whichever side travels, the rows are the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshelf.operators import knn as sides
from vecshelf.operators import present, search
from vecshelf.operators.knn import grid_partitions, knn


@pytest.fixture(scope="module")
def case(spark, shelf):
    corpus, _ = shelf
    rng = np.random.default_rng(9)
    queries = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in rng.normal(size=8)]) for i in range(12) for _ in range(1 + i % 3)],
        "qid string, vec array<double>",
    )
    exclude = spark.createDataFrame([(f"q{i}", k) for i in range(12) for k in range(i, 300, 7)], "qid string, work_key long")
    groups = spark.createDataFrame([(f"q{i}", f"author {i}") for i in range(6)], "qid string, author string")
    return corpus, queries, exclude, groups


def rows(df):
    return sorted((r.qid, r["rank"], r.work_key, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "mean_cosine"])
def test_three_ways_agree(case, metric):
    corpus, queries, exclude, groups = case
    options = {"exclude": exclude, "exclude_groups": groups, "metric": metric}
    few = rows(knn(corpus, queries, 5, **options))
    assert rows(knn(corpus, queries, 5, broadcast_bytes=0, **options)) == few
    assert rows(knn(corpus, queries, 5, broadcast_bytes=0, corpus_bytes=0, **options)) == few
    # the corpus in several blocks
    assert rows(sides.top_ranked(sides._past_corpus(
        corpus, queries, 5, exclude, groups, "work_key", "author", None, metric, sides._Extra(), 4000
    ), "qid", 5, [F.col("score").desc(), F.col("work_key").asc()])) == few


@pytest.mark.parametrize("first, pairs", [(0, 1_000_000), (4096, 3), (2, 3)])
def test_bounds_change_nothing(case, monkeypatch, first, pairs):
    corpus, queries, exclude, groups = case
    want = rows(knn(corpus, queries, 5, exclude=exclude, exclude_groups=groups))
    monkeypatch.setattr(sides, "FIRST_LOOK", first)
    monkeypatch.setattr(sides, "BROADCAST_EXCLUSIONS", pairs)
    assert rows(knn(corpus, queries, 5, exclude=exclude, exclude_groups=groups)) == want


@pytest.mark.parametrize("block", [None, 4000])
def test_against_and_near(case, block):
    corpus, queries, exclude, _ = case
    vec = {r.work_key: np.array(r.vec, float) / np.linalg.norm(r.vec) for r in corpus.collect()}
    wishes, against = {}, {}
    for r in queries.collect():
        wishes.setdefault(r.qid, []).append(np.array(r.vec) / np.linalg.norm(r.vec))
    bad = queries.where("qid in ('q1', 'q2')").select("qid", F.reverse("vec").alias("vec"))
    for r in bad.collect():
        against.setdefault(r.qid, []).append(np.array(r.vec) / np.linalg.norm(r.vec))
    for asked in ({"lam": 0.7}, {"avoid": 0.2}, {"lam": 0.3, "avoid": 0.4}, {"min_near": (2, 0.1)}):
        extra = {} if "min_near" in asked else {"against": bad}
        got = rows(knn(corpus, queries, 6, corpus_bytes=block, **extra, **asked))
        want = []
        for q, vs in wishes.items():
            scored = []
            for k, v in vec.items():
                scores = [round(float(w @ v), 12) for w in vs]
                worst = max((round(float(w @ v), 12) for w in against.get(q, [])), default=None)
                if "min_near" in asked and sum(s >= asked["min_near"][1] for s in scores) < asked["min_near"][0]:
                    continue
                if worst is not None and worst >= asked.get("avoid", 9) and extra:
                    continue
                score = max(scores) - (asked.get("lam", 0) * worst if worst is not None and extra else 0)
                scored.append((-round(score, 12), k))
            want += [(q, i + 1, k, round(-s, 9)) for i, (s, k) in enumerate(sorted(scored)[:6])]
        assert got == sorted(want)


def test_grid_partitions_are_bounded():
    # 10^5 blocks of queries and 400 of the corpus
    assert grid_partitions(100_000 * 400, 8) == 256
    assert grid_partitions(3, 8) == 3


def test_near_duplicates(spark, shelf):
    corpus, unit = shelf
    copies = corpus.where("work_key < 20").withColumn("work_key", F.col("work_key") + 1000)
    both = corpus.unionByName(copies)
    pairs, classes = present.near_duplicates(both, 0.9)
    got = {(r.key_a, r.key_b): round(r.score, 6) for r in pairs.collect()}
    scores = unit @ unit.T
    want = {(a, b): round(scores[a, b], 6) for a in range(300) for b in range(a + 1, 300) if scores[a, b] >= 0.9}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-5)
    assert {r.work_key: r.class_key for r in classes.collect()} == {**{i: i for i in range(300)}, **{1000 + i: i for i in range(20)}}


def test_search_limit_is_what_was_asked_for(spark):
    rows_ = [(i, "a", f"title {i}", 1900, i, "a", f"title {i}") for i in range(500)]
    catalog = spark.createDataFrame(rows_, "work_key long, author string, title string, year long, editions long, author_lc string, title_lc string")
    corpus = catalog.select("work_key").limit(3)
    assert search.search_catalog(catalog, corpus, ["title"], 500).count() == 500
    with pytest.raises(ValueError):
        search.search_catalog(catalog, corpus, ["title"], 0)


@pytest.mark.parametrize("chars", [4_000_000, 1])
def test_gram_bound_changes_nothing(spark, monkeypatch, chars):
    monkeypatch.setattr(search, "BROADCAST_CHARS", chars)
    texts = spark.createDataFrame([(i, f"word{i % 7} end") for i in range(50)], "id long, t string")
    needles = spark.createDataFrame([("word3",), ("d4 e",), ("d",), ("nope",)], "query string")
    got = sorted((r["query"], r.id) for r in search.substring_pairs(texts, ["t"], needles, inline=0).collect())
    want = sorted((n, i) for n in ("word3", "d4 e", "d", "nope") for i in range(50) if n in f"word{i % 7} end")
    assert got == want


@pytest.mark.parametrize("asked", [{"lam": 0.7}, {"avoid": 0.2}, {"min_near": (2, 0.1)}])
def test_large_corpus_stays_off_the_driver(spark, case, monkeypatch, asked):
    corpus, queries, exclude, groups = case
    options = {"exclude": exclude, "exclude_groups": groups, **asked}
    if "min_near" not in asked:
        options["against"] = queries.select("qid", F.reverse("vec").alias("vec"))
    want = rows(knn(corpus, queries, 6, **options))

    def refused(*_):
        raise AssertionError("the corpus came to the driver")

    # 300 x 8 float64 values are 19,200 bytes, in ten blocks here
    monkeypatch.setattr(type(corpus), "toArrow", refused)
    monkeypatch.setattr(spark.sparkContext, "broadcast", refused)
    found = knn(corpus, queries, 6, corpus_bytes=4000, **options)
    monkeypatch.undo()
    assert want and rows(found) == want
