import numpy as np
import pytest
from pyspark.sql import functions as F

import vecshelf.operators.knn as knn_module
from vecshelf.operators.knn import knn, within

N = 6


def brute(unit, queries, out_keys=(), out_authors=(), n=N):
    """Best works per query by plain numpy; a query may have several vectors."""
    found = set()
    for qid, members in queries.items():
        scores = np.round((unit[members] @ unit.T).max(0), 12)
        allowed = [
            i for i in range(len(unit))
            if (qid, i) not in out_keys and (qid, f"author {i % 12}") not in out_authors
        ]
        best = sorted(allowed, key=lambda i: (-scores[i], i))[:n]
        found |= {(qid, i, round(float(scores[i]), 9), rank + 1) for rank, i in enumerate(best)}
    return found


def taken(df):
    return {(r.qid, r.work_key, round(r.score, 9), r.rank) for r in df.collect()}


@pytest.fixture(params=["broadcast", "grid", "tiny cells"])
def path(request, monkeypatch):
    if request.param != "broadcast":
        monkeypatch.setattr(knn_module, "CORPUS_BYTES", 0)
    if request.param == "tiny cells":
        monkeypatch.setattr(knn_module, "CELL_QUERY_BYTES", 8 * 8 * 3)
        monkeypatch.setattr(knn_module, "CELL_CORPUS_ROWS", 40)
    return {"broadcast_bytes": knn_module.BROADCAST_BYTES if request.param == "broadcast" else 0}


def test_knn_equals_brute_force(spark, shelf, path):
    corpus, unit = shelf
    members = {q: [q * 7 % 300, (q * 11 + 3) % 300] for q in range(9)}
    # One query owns a third of all query vectors.
    members[9] = list(range(100, 109))
    pairs = [(q, i) for q, rows in members.items() for i in rows]
    owners = spark.createDataFrame(pairs, "qid long, work_key long")
    queries = owners.join(corpus.select("work_key", "vec"), "work_key").select("qid", "vec")
    authors = [(q, f"author {(q + d) % 12}") for q in range(10) for d in range(3)]
    out_authors = spark.createDataFrame(authors, "qid long, author string")
    # Query 0 leaves out a third of the corpus.
    keys = pairs + [(0, i) for i in range(100)] + [(99, 5), (1, 10_000)]
    out_keys = spark.createDataFrame(keys, "qid long, work_key long")
    got = knn(corpus, queries, N, exclude=out_keys, exclude_groups=out_authors, **path)
    assert taken(got) == brute(unit, members, set(keys), set(authors))
    plain = knn(corpus, queries, N, **path)
    assert taken(plain) == brute(unit, members)


def test_copies_tie_on_the_key(spark, shelf, path):
    corpus, _ = shelf
    copies = corpus.withColumn(
        "vec", F.when(F.col("work_key") < 150, F.array(*[F.lit(1.0).cast("float")] * 8)).otherwise(F.col("vec"))
    )
    query = spark.createDataFrame([(0, [1.0] * 8)], "qid int, vec array<double>")
    got = sorted((r.rank, r.work_key) for r in knn(copies, query, 5, **path).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_string_keys_and_null_groups(spark, path):
    corpus = spark.createDataFrame(
        [("a", None, [1.0, 0.0]), ("b", "g", [1.0, 0.1]), ("c", "h", [0.0, 1.0]), ("z", "h", [0.0, 0.0])],
        "work_key string, author string, vec array<double>",
    )
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "qid string, vec array<double>")
    out = spark.createDataFrame([("q", "g")], "qid string, author string")
    got = sorted((r.qid, r.work_key, r.rank) for r in knn(corpus, queries, 5, exclude_groups=out, **path).collect())
    assert got == [("q", "a", 1), ("q", "c", 2)]


def test_empty_sides(spark, shelf, path):
    corpus, _ = shelf
    none = spark.createDataFrame([], "qid long, vec array<double>")
    assert knn(corpus, none, 5, **path).count() == 0
    query = spark.createDataFrame([(0, [1.0] * 8)], "qid long, vec array<double>")
    assert knn(corpus.where("work_key < 0"), query, 5, **path).count() == 0


def test_metrics_and_prefilter(spark, shelf, path):
    corpus, unit = shelf
    rows = {r.work_key: np.array(r.vec, dtype=float) for r in corpus.collect()}
    q = np.arange(1.0, 9.0)
    query = spark.createDataFrame([(0, q.tolist())], "qid long, vec array<double>")
    expected = {
        "dot": lambda v: v @ q,
        "l2": lambda v: -np.linalg.norm(v - q),
        "mean_cosine": lambda v: v @ q / np.linalg.norm(v),
        "cosine": lambda v: v @ q / np.linalg.norm(v) / np.linalg.norm(q),
    }
    for metric, score in expected.items():
        got = knn(corpus, query, 3, metric=metric, where="year > 1950", **path).orderBy("rank").collect()
        chosen = [k for k in rows if 1900 + k % 90 > 1950]
        best = sorted(chosen, key=lambda k: -score(rows[k]))[:3]
        assert [r.work_key for r in got] == best
        assert np.allclose([r.score for r in got], [score(rows[k]) for k in best])
    with pytest.raises(ValueError):
        knn(corpus, query, 3, metric="other")


def test_within_finds_every_pair(spark, shelf, path):
    corpus, unit = shelf
    queries = corpus.select(F.col("work_key").alias("qid"), "vec")
    got = {(r.qid, r.work_key) for r in within(corpus, queries, 0.7, **path).collect()}
    scores = np.round(unit @ unit.T, 12)
    assert got == {tuple(map(int, p)) for p in np.argwhere(scores >= 0.7)}
    assert all((b, a) in got for a, b in got) and all((i, i) in got for i in range(300))


def test_within_counts_the_vectors_of_a_query(spark, shelf, path):
    corpus, unit = shelf
    members = {q: list(range(q * 20, q * 20 + 12)) for q in range(4)}
    owners = spark.createDataFrame([(q, i) for q, m in members.items() for i in m], "qid long, work_key long")
    queries = owners.join(corpus.select("work_key", "vec"), "work_key").select("qid", "vec")
    got = {(r.qid, r.work_key): (round(r.score, 9), r.near) for r in within(corpus, queries, 0.5, **path).collect()}
    expected = {}
    for q, m in members.items():
        scores = np.round(unit[m] @ unit.T, 12)
        for i in np.flatnonzero((scores >= 0.5).any(0)):
            expected[(q, int(i))] = (round(float(scores[:, i].max()), 9), int((scores[:, i] >= 0.5).sum()))
    assert got == expected


def test_vectors_of_different_length_are_refused(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "work_key long, vec array<double>").coalesce(1)
    query = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vec array<double>")
    with pytest.raises(Exception, match="differ in length"):
        knn(corpus, query, 1).collect()
