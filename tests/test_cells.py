import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshelf.operators import cells, hyperplanes, partial, present, project
from vecshelf.operators.cluster import silhouette_widths
from vecshelf.operators.knn import knn
from vecshelf.session import new_path


def frame(spark, matrix, keys=None):
    rows = [(k, [float(x) for x in v]) for k, v in zip(keys if keys is not None else range(len(matrix)), matrix, strict=True)]
    return spark.createDataFrame(rows, "work_key long, vec array<double>").repartition(4)


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def blobs(spark):
    """Twelve groups of directions, one of them with a third of all rows."""
    rng = np.random.default_rng(4)
    middles = unit(rng.normal(size=(12, 16)))
    of = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 12, 3000))
    matrix = unit(middles[of] + 0.15 * rng.normal(size=(3000, 16)))
    return frame(spark, matrix).cache(), matrix


def kmeans(matrix, k, rounds):
    heads = matrix[:k].copy()
    for _ in range(rounds):
        best = np.round(matrix @ heads.T, 12).argmax(1)
        for c in range(k):
            if (best == c).any():
                total = matrix[best == c].sum(0)
                heads[c] = total / np.linalg.norm(total)
    return heads, np.round(matrix @ heads.T, 12)


def test_corpus_clusters_equal_numpy(spark, blobs):
    corpus, matrix = blobs
    seeds = corpus.orderBy("work_key").limit(6)
    members, centroids = cells.cluster_corpus(corpus, 6, 5, seeds)
    heads, scores = kmeans(matrix, 6, 5)
    got = np.array([r["vec"] for r in centroids.orderBy("cell").collect()])
    assert np.allclose(got, heads, atol=1e-9)
    rows = members.orderBy("work_key").collect()
    assert [r["cell"] for r in rows] == scores.argmax(1).tolist()
    assert np.allclose([r["score"] for r in rows], scores.max(1))


def test_all_cells_are_exact_and_few_find_most(spark, blobs, monkeypatch):
    corpus, matrix = blobs
    # the hot cell is cut into many pieces, and the queries of a cell into several blocks
    monkeypatch.setattr(cells, "CELL_ROWS", 100)
    monkeypatch.setattr(cells, "QUERY_BYTES", 8 * 16 * 5)
    queries = corpus.where("work_key % 50 = 0").select(F.col("work_key").alias("qid"), "vec")
    exact = knn(corpus, queries, 10).cache()
    index = cells.CellIndex.build(corpus, new_path(spark, "index"), 24)
    assert index.sizes.sum() == 3000
    every = index.search(queries, 10, None)
    key = ["qid", "rank", "work_key"]
    assert every.select(*key).orderBy(*key).collect() == exact.select(*key).orderBy(*key).collect()
    probes = index.needed(queries, 10, 0.9)
    found = index.search(queries, 10, probes)
    assert probes < 12
    assert cells.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    again = cells.CellIndex.open(spark, index.path)
    assert again.search(queries, 10, probes).select(*key).orderBy(*key).collect() == found.select(*key).orderBy(*key).collect()


def test_queries_with_several_vectors_and_odd_rows(spark, blobs):
    corpus, _ = blobs
    odd = frame(spark, np.zeros((1, 16)), [9000]).union(spark.createDataFrame([(9001, None), (None, [1.0] * 16)], corpus.schema))
    whole = corpus.union(odd)
    queries = corpus.where("work_key < 6").select((F.col("work_key") % 2).alias("qid"), "vec")
    queries = queries.union(spark.createDataFrame([(5, None)], queries.schema))
    key = ["qid", "rank", "work_key"]
    got = cells.CellIndex.build(whole, new_path(spark, "index"), 8).search(queries, 7, None).select(*key).orderBy(*key).collect()
    assert got == knn(whole, queries, 7).select(*key).orderBy(*key).collect()


def test_empty_corpus(spark):
    empty = frame(spark, np.zeros((0, 2)))
    index = cells.CellIndex.build(empty, new_path(spark, "index"))
    queries = frame(spark, np.eye(2)).withColumnRenamed("work_key", "qid")
    assert index.search(queries, 3).count() == 0 and index.needed(queries, 3) == 1
    assert cells.knn_approx(empty, queries, new_path(spark, "index")).count() == 0
    assert project.reduce_dims(empty, 2) is None and partial.summed(empty, lambda t, b: t) is None


@pytest.mark.parametrize("block", [16_384, 40])
def test_banded_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hyperplanes, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(1200, 24))
    # near copies of a few rows, one of them two hundred times
    matrix[600:800] = matrix[5] + 0.1 * rng.normal(size=(200, 24))
    matrix[800:1000] = matrix[:200] + 0.2 * rng.normal(size=(200, 24))
    matrix[1000:1100] = matrix[7]
    corpus = frame(spark, matrix).union(spark.createDataFrame([(5000, None), (5001, [0.0] * 24)], "work_key long, vec array<double>"))
    want, classes = present.near_duplicates(corpus, 0.92)
    got, _ = present.near_duplicates(corpus, 0.92, recall=0.99999)
    assert got.columns == want.columns
    rows = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    assert rows(got) == rows(want) and want.count() > 10_000
    assert classes.where("work_key <> class_key").count() == 100
    # farther pairs are found as often as asked for
    far = {r[:2] for r in rows(present.near_duplicates(corpus, 0.5)[0])}
    found = {r[:2] for r in rows(present.near_duplicates(corpus, 0.5, recall=0.9)[0])}
    assert found <= far and len(found) >= 0.9 * len(far)


def test_banding_meets_its_recall():
    for threshold in (-0.5, 0.0, 0.4, 0.92, 1.0):
        for rows in (1, 10_000, 10**12):
            bits, tables = hyperplanes.banding(threshold, rows, 0.99)
            met = (1 - np.arccos(threshold) / np.pi) ** bits
            assert 1 - (1 - met) ** tables >= 0.99
    with pytest.raises(ValueError):
        hyperplanes.banding(0.9, 10, 1.0)


def test_principal_components_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(partial, "BLOCK", 10)  # sums travel in pieces
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 3
    df = frame(spark, matrix).withColumn("more", F.lit("x"))
    found = project.reduce_dims(df, 3)
    values, vectors = np.linalg.eigh(np.cov(matrix.T, bias=True))
    assert np.allclose(found.explained, values[::-1][:3])
    assert np.allclose(np.abs(np.sum(found.matrix * vectors[:, ::-1][:, :3], axis=0)), 1)
    assert (found.matrix[np.abs(found.matrix).argmax(0), range(3)] > 0).all()
    nulls = spark.createDataFrame([(777, None, "y")], df.schema)
    out = {r["work_key"]: r for r in found.apply(df.union(nulls)).collect()}
    assert out[777]["vec"] is None and out[777]["more"] == "y"
    assert np.allclose([out[i]["vec"] for i in range(500)], (matrix - matrix.mean(0)) @ found.matrix)
    assert project.reduce_dims(df, 99).matrix.shape == (6, 6)


def test_projection_equals_ridge(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)) + 1
    y = x @ rng.normal(size=(5, 3)) + 2 + 0.1 * rng.normal(size=(400, 3))
    rows = [([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y, strict=True)] + [(None, [1.0] * 3), ([1.0] * 5, None)]
    pairs = spark.createDataFrame(rows, "source array<double>, target array<float>").repartition(3)
    found = project.fit_projection(pairs, 2.0)
    xc, yc = x - x.mean(0), y.astype(np.float32).astype(float) - y.astype(np.float32).astype(float).mean(0)
    assert np.allclose(found.matrix, np.linalg.solve(xc.T @ xc + 2 * np.eye(5), xc.T @ yc))
    row = project.projection_quality(found, pairs).first()
    assert row["n"] == 400 and row["mean_cosine"] > 0.95
    plain = project.fit_projection(pairs, 2.0, intercept=False)
    assert np.allclose(plain.matrix, np.linalg.solve(x.T @ x + 2 * np.eye(5), x.T @ y), atol=1e-6)
    assert project.fit_projection(pairs.where("false")) is None


def test_silhouette_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(60, 4))
    of = rng.integers(0, 4, 60)
    of[0] = 9  # alone
    members = [(1, int(c), f"t{i}") for i, c in enumerate(of)] + [(2, 0, "t1"), (2, 0, "t2"), (3, 0, "t5")]
    vectors = spark.createDataFrame([(f"t{i}", [float(x) for x in v]) for i, v in enumerate(matrix)], "input_text string, vec array<double>")
    got = silhouette_widths(spark.createDataFrame(members, "user long, cluster int, input_text string"), vectors)
    got = {(r["user"], r["input_text"]): r["width"] for r in got.collect()}
    assert len(got) == 63 and got[2, "t1"] == got[3, "t5"] == got[1, "t0"] == 0
    u = unit(matrix)
    d = 1 - u @ u.T
    for i in range(1, 60):
        same = [j for j in range(60) if of[j] == of[i] and j != i]
        a = d[i, same].mean()
        b = min(d[i, of == c].mean() for c in set(of.tolist()) - {of[i]})
        assert got[1, f"t{i}"] == pytest.approx((b - a) / max(a, b))
