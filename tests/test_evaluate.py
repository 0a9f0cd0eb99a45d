import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshelf.operators import embed, evaluate
from vecshelf.operators.centroid import vector_arithmetic
from vecshelf.operators.knn import knn

WORDS = {
    "king": [1.0, 1.0, 0.0],
    "man": [0.0, 1.0, 0.0],
    "woman": [0.0, 0.0, 1.0],
    "queen": [1.0, 0.0, 1.0],
}


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(list(WORDS.items()), "label string, vec array<double>")


def test_analogy(spark, words):
    terms = spark.createDataFrame(
        [("royal", "king", 1.0), ("royal", "man", -1.0), ("royal", "woman", 1.0), ("lost", "king", 1.0), ("lost", "emu", 1.0)],
        "expr_id string, label string, coef double",
    )
    sums = vector_arithmetic(words, terms)
    # An expression with a term that has no vector is left out.
    assert [r.expr_id for r in sums.collect()] == ["royal"]
    assert np.allclose(sums.first().vec, np.array([1, 0, 1]) / np.sqrt(2))
    assert np.allclose(vector_arithmetic(words, terms, normalize=False).first().vec, [1, 0, 1])
    candidates = words.select(F.lit("royal").alias("expr_id"), "label", (F.col("label") == "queen").alias("expected"))
    ranked = evaluate.analogy_rank(sums, candidates, words).orderBy("rank").collect()
    assert (ranked[0].label, ranked[0].expected) == ("queen", True) and len(ranked) == 4
    assert ranked[0].score == pytest.approx(1.0)


def test_pairwise_matrix(words):
    pairs = {(r.label_a, r.label_b): r.cosine for r in evaluate.pairwise_cosine(words).collect()}
    assert len(pairs) == 16
    for (a, b), cosine in pairs.items():
        assert cosine == pytest.approx(pairs[(b, a)])
        assert abs(cosine) <= 1 + 1e-9 and (a != b or cosine == pytest.approx(1.0))
    matrix = evaluate.pairwise_cosine(words, pivot=True)
    assert set(matrix.columns) == {"label_a", *WORDS} and matrix.count() == 4


def test_matrix_has_a_cell_for_a_zero_vector(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("zero", [0.0, 0.0])], "label string, vec array<double>")
    got = {(r.label_a, r.label_b): r.cosine for r in evaluate.pairwise_cosine(vectors).collect()}
    assert got == {("a", "a"): 1.0, ("a", "zero"): None, ("zero", "a"): None, ("zero", "zero"): None}


def test_analogy_ranks_every_candidate(spark):
    vectors = spark.createDataFrame([(f"w{i:02}", [1.0, i / 10]) for i in range(15)], "label string, vec array<double>")
    expression = spark.createDataFrame([("e", [1.0, 0.0])], "expr_id string, vec array<double>")
    candidates = vectors.select(F.lit("e").alias("expr_id"), "label", F.lit(False).alias("expected"))
    assert evaluate.analogy_rank(expression, candidates, vectors).count() == 15
    assert evaluate.analogy_rank(expression, candidates, vectors, 4).count() == 4


def test_overlap(spark):
    ranked = spark.createDataFrame(
        [("a", k, k) for k in range(1, 8)] + [("b", k + 2, k) for k in range(1, 8)] + [("c", k + 50, k) for k in range(1, 8)],
        "list_id string, key long, rank long",
    )
    got = {(r.list_a, r.list_b): r.overlap for r in evaluate.topk_overlap(ranked, 5).collect()}
    assert got == {("a", "a"): 5, ("b", "b"): 5, ("c", "c"): 5, ("a", "b"): 3, ("b", "a"): 3}


CONCEPT = "concept_id long, title string, type string, year long, expected_author string, expected_title string"


def test_render_formats(spark):
    concepts = spark.createDataFrame(
        [(1, "Dune", "Movie", 2021, "h", "Dune"), (2, "Halo", "Game", None, "d", "Halo")], CONCEPT
    )
    got = {(r.concept_id, r.format): r.text for r in evaluate.render_formats(concepts).collect()}
    assert got[(1, "bare")] == "Dune" and got[(1, "paren")] == "Dune (movie)"
    assert got[(1, "pipe")] == "Movie|2021|Dune" and got[(2, "pipe")] == "Game|Halo"
    assert got[(1, "pipe_no_year")] == "Movie|Dune"
    assert got[(1, "colon_nl")] == "category: Movie\ntitle: Dune\nyear: 2021"
    assert got[(2, "yaml")] == "category: Game\ntitle: Halo"
    assert got[(1, "json")] == '{"category": "Movie", "title": "Dune", "year": "2021"}'
    assert got[(2, "json")] == '{"category": "Game", "title": "Halo"}'
    assert got[(1, "ini")] == "[item]\ncategory=Movie\ntitle=Dune\nyear=2021"
    assert got[(1, "sentence")] == "The 2021 movie Dune" and got[(2, "sentence")] == "The game Halo"
    needed = {r.input_text for r in evaluate.format_texts(concepts).collect()}
    assert {"Movie", "2021", "category: Movie", "year: 2021", "category: Game"} <= needed


def test_evaluate_formats(spark, shelf):
    corpus, _ = shelf
    concepts = spark.createDataFrame(
        [(1, "Dune", "Movie", 2021, "author 3", "title 3"), (2, "Halo", "Game", None, "nobody", "x")], CONCEPT
    )
    inputs = evaluate.format_texts(concepts).unionByName(corpus.select("input_text"))
    vectors = embed.embed_texts(embed.keyed(inputs), embed.hash_embedder)
    scores = evaluate.evaluate_formats(concepts, vectors, corpus).collect()
    by = {(r.concept_id, r.format, r.variant): r.score for r in scores}
    assert len(by) == 2 * (2 + 7 * 3) and by[(2, "bare", "marked")] is None

    def hashed(text):
        v = embed.hash_embedder([text])[0].astype(float)
        return v / np.linalg.norm(v)

    found = [i for i in range(300) if "title 3" in f"title {i}" and "author 3" in f"author {i % 12}"]
    best = min(found, key=lambda i: (-(i % 17), 1900 + i % 90, i))
    target = hashed(f"Book|author {best % 12}|title {best}")
    lessened = hashed("Movie|2021|Dune") - hashed("category: Movie") - hashed("year: 2021")
    expected = lessened @ target / np.linalg.norm(lessened)
    assert by[(1, "pipe", "sub_explicit")] == pytest.approx(expected, abs=1e-6)
    hashed_corpus = corpus.drop("vec").join(vectors.select("input_text", "vec"), "input_text")
    near = evaluate.format_neighbours(concepts, vectors, hashed_corpus, 3)
    assert near.count() == len(by) * 3


def test_random_control_is_repeatable_and_far(spark, shelf):
    corpus, _ = shelf
    one = {r.qid: r.vec for r in evaluate.random_control(spark, 10, 4096).collect()}
    two = {r.qid: r.vec for r in evaluate.random_control(spark, 10, 4096).coalesce(1).collect()}
    assert one == two
    matrix = np.array([one[i] for i in range(10)])
    cosines = matrix @ matrix.T
    assert np.allclose(np.diag(cosines), 1) and np.abs(cosines - np.eye(10)).max() < 0.1
    assert knn(corpus, evaluate.random_control(spark, 2, 8), 3).count() == 6
