import pytest

from vecshelf.operators import search
from vecshelf.operators.catalog import all_vectors, book_meta, build_catalog, build_corpus, lookup
from vecshelf.operators.grouping import aggregate, canonical
from vecshelf.sources.preferences import read_preferences
from vecshelf.sources.tables import query_vectors
from pyspark.sql import functions as F

BOOKS = "work_key string, title string, primary_author_key string, first_publish_year int, edition_count long"


@pytest.fixture(scope="module")
def books(spark):
    rows = [
        ("W1", "Dune", "A1", 1965, 9),
        ("W2", "Dune", "A1", 1960, 9),
        ("W3", "Dune", "A1", None, 9),
        ("W4", "Dune Messiah", "A1", 1969, 5),
        ("W5", "100% True_Story", "A2", None, 3),
        ("W6", None, "A2", 1990, 2),
        ("W7", "Orphan", "A9", 1990, 2),
        ("W8", "Same", "A2", 2000, 4),
        ("W9", "Same", "A2", 2000, 4),
    ]
    authors = [("A1", "Frank Herbert"), ("A2", "An Author"), ("A3", "Nobody")]
    return (
        spark.createDataFrame(rows, BOOKS),
        spark.createDataFrame(authors, "author_key string, name string"),
    )


@pytest.fixture(scope="module")
def corpus(spark, books):
    meta = book_meta(*books)
    vectors = spark.createDataFrame(
        [
            ("Book|Frank Herbert|Dune", "m", [1.0, 0.0]),
            ("Book|Frank Herbert|Dune Messiah", "m", [1.0, 0.2]),
            ("Book|An Author|Same", "m", [0.0, 1.0]),
            ("Book|An Author|100% True_Story", "m", [0.1, 1.0]),
            ("Book|An Author|Same", "other", [9.0, 9.0]),
        ],
        "input_text string, model_id string, vec array<double>",
    )
    return build_corpus(meta, vectors, "m")


def keys(df):
    return [r.work_key for r in df.collect()]


def test_book_meta_picks_one_row_per_text(books):
    meta = {r.input_text: r.work_key for r in book_meta(*books).collect()}
    # Equal editions: the earlier year, a missing year last; equal years: the key.
    assert meta["Book|Frank Herbert|Dune"] == "W2" and meta["Book|An Author|Same"] == "W8"
    assert len(meta) == 4 and "W6" not in meta.values() and "W7" not in meta.values()


def test_catalog_needs_author_and_year(books):
    catalog = build_catalog(*books)
    assert sorted(keys(catalog)) == ["W1", "W2", "W4", "W6", "W8", "W9"]
    assert catalog.where("work_key = 'W4'").first().title_lc == "dune messiah"
    assert sorted(keys(lookup(catalog, ["W1", "W5"]))) == ["W1"]


def test_find_and_best_match(corpus):
    assert keys(search.find(corpus, "dune")) == ["W2", "W4"]
    assert keys(search.find(corpus, "HERBERT|dune m")) == ["W4"]
    assert keys(search.find(corpus, "%")) == ["W5"] and keys(search.find(corpus, "e_S")) == ["W5"]
    assert keys(search.best_match(corpus, "nothing")) == []


def test_similar_to(corpus):
    near = search.similar_to(corpus, "dune", 10).orderBy("rank").collect()
    assert [r.work_key for r in near] == ["W4", "W5", "W8"]
    others = search.similar_to(corpus, "dune", 1, same_author=False).collect()
    assert [r.work_key for r in others] == ["W5"]
    assert search.similar_to(corpus, "nothing").count() == 0


def test_similar_between(corpus):
    row = search.similar_between(corpus, "messiah", "same").first()
    assert (row.book_a, row.book_b) == ("Dune Messiah", "Same")
    assert row.sim == pytest.approx(0.2 / (1.04**0.5))
    assert search.similar_between(corpus, "messiah", "nothing").count() == 0


@pytest.mark.parametrize("inline", [256, 0])
def test_search_catalog(spark, books, corpus, inline):
    catalog = build_catalog(*books)
    queries = ["DUNE", "frank", "e", "zzz", "", "Dune Messiah!", "an author"]
    found = search.search_catalog(catalog, corpus, queries, 3, inline).orderBy("query", "rank").collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r.query, []).append((r.work_key, r.has_embedding))
    assert by_query == {
        "DUNE": [("W2", True), ("W1", False), ("W4", True)],
        "frank": [("W2", True), ("W1", False), ("W4", True)],
        "e": [("W2", True), ("W1", False), ("W4", True)],
        "an author": [("W8", True), ("W9", False), ("W6", False)],
    }
    assert search.search_catalog(catalog, corpus, ["e"], 1, inline).count() == 1


@pytest.mark.parametrize("inline", [256, 0])
def test_preferences(spark, tmp_path, corpus, inline):
    path = tmp_path / "preferences.txt"
    path.write_text(" herbert | DUNE \nherbert|DUNE\nherbert|messiah\nX|Dune\n|same\nAuthor|100%\n")
    prefs = read_preferences(spark, str(path))
    lines = {(r.pref_author, r.pref_title): r.matched_title for r in search.pref_matches(prefs, corpus, inline).collect()}
    assert lines.pop(("herbert", "DUNE")) == "Dune"
    assert lines.pop(("herbert", "messiah")) == "Dune Messiah"
    assert lines.pop(("X", "Dune")) is None
    assert lines.pop(("Author", "100%")) == "100% True_Story"


def test_find_vector_resolves_before_the_vector(spark, books):
    catalog = build_catalog(*books)
    vectors = spark.createDataFrame(
        [("Book|Frank Herbert|Dune Messiah", [1.0])], "input_text string, vec array<double>"
    )
    wanted = spark.createDataFrame([("herbert", "dune"), ("herbert", "messiah")], "author string, title string")
    got = {r.title: r.vec for r in search.find_vector(catalog, vectors, wanted).collect()}
    # The best match of "dune" is not embedded although another match is.
    assert got == {"dune": None, "messiah": [1.0]}


def test_all_vectors_prefers_the_corpus(spark, corpus):
    extra = spark.createDataFrame(
        [("Book|An Author|Same", [5.0, 5.0]), ("new", [2.0, 2.0]), ("new", [2.0, 2.0])],
        "input_text string, vec array<double>",
    )
    got = {r.input_text: r.vec for r in all_vectors(corpus, extra).collect()}
    assert got["Book|An Author|Same"] == [0.0, 1.0] and got["new"] == [2.0, 2.0] and len(got) == 5


def test_canonical_with_a_hot_group(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"),
        F.when(F.col("id") == 999, None).otherwise(F.col("id")).alias("v"),
    )
    got = {r.g: r.v for r in canonical(rows, ["g"], [-F.col("v")]).collect()}
    assert got[0] == 2997 and len(got) == 2001 and got[1] == 1


def test_aggregate_spreads_over_all_keys(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("a"), (F.col("id") % 5).alias("b"))
    on_a = rows.repartition(4, "a")
    plan = aggregate(on_a, ["a", "b"], F.count("*").alias("n"))
    assert plan.count() == 10
    text = plan._jdf.queryExecution().toString()
    assert "hashpartitioning(_groupingexpression" in text


def test_query_vectors(spark):
    got = query_vectors(spark, {"x": [1, 2.5]}).first()
    assert (got.label, got.vec) == ("x", [1.0, 2.5])
