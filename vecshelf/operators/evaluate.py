"""Experiments in the vector space: arithmetic, analogies, overlap, input formats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecshelf.functions.vector import cosine, l2_norm, l2_normalize
from vecshelf.operators.centroid import vector_arithmetic
from vecshelf.operators.grouping import top_ranked
from vecshelf.operators.knn import knn, within
from vecshelf.operators.search import find_vector
from vecshelf.session import written


def analogy_rank(
    expressions: DataFrame, candidates: DataFrame, vectors: DataFrame, n: int | None = None
) -> DataFrame:
    """Candidate labels by cosine to the combined vector of their expression:
    all of them, or the best ``n``.

    ``expressions`` is ``(expr_id, vec)`` and ``candidates`` is
    ``(expr_id, label, expected)`` with a flag on the sought label.
    """
    scored = (
        candidates.join(vectors.select("label", F.col("vec").alias("term")), "label")
        .join(expressions.select("expr_id", "vec"), "expr_id")
        .select("expr_id", "label", "expected", cosine("vec", "term").alias("score"))
    )
    order = [F.round("score", 12).desc(), F.col("label").asc()]
    if n is not None:
        return top_ranked(scored, "expr_id", n, order)
    rank = F.row_number().over(Window.partitionBy("expr_id").orderBy(*order))
    return scored.withColumn("rank", rank.cast("long"))


def pairwise_cosine(vectors: DataFrame, pivot: bool = False) -> DataFrame:
    """Cosine of every pair of labelled vectors: long ``(label_a, label_b, cosine)``,
    or one row per label with a column per other label."""
    norms = vectors.select("label", l2_norm("vec").alias("norm"))
    # the matrix is the result, so every pair is wanted; a zero vector has no cosine
    dots = within(
        vectors.select("label", "vec"),
        vectors.select(F.col("label").alias("qid"), "vec"),
        -1e300,
        key="label",
        metric="dot",
    ).select(F.col("qid").alias("label_a"), F.col("label").alias("label_b"), F.col("score").alias("dot"))
    both = dots.join(norms.toDF("label_a", "norm_a"), "label_a").join(norms.toDF("label_b", "norm_b"), "label_b")
    share = F.try_divide("dot", F.col("norm_a") * F.col("norm_b"))
    pairs = both.select("label_a", "label_b", share.alias("cosine"))
    if pivot:
        return pairs.groupBy("label_a").pivot("label_b").agg(F.first("cosine"))
    return pairs


def topk_overlap(ranked: DataFrame, k: int = 5) -> DataFrame:
    """``(list_a, list_b, overlap)``: how many of their first ``k`` keys two lists
    share. Lists meet on their keys; pairs that share none have no row."""
    top = ranked.where(F.col("rank") <= k).select("list_id", "key").distinct()
    return (
        top.withColumnRenamed("list_id", "list_a")
        .join(top.withColumnRenamed("list_id", "list_b"), "key")
        .groupBy("list_a", "list_b")
        .agg(F.count("*").alias("overlap"))
    )


def render_formats(concepts: DataFrame) -> DataFrame:
    """Every input format of each ``(concept_id, title, type, year)`` as
    ``(..., format, text)``; a NULL year is left out of the text."""
    title, kind, year = F.col("title"), F.col("type"), F.col("year").cast("string")

    def with_year(base: Column, tail: Column) -> Column:
        return F.when(year.isNull(), base).otherwise(F.concat(base, tail))

    def labelled(lead: str, between: str, year_lead: str) -> Column:
        base = F.concat(F.lit(lead), kind, F.lit(between), title)
        return with_year(base, F.concat(F.lit(year_lead), year))

    # The formats under test.
    formats = {
        "bare": title,
        "paren": F.concat(title, F.lit(" ("), F.lower(kind), F.lit(")")),
        "pipe": F.concat_ws("|", kind, year, title),
        "pipe_no_year": F.concat_ws("|", kind, title),
        "colon_nl": labelled("category: ", "\ntitle: ", "\nyear: "),
        "json": F.concat(
            labelled('{"category": "', '", "title": "', '", "year": "'), F.lit('"}')
        ),
        "ini": labelled("[item]\ncategory=", "\ntitle=", "\nyear="),
        "yaml": labelled("category: ", "\ntitle: ", "\nyear: "),
        "sentence": F.concat(
            F.lit("The "), F.lower(F.concat_ws(" ", year, kind)), F.lit(" "), title
        ),
    }
    rendered = [
        F.struct(F.lit(name).alias("format"), text.alias("text")) for name, text in formats.items()
    ]
    return concepts.select(*concepts.columns, F.inline(F.array(*rendered)))


def format_markers(concepts: DataFrame) -> DataFrame:
    """The marker strings to subtract: ``(concept_id, variant, text)``."""
    kind, year = F.col("type"), F.col("year").cast("string")
    markers = {
        "sub_bare": [kind, year],
        "sub_explicit": [F.concat(F.lit("category: "), kind), F.concat(F.lit("year: "), year)],
    }
    entries = [
        F.struct(F.lit(variant).alias("variant"), text.alias("text"))
        for variant, texts in markers.items()
        for text in texts
    ]
    return concepts.select("concept_id", F.inline(F.array(*entries))).where("text is not null")


def format_texts(concepts: DataFrame) -> DataFrame:
    """All distinct strings an evaluation needs vectors for, as ``input_text``."""
    rendered = render_formats(concepts).select("text")
    return (
        rendered.unionByName(format_markers(concepts).select("text"))
        .distinct()
        .withColumnRenamed("text", "input_text")
    )


_PARTS = ["concept_id", "format", "variant"]


def format_vectors(concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(concept_id, format, variant, expr_id, vec)`` of each rendering.

    Variants are the marked text, and the marked text minus its bare or its
    explicit markers; the plain formats have the first alone. ``expr_id`` is a
    number given to each.
    """
    rendered = render_formats(concepts).select("concept_id", "format", "text")
    whole = rendered.withColumn("variant", F.lit("marked")).withColumn("coef", F.lit(1.0))
    marked = rendered.where(~F.col("format").isin("bare", "paren"))
    markers = format_markers(concepts)
    variants = markers.select("concept_id", "variant").distinct()
    lessened = marked.join(variants, "concept_id").withColumn("coef", F.lit(1.0))
    minus = marked.drop("text").join(markers, "concept_id").withColumn("coef", F.lit(-1.0))
    terms = whole.unionByName(lessened).unionByName(minus).withColumnRenamed("text", "label")
    named = written(
        terms.select(*_PARTS).distinct().withColumn("expr_id", F.monotonically_increasing_id()),
        "format-numbers",
    )
    numbered = terms.join(named, _PARTS).select("expr_id", "label", "coef")
    sums = vector_arithmetic(vectors.select(F.col("input_text").alias("label"), "vec"), numbered)
    return named.join(sums, "expr_id").select(*_PARTS, "expr_id", "vec")


def evaluate_formats(concepts: DataFrame, vectors: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(concept_id, format, variant, expected_title, score)``: cosine of each
    rendering to the expected work, NULL if that work is not embedded.

    ``concepts`` is ``(concept_id, title, type, year, expected_author, expected_title)``.
    """
    wanted = ["expected_author", "expected_title"]
    lines = concepts.select(*[F.col(c).alias(c.removeprefix("expected_")) for c in wanted])
    targets = find_vector(catalog, vectors, lines.distinct()).select(
        F.col("author").alias("expected_author"),
        F.col("title").alias("expected_title"),
        F.col("vec").alias("target"),
    )
    expected = concepts.select("concept_id", *wanted).join(targets, wanted, "left")
    return (
        format_vectors(concepts, vectors)
        .join(expected, "concept_id")
        .select(*_PARTS, "expected_title", cosine("vec", "target").alias("score"))
    )


def format_neighbours(
    concepts: DataFrame, vectors: DataFrame, corpus: DataFrame, n: int = 10
) -> DataFrame:
    """The ``n`` nearest works of each concept, format and variant."""
    rendered = written(format_vectors(concepts, vectors), "format-vectors")
    hits = knn(corpus, rendered.select(F.col("expr_id").alias("qid"), "vec"), n)
    named = rendered.select(*_PARTS, F.col("expr_id").alias("qid"))
    return hits.join(named, "qid").drop("qid")


def random_control(spark: SparkSession, count: int, dim: int, seed: int = 42) -> DataFrame:
    """``count`` random unit vectors ``(qid, vec)``; each number comes from the
    SHA-256 of the seed, the vector's number and its place, so any engine draws
    the same: two 32-bit fractions make one normal deviate (Box-Muller)."""
    place = F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("pos")
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("qid"), F.col("pos")), 256)

    def fraction(start: int) -> Column:
        number = F.conv(F.substring("digest", start, 8), 16, 10).cast("double")
        return (number + 0.5) / F.lit(float(1 << 32))

    normal = F.sqrt(-2 * F.log(fraction(1))) * F.cos(2 * F.lit(np.pi) * fraction(9))
    drawn = spark.range(count).withColumnRenamed("id", "qid").select("qid", place)
    rows = drawn.withColumn("digest", digest).select("qid", "pos", normal.alias("x"))
    vectors = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("vec"))
    return vectors.select("qid", l2_normalize("vec").alias("vec"))
