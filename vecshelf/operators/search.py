"""Substring lookup over the catalog and the corpus.

Matching is literal and case-insensitive. Many needles are matched at once: a
few are carried into the scan as conditions, more as an automaton that passes
over each text once, and very many meet the rows through an equi-join on
character grams. None compares every row with every needle through a join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshelf.functions.text import text_match
from vecshelf.functions.vector import cosine
from vecshelf.operators.catalog import popularity_order
from vecshelf.operators.grouping import canonical, top_ranked
from vecshelf.operators.knn import knn

# Needles that become conditions of the scan. More are sent to it as automata of
# a bounded size each, as long as these are few; the rest go through the gram join,
# where they are broadcast if all their letters together stay within the bound.
INLINE_NEEDLES = 16
AUTOMATON_BYTES, NEEDLE_BYTES, MOST_BLOCKS = 16 << 20, 64, 8
BROADCAST_CHARS = 4_000_000
GRAM = 3


def _ranked_order() -> list[Column]:
    return [
        F.col("editions").desc_nulls_last(),
        F.col("year").asc_nulls_last(),
        F.col("work_key").asc(),
    ]


def needles_from(spark: SparkSession, queries: list[str] | DataFrame) -> DataFrame:
    """Distinct non-empty ``query`` strings."""
    if not isinstance(queries, DataFrame):
        queries = spark.createDataFrame([(q,) for q in queries], "query string")
    return queries.select("query").where("query != ''").distinct()


def substring_pairs(
    rows: DataFrame, columns: list[str], needles: DataFrame, inline: int = INLINE_NEEDLES
) -> DataFrame:
    """``rows`` with a ``query`` column, one row per needle found in any of ``columns``.

    A few needles become conditions of the scan. More are looked for by an
    automaton in one pass over each text, sent in blocks of bounded size; past
    some number of blocks, and with ``inline=0``, rows and needles meet by grams.
    """
    lowered = needles.select("query", F.lower("query").alias("needle"))
    if not inline:
        return _gram_pairs(rows, columns, lowered)
    small = lowered.limit(inline + 1).collect()
    if len(small) <= inline:
        return _inline_pairs(rows, columns, [(r.query, r.needle) for r in small])
    size = lowered.agg(F.sum(F.octet_length("needle") + F.octet_length("query") + NEEDLE_BYTES)).first()[0] or 0
    blocks = -(-size // AUTOMATON_BYTES)
    if blocks > MOST_BLOCKS:
        return _gram_pairs(rows, columns, lowered)
    return _automaton_pairs(rows, columns, lowered, blocks)


def _automaton_pairs(rows: DataFrame, columns: list[str], needles: DataFrame, blocks: int) -> DataFrame:
    """One scan for each block of needles, which is what comes to the driver at a time."""
    spark, found = rows.sparkSession, None
    for number in range(blocks):
        part = needles.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number) if blocks > 1 else needles
        block = part.where("query is not null").distinct().toArrow()
        sent = spark.sparkContext.broadcast((block["needle"].to_pylist(), block["query"].to_pylist()))
        hits = rows.withColumn("query", F.explode(_matcher(sent)(*[F.lower(c) for c in columns])))
        found = hits if found is None else found.unionByName(hits)
    return found


def _matcher(sent):
    state: dict = {}

    def automaton():
        import ahocorasick

        queries: dict[str, list[str]] = {}
        for needle, query in zip(*sent.value, strict=True):
            queries.setdefault(needle, []).append(query)
        everywhere = queries.pop("", [])
        found = ahocorasick.Automaton()
        for needle, own in queries.items():
            found.add_word(needle, own)
        if queries:
            found.make_automaton()
        return everywhere, found if queries else None

    def run(*texts: pa.Array) -> pa.Array:
        if not state:
            state["all"], state["found"] = automaton()
        everywhere, found = state["all"], state["found"]
        out = []
        for own in zip(*(t.to_pylist() for t in texts), strict=True):
            hits = set()
            for text in own:
                if text is not None:
                    hits.update(everywhere)
                    if found is not None:
                        for _, queries in found.iter(text):
                            hits.update(queries)
            out.append(list(hits))
        return pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")


def _inline_pairs(rows: DataFrame, columns: list[str], needles: list[tuple[str, str]]) -> DataFrame:
    lows = [f"_low{i}" for i in range(len(columns))]
    low_rows = rows.withColumns({low: F.lower(c) for low, c in zip(lows, columns)})

    def found(needle: str) -> Column:
        hit = F.lit(False)
        for low in lows:
            hit = hit | F.coalesce(F.contains(F.col(low), F.lit(needle)), F.lit(False))
        return hit

    none = F.array().cast("array<string>")
    hits = F.array_compact(F.array(*[F.when(found(n), F.lit(q)) for q, n in needles])) if needles else none
    return low_rows.withColumn("query", F.explode(hits)).drop(*lows)


def _grams(text: Column, size: int) -> Column:
    if size == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, pieces).otherwise(F.array().cast("array<string>"))


def _gram_pairs(rows: DataFrame, columns: list[str], needles: DataFrame) -> DataFrame:
    needles = needles.withColumn("size", F.least(F.length("needle"), F.lit(GRAM)))
    totals = needles.groupBy("size").agg(
        F.count("*").alias("n"), F.sum(F.length("needle") + F.length("query")).alias("chars")
    ).collect()
    sizes = sorted(t["size"] for t in totals)
    # A needle has at most as many grams as letters; this bounds both broadcasts.
    small = sum(t["chars"] + t["n"] for t in totals) <= BROADCAST_CHARS
    sent = F.broadcast if small else (lambda df: df)

    def all_grams(text: Column) -> Column:
        return F.flatten(F.array(*[_grams(text, s) for s in sizes]))

    # Lower-cased once per row: inside the gram lambda it would run once per gram.
    lows = {f"_low{i}": F.coalesce(F.lower(c), F.lit("")) for i, c in enumerate(columns)}
    low_rows = rows.withColumns(lows)
    found = F.array_distinct(F.flatten(F.array(*[all_grams(F.col(low)) for low in lows])))
    own = F.flatten(
        F.array(
            *[
                F.when(F.col("size") == s, _grams(F.col("needle"), s)).otherwise(
                    F.array().cast("array<string>")
                )
                for s in sizes
            ]
        )
    )
    # A needle is looked up by its rarest gram; a gram no row has ends it there.
    needle_grams = needles.withColumn("gram", F.explode(own))
    frequency = (
        low_rows.select(F.explode(found).alias("gram"))
        .join(sent(needle_grams.select("gram").distinct()), "gram", "left_semi")
        .groupBy("gram")
        .agg(F.count("*").alias("rows"))
    )
    chosen = (
        needle_grams.join(frequency, "gram", "left")
        .groupBy("query", "needle")
        .agg(F.min_by("gram", F.struct(F.coalesce("rows", F.lit(0)), "gram")).alias("gram"))
    )
    hit = F.lit(False)
    for low, c in zip(lows, columns):
        hit = hit | (F.col(c).isNotNull() & F.contains(F.col(low), F.col("needle")))
    row_grams = low_rows.withColumn("gram", F.explode(found))
    return row_grams.join(sent(chosen), "gram").where(hit).drop("gram", "needle", *lows)


def find(corpus: DataFrame, q: str, columns: tuple[str, ...] = ("title", "input_text")) -> DataFrame:
    """All fuzzy matches of ``q`` among embedded works, most editions first."""
    return (
        corpus.where(text_match(list(columns), q))
        .select("input_text", "work_key", "author", "title", "year", "editions")
        .orderBy(*_ranked_order())
    )


def best_match(
    corpus: DataFrame, q: str, columns: tuple[str, ...] = ("title", "input_text")
) -> DataFrame:
    """The one match of ``q`` with the most editions, all columns kept."""
    return corpus.where(text_match(list(columns), q)).orderBy(*_ranked_order()).limit(1)


def _resolved(corpus: DataFrame, q: str, columns: tuple[str, ...]) -> DataFrame:
    """The best match with its vector, as local data of at most one row. The match
    scans text columns only; the vector is then read by a filter on its key."""
    found = best_match(corpus.drop("vec"), q, columns).select("work_key").first()
    key = F.lit(found.work_key if found else None)
    return corpus.sparkSession.createDataFrame(corpus.where(F.col("work_key") == key).limit(1).toArrow())


def similar_to(corpus: DataFrame, q: str, n: int = 10, same_author: bool = True) -> DataFrame:
    """Neighbours of the best match of ``q``, itself left out."""
    match = _resolved(corpus, q, ("title", "input_text")).withColumn("qid", F.lit(0))
    hits = knn(
        corpus,
        match,
        n,
        exclude=match,
        exclude_groups=None if same_author else match,
    )
    return described(hits, corpus).drop("qid")


def similar_between(corpus: DataFrame, qa: str, qb: str) -> DataFrame:
    """Cosine of the best title matches of two queries; no row if one has none."""
    sides = [
        _resolved(corpus, q, ("title",)).select(F.lit(side).alias("side"), "title", "vec")
        for side, q in (("a", qa), ("b", qb))
    ]

    def of(side: str, column: str) -> Column:
        return F.first(F.when(F.col("side") == side, F.col(column)), ignorenulls=True)

    return (
        sides[0]
        .unionByName(sides[1])
        .agg(
            of("a", "title").alias("book_a"),
            of("b", "title").alias("book_b"),
            of("a", "vec").alias("vec_a"),
            of("b", "vec").alias("vec_b"),
        )
        .where("vec_a is not null and vec_b is not null")
        .select("book_a", "book_b", cosine("vec_a", "vec_b").alias("sim"))
    )


def described(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ranked hits with the metadata of the works they name."""
    meta = corpus.select("work_key", "author", "title", "year", "editions")
    first = [c for c in hits.columns if c not in ("work_key", "score", "rank")]
    return hits.join(meta, "work_key").select(
        *first, "work_key", "author", "title", "year", "editions", "score", "rank"
    )


def search_catalog(
    catalog: DataFrame,
    corpus: DataFrame,
    queries: list[str] | DataFrame,
    limit: int = 20,
    inline: int = INLINE_NEEDLES,
) -> DataFrame:
    """The ``limit`` most reprinted works per query whose title or author holds it,
    each with whether it is embedded. An empty query finds nothing; ``limit`` is
    any number from 1 on."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    rows = catalog.select("work_key", "author", "title", "year", "editions", "author_lc", "title_lc")
    needles = needles_from(catalog.sparkSession, queries)
    pairs = substring_pairs(rows, ["title_lc", "author_lc"], needles, inline)
    top = top_ranked(pairs.drop("author_lc", "title_lc"), "query", limit, _ranked_order())
    embedded = corpus.select("work_key", F.lit(True).alias("has_embedding")).distinct()
    return top.join(embedded, "work_key", "left").select(
        "query",
        "work_key",
        "author",
        "title",
        "year",
        "editions",
        F.coalesce("has_embedding", F.lit(False)).alias("has_embedding"),
        "rank",
    )


def match_preferences(
    prefs: DataFrame, corpus: DataFrame, inline: int = INLINE_NEEDLES
) -> DataFrame:
    """The best corpus row for each distinct ``(author, title)`` preference, as
    ``pref_author, pref_title`` beside the row; both texts must be contained."""
    prefs = prefs.select(
        F.col("author").alias("pref_author"), F.col("title").alias("pref_title")
    ).distinct()
    needles = prefs.where("pref_title is not null").select(
        F.col("pref_title").alias("query")
    ).distinct()
    titled = substring_pairs(corpus, ["title"], needles, inline).withColumnRenamed(
        "query", "pref_title"
    )
    by_author = F.contains(F.lower("author"), F.lower("pref_author"))
    pairs = titled.join(prefs, "pref_title").where(by_author)
    return canonical(pairs, ["pref_author", "pref_title"], popularity_order())


def pref_matches(prefs: DataFrame, corpus: DataFrame, inline: int = INLINE_NEEDLES) -> DataFrame:
    """Every preference with its matched work, NULL where nothing matches."""
    lines = prefs.select(
        F.col("author").alias("pref_author"), F.col("title").alias("pref_title")
    ).distinct()
    meta = corpus.select("work_key", "author", "title", "year", "editions")
    matched = match_preferences(prefs, meta, inline).select(
        "pref_author",
        "pref_title",
        F.col("author").alias("matched_author"),
        F.col("title").alias("matched_title"),
    )
    return lines.join(matched, ["pref_author", "pref_title"], "left")


def find_vector(
    catalog: DataFrame, vectors: DataFrame, wanted: DataFrame, inline: int = INLINE_NEEDLES
) -> DataFrame:
    """``(author, title, input_text, vec)`` per wanted ``(author, title)``.

    The best *catalog* match is taken before vectors join in, so a wanted work
    whose best match is not embedded has a NULL vector.
    """
    meta = catalog.select("work_key", "author", "title", "year", "editions", "input_text")
    best = match_preferences(wanted, meta, inline).select(
        "pref_author", "pref_title", "input_text"
    )
    return best.join(vectors.select("input_text", "vec"), "input_text", "left").select(
        F.col("pref_author").alias("author"), F.col("pref_title").alias("title"), "input_text", "vec"
    )
