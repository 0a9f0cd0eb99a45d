"""The search and recommendation operators as SQL table functions.

``register`` puts a corpus and a catalog under views and creates temporary
functions over them, with named and defaulted arguments::

    SELECT * FROM similar_to('dune', n => 5)

The bodies are plain SQL, so filters and columns around a call are planned
together with it. Lists are cut by ``rank <= n``. A function looks at one query
(or one set of them) and scores the corpus row by row inside the JVM; for many
queries at once use the DataFrame operators, which multiply blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshelf.operators.scoring import SCORE_DIGITS

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0d, (acc, x) -> acc + x)"
_ROW = "work_key {key}, author string, title string, year {year}, editions bigint, score double, rank int"
_BEST = "order by editions desc, year asc nulls last, work_key"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


def _like(q: str, *columns: str) -> str:
    """A literal search: the text in ``q`` has no wildcards."""
    return "(" + " or ".join(f"contains(lower({c}), lower({q}))" for c in columns) + ")"


def _ranked(scored: str) -> str:
    order = f"order by round(score, {SCORE_DIGITS}) desc, work_key"
    return f"""
      select work_key, author, title, year, editions, score, rank from (
        select *, row_number() over ({order}) as rank from ({scored}) where score is not null)"""


def _functions(prefix: str) -> dict[str, tuple[str, str]]:
    """name -> (arguments and result, body). ``score`` divides by lengths, so
    vectors need not be unit; a zero vector scores NULL and isn't ranked."""
    vecs, meta = f"{prefix}_vecs", f"{prefix}_catalog"
    cosine = f"try_divide({_dot('c.vec', 'b.vec')}, sqrt({_dot('c.vec', 'c.vec')}) * sqrt({_dot('b.vec', 'b.vec')}))"
    mean = f"try_divide({_dot('c.vec', 'm.vec')}, sqrt({_dot('c.vec', 'c.vec')}))"

    def best(q: str, *columns: str) -> str:
        return f"""select * from (
        select *, row_number() over ({_BEST}) as place from {vecs} where {_like(q, *columns)}) where place = 1"""

    # mean cosine to a set is the product with the mean of its unit vectors
    mean_of = lambda rows: f"""(select transform(array_sort(array_agg(struct(pos, s))), e -> e.s) as vec from (
        select pos, avg(x / length) as s from (
          select pos, cast(x as double) as x, length from (
            select vec, sqrt({_dot('vec', 'vec')}) as length from ({rows})) lateral view posexplode(vec) as pos, x
          where length > 0)
        group by pos))"""  # noqa: E731
    matched = f"""select * from (
        select l.pref_author, l.pref_title, c.*, row_number() over (partition by l.pref_author, l.pref_title {_BEST}) as place
        from (select distinct author as pref_author, title as pref_title from {prefix}_preferences) l
        join {vecs} c on contains(lower(c.title), lower(l.pref_title)) and contains(lower(c.author), lower(l.pref_author)))
      where place = 1"""
    return {
        "find_book": (
            "(q string) returns table (input_text string, work_key {key}, author string, title string, year {year}, editions bigint)",
            f"select input_text, work_key, author, title, year, editions from {vecs} where {_like('find_book.q', 'title', 'input_text')}",
        ),
        "similar_to": (
            f"(q string, n int default 10, same_author boolean default true) returns table ({_ROW})",
            f"""select * from ({_ranked(f'''select c.*, {cosine} as score from {vecs} c
        cross join ({best('similar_to.q', 'title', 'input_text')}) b
        where c.work_key <> b.work_key and (similar_to.same_author or c.author <> b.author)''')}) where rank <= similar_to.n""",
        ),
        "similar_between": (
            "(qa string, qb string) returns table (book_a string, book_b string, sim double)",
            f"""select c.title, b.title, {cosine} from ({best('similar_between.qa', 'title')}) c
        cross join ({best('similar_between.qb', 'title')}) b""",
        ),
        "recommend": (
            f"(liked_texts array<string>, n int default 10) returns table ({_ROW})",
            f"""select * from ({_ranked(f'''select c.*, {mean} as score from {vecs} c
        cross join {mean_of(f"select vec from {vecs} where array_contains(recommend.liked_texts, input_text)")} m
        where not array_contains(recommend.liked_texts, c.input_text)''')}) where rank <= recommend.n""",
        ),
        "recommend_from_preferences": (
            f"(n int default 20, exclude_pref_authors boolean default false) returns table ({_ROW})",
            f"""with hits as ({matched})
      select * from ({_ranked(f'''select c.*, {mean} as score from {vecs} c
        cross join {mean_of("select vec from hits")} m
        where c.work_key not in (select work_key from hits)
          and (not recommend_from_preferences.exclude_pref_authors or c.author not in (select author from hits where author is not null))''')})
      where rank <= recommend_from_preferences.n""",
        ),
        "pref_matches": (
            "() returns table (pref_author string, pref_title string, matched_author string, matched_title string)",
            f"""with hits as ({matched})
      select l.pref_author, l.pref_title, h.author, h.title
      from (select distinct author as pref_author, title as pref_title from {prefix}_preferences) l
      left join hits h on h.pref_author <=> l.pref_author and h.pref_title <=> l.pref_title""",
        ),
        "search_books": (
            "(q string, n int default 20) returns table (work_key {key}, author string, title string, year {year}, editions bigint, rank int)",
            f"""select work_key, author, title, year, editions, rank from (
        select *, row_number() over ({_BEST}) as rank from {meta} where {_like('search_books.q', 'title', 'author')})
      where rank <= search_books.n""",
        ),
    }


def register(corpus: DataFrame, catalog: DataFrame | None = None, preferences: DataFrame | None = None, prefix: str = "shelf") -> list[str]:
    """Creates the views ``<prefix>_vecs``, ``<prefix>_catalog`` and
    ``<prefix>_preferences`` and the functions over them; the functions' names.

    ``corpus`` has ``input_text, work_key, author, title, year, editions, vec``;
    ``catalog`` (the corpus if none is given) what a search needs of that;
    ``preferences`` is ``(author, title)``, without it there are none.
    """
    spark = corpus.sparkSession
    key, year = corpus.schema["work_key"].dataType.simpleString(), corpus.schema["year"].dataType.simpleString()
    corpus.where(F.col("vec").isNotNull()).createOrReplaceTempView(f"{prefix}_vecs")
    (corpus.drop("vec") if catalog is None else catalog).createOrReplaceTempView(f"{prefix}_catalog")
    if preferences is None:
        preferences = spark.createDataFrame([], "author string, title string")
    preferences.createOrReplaceTempView(f"{prefix}_preferences")
    made = _functions(prefix)
    for name, (signature, body) in made.items():
        spark.sql(f"create or replace temporary function {name}{signature.replace('{key}', key).replace('{year}', year)} return {body}")
    return list(made)
