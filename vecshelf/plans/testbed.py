"""The given tables read as a book catalog, a vector source and a rating log.

Parts are works, their line items the editions, brands the authors; an
embedding belongs to the work of the same number, and an event is a change to
the rating of the work its payload names.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshelf.operators.catalog import book_meta, build_catalog, build_corpus
from vecshelf.operators.grouping import canonical
from vecshelf.operators.ratings import fold_ratings, validate_ratings
from vecshelf.session import lean_writes, new_path, written
from vecshelf.sources.dump import land_dump, read_dump


class Testbed:
    """Lazily built working sets over one data folder; those several steps share
    are written once to the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        #: whether the concepts' renderings are in the cache at ``cache_path``
        self.embedded = False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def books(self) -> DataFrame:
        editions = (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("p_partkey"))
            .agg(
                F.count("*").alias("edition_count"),
                F.year(F.min("l_shipdate")).cast("long").alias("first_publish_year"),
            )
        )
        texts = self.table("documents").select(
            F.col("doc_id").alias("work_key"), F.col("text").alias("description")
        )
        return (
            self.table("part")
            .join(editions, "p_partkey")
            .select(
                F.col("p_partkey").alias("work_key"),
                F.col("p_name").alias("title"),
                F.col("p_brand").alias("primary_author_key"),
                "first_publish_year",
                "edition_count",
            )
            .join(texts, "work_key", "left")
        )

    @cached_property
    def authors(self) -> DataFrame:
        return (
            self.table("part")
            .select(F.col("p_brand").alias("author_key"), F.col("p_brand").alias("name"))
            .distinct()
        )

    @cached_property
    def listed(self) -> DataFrame:
        """Books without their long text, as catalog and corpus need them."""
        return written(self.books.drop("description"), "books")

    @cached_property
    def catalog(self) -> DataFrame:
        return written(build_catalog(self.listed, self.authors), "catalog")

    @cached_property
    def meta(self) -> DataFrame:
        return book_meta(self.listed, self.authors)

    @cached_property
    def vectors(self) -> DataFrame:
        """``(input_text, vec)``, the lowest numbered embedding of each text."""
        rows = self.table("embeddings").select(
            F.col("vec_id").alias("work_key"), F.col("embedding").alias("vec")
        )
        named = self.catalog.select("work_key", "input_text").join(rows, "work_key")
        return written(
            canonical(named, ["input_text"], [F.col("work_key")]).select("input_text", "vec"),
            "vectors",
        )

    @cached_property
    def corpus(self) -> DataFrame:
        return written(build_corpus(self.meta, self.vectors), "corpus")

    @cached_property
    def changes(self) -> DataFrame:
        return changes_of(self.table("events"))

    @cached_property
    def ratings(self) -> DataFrame:
        accepted, _ = validate_ratings(self.changes, self.catalog)
        return written(fold_ratings(accepted), "ratings")

    @cached_property
    def label_vectors(self) -> DataFrame:
        """``(label, vec)``: the mean vector of each embedding label."""
        from vecshelf.operators.centroid import vector_sum

        sums = vector_sum(self.table("embeddings"), ["label"], "embedding", F.count("*").alias("n"))
        return sums.select(
            F.col("label").cast("string").alias("label"),
            F.expr("transform(vec, x -> x / cast(n as double))").alias("vec"),
        )

    @cached_property
    def preference_lines(self) -> DataFrame:
        """``(author, title)`` wishes: one title per brand, and one per nation
        that no brand has."""
        brands = self.table("part").groupBy(F.col("p_brand").alias("author")).agg(
            F.max("p_name").alias("title")
        )
        nations = self.table("nation").select(
            F.col("n_name").alias("author"), F.lit("atlas").alias("title")
        )
        return brands.unionByName(nations)

    @cached_property
    def type_lines(self) -> DataFrame:
        """One ``(author, title)`` wish per type of part, its first part; these
        name some of the authors only."""
        return (
            self.table("part")
            .groupBy("p_type")
            .agg(
                F.min_by("p_brand", "p_partkey").alias("author"),
                F.min_by("p_name", "p_partkey").alias("title"),
            )
            .select("author", "title")
        )

    @cached_property
    def concepts(self) -> DataFrame:
        """Each distinct title and type of the parts as a concept; small sizes
        have no year."""
        years = F.min("year")
        parts = self.table("part").join(
            self.books.select(F.col("work_key").alias("p_partkey"), F.col("first_publish_year").alias("year")),
            "p_partkey",
        )
        return (
            parts.groupBy(F.col("p_name").alias("title"), F.col("p_type").alias("type"))
            .agg(
                F.when(F.min("p_size") > 2, years).alias("year"),
                F.max("p_brand").alias("expected_author"),
            )
            .select(
                F.concat_ws("/", "title", "type").alias("concept_id"),
                "title",
                "type",
                "year",
                "expected_author",
                F.col("title").alias("expected_title"),
            )
        )

    @cached_property
    def kept_concepts(self) -> DataFrame:
        return written(self.concepts, "concepts")

    @cached_property
    def cache_path(self) -> str:
        return new_path(self.spark, "cache")

    @cached_property
    def dump_path(self) -> str:
        path = new_path(self.spark, "dump")
        with lean_writes(self.spark):
            dump_lines(self).write.option("compression", "gzip").text(path)
        return path

    @property
    def cores(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    @cached_property
    def dump(self) -> tuple[DataFrame, DataFrame]:
        return read_dump(self.spark, self.dump_path, self.cores)

    @cached_property
    def records(self) -> dict[str, DataFrame]:
        return self.landed()

    def landed(self, columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
        """The dump's records, or only the tables and columns that are named."""
        return land_dump(self.spark, self.dump_path, new_path(self.spark, "records"), self.cores, columns)


def changes_of(events: DataFrame) -> DataFrame:
    """Rating changes of an event frame, batch or streaming. A sign-up withdraws
    the rating; its NULL stands for a delete."""
    kind = F.col("event_type")
    rating = (
        F.when(kind == "purchase", 2)
        .when(kind == "click", 1)
        .when(kind == "view", -1)
        .when(kind == "error", -2)
    )
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("long").alias("work_key"),
        rating.alias("rating"),
    )


def _json_text(text: Column) -> Column:
    """A string column as a JSON string literal."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _field(name: str, value: Column) -> Column:
    """``"name":value,`` or nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f'"{name}":'), value, F.lit(",")), F.lit(""))


def _record(kind: str, key: Column, fields: list[Column], stamp: Column) -> Column:
    body = F.concat(F.lit("{"), *fields, F.lit('"revision":1}'))
    return F.concat_ws("\t", F.lit(kind), key, F.lit("1"), stamp, body)


def work_name(partkey: Column) -> Column:
    return F.concat(F.lit("/works/OL"), partkey.cast("string"), F.lit("W"))


def author_name(suppkey: Column) -> Column:
    return F.concat(F.lit("/authors/OL"), suppkey.cast("string"), F.lit("A"))


def dump_lines(bed: Testbed) -> DataFrame:
    """The tables as dump records: parts as works, line items as editions,
    suppliers as authors, nations as a type to ignore, and regions as damage."""
    stamp = F.lit("2024-01-01T00:00:00")
    size = F.col("p_size")
    suppliers = bed.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high")
    )
    texts = bed.table("documents").select(F.col("doc_id").alias("p_partkey"), "text")
    part = bed.table("part").join(suppliers, "p_partkey", "left").join(texts, "p_partkey", "left")
    title = _json_text(F.col("p_name"))
    text = _json_text(F.col("text"))
    description = (
        F.when(size <= 15, F.concat(F.lit('{"type":"/type/text","value":'), text, F.lit("}")))
        .when(size <= 30, text)
        .when(size <= 35, F.lit("null"))
        .when(size <= 40, F.lit('{"type":"/type/text"}'))
    )
    subjects = (
        F.when(size <= 10, F.concat(F.lit("["), _json_text(F.col("p_type")), F.lit(',"Fiction, general"]')))
        .when(size <= 20, F.lit('["Historical Nonfiction",7]'))
        .when(size <= 25, F.lit('"Juvenile fiction"'))
        .when(size <= 45, F.concat(F.lit("["), _json_text(F.col("p_type")), F.lit("]")))
    )
    first_date = F.when(size <= 20, F.concat(F.lit("May "), (size + 1950).cast("string"))).when(
        size <= 30, F.lit("n.d.")
    )
    def author_entry(key: str) -> Column:
        return F.concat(F.lit('{"author":{"key":"'), author_name(F.col(key)), F.lit('"}}'))

    written_by = F.when(
        F.col("low").isNotNull(),
        F.concat(
            F.lit("["), author_entry("low"), F.lit(',{"role":"editor"},'), author_entry("high"), F.lit("]")
        ),
    )
    covers = F.when(size <= 5, F.lit("[]")).otherwise(F.concat(F.lit("["), size.cast("string"), F.lit(",-1]")))
    works = part.select(
        _record(
            "/type/work",
            work_name(F.col("p_partkey")),
            [
                _field("title", title),
                _field("subtitle", F.when(size > 40, _json_text(F.col("p_type")))),
                _field("first_publish_date", _json_text(first_date)),
                _field("description", description),
                _field("subjects", subjects),
                _field("authors", written_by),
                _field("covers", covers),
            ],
            stamp,
        ).alias("line")
    )
    quantity = F.col("l_quantity")
    edition_key = F.concat_ws("-", F.lit("/books/OL"), "l_orderkey", "l_linenumber")
    editions = bed.table("lineitem").select(
        _record(
            "/type/edition",
            edition_key,
            [
                _field("title", F.concat(F.lit('"Edition '), F.col("l_linenumber").cast("string"), F.lit('"'))),
                _field(
                    "works",
                    F.concat(F.lit('[{"key":"'), work_name(F.col("l_partkey")), F.lit('"}]')),
                ),
                _field(
                    "authors",
                    F.concat(F.lit('[{"key":"'), author_name(F.col("l_suppkey")), F.lit('"}]')),
                ),
                _field(
                    "publish_date",
                    F.when(quantity <= 5, F.lit('"n.d."')).otherwise(
                        F.concat(F.lit('"'), F.date_format("l_shipdate", "MMMM yyyy"), F.lit('"'))
                    ),
                ),
                _field("subjects", F.when(quantity >= 50, F.lit('["Science Fiction"]'))),
                _field(
                    "languages",
                    F.when(
                        F.col("l_returnflag") != "N",
                        F.concat(F.lit('[{"key":"/languages/'), F.lower("l_returnflag"), F.lit('"}]')),
                    ),
                ),
                _field("genres", F.when(quantity > 25, F.concat(F.lit('["'), F.col("l_linestatus"), F.lit('",1.0]')))),
                _field(
                    "isbn_13",
                    F.concat(F.lit('["978'), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit('"]')),
                ),
                _field(
                    "description",
                    F.when(
                        F.col("l_returnflag") == "R",
                        F.concat(F.lit('{"value":"'), F.col("l_linestatus"), F.lit(' reprint"}')),
                    ).when(F.col("l_returnflag") == "A", F.lit('"a \\"quoted\\" note"')),
                ),
            ],
            stamp,
        ).alias("line")
    )
    balance = F.col("s_acctbal")
    life = F.when(balance < 1000, F.lit('"A plain life."')).when(
        balance < 5000, F.lit('{"type":"/type/text","value":"A told life."}')
    )
    authors = bed.table("supplier").select(
        _record(
            "/type/author",
            author_name(F.col("s_suppkey")),
            [
                _field("name", _json_text(F.col("s_name"))),
                _field("birth_date", F.when(balance > 0, F.lit('"1 January 1900"'))),
                _field("bio", life),
                _field(
                    "alternate_names",
                    F.concat(F.lit("["), _json_text(F.lower("s_name")), F.lit(',"S."]')),
                ),
            ],
            stamp,
        ).alias("line")
    )
    # a key given twice: the first value counts
    repeated = bed.table("nation").select(
        F.concat_ws(
            "\t",
            F.lit("/type/author"),
            F.concat(F.lit("/authors/N"), F.col("n_nationkey").cast("string")),
            F.lit("1"),
            stamp,
            F.concat(F.lit('{"name":'), _json_text(F.col("n_name")), F.lit(',"name":"second","revision":1}')),
        ).alias("line")
    )
    ignored = bed.table("nation").select(
        _record("/type/redirect", F.col("n_name"), [], stamp).alias("line")
    )
    damaged = bed.table("region").select(
        F.when(F.col("r_regionkey") > 2, F.concat_ws("\t", F.lit("/type/work"), "r_name"))
        .otherwise(F.concat_ws("\t", F.lit("/type/work"), "r_name", F.lit("1"), stamp, F.lit('{"title":')))
        .alias("line")
    )
    return (
        works.unionByName(editions)
        .unionByName(authors)
        .unionByName(repeated)
        .unionByName(ignored)
        .unionByName(damaged)
    )
