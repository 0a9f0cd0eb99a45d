import gzip
import json

import pytest

import __spark_entry__ as entry_points
from vecshelf.functions.records import FIELDS
from vecshelf.operators import curate
from vecshelf.operators.catalog import popularity_tiers
from vecshelf.plans import testbed
from vecshelf.session import LEAN_WRITES, lean_writes
from vecshelf.sources import dump
from vecshelf.sources.dump import land_dump, read_dump
from vecshelf.sources.tables import table_counts, write_curated


def record(kind, key, **fields):
    return "\t".join([f"/type/{kind}", key, "1", "2024-01-01", json.dumps(fields)])


def work(key, **fields):
    return record("work", f"/works/{key}", **fields)


def edition(key, of, **fields):
    return record("edition", f"/books/{key}", works=[{"key": f"/works/{of}"}], **fields)


AUTHORED = [{"author": {"key": "/authors/A1"}}, {"role": "x"}, {"author": {"key": "/authors/A2"}}]

LINES = [
    work("W1", title='A "quoted" \\ title', subjects=["Fiction"], authors=AUTHORED, covers=[7, 8],
         description={"type": "/type/text", "value": "told"}, first_publish_date="May 1984"),
    work("W2", title="Two", subjects="Nonfiction", covers=[-1], description="plain", subtitle="sub"),
    work("W3", title="Three", subjects=["History"], covers=[]),
    work("W4", title="Four", subjects=["Fiction"]),
    work("W5", title="Five", subjects=["History"]),
    edition("E1", "W1", publish_date="1990", isbn_13=["978b"]),
    edition("E2", "W1", publish_date="n.d.", isbn_13=["978a"]),
    edition("E3", "W2", publish_date="March 2001"),
    edition("E4", "W2", publish_date="1999"),
    edition("E5", "W3", subjects=["Juvenile fiction"], description="b"),
    edition("E6", "W3", description={"value": "c"}),
    edition("E7", "W4"),
    edition("E8", "W5"),
    edition("E9", "W5"),
    record("edition", "/books/E10", title="no work"),
    record("author", "/authors/A1", name="One", bio={"value": "life"}, alternate_names=["1", 2]),
    record("author", "/authors/A2", name="Two", bio="plain"),
    record("author", "/authors/A3", name="Unused"),
    record("redirect", "/r/1"),
    "/type/work\t/works/W9\t1\t2024\t{broken",
    "/type/work\t/works/W8",
]


def dump_file(tmp_path):
    path = tmp_path / "dump.txt.gz"
    with gzip.open(path, "wt") as out:
        out.write("\n".join(LINES) + "\r\n")
    return str(path)


def landed(spark, tmp_path):
    return land_dump(spark, dump_file(tmp_path), str(tmp_path / "records"), partitions=3)


def rows(df, *columns):
    return {r[0]: r for r in df.select(*columns).collect()}


def test_read_dump_keeps_text_and_quarantines(spark, tmp_path):
    records, quarantine = read_dump(spark, dump_file(tmp_path), partitions=2)
    assert records.count() == len(LINES) - 2
    first = records.where("key = '/works/W1'").first()
    assert json.loads(first.json)["title"] == 'A "quoted" \\ title'
    assert {r.reason for r in quarantine.collect()} == {"bad_json", "missing_columns"}


def test_land_dump_routes_types(spark, tmp_path):
    tables = landed(spark, tmp_path)
    assert {k: v.count() for k, v in tables.items()} == {
        "authors": 3, "works": 5, "editions": 10, "quarantine": 2,
    }
    assert tables["editions"].where("key = '/books/E1'").first().work_key == "/works/W1"
    assert tables["authors"].where("key = '/authors/A1'").first().name == "One"


def test_repeated_keys_are_read(spark, tmp_path):
    path = tmp_path / "dump.txt"
    lines = [
        '/type/work\t/works/W1\t1\t2024\t{"title":"first","title":"second","subjects":["Fiction"],"subjects":[]}',
        '/type/edition\t/books/E1\t1\t2024\t{"works":[{"key":"/works/W1"}],"works":[{"key":"/works/W2"}]}',
        '/type/author\t/authors/A1\t1\t2024\t{"name":"x","name":"y"',
        '/type/redirect\t/r/1\t1\t2024\t{"a":1,"a":2}',
    ]
    path.write_text("\n".join(lines))
    records, quarantine = read_dump(spark, str(path))
    assert records.count() == 3
    assert [r.reason for r in quarantine.collect()] == ["bad_json"]
    tables = land_dump(spark, str(path), str(tmp_path / "records"))
    assert [r.title for r in tables["works"].collect()] == ["first"]
    assert [r.work_key for r in tables["editions"].collect()] == ["/works/W1"]
    assert tables["authors"].count() == 0
    assert [(r.reason, r.line) for r in tables["quarantine"].collect()] == [("bad_json", lines[2])]
    aggregates = curate.edition_aggregates(tables["editions"])
    assert curate.select_works(tables["works"], aggregates, min_editions=1).count() == 1


def test_edition_facets(spark):
    rows = [
        ("/works/W1", '{"languages":[{"key":"/languages/eng"},{"key":"/languages/eng"}],"genres":["Novel",1.0,null]}'),
        ("/works/W1", '{"languages":[{"key":"/languages/eng"},{}]}'),
        ("/works/W2", '{"languages":"eng","genres":{}}'),
        (None, '{"genres":["Novel"]}'),
    ]
    got = curate.edition_facets(spark.createDataFrame(rows, "work_key string, json string")).collect()
    assert {tuple(r) for r in got} == {
        ("/works/W1", "language", "/languages/eng", 2), ("/works/W1", "genre", "Novel", 1), ("/works/W1", "genre", "1.0", 1),
    }


def test_curated_tables(spark, tmp_path):
    tables = landed(spark, tmp_path)
    aggregates = curate.edition_aggregates(tables["editions"])
    w3 = aggregates.where("work_key = '/works/W3'").first()
    assert (w3.edition_count, w3.ed_fiction, w3.ed_desc) == (2, True, "c")
    chosen = curate.select_works(tables["works"], aggregates)
    assert set(rows(chosen, "work_key")) == {"/works/W1", "/works/W2", "/works/W3"}
    strict = curate.select_works(
        tables["works"], curate.edition_aggregates(tables["editions"], whole_word=True), whole_word=True
    )
    assert set(rows(strict, "work_key")) == {"/works/W1", "/works/W3"}

    books = {r.ol_id: r for r in curate.build_books(chosen).collect()}
    one, two, three = books["W1"], books["W2"], books["W3"]
    assert (one.first_publish_year, one.description, one.cover_id, one.isbn13) == (1984, "told", 7, "978b")
    assert one.subjects == ["Fiction"] and one.primary_author_key == "/authors/A1"
    assert (two.first_publish_year, two.subjects, two.cover_id, two.subtitle) == (1999, None, -1, "sub")
    assert (three.first_publish_year, three.description, three.cover_id) == (None, "c", None)

    links = curate.build_book_authors(chosen)
    assert sorted((r.author_key, r.position) for r in links.collect()) == [("/authors/A1", 1), ("/authors/A2", 3)]
    authors = rows(curate.build_authors(tables["authors"], links), "author_key", "bio", "alternate_names")
    assert set(authors) == {"/authors/A1", "/authors/A2"}
    assert authors["/authors/A1"].bio == "life" and authors["/authors/A1"].alternate_names == ["1", "2"]

    path = str(tmp_path / "curated")
    for _ in range(2):
        curated = write_curated({"books": curate.build_books(chosen), "links": links}, path)
    assert sorted(map(tuple, table_counts(curated).collect())) == [("books", 3), ("links", 2)]
    tiers = popularity_tiers(curated["books"], (2, 3))
    assert sorted(map(tuple, tiers.collect())) == [(2, 3), (3, 0)]


def dump_folder(tmp_path, parts):
    """The lines in files of one size nearly, several times over."""
    folder = tmp_path / "dump"
    folder.mkdir()
    for part in range(parts):
        with gzip.open(folder / f"part-{part}.txt.gz", "wt") as out:
            out.write("\n".join(LINES) + "\n")
    return str(folder)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in files.mkString("\n").split("\n") if "/shuffle_" in name}


def test_lines_dealt_out_by_files_are_not_shuffled(spark, tmp_path):
    folder = dump_folder(tmp_path, 4)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")  # else so small files make one task
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        records, quarantine = read_dump(spark, folder, partitions=4)
        assert "Exchange" not in executed(records) and "Exchange" not in executed(quarantine)
        assert records.count() == 4 * (len(LINES) - 2)
        more, _ = read_dump(spark, folder, partitions=50)
        assert "Exchange" in executed(more) and more.count() == records.count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_file_is_dealt_out_evenly_without_a_sort(spark, tmp_path):
    path = tmp_path / "dump.txt.gz"
    with gzip.open(path, "wt") as out:
        out.write("\n".join([work("W1", title="all the same")] * 4000))
    records, _ = read_dump(spark, str(path), partitions=4)
    assert "RoundRobin" not in executed(records)  # its rows are sorted first, and spilled
    dealt = records.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(dealt) == 4000 and len(dealt) == 4 and max(dealt) < 1200


def test_landing_holds_no_more_disk_than_its_files(spark, tmp_path, monkeypatch):
    planned = []
    land = dump._land

    def spied(headed, out, mode):
        land(headed, out, mode)
        planned.append({key: spark.conf.get(key, None) for key in LEAN_WRITES})

    monkeypatch.setattr(dump, "_land", spied)
    before = {key: spark.conf.get(key, None) for key in LEAN_WRITES}
    there = shuffle_files(spark)
    tables = landed(spark, tmp_path)
    assert not shuffle_files(spark) - there
    assert planned == [before]
    files = [f.name for f in (tmp_path / "records").rglob("*.parquet")]
    assert files and all(".zstd." in name for name in files)
    assert tables["works"].count() == 5


def test_lean_writes_restores_settings_after_an_error(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    spark.conf.set(key, "3")
    try:
        with pytest.raises(ValueError), lean_writes(spark):
            assert spark.conf.get(key) == LEAN_WRITES[key]
            raise ValueError
        assert spark.conf.get(key) == "3"
    finally:
        spark.conf.unset(key)


def test_land_dump_of_some_columns(spark, tmp_path):
    repeated = '/type/work\t/works/R\t1\t2024\t{"title":"first","title":"second"}'
    twice = '/type/edition\t/books/R\t1\t2024\t{"title":"x","title":"y"}'
    path = tmp_path / "dump.txt"
    path.write_text("\n".join([*LINES, repeated, twice]))
    columns = {"works": ["title"], "authors": ["json"]}
    tables = land_dump(spark, str(path), str(tmp_path / "records"), columns=columns)
    assert set(tables) == {"works", "authors", "quarantine"}
    assert tables["works"].columns == ["key", "title"] and tables["authors"].columns == ["key", "json"]
    whole = land_dump(spark, str(path), str(tmp_path / "whole"))
    for table, names in columns.items():
        want = whole[table].select("key", *names)
        assert sorted(tables[table].collect()) == sorted(want.collect())
    assert rows(tables["works"], "key", "title")["/works/R"].title == "first"
    assert sorted(tables["quarantine"].collect()) == sorted(whole["quarantine"].collect())
    assert whole["quarantine"].count() == 2 and whole["editions"].columns == ["key", *FIELDS["editions"], "json"]
    kept = {f.parent.name for f in (tmp_path / "records").rglob("*.parquet")}
    assert not any("edition" in name for name in kept)
    with_json = spark.read.parquet(str(tmp_path / "records")).where("type = '/type/work' and json is not null")
    assert with_json.count() == 0


#: what a query reads of the dump's records, and so all that it may land
READ = {
    "write_curated": {"editions", "works", "authors"},
    "build_books": {"editions", "works"},
    "split_by_type": {"editions", "works", "authors"},
    "edition_facets": {"editions"},
    "edition_aggregates": {"editions"},
    "build_authors": {"editions", "works", "authors"},
    "unwrap_text": {"works"},
    "extract_year": {"editions"},
    "select_works": {"editions", "works"},
    "build_book_authors": {"editions", "works"},
    "json_string_array": {"works"},
    "dump_quarantine": set(),
}
#: these parse the JSON themselves, and read nothing else
WITH_JSON = {"unwrap_text", "extract_year", "json_string_array"}


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """The tables that the dump is written from, with a few rows."""
    folder = tmp_path_factory.mktemp("tables")
    made = {
        "part": [
            "id + 1 as p_partkey", "concat('part ', id) as p_name", "concat('Brand#', id % 3) as p_brand",
            "'BRASS' as p_type", "cast(id * 4 + 1 as int) as p_size",
        ],
        "documents": ["id + 1 as doc_id", "concat('a text ', id) as text"],
        "lineitem": [
            "id as l_orderkey", "id % 12 + 1 as l_partkey", "id % 5 + 1 as l_suppkey", "1 as l_linenumber",
            "cast(id + 1 as double) as l_quantity", "substr('NAR', cast(id % 3 as int) + 1, 1) as l_returnflag",
            "'O' as l_linestatus", "timestamp'1995-03-01' as l_shipdate",
        ],
        "supplier": ["id + 1 as s_suppkey", "concat('Supplier ', id) as s_name", "cast(id * 900 as double) as s_acctbal"],
        "nation": ["id as n_nationkey", "concat('nation ', id) as n_name"],
        "region": ["id as r_regionkey", "concat('region ', id) as r_name"],
    }
    for name, columns in made.items():
        count = {"lineitem": 60, "part": 12, "documents": 9}.get(name, 5)
        spark.range(count).selectExpr(*columns).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", READ)
def test_queries_land_what_they_read(spark, small_tables, monkeypatch, name):
    asked = []

    def spied(spark, path, out, partitions=None, columns=None):
        tables = land_dump(spark, path, out, partitions, columns)
        asked.append((tables, set(spark.read.parquet(out).columns)))
        return tables

    monkeypatch.setattr(testbed, "land_dump", spied)
    assert entry_points.queries()[name](spark, small_tables).count() > 0
    ((tables, columns),) = asked
    assert set(tables) == READ[name] | {"quarantine"}
    used = {c for table in READ[name] for c in tables[table].columns}
    assert columns <= used | {"key", "line", "reason", "type"}
    assert ("json" in columns) == (name in WITH_JSON)
