import hashlib
import random

from pyspark.sql import functions as F

from vecshelf.llm.line_dedup import Cuckoo, LineIndex, dedup_lines, line_keys
from vecshelf.session import new_path

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines string, doc int"


def brute(rows):
    """(doc_id, text, lines, dropped) by definition; a NULL id comes last."""
    def place(doc):
        return (doc is None, doc or 0)

    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            first[key] = min(first.get(key, place(doc)), place(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(SPACE).translate(LOWER)
            if len(key) < 10 or first[key] == place(doc):
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA).repartition(3)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


def corpus(rng, ids):
    lines = [f"A common line number {i}" for i in range(30)] + ["short", "", "  \t", "Ünïcode éé ", "ÜNÏCODE ÉÉ x", "exactly 10", "日本語日本語日本語日", "日本語"]
    rows = []
    for doc in ids:
        n = rng.randint(0, 9)
        text = "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(lines + [f"only in {doc} {i}" for i in range(9)]) + rng.choice(["", "\r", " \x0b"]) for _ in range(n))
        rows.append((doc, rng.choice([text, text.upper(), text])))
    return rows


def test_equals_definition(spark):
    rng = random.Random(6)
    rows = corpus(rng, range(120)) + [(500, None), (501, ""), (None, "A common line number 1\nnull doc only line"), (None, "null doc only line")]
    rows += [rows[3], rows[3], (7, "A common line number 2\nanother text of document seven")]
    got = dedup_lines(frame(spark, rows), batches=3)
    assert result(got) == brute(rows)
    assert set(got.columns) == {"doc_id", "text", "n_lines", "n_dropped", "doc"}


def test_inserts_and_deletes_are_reversible(spark):
    rng = random.Random(9)
    rows = corpus(rng, range(90))
    # small shards, so that the filters are split on the way
    index = LineIndex(spark, new_path(spark, "index"), shard=64)
    for a in (0, 30, 60):
        index.insert(frame(spark, rows[a : a + 30]))
    assert index.bits > 0

    def agrees(alive):
        assert result(index.kept(frame(spark, alive))) == brute(alive)
        lines = {}
        for doc, text in alive:
            for key in {k for k in line_keys((text or "").encode()) if k}:
                lines.setdefault(key, []).append(doc)
        counts = {(r["hi"], r["lo"]): (r["refs"], r["least"]) for r in index.counts().collect()}
        want = {tuple(int.from_bytes(k[i : i + 8], "little", signed=True) for i in (0, 8)): (len(d), min(d)) for k, d in lines.items()}
        assert counts == want
        filters = {r["shard"]: Cuckoo(index.shard // 2, r["filter"]) for r in index.filters().collect()}
        marks = sum(sum(1 for x in f.table if x) for f in filters.values())
        assert marks == len(want) and not any(f.full for f in filters.values())
        assert all(lo in filters[(hi & (1 << 64) - 1) >> (64 - index.bits)] for hi, lo in want)

    agrees(rows)
    gone = [0, 1, 2, 5, 33, 61, 88, 12345]
    index.delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    agrees([r for r in rows if r[0] not in gone])
    # opened again, and one document back with another text
    index = LineIndex(spark, index.path, shard=64)
    back = [(1, "A common line number 3\nsomething new to say"), (2, rows[2][1])]
    index.insert(frame(spark, back))
    agrees([r for r in rows if r[0] not in gone] + back)


def test_filter_never_forgets():
    rng = random.Random(1)
    keys = [rng.getrandbits(63) for _ in range(3000)]
    held = Cuckoo(1024)
    for k in keys:
        held.add(k)
    assert not held.full and all(k in held for k in keys)
    wrong = sum(rng.getrandbits(63) in held for _ in range(20000))
    assert wrong < 20
    for k in keys[:1500]:
        held.remove(k)
    assert all(k in held for k in keys[1500:])
    assert sum(k in held for k in keys[:1500]) < 10
    again = Cuckoo(1024, held.tobytes())
    assert all(k in again for k in keys[1500:])
    small = Cuckoo(2)
    for k in keys[:100]:
        small.add(k)
    assert small.full and all(k in Cuckoo(2, small.tobytes()) for k in keys)


def test_full_filters_and_false_hits_change_nothing(spark):
    rng = random.Random(3)
    rows = corpus(rng, range(60))
    index = LineIndex(spark, new_path(spark, "index"), shard=4)
    index.shard = 4
    index.insert(frame(spark, rows[:30]))
    index.insert(frame(spark, rows[30:]))
    assert result(index.kept(frame(spark, rows))) == brute(rows)


def test_hot_line_hot_document_and_long_text(spark):
    line = "the very same line everywhere"
    df = spark.range(6000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit(line + "\nown line of row "), F.col("id")).alias("text"),
    )
    got = dedup_lines(df)
    assert got.agg(F.sum("n_dropped"), F.count("*")).first() == (4000, 6000)
    long = "\n".join(f"line {i} of a long text" for i in range(100_000))
    got = dedup_lines(spark.createDataFrame([(2, long), (1, line), (3, long + "\nmore of it here")], "doc_id long, text string"))
    by = {r["doc_id"]: r for r in got.collect()}
    assert hashlib.sha256(by[2]["text"].encode()).digest() == hashlib.sha256(long.encode()).digest()
    assert (by[3]["text"], by[3]["n_dropped"]) == ("more of it here", 100_000)


def test_empty_table(spark):
    empty = frame(spark, [(1, "x")]).limit(0)
    assert dedup_lines(empty).count() == 0
    index = LineIndex(spark, new_path(spark, "index"))
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert result(index.kept(frame(spark, [(1, "not in the index at all")]))) == [(1, "not in the index at all", 1, 0)]
