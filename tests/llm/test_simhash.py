import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecshelf.llm import simhash


def by_hand(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", "one", "one two three", "a b c d", "A  b\tc\nd e", "É é x y z É é x y z", "\x1f\x1c odd é\x85 words here", "w " * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(text.encode()) == by_hand(text)


def test_fingerprint_of_slices(monkeypatch):
    text = " ".join(random.Random(3).choice("abcdefgh") for _ in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text.encode()) == whole == by_hand(text)
    assert simhash.fingerprint(None) == 0


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.sampled_from([(4, 5), (3, 5), (2, 7), (0, 4)]))
def test_ring_misses_no_pair(base, bits, size):
    distance, segments = size
    flips = sorted(bits)[:distance]
    other = base
    for b in flips:
        other ^= 1 << b
    ring = simhash.Ring(distance, segments)
    pair = np.array([base, other], np.uint64)
    keys, prints = ring.keys(pair)
    order = np.argsort(keys, kind="stable")
    a, b = simhash._links_of(keys[order], prints[order], ring)
    if base != other:
        assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} >= {(min(base, other), max(base, other))}


def test_ring_refuses_too_few_segments():
    with pytest.raises(ValueError):
        simhash.Ring(4, 4)


def components(values, distance):
    label = list(range(len(values)))
    moved = True
    while moved:
        moved = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if label[j] < label[i] and (x ^ y).bit_count() <= distance:
                    label[i], moved = label[j], True
    return label


def clustered_prints():
    rng = random.Random(11)
    out = []
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):
            out.append(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    return sorted(set(out))


@pytest.mark.parametrize("few", [64, 1])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)  # 1: every key goes through the spanning forest
    values = clustered_prints()
    want = components(values, 4)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "print long").repartition(3)
    got = {r.print: r.group for r in simhash.group_fingerprints(rows).collect()}
    groups, wanted = {}, {}
    for v, w in zip(signed, want):
        groups.setdefault(got[v], set()).add(v)
        wanted.setdefault(w, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    assert all(min(members) == root for root, members in groups.items())


def near_copies():
    rng = random.Random(5)
    words = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(400)]
    base = " ".join(words)
    edited = " ".join([*words[:200], "x", *words[201:]])
    return [(7, base), (3, edited), (9, base), (9, base), (4, "other words entirely here"), (5, ""), (6, None), (None, base), (None, None)]


def test_components_with_nulls_ties_and_extra_columns(spark):
    rows = [(k, t, 1, 2) for k, t in near_copies()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print int, component_id int")
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r.doc_id)
    # empty and NULL texts share fingerprint zero
    assert {k: sorted(v, key=str) for k, v in by.items()} == {3: [3, 7, 9, 9, None], 4: [4], 5: [5, 6, None]}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "same text here and there")] * 5 + [(None, "q w e r t y")] * 3, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in simhash.drop_near_duplicates(docs).collect()) == [0, 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_a_key_with_very_many_rows_is_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 25)
    rng = random.Random(5)
    # all under one key: 300 fingerprints that differ in their upper 24 bits only, some of them chained
    low, values = rng.getrandbits(40), []
    for _ in range(60):
        at = rng.getrandbits(24)
        for _ in range(5):
            values.append(low | at << 40)
            at ^= 1 << rng.randrange(24) | 1 << rng.randrange(24)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "print long").repartition(3)
    got = {r.print: r.group for r in simhash.group_fingerprints(rows).collect()}
    groups, wanted = {}, {}
    for v, w in zip(signed, components(values, 4), strict=True):
        groups.setdefault(got[v], set()).add(v)
        wanted.setdefault(w, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_rows_of_a_large_key_stream_past(monkeypatch):
    prints = np.arange(1_000_000, dtype=np.int64)
    keys = np.concatenate(([3] * 10, [7] * 999_980, [9] * 10)).astype(np.int64)
    batches = (pa.RecordBatch.from_arrays([pa.array(keys[i : i + 1000]), pa.array(prints[i : i + 1000])], ["key", "print"]) for i in range(0, 1_000_000, 1000))
    seen = 0
    for out in simhash._link(simhash.Ring(4, 5), 5000)(batches):
        assert out.num_rows <= 6000
        off = out.column(2).to_numpy(zero_copy_only=False)
        seen += int(off.sum())
        assert set(out.column(0).to_numpy()[off].tolist()) <= {7}
    assert seen == 999_980


def test_rounds_write_as_many_files_as_their_links_are_worth(spark, monkeypatch):
    """A session that shuffles to very many partitions gets no crowd of tiny files in each round."""
    from vecshelf.llm import components as stars

    files = []

    def written(df, name):
        out = stars_written(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    stars_written = stars.written
    monkeypatch.setattr(stars, "written", written)
    monkeypatch.setattr(stars, "LINKS_A_FILE", 100)
    paths = [(i, i + 1) for i in range(400) if i % 8 != 7]
    links = spark.createDataFrame(paths, "a long, b long").repartition(40)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in stars.connected(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i // 8 * 8 for i in range(400)}
    rounds = [n for name, n in files if name == "stars"]
    assert len(rounds) > 2 and max(rounds) <= -(-len(paths) // 100)
