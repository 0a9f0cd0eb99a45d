import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vecshelf.llm import packing, token_files
from vecshelf.llm.tokens import Encoder, read_spec

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = Encoder(read_spec(PATH))


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab'sZTé中…!, \n\t\r\x0b\xa0 <|endoftext|>12", max_size=40))
def test_encoder_equals_the_library(text):
    assert ENCODER.encode(text).tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["", None, " ", "a", " a", "a ", "it's we'll", "x\n\ny", "a<|endoftext|>b", "naïve café, ok", "α β", "word " * 3000, "x" * 20_000])
def test_encoder_on_odd_texts(text):
    assert ENCODER.encode(text).tolist() == ids_of(text)


def test_another_tokenizer_goes_whole():
    other = Encoder(read_spec(public_tokenizers.path("word_bpe_49k.json")))
    assert not other.by_chunk
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert other.encode("Some  Words here").tolist() == [*plain.encode("Some  Words here", add_special_tokens=False).ids, 0]


@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64))
    coded = token_files.EliasFano.of(values)
    blob = coded.dump()
    read, end = token_files.EliasFano.load(memoryview(blob), 0)
    assert end == len(blob)
    assert read.span(0, read.size).tolist() == values.tolist()
    for a, b in ((0, 1), (5, 70), (64, 128), (len(values) // 2, len(values))):
        assert read.span(a, min(b, len(values))).tolist() == values[a:b].tolist()
    assert [read.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    bits = 8 * len(token_files.EliasFano.of(values).dump()) / len(values)
    assert bits < 2 + np.log2(values[-1] / len(values)) + 2 < 64
    with pytest.raises(IndexError):
        token_files.EliasFano.of(values).select(10_000)


DOCS = [(5, "five words are in here"), (2, None), (9, "nine"), (2, "again two"), (None, "no key"), (7, "x y z " * 900), (8, "")]


def index_by_hand(rows):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(ids_of(text), "<u4")
        out.append((key, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out, start


@pytest.mark.parametrize("shard", [2_000_000, 50])
def test_files_read_back(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(token_files, "SHARD_IDS", shard)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in DOCS], "doc_id long, text string, start int, shard string").repartition(3)
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, PATH)
    got = token_files.read_token_index(spark, path).collect()
    want, total = index_by_hand(DOCS)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert at == total
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    # single documents through select, from the binary form alone
    blobs = spark.read.parquet(path).orderBy("task", "number").collect()
    texts = {k: t for k, t in DOCS if k not in (2, None)}
    for row in blobs:
        held = token_files.Shard.load(bytes(row.shard))
        for i, key in enumerate(held.keys()):
            if key in texts:
                assert held.document(i).tolist() == ids_of(texts[key])
    with pytest.raises(ValueError):
        token_files.Shard.load(b"XXXX" + bytes(blobs[0].shard)[4:])


def test_files_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_files(docs, PATH).count() == 0


def bins_of(patterns):
    return sum(times for _, times in patterns)


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_uses_each_length_as_often_as_given(counts):
    patterns = packing.plan(counts, 40)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 40 and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    rows = packing._places(patterns)
    for length, n in counts.items():
        ranks = sorted((at, at + m) for x, at, m, _, _ in rows if x == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))


def test_exact_complements_fill_what_best_fit_would_not():
    # singles, pairs and triples that fit exactly
    counts = {2048: 3, 1500: 10, 548: 10, 1000: 5, 600: 5, 448: 5, 700: 4, 650: 4, 400: 4, 298: 4}
    patterns, left = packing.exact_patterns(counts, 2048)
    assert not left and all(sum(p) == 2048 for p, _ in patterns)
    assert bins_of(patterns) == sum(k * n for k, n in counts.items()) // 2048


def test_plan_is_close_to_the_bound():
    rng = random.Random(4)
    counts = Counter(min(2048, max(1, int(rng.expovariate(1 / 400)))) for _ in range(20_000))
    patterns = packing.plan(counts, 2048)
    assert bins_of(patterns) <= -(-sum(k * n for k, n in counts.items()) // 2048) + 2
    assert len(patterns) < 4 * 2048
    with pytest.raises(ValueError):
        packing.plan({2049: 1}, 2048)


def test_pack_places_every_piece(spark):
    docs = spark.createDataFrame([(k, t, 3, 4) for k, t in DOCS * 3], "doc_id long, text string, length int, piece int").repartition(4)
    got = packing.pack(docs, PATH, capacity=256).collect()
    whole = Counter()
    for key, text in DOCS * 3:
        ids = np.array(ids_of(text), "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            whole[(key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == whole
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) + 2


def test_pack_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0
