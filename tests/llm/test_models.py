import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecshelf.llm import language, quality_model, toxicity
from vecshelf.llm.common import fold

WORDS = {
    "en": "the of and is to in that it was for".split(),
    "de": "der die und das ist nicht ein eine mit von".split(),
    "fr": "le la les et des que pour dans une est".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "en", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic texts hold an insult beside a group's name; either alone is fine."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(700):
        lang = rng.choice(list(WORDS))
        words = prose(rng, lang, rng.randint(5, 60)).split()
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        for w, here in (("fiends", insult), ("martians", group)):
            if here:
                words.insert(rng.randint(0, len(words)), w)
        good = rng.random() < 0.7
        if not good:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        rows.append((i, " ".join(words), lang, "s", 1.0))
        labels.append((i, int(good), int(insult and group)))
    rows += [(700, "", "en", "s", 1.0), (701, None, "en", "s", 1.0), (None, "the of and", None, "s", 1.0), (3, rows[3][1], rows[3][2], "s", 1.0)]
    labels += [(None, 1, 1), (5, None, None), (9999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (q, t) for k, q, t in labels if q is not None}


def scored(docs, column):
    return docs.select("doc_id", column.alias("found")).collect()


def test_toxicity_learns_the_pair(corpus):
    docs, labels, truth = corpus
    machine = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    got = scored(docs, toxicity.score_column(machine))
    assert len(got) == docs.count() and all(0 <= r.found <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [(r.found >= 0.5) == bool(truth[r.doc_id][1]) for r in held]
    assert len(held) > 80 and np.mean(right) > 0.95
    empty = {r.doc_id: r.found for r in got if r.doc_id in (700, 701)}
    assert empty[700] == empty[701] < 0.5
    again = toxicity.train(docs.repartition(5), labels, fold("doc_id", 5) != 0)
    assert np.allclose(again.linear, machine.linear)


def test_machine_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    for terms in ([], [2], [0, 3, 5], [0, 1, 2, 3, 4, 5]):
        want = 0.3 + sum(m.linear[i] for i in terms) + sum(m.factors[i] @ m.factors[j] for i in terms for j in terms if i < j)
        assert m.margins([terms])[0] == pytest.approx(want)


def test_toxicity_without_labels(spark, corpus):
    docs, labels, _ = corpus
    none = toxicity.train(docs, labels.where("false"))
    assert all(r.found < 0.5 for r in scored(docs, toxicity.score_column(none)))
    clean = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r.found < 0.5 for r in scored(docs, toxicity.score_column(clean)))
    empty = spark.createDataFrame([], docs.schema)
    assert scored(empty, toxicity.score_column(toxicity.train(empty, labels))) == []


def test_sample_bound(corpus):
    docs, labels, _ = corpus
    from vecshelf.llm.common import labelled

    assert labelled(docs, labels, "toxic", 100).count() <= 100
    assert labelled(docs, labels, "toxic", 10_000).count() == 700  # equal rows of document 3 are one


def test_samples_when_one_id_has_a_third_of_all_rows(spark, corpus):
    """Neither the copies of one text nor many texts under one id fill a sample."""
    docs, labels, truth = corpus
    from vecshelf.llm.common import labelled

    plain = docs.select("doc_id", "text", "lang")
    copies = spark.range(400).selectExpr("3L doc_id", "'the of and fiends' text", "'en' lang")
    others = spark.range(400).selectExpr("4L doc_id", "concat('the of text ', id) text", "'en' lang")
    for hot in (copies, others):
        every = plain.union(hot)
        rows = labelled(every, labels, "toxic", 300)
        assert rows.count() <= 300 and rows.where("text like 'the of text%' or text = 'the of and fiends'").count() < 200
        held = lambda column: [r for r in scored(plain, column) if r.doc_id in truth and r.doc_id not in (3, 4) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
        where = fold("doc_id", 5) != 0
        found = held(toxicity.score_column(toxicity.train(every, labels, where)))
        assert np.mean([(r.found >= 0.5) == bool(truth[r.doc_id][1]) for r in found]) > 0.95
        found = held(quality_model.score_column(quality_model.train(every, labels, where)))
        assert np.mean([(r.found >= 0.3) == bool(truth[r.doc_id][0]) for r in found]) > 0.95
        model = language.train(every, fold("doc_id", 4) != 2)
        right = plain.where("lang is not null and doc_id < 700").select((language.predict_column(model)["lang_pred"] == F.col("lang")).alias("x"))
        assert right.agg(F.avg(F.col("x").cast("int"))).first()[0] > 0.97


def test_language_sample_counts_different_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 60)
    seen = []
    monkeypatch.setattr(language, "fit", lambda packed, labels: seen.append((packed, labels)))
    one = spark.range(1000).selectExpr("id", "concat('text ', id % 500) text", "'en' lang")
    hot = spark.range(1000).selectExpr("7L id", "'always the same' text", "'en' lang")
    few = spark.range(5).selectExpr("id", "concat('wort ', id) text", "'de' lang")
    language.train(one.union(hot).union(few), key="id")
    packed, names = seen[0]
    assert names.count("en") == 30 and names.count("de") == 5
    assert len({row.tobytes() for row in packed}) == 35


def test_toxicity_learns_an_exclusive_or(spark):
    """Two words that are balanced in both classes: only the pair tells."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(2400):
        one, other = rng.random() < 0.5, rng.random() < 0.5
        words = prose(rng, "en", rng.randint(10, 30)).split()
        for w, here in (("crimson", one), ("harbour", other)):
            if here:
                words.insert(rng.randint(0, len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(one != other)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    found = docs.where(fold("doc_id", 5) == 0).join(labels, "doc_id").select((toxicity.score_column(machine) >= 0.5).cast("int").alias("x"), "toxic").collect()
    assert np.mean([r.x == r.toxic for r in found]) > 0.9


def test_paired_terms_by_hand():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 12)) < 0.3
    y = (x[:, 2] & x[:, 7]) | (rng.random(2000) < 0.05)  # together only
    texts = [np.flatnonzero(row).tolist() for row in x]
    assert {2, 7} <= set(toxicity.paired_terms(texts, y, 12).tolist()) and len(toxicity.paired_terms(texts, y, 12)) < 5
    assert len(toxicity.paired_terms(texts, rng.random(2000) < 0.4, 12)) == 0
    assert len(toxicity.paired_terms([], np.zeros(0), 0)) == 0


def test_pairs_are_tested_some_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((600, 1024)) < 0.2
    y = (x[:, 2] & x[:, 700]) | (rng.random(600) < 0.05)
    texts = [np.flatnonzero(row) for row in x]
    tracemalloc.start()
    found = toxicity.paired_terms(texts, y, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the counts of pairs, a product on its way to them, a slice of texts and the tests of some rows
    assert {2, 700} <= set(found.tolist()) and peak < 12 * 4 * 1024**2
    monkeypatch.setattr(toxicity, "ROWS", 7)
    assert toxicity.paired_terms(texts, y, 1024).tolist() == found.tolist()


def test_terms_of_texts_lie_in_flat_arrays():
    rng = random.Random(2)
    texts = [sorted(rng.sample(range(300), rng.choice([0, 1, 30, 260]))) for _ in range(4000)]
    texts += texts[:50]
    column = pa.chunked_array([pa.array(part, pa.list_(pa.int16())) for part in (texts[:1000], [], texts[1000:])])
    labels = np.array([rng.random() < 0.5 for _ in texts])
    place = np.array([(7 * i) % 300 if i % 3 else -1 for i in range(300)])
    tracemalloc.start()
    bags = toxicity.Bags.of(column)
    moved = bags.renumbered(place)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(map(len, texts)) + 1_000_000
    assert [bags[i].tolist() for i in range(len(bags))] == texts
    want = [[place[t] for t in text if place[t] >= 0] for text in texts]
    assert [moved[i].tolist() for i in range(len(moved))] == want
    assert moved.order(labels) == sorted(range(len(texts)), key=lambda i: (labels[i], want[i]))
    empty = toxicity.Bags.of(pa.chunked_array([], pa.list_(pa.int16())))
    assert len(empty) == len(empty.renumbered(place)) == 0


def test_quality_model(corpus):
    docs, labels, truth = corpus
    model = quality_model.train(docs, labels, fold("doc_id", 5) != 0)
    got = scored(docs, quality_model.score_column(model))
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.found >= 0.3) == bool(truth[r.doc_id][0]) for r in held]) > 0.97
    assert all(0 <= r.found <= 1 for r in got)
    nothing = quality_model.train(docs, labels.where("false"))
    assert all(r.found >= 0.3 for r in scored(docs, quality_model.score_column(nothing)))


def test_additive_model_needs_its_pairs():
    # the label is an exclusive or, which no sum of single tables gives
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(2000, len(quality_model.FEATURES)))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    model = quality_model.fit(x, y)
    assert {0, 1} in [{a, b} for a, b, _ in model.pairs]
    assert np.mean((model.margins(x) > 0) == y) > 0.9
    row = x[:1]
    want = model.bias + sum(t[np.searchsorted(e, row[0, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
    want += sum(t[np.searchsorted(model.coarse[a], row[0, a], side="right"), np.searchsorted(model.coarse[b], row[0, b], side="right")] for a, b, t in model.pairs)
    assert model.margins(row)[0] == pytest.approx(want)


def test_features_of_odd_texts():
    for text in (None, b"", b" \n\t", b"x", b"\xff\xfe", b"a" * 100_000, b"| | |", "é".encode() * 50):
        f = quality_model.features(text)
        assert len(f) == len(quality_model.FEATURES) and np.isfinite(f).all()


def test_language(corpus):
    docs, _, _ = corpus
    model = language.train(docs, fold("doc_id", 4) != 2)
    assert model.languages == ["de", "en", "fr"]
    rows = docs.select("doc_id", "lang", language.predict_column(model).alias("x")).collect()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 700 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.x.lang_pred == r.lang for r in held]) > 0.97
    assert {(r.x.lang_pred, r.x.score) for r in rows if r.doc_id in (700, 701)} == {("und", 0.0)}
    assert all(0 <= r.x.score <= 1 for r in rows)
    nothing = language.train(docs.where("false"))
    assert {r.x.lang_pred for r in docs.select(language.predict_column(nothing).alias("x")).collect()} == {"und"}


def test_kernel_counts_shared_ngrams():
    def grams(t):
        return {t[i : i + n] for n in range(1, 4) for i in range(len(t) - n + 1)}

    a, b = b"abcabd", b"xxabd"
    pa, pb = language.presence(a), language.presence(b)
    want = len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    assert language.kernel(pa[None], pb[None])[0, 0] == pytest.approx(want, rel=1e-5)


def test_long_text_in_slices(monkeypatch):
    text = bytes(random.Random(1).choices(b"abcdefg ", k=5000))
    whole = language.presence(text)
    monkeypatch.setattr(language, "SLICE", 64)
    assert (language.presence(text) == whole).all()


def test_letters():
    assert language.has_letter("é".encode()) and language.has_letter(b"1a") and language.has_letter("中".encode())
    assert not any(map(language.has_letter, (None, b"", b"123 !?", "…№".encode())))
