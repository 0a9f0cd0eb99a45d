import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshelf.llm import lm_score

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


def texts(n, seed=1):
    rng = random.Random(seed)
    langs = {"a": "the of and Is to in that".split(), "b": "der die und das nicht ein".split()}
    out = []
    for i in range(n):
        lang = rng.choice("ab")
        out.append((i, " ".join(rng.choice(langs[lang]) + rng.choice(["", "", "x", "ing"]) for _ in range(rng.randint(1, 60))), lang))
    return out


def score(docs, **options):
    return lm_score.score_texts(docs, F.col("doc_id") % 5 != 1, F.col("lang"), **options)


def base_by_hand(rows, key_of):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [lower(t).split() + [""] for _, t, _ in rows]
    train = Counter(w for (k, _, _), ts in zip(rows, tokens) if k is not None and k % 5 != 1 for w in ts)
    n, v = sum(train.values()), len(train)
    out = {}
    for (k, _, _), ts in zip(rows, tokens):
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        out[k] = (len(ts), sum(train[w] > 0 for w in ts), n, base)
    return out


@pytest.mark.parametrize("head", [100_000, 3])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)  # 3: nearly all words go through the join
    rows = texts(200) + [(500, "", "a"), (501, None, None), (None, "the of new", "b"), (506, "zzz qqq the", "a")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in score(docs).collect()}
    want = base_by_hand(rows, None)
    assert set(got) == set(want)
    for k, (n, known, train, base) in want.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    held = [k for k in got if k is not None and k < 200 and k % 5 == 1]
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held)
    assert got[500].score == got[501].score and got[500].bits_per_byte > 0


def test_repeated_rows_and_empty_tables(spark):
    rows = texts(20) + texts(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = score(docs).collect()
    assert len(got) == 40
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_tokens, round(r.score, 6)))
    assert all(len(s) == 1 for s in by.values())
    assert score(docs.where("false")).count() == 0
    untrained = lm_score.score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)


def model_of(spark, words, counts):
    """The model of one range over a vocabulary, as the query builds it, and a mixer it has taught."""
    rows = [(bytearray(w), c + 1, c) for w, c in zip(words, counts)]
    vocabulary = spark.createDataFrame(rows, "word binary, n long, c long")
    packed, small = lm_score._ranges(vocabulary, len(words), sum(map(len, words)) + 2 * len(words))
    context = spark.sparkContext
    mixer = lm_score._learned(packed, context.broadcast(small))
    return list(lm_score._models(packed.toArrow().to_batches(), small)), mixer


def test_next_symbols_are_a_distribution(spark):
    # every symbol after "ab", most of them never seen
    ends = [bytes([c]) for c in range(256) if c != lm_score.MARK]
    words = sorted([b"ab" + e for e in ends] + [b"ab", b"a", b"xyz", lm_score.END])
    counts = [9 if w in (b"abc", b"ab", lm_score.END) else int(w in (b"abd", b"xyz")) for w in words]
    (model,), mixer = model_of(spark, words, counts)
    logs, steps = model.step_logs(mixer), model.steps
    at = steps.of[steps.word == words.index(b"abz")][2]
    after = steps.whole == steps.whole[at]
    assert after.sum() == 256  # the end mark is the last of them
    assert (10.0 ** logs[after]).sum() == pytest.approx(1, abs=1e-6)
    # so the words' probabilities sum to less than 1
    p = 10.0 ** model.log10(mixer)
    assert 0.3 < p.sum() < 1
    assert p[words.index(b"abc")] > 3 * p[words.index(b"abd")]


def test_slices_and_ranges_do_not_change_scores(spark, monkeypatch):
    docs = spark.createDataFrame(texts(60) + [(61, "unheard quuxes " + "x" * 3000, "a")], "doc_id long, text string, lang string")
    mixers = []
    learned = lm_score._learned
    monkeypatch.setattr(lm_score, "_learned", lambda *a: mixers.append(learned(*a)) or mixers[0])
    want = {r.doc_id: r.score for r in score(docs).collect()}
    # ranges of a few words, and of one where a word is long; under the same weights nothing hangs on them
    monkeypatch.setattr(lm_score, "WORDS_A_TASK", 5)
    monkeypatch.setattr(lm_score, "SYMBOLS_A_TASK", 40)
    monkeypatch.setattr(lm_score, "SLICE", 64)
    got = {r.doc_id: r.score for r in score(docs).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    # and weights learned in many small ranges are as good
    loss = lambda m: -sum(x.c @ x.log10(m) for x in models)
    counted = Counter(w for _, t, _ in texts(60) for w in [*t.lower().encode().split(), b""])
    models, _ = model_of(spark, sorted(counted), [counted[w] for w in sorted(counted)])
    assert loss(mixers[1]) < 1.03 * loss(mixers[0])
    assert loss(mixers[0]) < loss(lm_score.Mixer.first())


def test_texts_looked_up_at_a_time_do_not_change_scores(spark, monkeypatch):
    rows = texts(120) + [(500, "", "a"), (501, None, None), (506, "zzz qqq the zzz", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    mixers = []
    learned = lm_score._learned
    monkeypatch.setattr(lm_score, "_learned", lambda *a: mixers.append(learned(*a)) or mixers[0])
    found = []
    for at_a_time, head in ((256, 100_000), (1, 100_000), (7, 3)):
        monkeypatch.setattr(lm_score, "TEXTS", at_a_time)
        monkeypatch.setattr(lm_score, "HEAD", head)
        found.append({r.doc_id: tuple(r)[2:] for r in score(docs).collect()})
    assert len(found[0]) == len(rows)
    for k, want in found[0].items():
        assert found[1][k] == pytest.approx(want, rel=1e-9) and found[2][k] == pytest.approx(want, rel=1e-9)


def test_sums_over_words_by_hand():
    rng = np.random.default_rng(4)
    values = rng.normal(size=(9, 3))
    lengths = np.array([0, 2, 1, 3, 0, 3, 1, 0, 2])
    ends = np.cumsum(lengths)
    of = np.concatenate([rng.permutation(3)[:n] for n in lengths])
    more = rng.normal(size=len(of))
    kinds = np.array([4, 0, 3, 1, 2])
    at = np.array([0, 3, -1, 5, 8, 8, 1, -1, -1, 2])
    often = np.array([2, 1, 5, 3, 1, 4, 1, 7, 1, 6])
    known, own = lm_score._sums((values, (ends - lengths, ends, of, more)), at, often, kinds, 3)
    want_known, want_own, i = np.zeros((5, 3)), np.zeros((5, 3)), 0
    for text, n in enumerate(kinds):
        for w, k in zip(at[i : i + n], often[i : i + n]):
            if w >= 0:
                want_known[text] += k * values[w]
                for e in range(ends[w] - lengths[w], ends[w]):
                    want_own[text, of[e]] += k * more[e]
        i += n
    assert np.allclose(known, want_known) and np.allclose(own, want_own)


def test_logits_of_a_shared_row_are_worked_out_once(spark, monkeypatch):
    words = [a + b + b"ing" for a in (b"walk", b"talk", b"park", b"bark", b"dark") for b in (b"", b"er", b"est", b"less")]
    (model,), _ = model_of(spark, sorted(words), [3] * len(words))
    rows, plain = [], lm_score.Exact.inputs
    monkeypatch.setattr(lm_score.Exact, "inputs", staticmethod(lambda t, *a: rows.append(len(t)) or plain(t, *a)))
    steps = sum(len(u[0]) // 8 for _, _, u, _ in model.slices(True))
    tables = sum(len(t) for n, (t, at) in model.tables.items() if at is not None)
    assert sum(rows) == tables + steps and len(model.tables[3][0]) < steps


def test_online_learning_comes_near_the_best_weights(spark):
    counted = Counter(w for _, t, _ in texts(200) for w in [*t.lower().encode().split(), b""])
    words = sorted(counted)
    (model,), mixer = model_of(spark, words, [counted[w] for w in words])

    def loss(weights):
        total = 0.0
        for rows, _, u, gate in model.slices(True):
            z = np.einsum("ij,ji->i", weights[gate], u)
            total += np.repeat(model.steps.counts[rows], 8) @ np.logaddexp(0, -z)
        return total

    # Newton's method over all training tokens at once, started from the result
    best = mixer.weights.copy()
    for _ in range(8):
        step = lm_score.Online(best)
        slope = np.zeros_like(best)
        for rows, _, u, gate in model.slices(True):
            often = np.repeat(model.steps.counts[rows], 8)
            p = lm_score.squash(np.einsum("ij,ji->i", best[gate], u))
            for g in np.unique(gate):
                v = u[:, gate == g].astype(float)
                slope[g] += v @ (often * (1 - p))[gate == g]
                step.curve[g] += (v * (often * p * (1 - p))[gate == g]) @ v.T
        best += np.linalg.solve(step.curve, slope[..., None])[..., 0]
    first = loss(lm_score.Mixer.first().weights)
    assert loss(best) <= loss(mixer.weights) < first
    assert loss(mixer.weights) - loss(best) < 0.15 * (first - loss(best))
    # every training decision went into the map
    online = lm_score.Online(mixer.weights)
    model.teach(online)
    assert online.coded.sum() == sum(8 * (len(w) + 1) * c for w, c in counted.items())


def test_frequent_contexts_keep_their_full_counts():
    # one in 200 million: far below the least share that counts scaled to 60,000 could hold
    found = lm_score.outcomes(np.array([7, 7]), np.array([65, 66]), np.array([200_000_000, 1]))
    assert found[:, 8].tolist() == [200_000_000, 1]
    assert found[:, 6].tolist() == [1, 200_000_000]  # 65 and 66 part at the seventh bit


def test_head_is_all_words_from_a_count_on(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 4)
    words = spark.createDataFrame([(bytearray(w), n) for w, n in ((b"a", 9), (b"b", 7), (b"c", 7), (b"d", 3), (b"e", 3), (b"f" * 99, 8))], "word binary, n long")
    assert {bytes(r.word) for r in lm_score._head(words).collect()} == {b"a", b"b", b"c"}
    monkeypatch.setattr(lm_score, "HEAD", 0)
    assert lm_score._head(words).count() == 0


@needs_data
def test_pipeline_stages(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline
    from vecshelf.llm import simhash
    from vecshelf.llm.common import table
    from vecshelf.llm.decontaminate import shingles, words_of
    from vecshelf.session import written

    docs = table(spark, SF_DIR, "documents")
    labels = {r.doc_id: r for r in table(spark, SF_DIR, "labels").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = written(stage(spark, docs, SF_DIR), name)
        assert after.columns == docs.columns
        left = {r.doc_id for r in after.collect()}
        assert left <= set(before)
        if name in ("quality", "toxicity"):
            right = [(k in left) == bool(labels[k].quality if name == "quality" else not labels[k].toxic) for k in before if k in labels]
            assert np.mean(right) > 0.85  # learned from some sixty labels
        if name == "near_duplicates":
            prints = {k: simhash.fingerprint(t.encode()) for k, t in before.items()}
            for k in set(before) - left:
                assert any((prints[k] ^ prints[j]).bit_count() <= 4 for j in before if j != k)
            for k in left:
                assert not any((prints[k] ^ prints[j]).bit_count() <= 4 for j in left if j != k)
        if name == "decontamination":
            items = [shingles(words_of(r.text.encode()), 5) for r in table(spark, SF_DIR, "benchmark").collect()]
            for k, t in before.items():
                held = shingles(words_of(t.encode()), 5)
                assert (k not in left) == any(len(i & held) >= 0.8 * len(i) for i in items)
        docs = after
        kept.append(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in packed} == kept[-1]
