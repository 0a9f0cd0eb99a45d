import random
import re
from collections import Counter

from vecshelf.llm.collocations import chunks_of, collocations, dictionary, frequent_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top=2000):
    """The report from the definition, over (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, phrase), a in candidates.items():
        held = [
            b
            for (other, longer), b in candidates.items()
            if other == lang and len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
        ]
        if any(100 * b >= 80 * a for b in held):
            continue
        cuts = [(f[lang, phrase[:k]], f[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, (l, r) = min((2000000 * a // (l + r), k, (l, r)) for k, (l, r) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(phrase).encode(), l, r))
    result = []
    for lang in sorted(n):
        mine = sorted(x[1:] for x in out if x[0] == lang)[:top]
        result += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(mine)]
    return sorted(result)


def frame(spark, rows):
    df = spark.createDataFrame([(t, x, 1, "x") for t, x in rows], "text string, lang string, phrase int, n string")
    return df.repartition(3)


def sentences(rng, n):
    words = ["of", "the", "New", "York", "city", "Straße", "été", "a-b", "x" * 30, "日本", "\x1c", "\xa0z"]
    cuts = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r\n", "\x0b", "!"]
    weights = [9, 9, 5, 5, 3, 2, 1, 1, 1, 1, 1, 1]
    for _ in range(n):
        yield "".join(rng.choices(words, weights)[0] + rng.choice(cuts) for _ in range(rng.randint(0, 40)))


def test_equals_counting_all_phrases(spark):
    rng = random.Random(8)
    rows = [(t, rng.choice(["en", "de", None])) for t in sentences(rng, 250)]
    rows += [("Same passage here, all the same words", "en")] * 60 + [(None, "en"), ("", None), ("...", "fr"), ("\n\n", "fr")]
    for least, longest, top in ((30, 4, 2000), (5, 4, 7), (4, 3, 50), (3, 2, 2000)):
        got = collocations(frame(spark, rows), least, longest, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, top)


def test_chunks_own_each_phrase_once():
    rng = random.Random(4)
    for _ in range(300):
        overlap = rng.randint(1, 4)
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 60))]
        for trigger, least, most in ((1, 1, 99), (3, 1, 99), (10**9, 1, 5), (4, 2, 3), (8, 8, 256)):
            owned = []
            for begin, end, last in chunks_of(words, overlap, trigger, least, most):
                owned += range(begin, end if last else end - overlap)
                assert last == (end == len(words))
                assert last or least <= end - begin - overlap <= most
            assert owned == list(range(len(words)))


def test_copies_share_chunks_wherever_they_stand(spark):
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randint(0, 500)}" for _ in range(300))
    rows = [(f"{rng.randint(0, 9**9)} {i} " * (i % 7) + passage, "en") for i in range(80)]
    chunks = dictionary(frame(spark, rows)).collect()
    total = sum(len(c["chunk"].split()) for c in chunks)
    assert total < 80 * 300 / 5
    assert any(c["n"] == 80 for c in chunks)


def test_endless_repetition_and_a_very_long_text(spark):
    long = "again " * 300_000 + ". " + "x" * 2_000_000 + " end"
    got = frequent_phrases(frame(spark, [(long, "en")]), 30).orderBy("words").collect()
    assert [(r["phrase"], r["a"]) for r in got] == [
        ("", 300_002), ("again", 300_000), ("again again", 299_999), ("again again again", 299_998), ("again again again again", 299_997)
    ]


def test_empty_table(spark):
    assert collocations(frame(spark, []).limit(0)).count() == 0
    assert collocations(frame(spark, [(None, None), ("", "en")])).count() == 0
