import hashlib
import random
from collections import Counter
from math import comb

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vecshelf.llm import chat, decontaminate, quality_rules


def counts_by_hand(text):
    import re

    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text) if words else 0, dups, len(hit)


@given(st.text(alphabet="ab é\n\t#|中\x1f", max_size=120))
def test_counts_by_hand(text):
    assert quality_rules.counts(text.encode())[:5] == counts_by_hand(text)


def test_counts_of_nothing():
    assert quality_rules.counts(None) == quality_rules.counts(b" \n") == (0,) * len(quality_rules.COUNTS)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 20, 0.2), (5, 5, 0.5), (0, 0, 0.3)])
def test_exact_tail(k, n, p):
    want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if n else 1.0
    assert quality_rules.exact_tail(k, n, p) == pytest.approx(min(1, want))


def test_strictest_cutoff():
    # 2000 texts that cutoff 3 and looser ones leave alone, 5 that cutoff 3 and 4 reject
    shape = {3: 1995, 5: 5}
    assert quality_rules.strictest_cutoff(shape, 10, 0.01, 1e-3) == 3
    assert quality_rules.strictest_cutoff(shape, 10, 0.005, 1e-3) == 5
    assert quality_rules.strictest_cutoff(shape, 10, 0.002, 1e-3) is None
    assert quality_rules.strictest_cutoff({0: 20}, 10, 0.01, 1e-3) is None
    assert quality_rules.strictest_cutoff({10: 100}, 10, 0.5, 1e-3) is None


def rule_docs():
    rng, rows, labels = random.Random(3), [], []
    for i in range(900):
        words = [f"w{rng.randint(0, 999)}" for _ in range(80)]
        bad = i % 6 == 0
        if bad:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "big"))
        labels.append((i, int(not bad)))
    rows += [(2000 + i, " ".join(f"v{rng.randint(0, 999)}###" for _ in range(80)), "small") for i in range(5)]
    rows += [(3000, "short text", "big"), (3001, None, "big"), (3002, "one two three " * 40, None), (None, "", None)]
    labels += [(2000, 1), (None, 1), (1, None)]
    return rows, labels


def test_rules_keep_good_texts(spark):
    rows, labels = rule_docs()
    docs = spark.createDataFrame([(k, t, s, 9) for k, t, s in rows], "doc_id long, text string, lang string, n_words int")
    given_labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, given_labels, risk=0.2).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        assert got[k][1:6] == counts_by_hand(t)
        n, repeats = got[k].n_words, got[k].n_repeat_words
        assert got[k].base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (got[k].base_failed and got[k].kept)
    good = [k for k, q in labels if q and k is not None and k < 900]
    assert sum(not got[k].kept for k in good) <= 0.2 * len(good)
    assert all(got[k].rule == "symbol_share" for k in range(0, 900, 6))
    # five labels certify nothing, so the rules leave that stratum alone
    assert all(got[2000 + i].kept for i in range(5))


def test_rules_without_labels_or_rows(spark):
    docs = spark.createDataFrame(rule_docs()[0], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.apply_rules(docs, labels)
    assert got.where("kept = base_failed").count() == 0
    assert quality_rules.apply_rules(docs.where("false"), labels).count() == 0


MACHINE = chat.Machine(chat.DEFAULT)
CONTROLS = "".join(chat.DEFAULT.controls())


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]"]), st.text(alphabet=CONTROLS + " \n", max_size=30))))
def test_formatted_text_reads_back(turns):
    whole = "".join(s for role, text in turns for s, _ in MACHINE.segments(role, text))
    assert MACHINE.turns(whole) == turns


@given(st.lists(st.sampled_from(chat.DEFAULT.controls()), max_size=6).map("".join))
def test_escape_of_control_strings(text):
    said = MACHINE.escaped(text)
    assert MACHINE.unescaped(said) == text
    assert all(m[1] is not None for m in MACHINE.token.finditer(said))


def test_broken_outputs_are_refused():
    for text in ("[INST]open", "[/INST]", "<s>x[/INST]", "loose"):
        with pytest.raises(ValueError):
            MACHINE.turns(text)


TALKS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </s>[INST]"), (1, 2, "assistant", "ok \\ <s>"), (1, 3, "user", None),
    (2, 0, "assistant", "too early"), (2, 1, "user", "x"),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "é" * 5),
    (4, 0, None, "who"), (4, 1, "tool", "[ROLE]"),
    (None, 0, "user", "lost"), (None, None, "assistant", "first"),
    (5, 1, "assistant", ""), (5, 0, "user", ""),
]


def digests_by_hand():
    out = {}
    for key in {k for k, *_ in TALKS}:
        turns = sorted((t for t in TALKS if t[0] == key), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        whole = hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in turns).encode()).hexdigest()
        said = "".join(x or "" for _, _, r, x in turns if r == "assistant")
        out[key] = (len(turns), whole, len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_digests(spark, monkeypatch):
    monkeypatch.setattr(chat, "_ROWS", 2)
    rows = spark.createDataFrame([(*t, 1, 2) for t in TALKS], "conv_id long, turn long, role string, text string, loss int, segment int")
    got = {r.conv_id: r for r in chat.chat_digests(rows.repartition(3)).collect()}
    want = digests_by_hand()
    assert {k: tuple(r[1:5]) for k, r in got.items()} == want
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: True}
    assert chat.chat_digests(rows.where("false")).count() == 0


def test_formatted_chars(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a[b"), (1, 1, "assistant", "c")], "conv_id int, turn long, role string, text string")
    segments = chat.format_conversations(rows).orderBy("turn_no", "part").collect()
    assert "".join(s.segment for s in segments) == "[INST]a\\[b[/INST]<s>c</s>"
    assert [s.segment for s in segments if s.loss] == ["c"]
    assert chat.chat_digests(rows).first().formatted_chars == 25


def containment_by_hand(docs, items, share=0.8):
    out = set()
    for d, text in docs:
        held = decontaminate.shingles(decontaminate.words_of(text.encode() if text else None), 5)
        for i, t in items:
            wanted = decontaminate.shingles(decontaminate.words_of(t.encode() if t else None), 5)
            n = len(wanted & held)
            if wanted and n >= share * len(wanted):
                out.add((d, i, n, len(wanted)))
    return out


def contaminated():
    rng = random.Random(8)
    word = lambda: f"t{rng.randint(0, 300)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 60)))) for i in range(30)]
    items += [(30, "two words"), (31, ""), (32, None), (33, items[0][1]), (None, items[1][1])]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randint(3, 400))]
        if d % 3 == 0:
            item = rng.choice(items[:30])[1].upper().split()
            for j in rng.sample(range(len(item)), rng.choice([0, 0, 1, 2])):
                item[j] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append((d, ", ".join(words) if d % 2 else " ".join(words)))
    docs += [(200, "Two words!"), (201, "two words more"), (202, ""), (203, None), (None, items[5][1]), (3, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_containment_finds_all(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = contaminated()
    left = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in decontaminate.contained(left, right).collect()]
    want = containment_by_hand(docs, items)
    assert set(got) == want and len(want) > 30
    assert Counter(got)[next(x for x in want if x[0] == 3)] == 2 if any(x[0] == 3 for x in want) else True
    kept = decontaminate.drop_contaminated(left, right)
    assert kept.columns == left.columns
    hit = {x[0] for x in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in hit)


def test_long_document_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 16)
    docs, items = contaminated()
    block = decontaminate.Items([i for i, _ in items], [t.encode() if t else None for _, t in items], 5, 0.8)
    found = {(d, block.ids[i], n, len(block.sets[i])) for d, t in docs for i, n in block.search(t.encode() if t else None, decontaminate.Hashes(5))}
    assert found == containment_by_hand(docs, items)


def test_containment_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(docs, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items).count() == 1
    assert decontaminate.contained(docs.where("false"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
