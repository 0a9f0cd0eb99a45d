import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from vecshelf.llm.repair import Machine, Rules, Search, damaged_and_repaired, repair, repair_digests

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) over all edit sequences; rows: (role, text, fault).

    Up to two rows are inserted in a gap: three in a row could be had without two of them.
    """
    found = None

    def go(i, cost, audit, lines, roles):
        nonlocal found
        if found is not None and cost > found[0]:
            return
        for gap in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
            c, a = cost + 2 * len(gap), audit + "I" * len(gap)
            ls, rs = lines + [f"{r}:" for r in gap], roles + "".join(r[0] for r in gap)
            if i == len(rows):
                if GRAMMAR.fullmatch(rs) and (found is None or (c, a) < found[:2]):
                    found = (c, a, ls)
                continue
            role, text, fault = rows[i]
            go(i + 1, c + 3, a + "D", ls, rs)
            if fault in ("blank", "duplicate"):
                continue
            c += fault == "truncated"
            go(i + 1, c, a + "K", [*ls, f"{role}:{text}"], rs + role[:1] if role else rs + "?")
            for new in ("user", "assistant"):
                go(i + 1, c + 2, a + "R", [*ls, f"{new}:{text}"], rs + new[0])

    go(0, 0, "", [], "")
    return found


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        fault = None
        if not body:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif body[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(turns, rows):
    """The digest row of a damaged conversation in order."""
    marked = faults(rows)
    cost, audit, lines = cheapest(marked)
    known = [t for t in turns if t is not None]
    pairs = zip(rows, rows[1:], strict=False)
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        *(sum(f == kind for *_, f in marked) for kind in ("blank", "duplicate", "truncated")),
        sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def damage(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def columns(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in df.select(*names).collect()}


def test_query_equals_search_over_all_edit_sequences(spark):
    rng = random.Random(3)
    convs = {}
    for conv in [*range(150), None]:
        n = rng.randint(1, 5)
        rows = [
            (turn, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["a.", "b", " ", "", "c! ", None, "é?", "ok"]))
            for turn in rng.sample(range(9), n)
        ]
        if rng.random() < 0.2:
            rows.append((None, "user", "first."))
        convs[conv] = rows
    rows = [(c, *r, "more") for c, rs in convs.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy string").repartition(3)
    got = columns(damaged_and_repaired(df))
    assert got.keys() == convs.keys()
    for conv, rs in convs.items():
        kept = damage(conv, rs)
        assert got[conv] == expected([r[0] for r in kept], [r[1:] for r in kept]), (conv, kept)


def letters(rows, rules=None):
    search, out = Search(Machine(rules or Rules())), []
    held = peak = 0
    for role, text, fault in rows:
        final = search.feed((role.encode(), text.encode()), role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        out += [n.letters for n in final]
        held += 1 - len(final)
        peak = max(peak, held)
    cost, rest = search.end()
    return cost, "".join(out + [n.letters for n in rest]), peak


def test_all_short_conversations_by_exhaustion():
    kinds = [("user", "x.", None), ("assistant", "x.", None), ("system", "x.", None), ("tool", "x", "truncated"), ("user", "", "blank")]
    for n in range(4):
        for rows in product(kinds, repeat=n):
            assert letters(rows)[:2] == cheapest(list(rows))[:2], rows


def test_ties_that_stay_open_for_long():
    # deleted rows leave all survivors apart: the whole stretch is unresolved
    stretch = [("user", "", "blank")] * 7
    for first, last in product([("user", "x.", None), ("assistant", "x.", None)], repeat=2):
        rows = [first, *stretch[:3], last, *stretch[:2]]
        assert letters(rows)[:2] == cheapest(rows)[:2]
    cost, audit, _ = letters([("user", "x.", None), *stretch * 3000, ("assistant", "x.", None)])
    assert (cost, audit) == (63000, "K" + "D" * 21000 + "K")


def test_unresolved_part_stays_small_in_a_long_conversation():
    rng = random.Random(1)
    rows = [(rng.choice(["user", "assistant"]), "x.", rng.choice([None, None, "truncated", "blank"])) for _ in range(20000)]
    cost, audit, peak = letters(rows)
    assert sum(x != "I" for x in audit) == 20000 and peak < 40


def test_repaired_rows_and_edge_cases(spark):
    schema = "conv_id string, turn int, role string, text string, gaps string"
    rows = [("a", 0, "user", "hi.", "g"), ("a", 0, "user", "hi.", "g"), ("a", 2, "system", "Yes", "g"), ("b", None, None, None, "g")]
    found = repair(spark.createDataFrame(rows, schema))
    out = [tuple(r) for r in found.where("conv_id = 'a'").select("edit", "role", "text", "gaps", "duplicate", "truncated", "cost").collect()]
    assert out == [
        ("K", "user", "hi.", None, None, None, None),
        ("D", None, None, None, None, None, None),
        ("R", "assistant", "Yes", None, None, None, None),
        (None, None, None, 1, 1, 1, 6),
    ]
    assert columns(repair_digests(found))["b"] == (0, 1, 0, 0, 0, 3, "D", hashlib.sha256().hexdigest())
    empty = spark.createDataFrame([], schema)
    assert repair_digests(repair(empty)).count() == 0 and damaged_and_repaired(empty).count() == 0


def test_rules_must_give_equal_letters_one_meaning():
    with pytest.raises(ValueError):
        Machine(Rules(moves={0: {"u": 0, "a": 0}}, accepting=(0,)))


def test_long_texts_and_a_hot_conversation(spark):
    long = "wörd " * 200_000 + "end."
    df = spark.range(20_000, numPartitions=8).selectExpr(
        "if(id % 3 = 0, 7, id) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "if(id % 5 = 0, 'same.', concat('t', id, '.')) text"
    )
    df = df.union(spark.createDataFrame([(-5, 0, "user", long), (-5, 1, "assistant", long)], df.schema))
    got = repair_digests(repair(df)).where("conv_id in (7, -5)").collect()
    by = {r["conv_id"]: r for r in got}
    assert by[-5]["audit"] == "KK" and by[-5]["cost"] == 0
    rows = [("user" if i % 2 == 0 else "assistant", "same." if i % 5 == 0 else f"t{i}.") for i in range(20_000) if i % 3 == 0 or i == 7]
    cost, audit, _ = letters(faults(rows))
    assert (by[7]["cost"], by[7]["audit"]) == (cost, audit)
    assert by[7]["duplicate"] == sum(f == "duplicate" for *_, f in faults(rows))
