"""Repair of conversation structure by a cheapest edit sequence.

The roles of a repaired conversation follow a small automaton. A row is kept,
given another role, or deleted, and empty rows are inserted; a Viterbi search
keeps, for each state of the automaton, the survivor: the cheapest edits that
lead there, of equal costs those whose letters come first in ASCII order.

A survivor is given up as soon as another one could follow whatever it does for
less. The others share a tree of back-pointers with reference counts. What no survivor
refers to is freed. As soon as all survivors descend from one node, the edits
up to it are final: they are handed on with their rows, and the tree's root
moves there. So a conversation is read once, in order, and a task holds only
its unresolved rows. Ties compare the complete unresolved letters of both
survivors; their order is carried from row to row as ranks, so that a tie costs
one step however long the unresolved part is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as to_arrow

from vecshelf.llm.common import raw
from vecshelf.session import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Characters a complete row ends in.
ENDS = b".!?"
#: Rows and bytes of a batch that is handed on.
ROWS, BYTES = 4096, 4 << 20


class Rules(NamedTuple):
    """States are the keys of ``moves``: state -> {role initial: next state}.
    The defaults accept ``(s?(ua)+)?``."""

    moves: dict = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    start: int = 0
    accepting: tuple = (0, 3)
    roles: tuple = ("user", "assistant")
    follow: tuple = ("su", "ua", "au")
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


class Step(NamedTuple):
    """A way from a state over one row: its letters, and the role that each
    letter's row gets (None: its own, or none)."""

    cost: int
    letters: str
    roles: tuple
    to: int


class Machine:
    """All steps over a row, by its role's initial and whether it must go."""

    def __init__(self, rules: Rules) -> None:
        for q, moves in rules.moves.items():
            if sum(r[0] in moves for r in rules.roles) > 1:
                # else equal letters could mean different edits
                raise ValueError(f"state {q} can go on with more than one of {rules.roles}")
        self.rules, self._known = rules, {}
        self._inserts = {q: self._inserted(q) for q in rules.moves}
        self.lead = self._leads()

    def _inserted(self, q: int) -> list[tuple[int, tuple]]:
        """(state, roles) after no, one, two... inserted rows, no state twice."""
        found, roles, seen = [], (), set()
        while q not in seen:
            found.append((q, roles))
            seen.add(q)
            role = next((r for r in self.rules.roles if r[0] in self.rules.moves[q]), None)
            if role is None:
                break
            q, roles = self.rules.moves[q][role[0]], (*roles, role)
        return found

    def steps(self, initial: str, must_go: bool, truncated: bool) -> dict[int, list[Step]]:
        key = (initial, must_go, truncated)
        if key not in self._known:
            if len(self._known) > 10_000:
                self._known.clear()
            self._known[key] = {q: list(self._from(q, *key)) for q in self.rules.moves}
        return self._known[key]

    def _from(self, q: int, initial: str, must_go: bool, truncated: bool) -> Iterator[Step]:
        rules, more = self.rules, self.rules.truncated * truncated
        for at, roles in self._inserts[q]:
            cost, letters, moves = rules.insert * len(roles), INSERT * len(roles), rules.moves[at]
            yield Step(cost + rules.delete, letters + DELETE, (*roles, None), at)
            if must_go:
                continue
            if initial in moves:
                yield Step(cost + more, letters + KEEP, (*roles, None), moves[initial])
            for role in rules.roles:
                if role[0] in moves:
                    yield Step(cost + more + rules.rerole, letters + REROLE, (*roles, role), moves[role[0]])

    def _leads(self) -> dict[tuple[int, int], int]:
        """(p, q) -> c: whatever follows, going on from p costs at most c more
        than going on from q. So a survivor of q that costs over c more than
        that of p can neither win nor tie. Each way on from q, over any kind of
        row, has an answer from p; c is what the worst sequence of them costs."""
        states, initials = list(self.rules.moves), {r for moves in self.rules.moves.values() for r in moves} | {""}
        kinds = [self.steps(r, *flags) for r in initials for flags in ((False, False), (False, True), (True, False))]
        end = {q: min((s.cost for s in self.endings(q)), default=None) for q in states}
        lead = {(p, q): max(0, end[p] - end[q]) for p in states for q in states if None not in (end[p], end[q])}
        for _ in range(100):
            more = {
                (p, q): max(
                    [c] + [min(a.cost + lead.get((a.to, s.to), 1 << 40) for a in kind[p]) - s.cost for kind in kinds for s in kind[q]]
                )
                for (p, q), c in lead.items()
            }
            if more == lead:
                return lead
            lead = more
        return {}

    def endings(self, q: int) -> Iterator[Step]:
        for at, roles in self._inserts[q]:
            if at in self.rules.accepting:
                yield Step(self.rules.insert * len(roles), INSERT * len(roles), roles, at)


class Node:
    """The edits at one row, the row itself, and the node before."""

    __slots__ = ("letters", "roles", "row", "before", "refs")

    def __init__(self, letters: str, roles: tuple, row, before: Node | None) -> None:
        self.letters, self.roles, self.row, self.before, self.refs = letters, roles, row, before, 0
        if before is not None:
            before.refs += 1


class Search:
    """The search over one conversation. ``feed`` takes its rows in order and
    returns the nodes that have become final; ``end`` returns the rest."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.root = Node("", (), None, None)
        self.root.refs = 1
        #: state -> (cost, rank of its letters among the survivors, node)
        self.best = {machine.rules.start: (0, 0, self.root)}

    def feed(self, row, initial: str, must_go: bool, truncated: bool) -> list[Node]:
        steps, chosen = self.machine.steps(initial, must_go, truncated), {}
        for q, (cost, rank, node) in self.best.items():
            for step in steps[q]:
                # letters of different survivors: their rank decides; of the same one, the new letters
                key = (cost + step.cost, rank, step.letters)
                held = chosen.get(step.to)
                if held is None or key < held[0]:
                    chosen[step.to] = (key, step, node)
        lead = self.machine.lead
        hopeless = {q for q in chosen for p in chosen if chosen[p][0][0] + lead.get((p, q), 1 << 40) < chosen[q][0][0]}
        order = sorted(chosen.keys() - hopeless, key=lambda q: chosen[q][0][1:])
        old, self.best = self.best, {}
        for rank, q in enumerate(order):
            key, step, node = chosen[q]
            tip = Node(step.letters, step.roles, row, node)
            tip.refs = 1
            self.best[q] = (key[0], rank, tip)
        for _, _, node in old.values():
            self._release(node)
        return self._settled()

    def _release(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            before, node.before = node.before, None
            before.refs -= 1
            node = before

    def _settled(self) -> list[Node]:
        if self.root.refs > 1:
            return []
        tips = {id(node) for _, _, node in self.best.values()}
        chain, node = [], next(iter(self.best.values()))[2]
        while node is not self.root:
            chain.append(node)
            node = node.before
        final = []
        while chain and self.root.refs == 1 and id(self.root) not in tips:
            self.root = chain.pop()
            self.root.before = None
            final.append(self.root)
        return final

    def end(self) -> tuple[int, list[Node]]:
        """(cost, last nodes): the cheapest survivor that can end, with inserted rows if need be."""
        ways = [
            ((cost + step.cost, rank, step.letters), step, node)
            for q, (cost, rank, node) in self.best.items()
            for step in self.machine.endings(q)
        ]
        key, step, node = min(ways, key=lambda way: way[0])
        chain = [Node(step.letters, step.roles, None, None)]
        while node is not self.root:
            chain.append(node)
            node = node.before
        return key[0], chain[::-1]


class _Out:
    """Rows of the result, in batches of bounded size."""

    SCHEMA = (
        "conv_id {key}, edit string, role string, text string, gaps long, blank long, duplicate long, "
        "truncated long, illegal long, cost long"
    )

    def __init__(self, key: pa.DataType) -> None:
        types = [key, pa.string(), pa.binary(), pa.binary()] + [pa.int64()] * 6
        names = ["conv_id", "edit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        self.schema = pa.schema(list(zip(names, types, strict=True)))
        self.rows, self.bytes = [], 0

    def edits(self, conv, nodes: list[Node]) -> None:
        for node in nodes:
            for letter, role in zip(node.letters, node.roles, strict=True):
                own, text = node.row if letter in (KEEP, REROLE) else (None, b"" if letter == INSERT else None)
                self.rows.append((conv, letter, role.encode() if role else own, text) + (None,) * 6)
                self.bytes += len(text or b"")

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least or self.bytes > BYTES:
            if self.rows:
                columns = list(zip(*self.rows, strict=True))
                arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
                arrays = [a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays]
                yield pa.RecordBatch.from_arrays(arrays, self.schema.names)
            self.rows, self.bytes = [], 0


def _repair(rules: Rules, key: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out = Machine(rules), _Out(key)
        search = conv = None
        repeated = False

        def close() -> None:
            cost, nodes = search.end()
            out.edits(conv, nodes)
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            out.rows.append((conv, None, None, None, gaps, *counts, cost))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2)]
            marks, roles, texts = batch.column(2).to_pylist(), raw(batch.column(3)), raw(batch.column(4))
            for now, turn, mark, role, text in zip(*columns, marks, roles, texts, strict=True):
                if search is None or now != conv:
                    if search is not None:
                        close()
                    search, conv, before = Search(machine), now, None
                    counts, turns = [0, 0, 0, 0], [0, 0, 0]
                if mark:
                    repeated = True
                    continue
                body = text.strip()
                blank, again, repeated = not body, repeated, False
                broken = not (blank or again) and body[-1:] not in ENDS
                initial = role.decode()[:1]
                counts[0] += blank
                counts[1] += again and not blank
                counts[2] += broken
                counts[3] += before is not None and before + initial not in rules.follow
                before = initial
                if turn is not None:
                    if not turns[2] or turn != turns[1]:
                        turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
                out.edits(conv, search.feed((role, text), initial, blank or again, broken))
                yield from out.batches(ROWS)
        if search is not None:
            close()
            yield from out.batches()

    return run


def repair(rows: DataFrame, rules: Rules | None = None, order: list[str] | None = None) -> DataFrame:
    """The repaired conversations of ``rows(conv_id, turn, role, text)``.

    One row for each edit, in order: ``edit`` (K, R, D or I), and the ``role``
    and ``text`` of the repaired row (NULL for deleted ones). After the edits
    of a conversation follows one row with a NULL ``edit``, its counts
    (``gaps blank duplicate truncated illegal``) and the ``cost``. A
    conversation's rows stand in one partition, one after the other, so a
    further pass over partitions can go on from there without a shuffle.

    Rows go by turn, NULLs first; rows of one turn by the columns ``order``
    names (or role and text). NULL roles and texts are one space. A NULL
    ``conv_id`` is a conversation like others. Repeated rows are duplicates of
    the first. A role that is empty or begins with an unknown letter can be
    replaced or deleted, not kept. No rows: no conversation.

    Of a repeated (role, text) of a conversation the rows after the first are
    found by a grouping on its hash, so a text that is repeated without end
    meets nowhere; the marks travel into the sort just before their rows. The
    rows of one conversation are read in one task, as a stream.
    """
    tie = order or ["role", "text"]
    by = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)]
    full = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        *by,
        F.monotonically_increasing_id().alias("_row"),
    )
    full = written(full, "rows")
    at = ["turn", *(f"_tie{i}" for i in range(len(tie))), "_row"]
    said = F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull().cast("string"), "role", "text")
    narrow = full.select("conv_id", *at, F.sha2(said, 256).alias("_said"))
    first = narrow.groupBy("_said").agg(F.min(F.struct(*at)).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    marks = narrow.join(first, "_said").where(F.col("_first._row") != F.col("_row"))
    marks = marks.select("conv_id", *at, F.lit(True).alias("mark"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = marks.unionByName(full.select("conv_id", *at, F.lit(False).alias("mark"), "role", "text"))
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["conv_id", *at, F.desc("mark")]
    dealt = both.repartition(parts, "conv_id").sortWithinPartitions(*sort).select("conv_id", "turn", "mark", "role", "text")
    key = rows.schema["conv_id"].dataType
    return dealt.mapInArrow(_repair(rules or Rules(), to_arrow(key)), _Out.SCHEMA.format(key=key.simpleString()))


def _digest(key: pa.DataType):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, some = [], hashlib.sha256(), False
        for batch in batches:
            found = []
            keys, edits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            roles, texts = raw(batch.column(2)), raw(batch.column(3))
            counts = zip(*(batch.column(i).to_pylist() for i in range(4, 10)), strict=True)
            for conv, edit, role, text, numbers in zip(keys, edits, roles, texts, counts, strict=True):
                if edit is None:
                    found.append((conv, *numbers, "".join(audit), sha.hexdigest()))
                    audit, sha, some = [], hashlib.sha256(), False
                    continue
                audit.append(edit)
                if edit != DELETE:
                    sha.update((b"\n" if some else b"") + role + b":")
                    sha.update(text)
                    some = True
            if found:
                types = [key] + [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return run


def repair_digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: its counts and cost, the
    edits' letters, and the SHA-256 of the repaired ``role:text`` lines."""
    key = repaired.schema["conv_id"].dataType
    schema = (
        f"conv_id {key.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string"
    )
    return repaired.mapInArrow(_digest(to_arrow(key)), schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    sets its role to user. NULLs are one space. ``was_role``, ``was_text`` (a
    hash) and ``copy`` order the rows of one turn as they were."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS.decode(), "")).otherwise(F.col("text")).alias("text"),
        F.col("role").alias("was_role"),
        F.sha2("text", 256).alias("was_text"),
        F.explode(copies).alias("copy"),
    )


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """Digests of every conversation of ``rows`` after planted faults; those
    without a row left have zeros, no edits and the hash of nothing."""
    found = repair_digests(repair(damaged(rows), order=["was_role", "was_text", "copy"]))
    ids = rows.select(F.col("conv_id").alias("_id")).distinct()
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = zero | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    joined = ids.join(found, F.col("_id").eqNullSafe(found["conv_id"]), "left")
    return joined.select(F.col("_id").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(v).cast(found.schema[c].dataType)).alias(c) for c, v in empty.items()))
