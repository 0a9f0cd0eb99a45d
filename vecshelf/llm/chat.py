"""Chat formatting by a finite-state machine over roles.

A template declares, for each role, which roles may come before it, what is
written before and after its text, and whether its text counts for the loss.
The machine walks the turns of a conversation and emits segments: what the
template writes and what the speaker said, each with a loss flag. Inside texts
the template's control strings and the escape character are escaped, so the
turns can be read back from the formatted text alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecshelf.session import written

START = ""


@dataclass(frozen=True)
class Turn:
    """How a role is written, and after which roles it may speak (START: at the beginning)."""

    role: str
    before: str
    after: str
    loss: bool
    follows: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    turns: tuple[Turn, ...]
    #: A role without an entry: its name is written between these two, escaped, then its text.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "</s>")
    escape: str = "\\"

    def controls(self) -> list[str]:
        """Everything that must not stand in a text as it is, longest first."""
        found = {self.escape, *self.other, *(x for t in self.turns for x in (t.before, t.after))}
        return sorted(found - {""}, key=lambda x: (-len(x), x))


DEFAULT = Template(
    (
        Turn("system", "<<SYS>>", "<</SYS>>", False, (START,)),
        Turn("user", "[INST]", "[/INST]", False, (START, "system", "assistant")),
        Turn("assistant", "<s>", "</s>", True, ("user",)),
    )
)


class Machine:
    """Writes and reads conversations of one template."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.of = {t.role: t for t in template.turns}
        # what a control string begins with: escaped everywhere, so none can begin inside a text
        self.opening = re.compile("[" + "".join(re.escape(c) for c in sorted({x[0] for x in template.controls()})) + "]")
        quoted = re.escape(template.escape)
        # in the output: an escaped character, or a marker
        self.token = re.compile(quoted + "(.)|(" + "|".join(re.escape(x) for x in template.controls() if x != template.escape) + ")", re.DOTALL)

    def escaped(self, text: str) -> str:
        """The escape before each character that a control string begins with,
        so none is left in the text and none can arise where it meets a marker."""
        return self.opening.sub(lambda m: self.template.escape + m[0], text)

    def allowed(self, state: str | None, role: str | None) -> bool:
        turn = self.of.get(role) if role is not None else None
        return turn is not None and state in turn.follows

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """(written text, loss) of one turn; a NULL role is an unknown one with no name."""
        said, turn = self.escaped(text or ""), self.of.get(role or "")
        if turn:
            return [(turn.before, False), (said, turn.loss), (turn.after, False)]
        a, b, end = self.template.other
        return [(a, False), (self.escaped(role or ""), False), (b, False), (said, False), (end, False)]

    def unescaped(self, text: str) -> str:
        return self.token.sub(lambda m: m[1] if m[1] is not None else m[0], text)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn, read from the formatted text alone."""
        found, at, parts, expect, role = [], 0, [], None, None
        begins = {t.before: t for t in self.template.turns}
        for m in self.token.finditer(formatted):
            parts.append(formatted[at : m.start()])
            at = m.end()
            if m[1] is not None:
                parts.append(m[1])
                continue
            if expect is None:
                if m[2] in begins:
                    role, expect = begins[m[2]].role, begins[m[2]].after
                elif m[2] == self.template.other[0]:
                    role, expect = None, self.template.other[1]
                else:
                    raise ValueError(f"no turn begins with {m[2]}")
            elif m[2] != expect:
                raise ValueError(f"{m[2]} instead of {expect}")
            elif role is None:
                role, expect = "".join(parts), self.template.other[2]
            else:
                found.append((role, "".join(parts)))
                expect = None
            parts = []
        if expect is not None or "".join(parts) or at != len(formatted):
            raise ValueError("the text ends inside a turn")
        return found


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
    """(first of its conversation, row) of rows sorted by conversation."""
    last = object()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[0] != last, list(row)
            last = row[0]


_ROWS = 4096


def _format(template: Template, kind: pa.DataType):
    schema = pa.schema([("key", kind), ("turn_no", pa.int64()), ("part", pa.int32()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(template)
        out: list[tuple] = []
        state, valid, number = START, True, 0
        for fresh, (key, _, role, text) in _runs(batches):
            if fresh:
                state, valid, number = START, True, 0
            valid = valid and machine.allowed(state, role)
            state = role
            out += [(key, number, i, s, loss, valid) for i, (s, loss) in enumerate(machine.segments(role, text))]
            number += 1
            if len(out) >= _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def format_conversations(
    rows: DataFrame, template: Template = DEFAULT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(key, turn_no, part, segment, loss, valid): the segments of each conversation.

    ``valid`` is true up to the first turn that the machine doesn't allow;
    such conversations are written all the same, unknown and NULL roles under
    their name. Turns go by ``turn`` (NULL first), equal ones by role and
    text, so repeated rows are turns of their own. NULL texts are empty, and
    all rows with a NULL key are one conversation. Rows are read as a stream
    in sort order: a conversation of any length needs memory for one turn.
    """
    kind = rows.schema[key].dataType
    dealt = (
        rows.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
        .repartition(F.col("key"))
        .sortWithinPartitions("key", "turn", "role", "text")
    )
    arrow = to_arrow_type(kind)
    out = f"key {kind.simpleString()}, turn_no long, part int, segment string, loss boolean, valid boolean"
    return dealt.mapInArrow(_format(template, arrow), out).withColumnRenamed("key", key)


def _read(template: Template, kind: pa.DataType):
    schema = pa.schema(
        [("key", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, done, at = Machine(template), [], None

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

        def close() -> None:
            n, turns, chars, loss, total, valid, key, held = at
            turn(held, turns)
            done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total, valid))

        def turn(held: list[str], turns) -> None:
            # the turn as it stands in the output, markers and all
            for role, text in machine.turns("".join(held)):
                turns.update(f"{role}\n{text}\n".encode())

        number = None
        for fresh, (key, turn_no, _, segment, loss, valid) in _runs(batches):
            if fresh:
                if at:
                    close()
                    if len(done) >= _ROWS:
                        yield batch_of()
                        done.clear()
                at, number = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, key, []], None
            if turn_no != number:
                turn(at[7], at[1])
                at[7], number = [], turn_no
                at[0] += 1
            at[7].append(segment)
            at[4] += len(segment)
            at[5] = valid
            if loss:
                plain = machine.unescaped(segment)
                at[2] += len(plain)
                at[3].update(plain.encode())
        if at:
            close()
        if done:
            yield batch_of()

    return run


def digest_conversations(segments: DataFrame, template: Template = DEFAULT, key: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back, turn by turn, and sums them up."""
    kind = segments.schema[key].dataType.simpleString()
    arrow = to_arrow_type(segments.schema[key].dataType)
    dealt = segments.select(F.col(key).alias("key"), "turn_no", "part", "segment", "loss", "valid").repartition(F.col("key")).sortWithinPartitions("key", "turn_no", "part")
    out = f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return dealt.mapInArrow(_read(template, arrow), out).withColumnRenamed("key", key)


def chat_digests(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Formats conversations into a table in the shared folder and reads it back."""
    return digest_conversations(written(format_conversations(rows, template), "chat"), template)
