"""Language-model scores by logistic context mixing.

A token (a word, or the end of a text) is coded as its bytes and an end mark,
each symbol as eight binary decisions. Several predictors give each decision a
probability from counts under a hashed context: the symbols before it in the
word, of several lengths, and the place in the word. Their logits are mixed
with weights that a gate selects (how much two of the contexts have seen, and
where in the word), and the mixed probability is refined by a map that adapts
to what came of it. The sum of the decisions' logarithms is a token's log
probability, and their total over a text gives its bits per byte.

The weights are learned online: a task goes through the training tokens of its
share once, predicts, and takes an online Newton step in each gate; what the
tasks have learned is averaged by how sure each is. A second round begins there
and keeps the map's counts as it goes. Counts, weights and map cover every
training token, each predicted from counts that it is taken out of.

A text has a class, its language say, that isn't known when it is scored. What
is learned of a class are its tokens' counts, with the mixing model for what it
hasn't seen (Witten and Bell's weight): ``(c + V * p) / (N + V)``. A text is
scored by the mixture over all classes. Apart from a factor of its own, a class
differs from the model only by the tokens it has seen, so sums of those few
terms are all a text needs, whatever the number of classes.

Contexts of 64 bits of hash are counted exactly, at any size of the vocabulary:
the distinct words are cut into sorted ranges, so the words with the same
beginning lie in one range, except for the few beginnings that a cut goes
through; shorter contexts are counted by Spark and each range is sent those
that it has. A token's probability depends on the token alone, so each
distinct word is scored once and the texts look their words up: frequent ones
in a bounded table that is broadcast, the others by a join.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshelf.llm.common import raw
from vecshelf.session import written

WHOLE = 99
#: Length of each predictor's context (0: the place in the word only, WHOLE: all of the word so far).
LENGTHS = (0, 1, 2, 3, 4, WHOLE)
LONGEST = max(n for n in LENGTHS if n != WHOLE)
#: The two contexts whose counts select the gate.
GATED = (3, WHOLE)
#: Decisions computed on at a time, and distinct words counted before a task sends them on.
SLICE, FLUSH = 1 << 16, 300_000
#: How often all training tokens are learned from, and how many decisions the
#: weights' and map's first state counts for.
ROUNDS, FIRST_WEIGHT, FIRST = 2, 50.0, 0.25
#: Most frequent words sent to all tasks, and the longest such word in bytes.
HEAD, HEAD_BYTES = 100_000, 64
#: Texts whose words are looked up at a time.
TEXTS = 256
#: Words of one sorted range, and symbols, about; a longer word is a range of its own.
WORDS_A_TASK, SYMBOLS_A_TASK = 50_000, 1 << 19
#: Symbols whose contexts a task adds up before it sends them on.
GATHERED = 1 << 21
MARK = 0x20
#: Gate: how many tokens the two contexts have seen (by these limits), and the place in the word.
SEEN, PLACES = np.array([1.5, 7.5, 31.5, 255.5], np.float32), 4
GATES, STEPS = (len(SEEN) + 1) ** 2 * PLACES, 33
END = b""

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_C, _D = np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def stream(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words as symbols, a mark before and after each, and where each begins."""
    mark = bytes([MARK])
    flat = np.frombuffer(b"".join(mark + w + mark for w in words), np.uint8)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return flat, np.cumsum(sizes) - sizes


def _prefixes(symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the word so far at each symbol, that symbol excluded: the sum
    of the symbols' hashes by place."""
    power = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _A
    power ^= power >> np.uint64(29)
    terms = (symbols.astype(np.uint64) + np.uint64(1)) * power * _D
    before = np.cumsum(terms) - terms
    h = before - before[np.maximum.accumulate(np.where(place == 0, np.arange(len(place)), 0))]
    h ^= h >> np.uint64(32)
    return h * _A


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -16, 16)))


@dataclass
class Mixer:
    weights: np.ndarray  # gate, predictor
    refined: np.ndarray  # gate, step of the mixed logit

    @staticmethod
    def first() -> Mixer:
        curve = squash(np.linspace(-12, 12, STEPS))
        return Mixer(np.full((GATES, len(LENGTHS)), FIRST), np.tile(curve, (GATES, 1)))

    @staticmethod
    def gate(seen: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        return (seen[0].astype(np.int64) * (len(SEEN) + 1) + seen[1]) * PLACES + np.minimum(place, PLACES) - 1

    @staticmethod
    def step(logit: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(logit, -12, 12) + 12) * (STEPS - 1) / 24).astype(np.int64)

    def final(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The probability of a one: half the mixed one, half the refined one."""
        p = (squash(logit) + self.refined[gate, self.step(logit)]) / 2
        return np.clip(p, 1e-6, 1 - 1e-6)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, class, tokens), added up for many texts at a time; no class: not learned from."""
    counters: dict[str | None, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for group, counter in counters.items():
            same = pa.array([group], pa.string()).take(pa.array(np.zeros(len(counter), np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), same, pa.array(counter.values(), pa.int64())], ["word", "group", "n"])

    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            words = (text or b"").lower().split()
            words.append(END)
            counters.setdefault(group, Counter()).update(words)
            if sum(map(len, counters.values())) >= FLUSH:
                yield from out()
                counters.clear()
    yield from out()


def outcomes(context: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(row, 9) from counts of symbols under contexts, in order of context and
    symbol: for each bit of the symbol how often it came out the other way
    after the same earlier bits, and how often the symbol came."""
    if not len(context):
        return np.zeros((0, 9), np.float32)
    fresh = np.r_[True, context[1:] != context[:-1]]
    key = (np.cumsum(fresh) << 8) | symbol
    out = np.empty((len(key), 9), np.float32)
    above = None
    for b in range(9):
        node = key >> (8 - b)
        first = np.r_[True, node[1:] != node[:-1]]
        total = np.add.reduceat(counts, np.flatnonzero(first))[np.cumsum(first) - 1]
        if b:
            out[:, b - 1] = above - total
        above = total
    out[:, 8] = above
    return out


@dataclass
class Steps:
    """The distinct steps (beginning, next symbol) of some words."""

    of: np.ndarray  # step of each symbol of the words
    word: np.ndarray  # word of each symbol
    key: np.ndarray  # hash of beginning and symbol
    whole: np.ndarray  # hash of the beginning
    place: np.ndarray
    symbol: np.ndarray
    last: np.ndarray  # the last four symbols of the beginning, as one number
    counts: np.ndarray  # training tokens with the step

    @staticmethod
    def taken(words: list[bytes], weights: np.ndarray) -> Steps:
        flat, starts = stream(words)
        word = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(flat))))
        place = np.arange(len(flat)) - starts[word]
        whole = _prefixes(flat, place)
        last = np.zeros(len(flat), np.int64)
        for i in range(1, LONGEST + 1):
            before = np.zeros(len(flat), np.int64)
            before[i:] = flat[:-i]
            last |= np.where(place >= i, before, 0) << (8 * (i - 1))
        own = place > 0
        word, place, whole, last, symbol = word[own], place[own], whole[own], last[own], flat[own].astype(np.int64)
        key = (whole + (symbol.astype(np.uint64) + np.uint64(1)) * _D) * _C
        key, first, of = np.unique(key, return_index=True, return_inverse=True)
        counts = np.bincount(of, weights[word], len(key))
        return Steps(of, word, key, whole[first], place[first], symbol[first], last[first], counts)


def _short(steps: Steps) -> np.ndarray:
    return (np.minimum(steps.place, 7) << 8) | steps.symbol


_LAST, _PLACE, _SHARED = range(3)


def _gathered(shared):
    """Counts of the contexts that reach beyond a range of words: by the last
    symbols, by place, and by the beginnings that a cut goes through."""
    def out(p: int, words: list[bytes], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        steps = Steps.taken(words, np.concatenate(weights))
        cut = np.isin(steps.whole, shared.value)
        every = np.ones(len(cut), bool)
        for kind, context, rows in ((_LAST, steps.last, every), (_PLACE, np.minimum(steps.place, 7), every), (_SHARED, steps.whole.view(np.int64), cut)):
            context, symbol, counts = context[rows], steps.symbol[rows], steps.counts[rows]
            if not len(context):
                continue
            order = np.lexsort((symbol, context))
            context, symbol, counts = context[order], symbol[order], counts[order]
            first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])])
            sums = np.add.reduceat(counts, first).astype(np.int64)
            fixed = [pa.array(np.full(len(first), p, np.int64)), pa.array(np.full(len(first), kind, np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(context[first]), pa.array(symbol[first]), pa.array(sums)], ["p", "kind", "context", "symbol", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words, weights, held = None, [], [], 0
        for batch in batches:
            ranges = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if words and (ranges[a] != number or held > GATHERED):
                    yield from out(number, words, weights)
                    words, weights, held = [], [], 0
                number = int(ranges[a])
                part = batch.slice(a, b - a)
                fresh = part.column(1).to_pylist()
                words += fresh
                weights.append(part.column(2).to_numpy())
                held += sum(map(len, fresh)) + 2 * len(fresh)
        if words:
            yield from out(number, words, weights)

    return run


def _told(rows: DataFrame) -> DataFrame:
    """(context, symbol, outcomes) from (context, symbol, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = np.column_stack([c.to_numpy() for c in batch.columns])
            table = table if held is None else np.concatenate([held, table])
            # the last context may go on in the next batch; it has 256 rows at most
            done = int(np.searchsorted(table[:, 0], table[-1, 0])) if len(table) else 0
            held = table[done:]
            yield out(table[:done])
        if held is not None:
            yield out(held)

    def out(table: np.ndarray) -> pa.RecordBatch:
        found = outcomes(table[:, 0], table[:, 1], table[:, 2])
        blobs = pa.array([row.tobytes() for row in found], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), blobs], ["context", "symbol", "t"])

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select("context", "symbol", "c").repartition(parts, "context")
    return ordered.sortWithinPartitions("context", "symbol").mapInArrow(run, "context long, symbol long, t binary")


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and symbols in order, and their outcomes."""
    table = rows.select("context", "symbol", "c").orderBy("context", "symbol").toArrow()
    context, symbol, counts = (c.to_numpy() for c in table.columns)
    return context, symbol, outcomes(context, symbol, counts)


def _cuts(ranges: DataFrame) -> np.ndarray:
    """Hashes of the beginnings that words on both sides of a cut have."""
    ends = ranges.groupBy("p").agg(F.min("word").alias("a"), F.max("word").alias("b")).orderBy("p").collect()
    found = [np.zeros(0, np.uint64)]
    for left, right in zip(ends, ends[1:]):
        x, y = bytes(left["b"]), bytes(right["a"])
        same = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
        flat, _ = stream([x[:same]])
        found.append(_prefixes(flat, np.arange(len(flat)))[1:])
    return np.unique(np.concatenate(found))


class Online:
    """What a task has learned so far: weights, how sure each gate is of them
    (the curvature of the loss it has seen), and what came of mixed logits."""

    def __init__(self, weights: np.ndarray) -> None:
        size = len(LENGTHS)
        self.weights = weights.copy()
        self.curve = np.tile(FIRST_WEIGHT * np.eye(size), (GATES, 1, 1))
        self.coded, self.ones = np.zeros((2, GATES * STEPS))

    def learn(self, u: np.ndarray, gate: np.ndarray, often: np.ndarray, ones: np.ndarray) -> None:
        """A slice of decisions: predict, note what came of it, and step.
        ``u`` are logits of the side taken (predictor, decision)."""
        order = np.argsort(gate.astype(np.int16), kind="stable")  # so few bits are sorted by radix
        gate, often, ones = gate[order], often[order], ones[order]
        u, z = u[:, order].astype(np.float64), np.empty(len(gate))
        ends = np.r_[0, np.flatnonzero(np.diff(gate)) + 1, len(gate)]
        for a, b in zip(ends, ends[1:]):
            g, v = gate[a], u[:, a:b]
            z[a:b] = self.weights[g] @ v
            p = squash(z[a:b])
            missed = often[a:b] * (1 - p)
            self.curve[g] += (v * (missed * p)) @ v.T
            self.weights[g] += np.linalg.solve(self.curve[g], v @ missed)
        at = gate * STEPS + Mixer.step(np.where(ones, z, -z))
        self.coded += np.bincount(at, often, GATES * STEPS)
        self.ones += np.bincount(at, often * ones, GATES * STEPS)

    def packed(self) -> np.ndarray:
        pull = np.einsum("gij,gj->gi", self.curve, self.weights)
        return np.concatenate([self.curve.ravel(), pull.ravel(), self.coded, self.ones])

    @staticmethod
    def merged(total: np.ndarray) -> Mixer:
        """The tasks' weights, averaged by how sure they are, and the map."""
        size = len(LENGTHS)
        curve, pull, coded, ones = np.split(total, np.cumsum([GATES * size * size, GATES * size, GATES * STEPS]))
        weights = np.linalg.solve(curve.reshape(GATES, size, size), pull.reshape(GATES, size)[..., None])[..., 0]
        first = squash(np.linspace(-12, 12, STEPS))
        coded, ones = coded.reshape(GATES, STEPS), ones.reshape(GATES, STEPS)
        return Mixer(weights, (ones + FIRST_WEIGHT * first) / (coded + FIRST_WEIGHT))


class Exact:
    """The words of one range with all counts that their decisions need."""

    def __init__(self, packed: bytes, small: tuple):
        words, self.n, self.c, keys, last = pickle.loads(packed)
        self.words = words
        steps = self.steps = Steps.taken(words, self.c)
        order = np.lexsort((steps.symbol, steps.whole))
        whole = np.empty((len(order), 9), np.float32)
        whole[order] = outcomes(steps.whole[order], steps.symbol[order], steps.counts[order])
        (place_keys, by_place), (one_keys, by_one), (shared, shared_keys, by_shared) = small
        cut = np.flatnonzero(np.isin(steps.whole, shared))
        if len(cut):
            whole[cut] = by_shared[np.searchsorted(shared_keys, steps.key[cut])]
        at = np.searchsorted(keys, (steps.last << 8) | steps.symbol)
        one_at = np.searchsorted(one_keys, ((steps.last & 0xFF) << 8) | steps.symbol)
        place_at = np.searchsorted(place_keys, _short(steps))
        # table, and the row of each step in it
        self.tables = {0: (by_place, place_at), 1: (by_one, one_at), WHOLE: (whole, None)}
        self.tables |= {n: (last[:, 9 * i : 9 * i + 9], at) for i, n in enumerate((2, 3, 4))}

    @staticmethod
    def inputs(t: np.ndarray, left_out: bool, gated: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Logits of the side taken for rows of outcomes, eight decisions each;
        ``gated``: and how much their contexts have seen."""
        other = t[:, :8]
        # how often a bit came out as it does: the symbol's count and what parts from it later
        later = t[:, :8].copy()
        for b in range(6, -1, -1):
            later[:, b] += later[:, b + 1]
        same = t[:, 8:] + later - other
        if left_out:
            same = np.maximum(same - 1, 0)
        seen = None
        if gated:
            seen = sum(((same + other) > x).view(np.uint8) for x in SEEN)
        return np.log((same + np.float32(0.4)) / (other + np.float32(0.4))), seen

    def slices(self, left_out: bool) -> Iterator[tuple]:
        """(steps, ones, inputs of the side taken (predictor, decision), gates),
        eight decisions a step; ``left_out``: of the training tokens, each taken
        out of the counts."""
        steps = self.steps
        chosen = np.flatnonzero(steps.counts > 0) if left_out else np.arange(len(steps.key))
        size = max(1, SLICE // 8)
        # many steps read the same row of a table by last symbols or place, so that is worked out once
        shared = {n: self.inputs(t, left_out, n in GATED) for n, (t, at) in self.tables.items() if at is not None}
        for i in range(0, len(chosen), size):
            rows = chosen[i : i + size]
            u, seen = np.empty((len(LENGTHS), 8 * len(rows)), np.float32), []
            for k, length in enumerate(LENGTHS):
                table, at = self.tables[length]
                if at is None:
                    logits, often = self.inputs(table[rows], left_out, length in GATED)
                else:
                    logits, often = (x if x is None else x[at[rows]] for x in shared[length])
                u[k] = logits.ravel()
                if length in GATED:
                    seen.append(often.ravel())
            ones = ((steps.symbol[rows, None] >> np.arange(7, -1, -1)) & 1).ravel().astype(bool)
            yield rows, ones, u, Mixer.gate(seen, np.repeat(steps.place[rows], 8))

    def teach(self, online: Online) -> None:
        for rows, ones, u, gate in self.slices(True):
            online.learn(u, gate, np.repeat(self.steps.counts[rows], 8), ones)

    def step_logs(self, mixer: Mixer) -> np.ndarray:
        """log10 of the probability of each step's symbol after its beginning."""
        logs, weights = np.empty(len(self.steps.key)), mixer.weights.T.copy()
        for rows, ones, u, gate in self.slices(False):
            z = sum(w[gate] * x for w, x in zip(weights, u, strict=True))
            p = mixer.final(np.where(ones, z, -z), gate)
            logs[rows] = np.log10(np.where(ones, p, 1 - p)).reshape(-1, 8).sum(axis=1)
        return logs

    def log10(self, mixer: Mixer) -> np.ndarray:
        """log10 of the probability of each word, its end mark included."""
        return np.bincount(self.steps.word, self.step_logs(mixer)[self.steps.of], len(self.words))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words of a task with the number of their range: a new one begins
    where the words or the symbols of the last are enough."""
    first = TaskContext.get().partitionId() << 32
    number = words = symbols = 0
    for batch in batches:
        p = []
        for word in batch.column(0).to_pylist():
            if words and (words >= WORDS_A_TASK or symbols + len(word) + 2 > SYMBOLS_A_TASK):
                number, words, symbols = number + 1, 0, 0
            words, symbols = words + 1, symbols + len(word) + 2
            p.append(first + number)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), *batch.columns], ["p", "word", "n", "c"])


def _ranges(vocabulary: DataFrame, words: int, symbols: int) -> tuple[DataFrame, tuple]:
    """(size, packed) for each sorted range of the vocabulary, its words and the counts of
    the contexts they share with other ranges; and the few small tables that all ranges read."""
    spark = vocabulary.sparkSession
    parts = max(1, -(-words // WORDS_A_TASK), -(-symbols // SYMBOLS_A_TASK))
    ranges = vocabulary.select("word", "n", "c").repartitionByRange(parts, "word").sortWithinPartitions("word")
    ranges = written(ranges.mapInArrow(_numbered, "p long, word binary, n long, c long"), "ranges")
    shared = _cuts(ranges)
    gather = _gathered(spark.sparkContext.broadcast(shared))
    gathered = ranges.select("p", "word", "c").mapInArrow(gather, "p long, kind int, context long, symbol long, c long")
    total = F.sum("c").alias("c")
    gathered = written(gathered.groupBy("p", "kind", "context", "symbol").agg(total), "contexts")

    def shorter(rows: DataFrame, symbols: int) -> DataFrame:
        kept = F.col("context").bitwiseAND(F.lit((1 << 8 * symbols) - 1)).alias("context")
        return rows.select(kept, "symbol", "c").groupBy("context", "symbol").agg(total)

    four = written(gathered.where(F.col("kind") == _LAST).groupBy("context", "symbol").agg(total), "four")
    three = shorter(four, 3)
    two = shorter(three, 2)
    # by place and by one symbol there are 2^16 rows at most; the beginnings are those at the cuts
    by_place, by_one, by_shared = (
        _collected(rows)
        for rows in (
            gathered.where(F.col("kind") == _PLACE).groupBy("context", "symbol").agg(total),
            shorter(two, 1),
            gathered.where(F.col("kind") == _SHARED).groupBy("context", "symbol").agg(total),
        )
    )
    keys = (by_shared[0].view(np.uint64) + (by_shared[1].astype(np.uint64) + np.uint64(1)) * _D) * _C
    order = np.argsort(keys)
    small = (
        ((by_place[0] << 8) | by_place[1], by_place[2]),
        ((by_one[0] << 8) | by_one[1], by_one[2]),
        (shared, keys[order], by_shared[2][order]),
    )

    def cut(symbols: int, name: str) -> DataFrame:
        told = _told({2: two, 3: three}[symbols])
        return told.select(F.col("context").alias(f"context{symbols}"), "symbol", F.col("t").alias(name))

    # a context is the end of 257 contexts that are one symbol longer, at most, so none of these keys is hot
    chain = _told(four).withColumnRenamed("t", "t4")
    chain = chain.withColumn("context3", F.col("context").bitwiseAND(F.lit(0xFFFFFF)))
    near = cut(3, "t3").withColumn("context2", F.col("context3").bitwiseAND(F.lit(0xFFFF))).join(cut(2, "t2"), ["context2", "symbol"])
    chain = chain.join(near, ["context3", "symbol"]).select("context", "symbol", F.concat("t2", "t3", "t4").alias("t"))
    chain = written(chain, "chain")
    asked = gathered.where(F.col("kind") == _LAST).select("p", "context", "symbol").join(chain, ["context", "symbol"])
    key = F.shiftleft("context", 8).bitwiseOR(F.col("symbol"))
    sides = ranges.select("p", F.lit(0).alias("side"), F.lit(0).cast("long").alias("key"), "word", "n", "c").unionByName(
        asked.select("p", F.lit(1).alias("side"), key.alias("key"), "t"), allowMissingColumns=True
    )
    sides = sides.repartition(parts, "p").sortWithinPartitions("p", "side", "key", "word")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words, weights, keys, told = None, [], [], [], []

        def out() -> pa.RecordBatch:
            table = np.concatenate(weights)
            data = (words, table[:, 0], table[:, 1], np.concatenate(keys), np.concatenate(told))
            data = pickle.dumps(data, protocol=5)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(data)]), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], ["size", "packed"]
            )

        for batch in batches:
            ps, side = batch["p"].to_numpy(), batch["side"].to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(ps) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(ps)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if words and ps[a] != number:
                    yield out()
                    words, weights, keys, told = [], [], [], []
                number, part = ps[a], batch.slice(a, b - a)
                if side[a]:
                    keys.append(part["key"].to_numpy())
                    told.append(np.frombuffer(b"".join(part["t"].to_pylist()), np.float32).reshape(b - a, -1))
                else:
                    words = words + part["word"].to_pylist()
                    weights.append(np.column_stack([part[c].to_numpy() for c in ("n", "c")]))
        if words:
            yield out()

    return written(sides.mapInArrow(pack, "size long, packed binary"), "packed"), small


def _models(batches: Iterator[pa.RecordBatch], small: tuple) -> Iterator[Exact]:
    for batch in batches:
        for size, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield Exact(pa.decompress(packed.as_buffer(), size, "zstd", asbytes=True), small)


def _learned(packed: DataFrame, small) -> Mixer:
    """Weights and map after ``ROUNDS`` rounds over all training tokens."""
    mixer = Mixer.first()
    for _ in range(ROUNDS):
        weights = mixer.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            online = Online(weights)
            for model in _models(batches, small.value):
                model.teach(online)
            found = online.packed()
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["i", "v"])

        sums = packed.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        if not sums.num_rows:
            break
        total = np.zeros(len(Online(weights).packed()))
        total[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        mixer = Online.merged(total)
    return mixer


def _head(words: DataFrame) -> DataFrame:
    """The most frequent words, ``HEAD`` at most: all from some count on, found in the counts' histogram."""
    held, least = 0, None
    for row in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        held += row["words"]
        if held > HEAD:
            break
        least = row["n"]
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    return short.where(F.col("n") >= least) if least is not None else short.where("false")


def _sums(table: tuple, at: np.ndarray, often: np.ndarray, kinds: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, known words and base and score of the model) and (text, class): sums
    over the words of some texts, ``kinds`` distinct words each, that lie at ``at``
    in a table (below zero: not in it) and come ``often``."""
    values, (starts, ends, of, more) = table
    text = np.repeat(np.arange(len(kinds)), kinds)[at >= 0]
    at, often = at[at >= 0], often[at >= 0].astype(float)
    known = np.column_stack([np.bincount(text, often * values[at, i], len(kinds)) for i in range(values.shape[1])]).astype(float)
    first, lengths = starts[at], ends[at] - starts[at]
    terms = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    cell = np.repeat(text * classes, lengths) + of[terms]
    own = np.bincount(cell, more[terms] * np.repeat(often, lengths), len(kinds) * classes)
    return known, own.astype(float).reshape(-1, classes)  # of no words at all, bincount gives integers


def score_texts(docs: DataFrame, train: Column, group: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    Learns from the rows where ``train`` holds (NULL: doesn't), with a class
    for each value of ``group`` among them (none: one class); when scoring, a
    text's class isn't read. Tokens are the words of the text, A-Z in lower
    case, and one end, so NULL and empty texts have the end alone.
    ``base_score`` is the add-half unigram score, ``score`` the model's; both
    are log10 of a probability. The order of a text's words doesn't count.
    Without training rows nothing is known and all words go by the mixer's
    first state. NULL keys and repeated rows are kept. A word takes some 250
    bytes of a task's memory for each of its bytes.
    """
    spark = docs.sparkSession
    group = F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))
    train = F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), train.alias("train"), F.when(train, group).alias("group"), F.col(text).alias("text"))
    counted = rows.select("group", "text").mapInArrow(_counted, "word binary, group string, n long")
    tokens = written(counted.groupBy("word", "group").agg(F.sum("n").alias("n")), "tokens")
    # one narrow row a class: documents, tokens and distinct tokens
    sizes = tokens.where(F.col("group").isNotNull()).groupBy("group").agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds"))
    sizes = sizes.join(rows.where("train").groupBy("group").agg(F.count("*").alias("texts")), "group").orderBy("group").collect()
    names = [r["group"] for r in sizes] or [""]
    total_texts = sum(r["texts"] for r in sizes)
    shares = np.array([math.log10(r["texts"] / total_texts) for r in sizes] or [0.0])
    kinds = np.array([r["kinds"] for r in sizes] or [1], float)
    # what each token costs in a class that hasn't seen it, beside the model's probability
    unseen = np.array([math.log10(r["kinds"] / (r["tokens"] + r["kinds"])) for r in sizes] or [0.0])

    number = spark.createDataFrame([(x, g) for g, x in enumerate(names)], "group string, g int")
    own = F.filter(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("g", F.col("n").alias("c")))), lambda x: x.isNotNull())
    seen = F.sum(F.when(F.col("g").isNotNull(), F.col("n")).otherwise(0))
    vocabulary = tokens.join(F.broadcast(number), "group", "left").groupBy("word").agg(F.sum("n").alias("n"), seen.alias("c"), own.alias("own"))
    vocabulary = written(vocabulary, "vocabulary")
    total = vocabulary.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count_if(F.col("c") > 0).alias("v"),
        F.count("*").alias("words"),
        F.coalesce(F.sum(F.octet_length("word") + 2), F.lit(0)).alias("symbols"),
    ).first()
    n, v = int(total["n"]), int(total["v"])

    packed, small = _ranges(vocabulary, int(total["words"]), int(total["symbols"]))
    small = spark.sparkContext.broadcast(small)
    mixer = _learned(packed, small)
    floor = n + 0.5 * (v + 1)

    def scored(batches):
        for model in _models(batches, small.value):
            yield pa.RecordBatch.from_arrays([pa.array(model.words, pa.binary()), pa.array(model.log10(mixer))], ["word", "score"])

    words = packed.mapInArrow(scored, "word binary, score double").join(vocabulary, "word")
    more = F.expr(f"transform(own, x -> struct(x.g as g, log10(1 + x.c / (element_at(array({', '.join(f'{x}D' for x in kinds)}), x.g + 1) * pow(10D, score))) as more))")
    words = words.select("word", "n", "c", F.log10((F.col("c") + 0.5) / F.lit(floor)).alias("base"), "score", more.alias("own"))
    words = written(words, "words")

    # the bound of what is broadcast: HEAD words of HEAD_BYTES at most, each with the classes it is seen in
    top = _head(words).select("word", "c", "base", "score", "own").toArrow()
    values = np.column_stack(((top.column("c").to_numpy() > 0).astype(float), top.column("base").to_numpy(), top.column("score").to_numpy()))
    lists = top.column("own").combine_chunks()
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))) if len(lists) else np.zeros(1)
    flat = lists.flatten()
    ends = ends.astype(np.int64)
    sparse = ends[:-1], ends[1:], flat.field("g").to_numpy(), flat.field("more").to_numpy()
    head = spark.sparkContext.broadcast(({w: i for i, w in enumerate(top.column("word").to_pylist())}, values, sparse))
    classes = len(names)

    def looked_up(batches):
        find = head.value[0].get
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                words, numbers = [], []
                for text in raw(part.column(2)):
                    tokens = (text or b"").lower().split()
                    tokens.append(END)
                    times = Counter(tokens)
                    numbers.append((len(tokens), len(text or b""), len(times)))
                    words.append(times)
                kinds = np.array([x for _, _, x in numbers])
                flat = list(chain.from_iterable(words))
                at = np.fromiter(map(find, flat, repeat(-1)), np.int64, len(flat))
                often = np.fromiter(chain.from_iterable(x.values() for x in words), np.int64, len(flat))
                known, own = _sums(head.value[1:], at, often, kinds, classes)
                missing = at < 0
                ends_of_rare = np.r_[0, np.cumsum(missing)][np.r_[0, np.cumsum(kinds)]]
                rare = pa.array(list(compress(flat, missing.tolist())), pa.binary())
                rest = pa.StructArray.from_arrays([rare, pa.array(often[missing])], ["word", "times"])
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(kinds) + 1) * classes, pa.int32()), pa.array(own.ravel()))
                rest = pa.ListArray.from_arrays(pa.array(ends_of_rare, pa.int32()), rest)
                whole = [pa.array([x[i] for x in numbers], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], *whole, pa.array(known[:, 0].astype(np.int64)), pa.array(known[:, 1].copy()), pa.array(known[:, 2].copy()), own, rest],
                    ["key", "train", "n_tokens", "n_bytes", "found", "base", "score", "own", "rest"],
                )

    kind = docs.schema[key].dataType.simpleString()
    looked = rows.select("key", "train", "text").mapInArrow(
        looked_up,
        f"key {kind}, train boolean, n_tokens long, n_bytes long, found long, base double, score double, own array<double>, rest array<struct<word:binary,times:long>>",
    )
    looked = written(looked.withColumn("row", F.monotonically_increasing_id()), "looked-up")
    rare = looked.select("row", F.explode("rest").alias("t")).select("row", "t.word", "t.times")
    # words beyond the head are rarer than all of it, so none of these keys is hot
    met = rare.join(words, "word")
    # a word's own figures go with the first class that has seen it, or under class -1
    none = F.array(F.struct(F.lit(-1).alias("g"), F.lit(0.0).alias("more")))
    terms = F.when(F.size("own") > 0, F.col("own")).otherwise(none)
    met = met.select("row", "times", "c", "base", "score", F.posexplode(terms).alias("at", "x"))
    once = F.when(F.col("at") == 0, F.col("times")).otherwise(0)
    sums = met.groupBy("row", F.col("x.g").alias("g")).agg(
        F.sum(F.when(F.col("c") > 0, once).otherwise(0)).alias("known"),
        F.sum(once * F.col("base")).alias("base"),
        F.sum(once * F.col("score")).alias("score"),
        F.sum(F.col("times") * F.col("x.more")).alias("more"),
    )
    # one entry a class
    of_row = sums.groupBy("row").agg(
        *(F.sum(c).alias(f"rare_{c}") for c in ("known", "base", "score")),
        F.map_from_entries(F.collect_list(F.struct("g", "more"))).alias("rare_own"),
    )
    both = looked.drop("rest").join(of_row, "row", "left")
    fixed = F.array(*(F.lit(float(x)) for x in shares)), F.array(*(F.lit(float(x)) for x in unseen))
    both = both.withColumns({"score": F.col("score") + F.coalesce("rare_score", F.lit(0.0)), "shares": fixed[0], "unseen": fixed[1]})
    logs = "transform(own, (x, g) -> x + coalesce(rare_own[g], 0D) + element_at(shares, g + 1) + n_tokens * element_at(unseen, g + 1))"
    both = both.withColumn("logs", F.expr(logs)).withColumn("best", F.array_max("logs"))
    # the mixture over the classes, from its largest term
    score = F.col("score") + F.col("best") + F.log10(F.expr("aggregate(logs, 0D, (a, x) -> a + pow(10D, x - best))"))
    return both.select(
        F.col("key").alias(key),
        "train",
        "n_tokens",
        (F.col("found") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score / F.log10(F.lit(2.0)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
