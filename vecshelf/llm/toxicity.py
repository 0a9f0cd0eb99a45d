"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their byte 5-grams, hashed; a text is the
set of its terms. The machine adds to a linear score the dot products of the
terms' factors, so that a pair of terms can count for more (or less) than the
two apart, as an insult beside the mention of a group does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshelf.llm.common import labelled, raw, text_udf
from vecshelf.session import written

BUCKETS = 1 << 18
GRAM = 5
#: Labelled texts learned from, at most. The rest of the model doesn't grow with the data.
SAMPLE = 20_000
#: Hashed terms kept: those that set the classes apart most, by z-score.
TERMS, LEAST_Z, LEAST_TEXTS = 4096, 3.5, 5
#: Frequent words that are looked at in pairs, and the z-score from which two of
#: them are kept because of what they do together, alone without effect or not
#: (five and a half deviations: two million pairs are tested).
PAIRED, LEAST_PAIR_Z = 2048, 5.5
#: Terms whose pairs with all others are tested at a time.
ROWS = 128
FACTORS, EPOCHS, BATCH, RATE, SHRINK = 8, 30, 128, 0.02, 1e-4
#: Words whose terms are kept per task; at more, the task starts a new table.
KEPT = 200_000

_APART = bytes.maketrans(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""", b" " * 32)


def words_of(text: bytes | None) -> set[bytes]:
    """The distinct words: A-Z in lower case, ASCII punctuation as space."""
    return set((text or b"").lower().translate(_APART).split())


def word_bucket(word: bytes) -> int:
    return zlib.crc32(b" " + word) % BUCKETS


def hashed(word: bytes) -> np.ndarray:
    """The buckets of a word and of the 5-grams of the marked word."""
    marked = b"<" + word + b">"
    grams = {marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)}
    return np.unique(np.array([word_bucket(word), *(zlib.crc32(t) % BUCKETS for t in grams)], np.int64))


class Terms:
    """Finds the kept terms of texts; remembers them word by word."""

    def __init__(self, kept: np.ndarray) -> None:
        self.at = np.full(BUCKETS, -1, np.int32)
        self.at[kept] = np.arange(len(kept), dtype=np.int32)
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: bytes | None) -> list[int]:
        words, known = words_of(text), self.known
        fresh = words.difference(known)
        if len(known) + len(fresh) > KEPT:
            known.clear()
            fresh = words
        for w in fresh:
            at = self.at[hashed(w)]
            known[w] = tuple(at[at >= 0].tolist())
        found = {t for w in words for t in known[w]}
        return sorted(found)


class Bags:
    """The terms of many texts, one text after the other in a flat array: two
    bytes a term, as there are fewer than 2^15 of them."""

    def __init__(self, flat: np.ndarray, cuts: np.ndarray) -> None:
        self.flat, self.cuts = flat, cuts

    @staticmethod
    def of(column: pa.ChunkedArray) -> Bags:
        flat, sizes = [np.zeros(0, np.int16)], [np.zeros(1, np.int64)]
        for part in column.chunks:
            flat.append(part.flatten().to_numpy())
            sizes.append(part.value_lengths().to_numpy())
        return Bags(np.concatenate(flat), np.cumsum(np.concatenate(sizes)))

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.cuts[i] : self.cuts[i + 1]]

    def renumbered(self, place: np.ndarray) -> Bags:
        """Each term as the number ``place`` gives it, without those below zero."""
        place = place.astype(np.int16)
        flat, sizes = [np.zeros(0, np.int16)], [np.zeros(1, np.int64)]
        for i in range(len(self)):
            found = place[self[i]]
            flat.append(found[found >= 0])
            sizes.append([len(flat[-1])])
        return Bags(np.concatenate(flat), np.cumsum(np.concatenate(sizes)))

    def order(self, labels: np.ndarray) -> list[int]:
        """The texts by label and terms."""
        return sorted(range(len(self)), key=lambda i: (labels[i], self[i].astype(">u2").tobytes()))


@dataclass
class Machine:
    kept: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, texts: Sequence[Sequence[int]]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.full(len(texts), self.bias)
        full = np.flatnonzero(sizes)
        if full.size:
            flat = np.concatenate([np.asarray(t, np.int64) for t in texts])
            cuts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            v = self.factors[flat]
            total = np.add.reduceat(v, cuts, axis=0)
            own = np.add.reduceat((v * v).sum(axis=1), cuts)
            out[full] += np.add.reduceat(self.linear[flat], cuts) + ((total * total).sum(axis=1) - own) / 2
        return out


def fit(texts: Sequence[Sequence[int]], labels: np.ndarray, kept: np.ndarray, seed: int = 7) -> Machine:
    """Minimises logistic loss with Adam over small batches."""
    rng = np.random.default_rng(seed)
    n, y = len(texts), labels.astype(float)
    rate = (y.sum() + 1) / (n + 2) if n else 0.0
    # no labels at all: nothing is called toxic
    m = Machine(kept, float(np.log(rate / (1 - rate))) if rate else -20.0, np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS)))
    if not n or not len(kept):
        return m
    moments = [np.zeros_like(m.linear), np.zeros_like(m.linear), np.zeros_like(m.factors), np.zeros_like(m.factors)]
    bias_m = bias_s = 0.0
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for first in range(0, n, BATCH):
            step += 1
            at = order[first : first + BATCH]
            part = [texts[i] for i in at]
            off = 1 / (1 + np.exp(-np.clip(m.margins(part), -30, 30))) - y[at]
            off /= len(at)
            grad_w, grad_v = SHRINK * m.linear, SHRINK * m.factors
            for t, e in zip(part, off, strict=True):
                if len(t):
                    v = m.factors[t]
                    grad_w[t] += e
                    grad_v[t] += e * (v.sum(axis=0) - v)
            grow = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for value, grad, a, b in ((m.linear, grad_w, *moments[:2]), (m.factors, grad_v, *moments[2:])):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                value -= grow * a / (np.sqrt(b) + 1e-8)
            g = float(off.sum())
            bias_m, bias_s = bias_m + 0.1 * (g - bias_m), bias_s + 0.001 * (g * g - bias_s)
            m.bias -= grow * bias_m / (bias_s**0.5 + 1e-8)
    return m


def paired_terms(texts: Sequence[Sequence[int]], labels: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` terms are in a pair whose effect isn't the sum of the two.

    ``texts`` are lists of term numbers. A pair's texts fall in four cells by
    which of the two they have; of the cells' shares of label 1, with one text
    in two added to each, the interaction ``p11 - p10 - p01 + p00`` is compared
    with its deviation. Each cell must have ``LEAST_TEXTS`` texts. The two
    counts of all pairs are held, the rest is worked out for ``ROWS`` terms at a time.
    """
    n, y = len(texts), labels.astype(np.float32)
    # whole numbers below 2^24, so exact
    every, ones = np.zeros((2, size, size), np.float32)
    for first in range(0, n, 1024):
        part = [texts[i] for i in range(first, min(first + 1024, n))]
        x = np.zeros((len(part), size), np.float32)
        for i, t in enumerate(part):
            x[i, t] = 1
        every += x.T @ x
        ones += x.T @ (x * y[first : first + 1024, None])
    own, own_ones = np.diag(every).astype(float), np.diag(ones).astype(float)
    most = np.zeros(size)
    for first in range(0, size, ROWS):
        rows = slice(first, first + ROWS)
        both, both_ones = every[rows].astype(float), ones[rows].astype(float)
        cells = [(both, both_ones), (own[rows, None] - both, own_ones[rows, None] - both_ones), (own - both, own_ones - both_ones)]
        cells.append((n - sum(c for c, _ in cells), float(y.sum()) - sum(c for _, c in cells)))
        shares = [(c1 + 0.5) / (c + 1) for c, c1 in cells]
        spread = np.sqrt(sum(p * (1 - p) / (c + 1) for p, (c, _) in zip(shares, cells, strict=True)))
        z = np.abs(shares[0] - shares[1] - shares[2] + shares[3]) / spread
        z[np.minimum.reduce([c for c, _ in cells]) < LEAST_TEXTS] = 0
        z[np.arange(len(z)), np.arange(first, first + len(z))] = 0
        most = np.maximum(most, z.max(axis=0, initial=0))
    return np.flatnonzero(most >= LEAST_PAIR_Z)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and bucket, the labelled texts of each class that have it, and those that have it as a word."""
    counts = np.zeros((3, BUCKETS), np.int64)
    known: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            words = words_of(text)
            fresh = words.difference(known)
            if len(known) + len(fresh) > KEPT:
                known.clear()
                fresh = words
            known.update((w, hashed(w)) for w in fresh)
            if words:
                counts[1 if label else 0][np.unique(np.concatenate([known[w] for w in words]))] += 1
                counts[2][np.unique(np.array([word_bucket(w) for w in words]))] += 1
    at = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c[at]) for c in counts)], ["bucket", "clean", "toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine for ``label`` of ``labels(doc_id, label)``, of rows that pass ``where``.

    The chosen texts are read once and written; the counts that choose the
    terms are summed by Spark. Kept are terms that set the classes apart by
    themselves, and of the ``PAIRED`` most frequent words those that do in a
    pair. Only bucket numbers and, for each chosen text, which of those terms
    it has come to the driver.
    """
    rows = written(labelled(docs, labels, label, sample, where), "toxic-sample")
    sizes = {r["_label"] != 0: r["n"] for r in rows.groupBy((F.col("_label") != 0).cast("int").alias("_label")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(False, 0), sizes.get(True, 0)
    apart = frequent = np.zeros(0, np.int64)
    if clean and toxic:
        counted = rows.mapInArrow(_counted, "bucket long, clean long, toxic long, words long")
        counted = counted.groupBy("bucket").agg(*(F.sum(a).alias(b) for a, b in (("clean", "c"), ("toxic", "t"), ("words", "w"))))
        counted = written(counted.where(F.col("c") + F.col("t") >= LEAST_TEXTS), "toxic-terms")
        share = (F.col("c") + F.col("t")) / (clean + toxic)
        spread = F.sqrt(share * (1 - share) * (1 / clean + 1 / toxic))
        z = (F.col("t") / toxic - F.col("c") / clean) / spread
        best = counted.where(share < 1).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(TERMS)
        often = counted.where((share < 1) & (F.col("w") >= LEAST_TEXTS)).orderBy(F.desc("w"), "bucket").limit(PAIRED)
        apart, frequent = (np.sort(np.array([r["bucket"] for r in x.select("bucket").collect()], np.int64)) for x in (best, often))
    looked_at = np.union1d(apart, frequent)

    def found(batches):
        terms = Terms(looked_at)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms.of(t) for t in raw(batch.column(1))], pa.list_(pa.int16()))], ["label", "terms"])

    got = rows.mapInArrow(found, "label int, terms array<smallint>").toArrow()
    texts, y = Bags.of(got.column("terms")), got.column("label").to_numpy() != 0
    del got
    # numbers among the frequent words, and then among all that are kept
    place = np.full(len(looked_at), -1)
    place[np.searchsorted(looked_at, frequent)] = np.arange(len(frequent))
    pairs = paired_terms(texts.renumbered(place), y, len(frequent)) if len(frequent) else np.zeros(0, np.int64)
    kept = np.union1d(apart, frequent[pairs])
    place = np.full(len(looked_at), -1)
    place[np.searchsorted(looked_at, kept)] = np.arange(len(kept))
    texts = texts.renumbered(place)
    order = texts.order(y)  # the same fit for any order of rows
    return fit([texts[i] for i in order], y[order] if len(order) else np.zeros(0), kept)


def score_column(machine: Machine, text: str = "text") -> Column:
    """The probability that a text is toxic. NULL and empty texts have no
    terms, so they get the machine's bias alone."""
    sent = F.col(text)
    state: dict[str, Terms] = {}

    def run(texts: list[bytes | None]) -> pa.Array:
        terms = state.setdefault("terms", Terms(machine.kept))
        margins = machine.margins([terms.of(t) for t in texts])
        return pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))))

    return text_udf(run, "double")(sent)
