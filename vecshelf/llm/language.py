"""Language identification with a string kernel.

The kernel of two texts counts the distinct n-grams of 1 to ``LONGEST`` bytes
that both have (a blended spectrum of presence), over the root of the product
of their own counts. Landmark texts stand for the training set (Nyström): a
text becomes its kernel values with the landmarks, whitened by the landmarks'
own kernel, and kernel ridge regression has one output for each language
against the rest. Texts are scored in blocks by matrix products.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshelf.llm.common import raw, text_udf

#: N-grams are hashed to so many places.
PLACES, LONGEST = 1 << 14, 3
#: Training texts over all languages, and landmarks among them, at most (but 16 and 4 for each language).
SAMPLE, LANDMARKS = 3000, 192
RIDGE = 1.0
BLOCK = 256
#: Bytes looked at a time, with an overlap: a long text is one presence set all the same.
SLICE = 1 << 20
UNDETERMINED = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def presence(text: bytes | None) -> np.ndarray:
    """Which places the n-grams of a whole text fall on; A-Z in lower case."""
    here = np.zeros(PLACES, bool)
    text = (text or b"").lower()
    for first in range(0, len(text), SLICE):
        x = np.frombuffer(text[first : first + SLICE + LONGEST - 1], np.uint8).astype(np.uint32)
        code = np.zeros(len(x), np.uint32)
        for n in range(1, LONGEST + 1):
            code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
            here[((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - PLACES.bit_length() + 1)] = True
    return here


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of the rows of two 0/1 matrices."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    sizes = np.sqrt(np.maximum(a.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(b.sum(axis=1), 1))[None, :]
    return (a @ b.T) / sizes


@dataclass
class KernelRidge:
    languages: list[str]
    landmarks: np.ndarray  # packed presence
    weights: np.ndarray  # from kernel values to one output a language

    def outputs(self, places: np.ndarray) -> np.ndarray:
        return kernel(places, np.unpackbits(self.landmarks, axis=1)) @ self.weights


def fit(packed: np.ndarray, labels: list[str]) -> KernelRidge:
    """``packed``: presence bits of the training texts, in an order that is the same on each run."""
    names = sorted(set(labels))
    if not names:
        return KernelRidge([], np.zeros((0, PLACES // 8), np.uint8), np.zeros((0, 0), np.float32))
    y = np.array([names.index(x) for x in labels])
    each = max(4, LANDMARKS // len(names))
    marks = np.concatenate([np.flatnonzero(y == i)[:each] for i in range(len(names))])
    landmarks = packed[marks]
    wide = np.unpackbits(landmarks, axis=1)
    own = kernel(wide, wide).astype(float)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([kernel(np.unpackbits(packed[i : i + BLOCK], axis=1), wide) @ whiten for i in range(0, len(packed), BLOCK)])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1 / np.maximum(np.bincount(y, minlength=len(names)), 1)[y]  # languages weigh the same
    share *= len(y) / share.sum()
    left = phi.T @ (phi * share[:, None]) + RIDGE * np.eye(phi.shape[1])
    solved = np.linalg.solve(left, phi.T @ (target * share[:, None]))
    return KernelRidge(names, landmarks, (whiten @ solved).astype(np.float32))


def train(docs: DataFrame, where: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> KernelRidge:
    """Learns from rows with a language and a letter that pass ``where``.

    Each language gives its share of ``SAMPLE`` different texts at most, or 16
    where there are very many languages, drawn by the hash of language and
    text; a text that is repeated, under one key or several, counts once. A
    language of 16 texts or fewer gives all of them. The texts' presence bits,
    2 KB each, come to the driver.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", "hash").distinct().groupBy("lang").count().collect()}
    each = max(16, SAMPLE // max(len(sizes), 1))
    # the draw takes some more than wanted of a small share, and the first of those by hash
    shares = [(name, min(1.0, (each + 5 * each**0.5) / n)) for name, n in sizes.items()]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    place = F.xxhash64(F.lit(3), "lang", "hash")
    picked = rows.join(F.broadcast(shares), "lang").where((place / float(1 << 64) + 0.5 <= F.col("share")))

    def measured(batches):
        for batch in batches:
            texts = raw(batch.column(2))
            bits = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["lang", "place", "bits"])

    found = picked.select("lang", place.alias("place"), "text").mapInArrow(measured, "lang string, place long, bits binary")
    got = found.where("bits is not null").groupBy("lang", "place").agg(F.first("bits").alias("bits")).toArrow()
    seen = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True))
    taken, names = [], Counter()
    for row in seen:
        names[row[0]] += 1
        if names[row[0]] <= each:
            taken.append(row)
    packed = np.frombuffer(b"".join(x[2] for x in taken), np.uint8).reshape(-1, PLACES // 8)
    return fit(packed, [x[0] for x in taken])


def predict_column(model: KernelRidge, text: str = "text") -> Column:
    """struct(lang_pred, score): the language with the highest output, and the
    share of its output among all after a softmax. NULL texts, texts without a
    letter, and all texts of a model without languages: ``und`` with score 0."""

    def run(texts: list[bytes | None]) -> pa.Array:
        named, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
        for first in range(0, len(known), BLOCK):
            at = known[first : first + BLOCK]
            out = model.outputs(np.array([presence(texts[i]) for i in at]))
            soft = np.exp(4 * (out - out.max(axis=1, keepdims=True)))
            best = out.argmax(axis=1)
            for i, b, s in zip(at, best, soft.max(axis=1) / soft.sum(axis=1), strict=True):
                named[i], scores[i] = model.languages[b], s
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return text_udf(run, "lang_pred string, score double")(F.col(text))
