"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text falls in one of a few bins. Cyclic boosting visits the
features in turn and adds a small step of a shallow tree over one feature's
bins, so what is learned is one table of values for each feature; then the
same for pairs of features over coarser bins. A score is a sum of look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecshelf.llm.common import labelled, raw, text_udf

#: Labelled texts learned from, at most.
SAMPLE = 20_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, STEP, SPLITS = 200, 60, 8, 0.1, 3
#: Keeps steps small where few texts are.
DAMP = 5.0

FEATURES = (
    "log_words word_bytes symbols pipes capitals bangs digits variety repeated_lines stops "
    "short_words line_words beyond_ascii symbol_ends repeated_pairs longest_word"
).split()
_SYMBOLS = np.frombuffer(b"#*$%&|<>~^_=+{}[]\\@", np.uint8)


def features(text: bytes | None) -> list[float]:
    """One number for each of FEATURES; all zero for NULL and empty texts."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    chars = int(sizes.sum())
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = np.bincount(np.fromiter((w[-1] for w in words), np.uint8, n), minlength=256)
    return [
        np.log1p(n),
        chars / n,
        seen[_SYMBOLS].sum() / chars,
        seen[124] / n,
        upper / (upper + lower + 1),
        seen[33] / n,
        seen[48:58].sum() / chars,
        len(set(words)) / n**0.8,
        1 - len(set(lines)) / len(lines),
        seen[46] / n,
        np.count_nonzero(sizes <= 2) / n,
        np.log1p(n / len(lines)),
        seen[128:].sum() / chars,
        ends[_SYMBOLS].sum() / n,
        1 - (len(set(zip(words, words[1:], strict=False))) + 1) / n,
        np.log1p(sizes.max()),
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if values.size else np.zeros(0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best gain of one split of a run of bins, and where it is (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + DAMP) + (all_g - left_g) ** 2 / (all_h - left_h + DAMP) - all_g**2 / (all_h + DAMP)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, splits: int) -> np.ndarray:
    """Leaf values per bin of a tree of a few splits, best gain first."""
    runs = [(0, len(g))]
    for _ in range(splits):
        gains = [_cut(g[a:b], h[a:b]) for a, b in runs]
        best = max(range(len(runs)), key=lambda i: gains[i][0])
        if not gains[best][1]:
            break
        a, b = runs.pop(best)
        at = a + gains[best][1]
        runs += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + DAMP)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A split on one axis, then one on the other axis in each half: gain and leaf values."""
    best_gain, best = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + DAMP)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for at in range(1, gg.shape[0]):
            gain, out = -whole, np.zeros_like(gg)
            for rows in (slice(0, at), slice(at, None)):
                a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                split = _cut(a, b)[1]
                for columns in (slice(0, split), slice(split, None)):
                    s, t = a[columns].sum(), b[columns].sum()
                    gain += s**2 / (t + DAMP)
                    out[rows, columns] = s / (t + DAMP)
            if gain > best_gain:
                best_gain, best = gain, out if axis == 0 else out.T
    return best_gain, best


@dataclass
class Additive:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, j], side="right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for p in self.pairs for j in p[:2]}
        for a, b, values in self.pairs:
            out += values[bins[a], bins[b]]
        return out


def fit(x: np.ndarray, labels: np.ndarray) -> Additive:
    """Cyclic boosting of the logistic loss, single features first, then pairs."""
    y, n = labels.astype(float), len(labels)
    rate = (y.sum() + 1) / (n + 1.5)
    width = x.shape[1]
    edges = [_edges(x[:, j], BINS) for j in range(width)]
    coarse = [_edges(x[:, j], COARSE) for j in range(width)]
    model = Additive(float(np.log(rate / max(1 - rate, 1e-9))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    margin = np.full(n, model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            size = len(edges[j]) + 1
            step = STEP * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), SPLITS)
            model.tables[j] += step
            margin += step[bins[j]]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = low[a] * shape[1] + low[b]
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_pair_tree(*grid(a, b)[1:])[0], a, b) for a in range(width) for b in range(a)), reverse=True)
    chosen = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for a, b, values in model.pairs:
            cell, g, h = grid(a, b)
            step = STEP * _pair_tree(g, h)[1]
            values += step
            margin += step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "quality", sample: int = SAMPLE) -> Additive:
    """Fits on at most about ``sample`` labelled texts. Their features, a few
    numbers for each, come to the driver; the texts don't. No labels: every
    text is called good, as a filter without knowledge should keep all."""

    def measured(batches):
        for batch in batches:
            x = matrix(raw(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = labelled(docs, labels, label, sample, where).mapInArrow(measured, "label int, x array<double>").toArrow()
    y = got.column("label").to_numpy()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # the same fit for any order of rows
    return fit(x[order], (y != 0)[order])


def score_column(model: Additive, text: str = "text") -> Column:
    """The probability that a text is good; NULL and empty texts have all features zero."""

    def run(texts: list[bytes | None]) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(model.margins(matrix(texts)), -30, 30))))

    return text_udf(run, "double")(F.col(text))
