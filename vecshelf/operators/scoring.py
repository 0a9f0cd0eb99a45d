"""Block scoring inside a task: a query matrix against batches of corpus rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

# Scores are ordered at this many digits, so equal vectors tie whatever block
# they were multiplied in, and the key decides.
SCORE_DIGITS = 12
_SLICE_CELLS = 1 << 21
_SLICE_ROWS = 4096


def to_matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal-length vectors as a float64 matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows and flat.size % rows:
        raise ValueError("vectors differ in length; run validate_vectors first")
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def to_keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if len(column) else np.empty(0, object)
    return np.asarray(values)


def unit_rows(matrix: np.ndarray, zero: float = 1.0) -> np.ndarray:
    """Rows divided by their length, those of length 0 by ``zero``."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = zero
    return matrix / norms


def row_scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Scores of raw query rows against raw corpus rows; what has none is -inf."""
    if metric == "cosine":
        queries = unit_rows(queries, np.nan)
    if metric == "l2":
        squares = (queries**2).sum(1)[:, None] + (corpus**2).sum(1) - 2 * (queries @ corpus.T)
        # the expansion loses digits where vectors nearly agree: those few are measured
        scale = (queries**2).sum(1)[:, None] + (corpus**2).sum(1)
        for q, c in zip(*np.nonzero(squares < 1e-6 * scale)):
            squares[q, c] = ((queries[q] - corpus[c]) ** 2).sum()
        scores = -np.sqrt(np.maximum(squares, 0))
    else:
        scores = queries @ corpus.T
    if metric in ("cosine", "mean_cosine"):
        norms = np.sqrt(np.einsum("ij,ij->i", corpus, corpus))
        norms[norms == 0] = np.nan
        scores = scores / norms
    scores = np.round(scores, SCORE_DIGITS)
    scores[np.isnan(scores)] = -np.inf
    return scores


@dataclass
class Exclusions:
    """Pairs (value, query position), sorted by value."""

    values: np.ndarray
    positions: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, positions: np.ndarray) -> "Exclusions":
        order = np.argsort(values, kind="stable")
        return cls(values[order], positions[order])

    def hits(self, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query position, probe row) for every match of ``probe``."""
        if not len(self.values) or not len(probe):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lo = np.searchsorted(self.values, probe, "left")
        count = np.searchsorted(self.values, probe, "right") - lo
        rows = np.repeat(np.arange(len(probe)), count)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        return self.positions[np.repeat(lo, count) + within], rows


class QueryBlock:
    """Scores corpus batches and keeps the best ``n`` per query, or passes on
    every query and key reaching ``floor`` when ``n`` is None.

    A query may own several vectors; its score for a corpus row is then the
    highest of theirs. Exclusion positions index ``owners``.
    """

    def __init__(
        self, qids: np.ndarray, matrix: np.ndarray, n: int | None, metric: str, floor: float | None
    ):
        self.owners, owner = np.unique(qids, return_inverse=True)
        order = np.argsort(owner, kind="stable")
        matrix = matrix[order]
        self.matrix = unit_rows(matrix, np.nan) if metric == "cosine" else matrix
        self.owner = owner[order]
        self.starts = np.searchsorted(self.owner, np.arange(len(self.owners) + 1))
        self.metric = metric
        self.n = n
        self.floor = -np.inf if floor is None else floor
        self.blocks = list(self._owner_blocks())
        if n is not None:
            self.best_score = np.full((len(self.owners), n), -np.inf)
            self.best_key: np.ndarray | None = None

    def _owner_blocks(self):
        """Consecutive owners whose vectors together fill one multiplication."""
        first = 0
        while first < len(self.owners):
            last = int(np.searchsorted(self.starts, self.starts[first] + _SLICE_ROWS, "right")) - 1
            last = min(max(last, first + 1), len(self.owners))
            yield first, last
            first = last

    def exclusions(self, qids: np.ndarray, values: np.ndarray) -> list[Exclusions]:
        """Pairs (query, value) by owner block; other cells' queries are passed over."""
        # owners are sorted, so foreign queries are told apart without a look at each
        found = np.searchsorted(self.owners, qids) if len(qids) else np.empty(0, np.int64)
        found[found == len(self.owners)] = 0
        found = np.where(self.owners[found] == qids, found, -1).astype(np.int64) if len(qids) else found
        order = np.argsort(found, kind="stable")
        found, values = found[order], values[order]
        edges = np.searchsorted(found, [first for first, _ in self.blocks] + [len(self.owners)])
        return [
            Exclusions.of(values[lo:hi], found[lo:hi] - first)
            for (first, _), lo, hi in zip(self.blocks, edges, edges[1:])
        ]

    def _scores(self, queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
        # the queries of a cosine search are unit rows already
        return row_scores(queries, corpus, "mean_cosine" if self.metric == "cosine" else self.metric)

    def feed(self, keys, groups, corpus, key_exclusions, group_exclusions):
        """Score one corpus batch. A threshold search yields what it finds as
        (owner positions, keys, scores, number of vectors at the floor or
        nearer); a top-n search keeps its finds and yields nothing."""
        width = max(_SLICE_CELLS // _SLICE_ROWS, _SLICE_CELLS // max(len(self.matrix), 1))
        for at in range(0, len(keys), width):
            part = slice(at, at + width)
            for number, (first, last) in enumerate(self.blocks):
                queries = self.matrix[self.starts[first] : self.starts[last]]
                scores = self._scores(queries, corpus[part])
                near = scores >= self.floor if self.n is None else None
                if len(queries) > last - first:
                    offsets = self.starts[first:last] - self.starts[first]
                    scores = np.maximum.reduceat(scores, offsets, axis=0)
                    if near is not None:
                        near = np.add.reduceat(near, offsets, axis=0, dtype=np.int64)
                if near is not None:
                    owner, ci = np.nonzero(near)
                    yield owner + first, keys[part][ci], scores[owner, ci], near[owner, ci]
                    continue
                self._drop(scores, key_exclusions[number], keys[part])
                if groups is not None:
                    self._drop(scores, group_exclusions[number], groups[part])
                self._keep(first, scores, keys[part])

    @staticmethod
    def _drop(scores: np.ndarray, exclusions: Exclusions, values: np.ndarray) -> None:
        if not len(exclusions.values):
            return
        present = np.flatnonzero(pd.notna(values))
        owner, row = exclusions.hits(values[present])
        scores[owner, present[row]] = -np.inf

    def _keep(self, first: int, scores: np.ndarray, keys: np.ndarray) -> None:
        span = slice(first, first + len(scores))
        bound = np.maximum(self.best_score[span, -1], self.floor)[:, None]
        wanted = (scores >= bound) & (scores > -np.inf)
        if scores.shape[1] > self.n and wanted.sum() > 4 * self.n * len(scores):
            kth = np.partition(scores, scores.shape[1] - self.n, axis=1)[:, -self.n]
            wanted &= scores >= kth[:, None]
        # Ties with the n-th score stay in: the key decides among them below.
        qi, ci = np.nonzero(wanted)
        if not len(qi):
            return
        if self.best_key is None:
            self.best_key = np.empty(self.best_score.shape, keys.dtype)
        touched = np.unique(qi)
        held = self.best_score[first + touched]
        ht, hc = np.nonzero(held > -np.inf)
        q = np.concatenate([touched[ht], qi])
        score = np.concatenate([held[ht, hc], scores[qi, ci]])
        key = np.concatenate([self.best_key[first + touched[ht], hc], keys[ci]])
        rank = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
        order = np.lexsort((rank, -score, q))
        q, score, key = q[order], score[order], key[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept = place < self.n
        self.best_score[first + touched] = -np.inf
        self.best_score[first + q[kept], place[kept]] = score[kept]
        self.best_key[first + q[kept], place[kept]] = key[kept]

    def best(self):
        owner, place = np.nonzero(self.best_score > -np.inf)
        if not len(owner):
            return owner, np.empty(0, object), np.empty(0)
        return owner, self.best_key[owner, place], self.best_score[owner, place]
