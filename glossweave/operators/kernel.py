"""Numeric helper that runs inside Arrow tasks: score one block of items
against one block of queries and keep each query's best few.

Scores are cosines rounded to six places; ties go to the smaller item name.
"""

from __future__ import annotations

import numpy as np

from glossweave.functions.grams import END, START

ALPHABET = START + END + " abcdefghijklmnopqrstuvwxyz"
SIZE = len(ALPHABET)
DIMS = SIZE + SIZE * SIZE
SCORE_CELLS = 4_000_000  # cells of one score matrix: 32 MB of doubles
# room for the rounding of scores and of bounds in floats of 32 bits
NEAR = 1e-4

_CODES = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i


def gram_index(gram: str) -> int:
    """Column of a unigram or bigram in the full gram matrix."""
    codes = [ALPHABET.index(c) for c in gram]
    return codes[0] if len(codes) == 1 else SIZE + codes[0] * SIZE + codes[1]


def gram_matrix(keys: list[str]) -> np.ndarray:
    """Gram counts, one row per key; an empty key is a row of zeros."""
    padded = [f"{START}{k}{END}" if k else "" for k in keys]
    lengths = np.array([len(p) for p in padded], dtype=np.int64)
    codes = _CODES[np.frombuffer("".join(padded).encode("ascii"), dtype=np.uint8)]
    rows = np.repeat(np.arange(len(keys), dtype=np.int64), lengths)
    inside = rows[1:] == rows[:-1]
    pairs = SIZE + codes[:-1] * SIZE + codes[1:]
    cells = np.concatenate(
        [rows * DIMS + codes, (rows[:-1] * DIMS + pairs)[inside]]
    )
    counts = np.bincount(cells, minlength=len(keys) * DIMS)
    return counts.astype(np.float32).reshape(len(keys), DIMS)


def exact(matrix: np.ndarray) -> np.ndarray:
    """The counts in a type that adds their products exactly: floats of 32 bits
    hold whole numbers below 2^24, so rows summing to less than 4,096 are safe."""
    if matrix.size and matrix.sum(axis=1).max() >= 4096:
        return matrix.astype(np.float64)
    return matrix


def unit_free_norm2(matrix: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", matrix, matrix).astype(np.float64)


def rounded(cosine: np.ndarray) -> np.ndarray:
    return np.floor(cosine * 1e6 + 0.5) / 1e6


class QueryBlock:
    """A block of query vectors with the best score floor seen so far; `k` None
    keeps all that reach the threshold."""

    def __init__(self, matrix: np.ndarray, k: int | None, threshold=None, inclusive=True):
        matrix = exact(matrix)
        # grams that no query has add nothing to a product
        self.columns = np.flatnonzero(matrix.any(axis=0))
        self.matrix = np.ascontiguousarray(matrix[:, self.columns].T)
        self.norm2 = unit_free_norm2(matrix)
        self.k = k
        self.threshold = threshold
        self.inclusive = inclusive
        self.floor = np.full(matrix.shape[0], -np.inf)

    def rows_per_step(self) -> int:
        return int(max(1, min(2048, SCORE_CELLS // max(1, len(self.norm2)))))

    def scores(self, items: np.ndarray) -> np.ndarray:
        items = exact(items)
        dots = (items[:, self.columns] @ self.matrix).astype(np.float64)
        norms = np.sqrt(unit_free_norm2(items)[:, None] * self.norm2[None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = dots / norms
        cosine = rounded(cosine)
        cosine[~np.isfinite(cosine)] = -np.inf
        if self.threshold is not None:
            low = (
                cosine < self.threshold
                if self.inclusive
                else cosine <= self.threshold
            )
            cosine[low] = -np.inf
        return cosine

    def reaching(self, items: np.ndarray):
        """(query, item, score) arrays of all pairs that reach a positive threshold.
        Products are compared with what the threshold needs, a little less for
        floats of 32 bits, and scores are made of those that come near it."""
        items = exact(items)
        dots = items[:, self.columns] @ self.matrix
        norm2 = unit_free_norm2(items)
        need = (np.sqrt(norm2) * (self.threshold - NEAR)).astype(dots.dtype)
        near = np.flatnonzero(dots >= need[:, None] * np.sqrt(self.norm2).astype(dots.dtype))
        at, query = np.divmod(near, len(self.norm2))
        with np.errstate(divide="ignore", invalid="ignore"):
            score = rounded(dots.ravel()[near].astype(np.float64) / np.sqrt(norm2[at] * self.norm2[query]))
        good = score >= self.threshold if self.inclusive else score > self.threshold
        return query[good], at[good], score[good]

    def best(self, items: np.ndarray):
        """(query, item, score) arrays of the items of one block, given in name
        order, that can still be among a query's k best. Exact: an item is left
        out only below k others."""
        k = self.k
        if k is None and self.threshold is not None and self.threshold > NEAR:
            return self.reaching(items)
        cosine = self.scores(items)
        n = cosine.shape[0]
        if k is None:
            at, query = np.nonzero(cosine > -np.inf)
            return query, at, cosine[at, query]
        if n > k:
            kth = np.partition(cosine, n - k, axis=0)[n - k]
            self.floor = np.maximum(self.floor, kth)
        at, query = np.nonzero((cosine >= self.floor) & (cosine > -np.inf))
        score = cosine[at, query]
        order = np.lexsort((at, -score, query))
        at, query, score = at[order], query[order], score[order]
        first = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - first < k
        return query[keep], at[keep], score[keep]
