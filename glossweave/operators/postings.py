"""Numeric side of the stored search index, inside Arrow tasks: blocks of keys as
postings with score bounds, and queries against them.

A block holds up to `BLOCK_KEYS` keys in order of length. Bigrams have postings;
single letters are left out of the index and stand in a small matrix, with their
norm for each key. A query adds up its bigrams' postings and then drops every key
whose sum, plus the product of the two single-letter norms, cannot reach the
score it needs; only what is left meets the matrix. The score it needs is the
threshold or, once k keys are known, the k-th best score so far.

Lengths bound scores as well: with whole counts a dot product is at most the
query's largest count times the key's number of grams, and a key's norm at least
the root of that number. Keys too short for the needed score are never touched.

Many queries meet a block in tiles. Their bigrams are folded into `FOLD` columns:
a product of folded vectors is at least that of the vectors, since counts are not
negative, and it takes one small matrix product for a tile and a block. Only pairs
whose folded product reaches the score that is needed are scored, from the bigrams
of the key. A query without a bound yet gets one from the keys with the largest
folded products.

Scores are cosines rounded to six places; ties go to the smaller key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from glossweave.functions.grams import END, START
from glossweave.operators.kernel import _CODES, SIZE, gram_index, rounded

BLOCK_KEYS = 8_192
PAIRS = SIZE * SIZE
#: Columns that the bigrams of many queries are folded into.
FOLD = 96
_FOLDED = ((np.arange(PAIRS, dtype=np.int64) * 2_654_435_761) % (1 << 32) * FOLD) >> 32
#: Queries of one tile, and the fewest that are searched in tiles.
TILE = 256
TILED = 32
#: Keys that give a query its first bound, for each that is asked for.
FIRST = 4
# scores are rounded: a bound may fall short by half a unit of the sixth place
HAIR = 1e-6
# and folded products are sums of floats of 32 bits
FOLD_HAIR = 1e-4


@dataclass
class Grams:
    """Gram counts of some keys: `single` as a matrix, bigrams as runs of
    (pair, count) from start[i] to start[i + 1]."""

    names: list[str]
    single: np.ndarray
    start: np.ndarray
    pair: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, names: list[str]) -> Grams:
        padded = [f"{START}{k}{END}" for k in names]
        lengths = np.array([len(p) for p in padded], dtype=np.int64)
        codes = _CODES[np.frombuffer("".join(padded).encode("ascii"), dtype=np.uint8)]
        rows = np.repeat(np.arange(len(names), dtype=np.int64), lengths)
        single = np.bincount(rows * SIZE + codes, minlength=len(names) * SIZE)
        inside = rows[1:] == rows[:-1]
        cells = (rows[:-1] * PAIRS + codes[:-1] * SIZE + codes[1:])[inside]
        cells, count = np.unique(cells, return_counts=True)
        start = np.searchsorted(cells, np.arange(len(names) + 1) * PAIRS)
        return cls(names, single.reshape(len(names), SIZE), start, cells % PAIRS, count)

    @classmethod
    def from_counts(cls, names: list[str], vectors: pa.Array) -> Grams:
        """From stored vectors: a list of (gram, tf) for each name."""
        rows = np.repeat(np.arange(len(names), dtype=np.int64), np.diff(vectors.offsets.to_numpy()))
        flat = vectors.flatten()
        tf = flat.field("tf").to_numpy().astype(np.int64)
        named, which = np.unique(np.asarray(flat.field("gram").to_pylist(), dtype=object).astype(str), return_inverse=True)
        column = np.array([gram_index(g) for g in named], dtype=np.int64)[which]
        alone = column < SIZE
        single = np.zeros((len(names), SIZE), dtype=np.int64)
        single[rows[alone], column[alone]] = tf[alone]
        cells, count = rows[~alone] * PAIRS + column[~alone] - SIZE, tf[~alone]
        order = np.argsort(cells)
        cells, count = cells[order], count[order]
        start = np.searchsorted(cells, np.arange(len(names) + 1) * PAIRS)
        return cls(names, single, start, cells % PAIRS, count)

    def __len__(self) -> int:
        return len(self.names)

    def norms2(self) -> tuple[np.ndarray, np.ndarray]:
        """Squared norms of the single letters and of all grams."""
        single = (self.single.astype(np.int64) ** 2).sum(1)
        pairs = np.add.reduceat(np.r_[self.count.astype(np.int64) ** 2, 0], self.start[:-1]) if len(self) else single
        return single, single + pairs

    def largest(self) -> np.ndarray:
        """Largest count of any gram: no bigram is more frequent than its first letter."""
        return self.single.max(1) if len(self) else np.zeros(0, np.int64)


def folded(single: np.ndarray, row: np.ndarray, pair: np.ndarray, count: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Unit vectors of `row`s with their bigrams folded."""
    n = len(single)
    pairs = np.bincount(row * FOLD + _FOLDED[pair], weights=count, minlength=n * FOLD).reshape(n, FOLD)
    return (np.hstack([single, pairs]) / norm[:, None]).astype(np.float32)


PACKED = (
    "block long, keys array<string>, lengths binary, single binary, single_norm binary, norm binary,"
    " starts binary, rows binary, counts binary"
)


def pack(block: int, names: list[str]) -> dict:
    """One block as a row of `PACKED`; `names` sorted by length, then key."""
    return pack_grams(block, Grams.of(names))


def pack_grams(block: int, grams: Grams) -> dict:
    names = grams.names
    single2, all2 = grams.norms2()
    row = np.repeat(np.arange(len(names), dtype=np.int32), np.diff(grams.start))
    order = np.argsort(grams.pair, kind="stable")  # rows stay ascending in a list
    starts = np.searchsorted(grams.pair[order], np.arange(PAIRS + 1)).astype(np.int32)
    return {
        "block": block,
        "keys": names,
        "lengths": np.array([len(n) for n in names], np.int32).tobytes(),
        "single": grams.single.astype(np.float32).tobytes(),
        "single_norm": np.sqrt(single2).tobytes(),
        "norm": all2.astype(np.int64).tobytes(),
        "starts": starts.tobytes(),
        "rows": row[order].tobytes(),
        "counts": grams.count[order].astype(np.float32).tobytes(),
    }


class KeyBlock:
    """A packed block, ready for queries."""

    def __init__(self, row: dict):
        self.names = np.asarray(row["keys"], dtype=object)
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.single = np.frombuffer(row["single"], np.float32).reshape(-1, SIZE)
        self.single_norm = np.frombuffer(row["single_norm"], np.float64)
        self.norm2 = np.frombuffer(row["norm"], np.int64).astype(np.float64)
        self.norm = np.sqrt(self.norm2)
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.rows = np.frombuffer(row["rows"], np.int32)
        self.counts = np.frombuffer(row["counts"], np.float32)

    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bigrams by key: runs of (pair, count) from start[i] to start[i + 1]."""
        order = np.argsort(self.rows, kind="stable")
        pair = np.repeat(np.arange(PAIRS), np.diff(self.starts))[order]
        return np.searchsorted(self.rows[order], np.arange(len(self.names) + 1)), pair, self.counts[order].astype(np.float64)

    @cached_property
    def folded(self) -> np.ndarray:
        """One column for each key."""
        start, pair, count = self.grams
        row = np.repeat(np.arange(len(self.names), dtype=np.int64), np.diff(start))
        return np.ascontiguousarray(folded(self.single, row, pair, count, self.norm).T)

    @cached_property
    def place(self) -> np.ndarray:
        """Place of each key in the order of names."""
        place = np.empty(len(self.names), np.int64)
        place[np.argsort(self.names.astype(str), kind="stable")] = np.arange(len(self.names))
        return place

    def reaching(self, q: Query, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all keys that score `least` or more."""
        need = (least - HAIR) * q.norm  # of the dot product, by the key's norm
        low = 0
        if need > 0:
            # grams of a key: two more letters than it has, and one pair less
            grams = (need / q.largest) ** 2
            low = int(np.searchsorted(self.lengths, (grams - 3) / 2 - HAIR))
        n = len(self.names) - low
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        held, weight = [], []
        for pair, count in zip(q.pairs, q.counts):
            a, b = self.starts[pair], self.starts[pair + 1]
            if low and a < b:
                a += np.searchsorted(self.rows[a:b], low)
            if a < b:
                held.append(self.rows[a:b])
                weight.append(self.counts[a:b] * count)
        if held:
            at = np.concatenate(held)
            dots = np.bincount(at - low if low else at, weights=np.concatenate(weight), minlength=n)
        else:
            dots = np.zeros(n)
        if need > 0:
            kept = np.nonzero(dots + q.single_norm * self.single_norm[low:] >= need * self.norm[low:])[0]
        else:
            kept = np.arange(n)
        row = kept + low
        dots = dots[kept] + self.single[row].astype(np.float64) @ q.single
        score = rounded(dots / np.sqrt(self.norm2[row] * q.norm2))
        good = score >= least
        return row[good], score[good]


@dataclass
class Query:
    pairs: list[int]
    counts: list[int]
    single: np.ndarray
    single_norm: float
    norm2: float
    norm: float
    largest: float


def queries_of(names: list[str]) -> list[Query]:
    grams = Grams.of(names)
    single2, all2 = grams.norms2()
    largest = grams.largest()
    pair, count = grams.pair.tolist(), grams.count.tolist()
    out = []
    for i in range(len(names)):
        a, b = grams.start[i], grams.start[i + 1]
        out.append(
            Query(
                pair[a:b], count[a:b], grams.single[i].astype(np.float64), float(np.sqrt(single2[i])),
                float(all2[i]), float(np.sqrt(all2[i])), float(largest[i]),
            )
        )
    return out


class QueryTiles:
    """Queries in tiles of `TILE`."""

    def __init__(self, names: list[str]):
        self.grams = Grams.of(names)
        self.row = np.repeat(np.arange(len(names), dtype=np.int64), np.diff(self.grams.start))
        self.norm2 = self.grams.norms2()[1].astype(np.float64)
        self.single = self.grams.single.astype(np.float64)
        self.folded = folded(self.grams.single, self.row, self.grams.pair, self.grams.count, np.sqrt(self.norm2))

    def pairs(self, begin: int, end: int) -> np.ndarray:
        """Counts of all bigrams, for the queries from begin to end."""
        a, b = self.grams.start[begin], self.grams.start[end]
        dense = np.zeros((end - begin) * PAIRS)
        dense[(self.row[a:b] - begin) * PAIRS + self.grams.pair[a:b]] = self.grams.count[a:b]
        return dense

    def scores(self, block: KeyBlock, begin: int, dense: np.ndarray, query: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query, counted from `begin`, and a key."""
        start, pair, count = block.grams
        length = start[key + 1] - start[key]
        first = np.cumsum(length) - length
        at = np.repeat(start[key] - first, length) + np.arange(length.sum())
        # no key is without bigrams: its letters have a mark on both sides
        dots = np.add.reduceat(dense[np.repeat(query * PAIRS, length) + pair[at]] * count[at], first)
        dots += np.einsum("ij,ij->i", block.single[key].astype(np.float64), self.single[begin + query])
        return rounded(dots / np.sqrt(block.norm2[key] * self.norm2[begin + query]))


class Search:
    """A list of queries against one block after another; keeps each query's k
    best scores so far (k None: all that reach the threshold)."""

    def __init__(self, names: list[str], k: int | None, threshold: float | None, inclusive: bool):
        self.names = np.asarray(names, dtype=object)
        self.k, self.inclusive = k, inclusive
        self.threshold = -np.inf if threshold is None else threshold
        if len(names) >= TILED:
            self.tiles = QueryTiles(list(names))
            self.scored = np.full((len(names), k or 0), -np.inf)
        else:
            self.queries = queries_of(list(names))
            self.best = [np.zeros(0)] * len(names)

    def block(self, block: KeyBlock):
        """(q_key, key, score) arrays of the rows of one block that can still be
        among the best. Exact: a key is left out only behind k others."""
        if not len(block.names):
            return None
        if len(self.names) < TILED:
            found = self._one_by_one(block)
        else:
            found = [self._tile(block, at) for at in range(0, len(self.names), TILE)]
        found = [f for f in found if len(f[0])]
        if not found:
            return None
        i, row, score = (np.concatenate(c) for c in zip(*found))
        return self.names[i], block.names[row], score

    def _tile(self, block: KeyBlock, begin: int):
        tiles, k, keys = self.tiles, self.k, len(block.names)
        end = min(begin + TILE, len(self.names))
        n, dense = end - begin, tiles.pairs(begin, end)
        bound = tiles.folded[begin:end] @ block.folded
        least = np.full(n, self.threshold)
        if k is not None:
            least = np.maximum(least, self.scored[begin:end, 0])
            new = np.nonzero(least == -np.inf)[0]
            if len(new) and keys >= k:
                some = min(keys, FIRST * k)
                key = np.argpartition(bound[new], keys - some, axis=1)[:, keys - some :]
                score = tiles.scores(block, begin, dense, np.repeat(new, some), key.ravel()).reshape(-1, some)
                least[new] = np.partition(score, some - k, axis=1)[:, some - k]
        at = np.flatnonzero(bound >= (least - FOLD_HAIR).astype(np.float32)[:, None])
        query = at // keys
        row = at - query * keys
        if not len(at):
            return query, row, np.zeros(0)
        score = tiles.scores(block, begin, dense, query, row)
        good = score >= least[query]
        if not self.inclusive:
            good &= score > self.threshold
        query, row, score = query[good], row[good], score[good]
        if k is not None and len(query):
            order = np.lexsort((block.place[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            nth = np.arange(len(query)) - np.searchsorted(query, query, side="left")
            query, row, score, nth = (c[nth < k] for c in (query, row, score, nth))
            here = np.full((n, k), -np.inf)
            here[query, nth] = score
            self.scored[begin:end] = np.sort(np.hstack([self.scored[begin:end], here]), axis=1)[:, k:]
        return begin + query, row, score

    def _one_by_one(self, block: KeyBlock) -> list:
        found = []
        for i, q in enumerate(self.queries):
            best = self.best[i]
            full = self.k is not None and len(best) == self.k
            least = max(self.threshold, best[0]) if full else self.threshold
            row, score = block.reaching(q, least)
            if not self.inclusive:
                above = score > self.threshold
                row, score = row[above], score[above]
            if self.k is not None and len(row):
                if len(row) > self.k:
                    # rows are in order of length: ties need the names
                    cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
                    some = score >= cut
                    row, score = row[some], score[some]
                    if len(row) > self.k:
                        order = np.lexsort((block.names[row].astype(str), -score))[: self.k]
                        row, score = row[order], score[order]
                self.best[i] = np.sort(np.r_[best, score])[-self.k :]
            found.append((np.full(len(row), i), row, score))
        return found
