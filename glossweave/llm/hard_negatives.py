"""Hard-negative mining by threshold joins over suffix-bounded indexes.

Anchors meet all rows in blocks: both sides are dealt by hash, each pair of
blocks is one bounded task, and only winners leave it. Within a pair of blocks a
threshold join after L2AP finds all pairs that score a threshold or more:

* Dimensions have one order, strongest first. The index of a block leaves out the
  leading dimensions of a row while the norm up to there, times the norm of the
  largest anchor, stays under the threshold: rows that meet an anchor only there
  cannot reach it.
* Indexed dimensions are taken from the last back. A pair is dropped once its
  partial score plus the product of what remains of both norms is under the
  threshold. What survives is finished with the dimensions before, those left out
  of the index included.
* Thresholds start high, where a sample of the block says that a few more rows
  than are wanted will be, and are lowered, anchor by anchor, until the anchor's
  windows are full or the least score that can count is reached. Windows that are
  full at a threshold hold the best of the block, since nothing above it is
  missing; the best of all blocks are among the best of each.

The first join fills, per anchor, the `positives` best rows of its own label; the
second, per anchor and positive, the `negatives` best rows of other labels with
low * positive_score <= 100 * score <= high * positive_score.

Scores are exact integers (floats only where all sums stay below 2^53).

A row takes part with an id, a label and a vector without null, NaN or infinite
components whose scores are sure to fit a long: (length of the longest vector) *
(largest component as an integer)^2 < 2^62. Shorter vectors are filled up with
zeros; an empty vector scores zero. Rows that are equal in id, label and vector
count once; a row is never its own anchor's positive or negative by its id.
Anchors that share an id but not the row are different anchors of that id, each
with its own results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.session import scratch_path, shuffle_partitions

ANCHOR_BLOCK = 4_096
ITEM_BLOCK = 16_384
# pairs held as one matrix
CELLS = 2_000_000
# rows of a block whose scores say where thresholds may begin
SAMPLE = 256
# winners that a first threshold is meant to find, for each that is wanted
SPARE = 4
# below this share of surviving pairs they are finished one by one
SPARSE = 0.005
MOST = 1 << 62
# thresholds that every score, or none, reaches
EVERY, NONE = -(1 << 62), 1 << 62


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _block(column: Column, blocks: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(blocks)).cast("int")


# --- vectors ---------------------------------------------------------------------


def integer_rows(
    vectors: DataFrame, id_column: str, label: Column, vector_column: str, scale: int = 256
) -> DataFrame:
    """(id, label, row): rows that take part, as packed 64-bit integers of
    floor(scale * x), each filled up to the longest vector."""
    x = F.col(vector_column)
    # beyond this size no score is sure to fit
    largest = float(1 << 31)

    def sound(v: Column) -> Column:
        return F.coalesce((v * scale < largest) & (v * scale > -largest) & ~F.isnan(v), F.lit(False))

    doubles = F.transform(x, lambda v: v.cast("double"))
    rows = (
        vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), doubles.alias("x"))
        .where("id is not null and label is not null and x is not null")
        .where(F.forall("x", sound))
        .select("id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("x"))
        .distinct()
    )
    rows = _written(rows, "integer-vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for values in batch.column(2).to_pylist():
                row = np.zeros(width, np.int64)
                row[: len(values)] = values
                fits = not width or width * max(map(abs, values), default=0) ** 2 < MOST
                packed.append(row.tobytes() if fits else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["id", "label", "row"])

    return rows.mapInArrow(pack, "id long, label long, row binary").where("row is not null")


def _matrix(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), -1)


# --- the threshold join of two blocks ----------------------------------------------


def _number_type(a: np.ndarray, b: np.ndarray):
    """A type that adds products of these rows exactly."""
    if not a.size or not b.size:
        return np.float64
    most = a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max())
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _norms(x: np.ndarray) -> np.ndarray:
    """norms[:, j]: a row's norm over its first j dimensions, rounded up."""
    squares = np.cumsum(x.astype(np.float64) ** 2, axis=1)
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), squares], axis=1)) * (1 + 1e-9)


@dataclass
class BlockIndex:
    """Rows of a block, their dimensions strongest first."""

    order: np.ndarray
    rows: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> BlockIndex:
        strength = (rows.astype(np.float64) ** 2).sum(0)
        order = np.argsort(-strength, kind="stable")
        ordered = np.ascontiguousarray(rows[:, order])
        return cls(order, ordered, _norms(ordered))

    def left_out(self, threshold: float, most: float) -> np.ndarray:
        """Leading dimensions of each row that the index leaves out."""
        return (self.norms[:, 1:] * most < threshold).sum(1)

    def reaching(self, anchors: np.ndarray, thresholds: np.ndarray):
        """(anchor, row, score) of all pairs that score their anchor's threshold
        or more. `anchors` have the index's order of dimensions.

        The last dimensions are summed first, down to where what remains of any
        pair is worth half the least threshold; before that, little can be
        dropped. Only pairs whose sum and remaining norms reach the threshold go
        on: all together while they are many, one by one when they are few."""
        wide, least = anchors.shape[1], thresholds.min(initial=0)
        kind = _number_type(anchors, self.rows)
        typed = anchors.astype(kind)
        if not wide or least <= 0:
            # at or under zero no dimension can be left out
            return _over(typed @ self.rows.astype(kind).T, thresholds, np.arange(len(self.rows)))
        norms = _norms(anchors)
        out = self.left_out(least, norms[:, -1].max())
        alive = np.nonzero(out < wide)[0]
        if not len(alive):
            return _over(np.zeros((len(anchors), 0), kind), thresholds, alive)
        rows, rest = self.rows[alive].astype(kind), self.norms[alive]
        worth = norms.max(0) * rest.max(0)
        half = int(np.searchsorted(worth, least / 2, side="right")) - 1
        at = min(max(half, int(out[alive].max()), 1), wide - 1)
        # postings: dimensions from `at` on are in the index of every row
        partial = typed[:, at:] @ rows[:, at:].T
        wider = np.float32 if kind == np.float32 else np.float64
        # a hair more, for rounded sums
        short = thresholds.astype(wider)[:, None] * wider(1 - 1e-5) - 1 - partial
        keep = norms[:, at].astype(wider)[:, None] * rest[:, at].astype(wider) * wider(1 + 1e-5) >= short
        share = keep.mean()
        if share < SPARSE:
            a, r = np.nonzero(keep)
            return self._finished(anchors, thresholds, a, alive[r])
        used = keep.any(0)
        if not used.all():
            alive, rows, partial = alive[used], rows[used], partial[:, used]
        return _over(partial + typed[:, :at] @ rows[:, :at].T, thresholds, alive)

    def _finished(self, anchors, thresholds, a, r):
        """Scores of the pairs that are left."""
        score = np.empty(len(a), np.int64)
        for at in range(0, len(a), 65_536):
            here = slice(at, at + 65_536)
            score[here] = np.einsum("ij,ij->i", anchors[a[here]], self.rows[r[here]])
        kept = score >= thresholds[a]
        return a[kept], r[kept], score[kept]

    def usual(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The score that about `rows` of the block's rows reach, for each anchor,
        as a sample of them has it."""
        some = self.rows[:: max(1, len(self.rows) // SAMPLE)]
        if not len(some):
            return np.zeros(len(anchors), np.int64)
        kind = _number_type(anchors, some)
        scores = np.sort(anchors.astype(kind) @ some.astype(kind).T, axis=1)[:, ::-1]
        place = np.clip(np.ceil(rows * len(some) / max(1, len(self.rows))).astype(int) - 1, 0, len(some) - 1)
        return scores[np.arange(len(anchors)), place].astype(np.int64)


def _over(scores: np.ndarray, thresholds: np.ndarray, rows: np.ndarray):
    """Pairs at or over their threshold, by whole scores."""
    # in the type of the scores: it holds all of them exactly, and more
    a, r = np.nonzero(scores >= thresholds.astype(scores.dtype)[:, None])
    return a, rows[r], scores[a, r].astype(np.int64)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group, ties by id."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    rank = np.arange(len(order)) - np.searchsorted(ordered, ordered, side="left")
    return order[rank < k]


def _chunks(anchors: int, items: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, items))
    for at in range(0, anchors, step):
        yield slice(at, at + step)


def best_of_own_label(a_ids, a_labels, anchors, ids, labels, index: BlockIndex, k: int):
    """(anchor, row, score): the block's k best rows of each anchor's label."""
    found = []
    # as many rows of any label as are likely to hold enough of the anchor's own
    known, count = np.unique(labels, return_counts=True)
    size = np.zeros(len(anchors), np.int64)
    if len(known):
        place = np.minimum(np.searchsorted(known, a_labels), len(known) - 1)
        size = np.where(known[place] == a_labels, count[place], 0)
    rows = SPARE * k * len(ids) / np.maximum(size, 1)
    levels = [index.usual(anchors, rows), index.usual(anchors, 4 * rows), np.full(len(anchors), EVERY)]
    for part in _chunks(len(anchors), len(ids)):
        todo = np.nonzero(size > 0)[0][part]
        for level in levels:
            if not len(todo):
                break
            a, r, s = index.reaching(anchors[todo], level[todo])
            a = todo[a]
            own = (labels[r] == a_labels[a]) & (ids[r] != a_ids[a])
            a, r, s = a[own], r[own], s[own]
            full = (np.bincount(a, minlength=len(anchors)) >= np.minimum(k, size)) | (level == EVERY)
            won = _best(a, s, ids[r], k)
            won = won[full[a[won]]]
            found.append((a[won], r[won], s[won]))
            todo = todo[~full[todo]]
    return _joined(found, 3)


def best_in_windows(a_ids, a_labels, anchors, least, most, ids, labels, index: BlockIndex, k: int):
    """(anchor, window, row, score): the block's k best rows of other labels in
    each window. `least` and `most`: a row per anchor, a column per window; where
    there is none, `NONE` and `EVERY`."""
    found = []
    floor = least.min(axis=1, initial=NONE)
    has = np.nonzero(floor < NONE)[0]
    # under the lowest upper end, or lower where scores are usually lower
    top = np.where(most > EVERY, most, NONE).min(axis=1, initial=NONE)
    first = np.minimum(index.usual(anchors, np.full(len(anchors), 4 * SPARE * k)), (top * 0.97).astype(np.int64))
    levels = [np.maximum(x, floor) for x in (first, np.minimum(first, (top * 0.8).astype(np.int64)), floor)]
    for part in _chunks(len(has), len(ids)):
        todo = has[part]
        for level in levels:
            if not len(todo):
                break
            a, r, s = index.reaching(anchors[todo], level[todo])
            a = todo[a]
            other = (labels[r] != a_labels[a]) & (ids[r] != a_ids[a])
            a, r, s = a[other], r[other], s[other]
            full, won = np.ones(len(anchors), bool), []
            for w in range(least.shape[1]):
                inside = np.nonzero((s >= least[a, w]) & (s <= most[a, w]))[0]
                best = inside[_best(a[inside], s[inside], ids[r[inside]], k)]
                won.append((a[best], np.full(len(best), w), r[best], s[best]))
                full &= (np.bincount(a[best], minlength=len(anchors)) >= k) | (level <= least[:, w])
            for rows in won:
                kept = full[rows[0]]
                found.append(tuple(c[kept] for c in rows))
            todo = todo[~full[todo]]
    return _joined(found, 4)


def _joined(found, columns: int):
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(columns))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(columns))


# --- blocks ------------------------------------------------------------------------


def _paired(anchors: DataFrame, rows: DataFrame, anchor_block: int, item_block: int):
    """Both sides grouped so that each block of anchors meets each of rows."""
    tasks = shuffle_partitions(rows.sparkSession)
    n_anchors, n_rows = anchors.count(), rows.count()
    a_blocks = max(1, -(-n_anchors // anchor_block))
    r_blocks = max(1, -(-n_rows // item_block), min(tasks, -(-n_rows // 256)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("a_block", _block(F.col("id"), a_blocks, 1)).withColumn("r_block", every(r_blocks))
    right = rows.withColumn("r_block", _block(F.col("id"), r_blocks, 2)).withColumn("a_block", every(a_blocks))
    return left.groupBy("a_block", "r_block").cogroup(right.groupBy("a_block", "r_block"))


def _columns(frame: pd.DataFrame):
    return frame["id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), _matrix(list(frame["row"]))


def _positives(anchors: DataFrame, rows: DataFrame, k: int, **blocks) -> DataFrame:
    """(anchor_no, anchor_id, positive_id, positive_score)."""

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_no", "anchor_id", "positive_id", "positive_score"]
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        (a_ids, a_labels, a_rows), (ids, labels, b_rows) = _columns(a), _columns(b)
        index = BlockIndex.of(b_rows)
        x, r, s = best_of_own_label(a_ids, a_labels, a_rows[:, index.order], ids, labels, index, k)
        return pd.DataFrame({"anchor_no": a["anchor_no"].to_numpy()[x], "anchor_id": a_ids[x], "positive_id": ids[r], "positive_score": s})

    met = _paired(anchors, rows, **blocks).applyInPandas(
        meet, "anchor_no long, anchor_id long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("anchor_no").orderBy(F.desc("positive_score"), "positive_id")
    return met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def _negatives(anchors: DataFrame, rows: DataFrame, k: int, low: int, high: int, **blocks) -> DataFrame:
    """(anchor_no, anchor_id, positive_id, positive_score, negative_id,
    negative_score); `anchors` carry `positives` (positive_id, positive_score)."""

    names = ["anchor_no", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        (a_ids, a_labels, a_rows), (ids, labels, b_rows) = _columns(a), _columns(b)
        index = BlockIndex.of(b_rows)
        wide = max(map(len, a["positives"]))
        positive, score = np.zeros((2, len(a), wide), np.int64)
        least, most = np.full((len(a), wide), NONE), np.full((len(a), wide), EVERY)
        for n, asked in enumerate(a["positives"]):
            for w, p in enumerate(asked):
                positive[n, w], score[n, w] = p["positive_id"], p["positive_score"]
                value = int(p["positive_score"])
                least[n, w], most[n, w] = -(-low * value // 100), high * value // 100
        x, w, r, s = best_in_windows(a_ids, a_labels, a_rows[:, index.order], least, most, ids, labels, index, k)
        made = (a["anchor_no"].to_numpy()[x], a_ids[x], positive[x, w], score[x, w], ids[r], s)
        return pd.DataFrame(dict(zip(names, made)))

    met = _paired(anchors, rows, **blocks).applyInPandas(meet, ", ".join(f"{c} long" for c in names))
    best = Window.partitionBy("anchor_no", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    anchor_block: int = ANCHOR_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). `rows` as `integer_rows` gives them; `is_anchor` is over id
    and label."""
    blocks = {"anchor_block": anchor_block, "item_block": item_block}
    rows = _written(rows, "vector-rows")
    anchors = _written(rows.where(is_anchor).withColumn("anchor_no", F.monotonically_increasing_id()), "anchors")
    found = _written(_positives(anchors, rows, positives, **blocks), "positives")
    # at most `positives` of an anchor; a window above a score of 0 or less is empty
    lists = found.where("positive_score >= 0").groupBy("anchor_no").agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")
    )
    return _negatives(anchors.join(lists, "anchor_no"), rows, negatives, low, high, **blocks).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
