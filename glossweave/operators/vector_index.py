"""Stored indexes over supplied embeddings: blocks that bounds can skip (exact
search), and neighbour graphs (approximate search).

Both place every item in the cell of its nearest pivot, by angle between unit
vectors. Pivots come from a sample of at most `SAMPLE` items (those of smallest
id hash); every item is indexed. Cells of more than a block are cut into rings by
angle to the pivot, a ring that is still larger (many copies) by id.

**Exact search.** The angle between a query and an item is at least the
difference of their angles to the pivot, so a block whose ring is far enough from
the query's angle holds nothing that reaches a score. Each query first searches
the block where it could score best; the k-th score found there is its floor, and
of all other blocks it meets only those whose bound reaches the floor. Blocks lie
in slots of `SLOT_BLOCKS`: a query travels once to every slot in which it meets a
block, and what it finds there raises its floor for the blocks after. Only scores
from the floor on leave a task, k of a query at most. Slots that no query meets
are not read.

**Approximate search.** Each block has a graph: items are linked with their
nearest neighbours, both ways, and with a few random ones. A query walks the
graphs of its nearest blocks, always on from the best item that it has not opened
yet, until the `beam` best are all open. Blocks do not grow with the table, the
blocks that a query walks neither.

Vectors with a norm of zero, or a null or non-finite component, are in no block
and match nothing. Scores are cosines rounded to six places, ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.session import scratch_path, shuffle_partitions

SAMPLE = 20_000
BLOCK_ITEMS = 4_096
#: Summaries of blocks travel with the tasks: blocks grow before there are more.
MOST_BLOCKS = 100_000
MOST_PIVOTS = 1_024
QUERY_PART = 4_096
#: Blocks of a slot, most queries that meet a slot in one task, and the fewest.
SLOT_BLOCKS = 16
SWEEP_PART = 65_536
LEAST_PART = 256
ROUNDS = 4
# angles and scores are compared with this much to spare
SLACK = 2e-6
SCORES = "query_id bigint, vec_id bigint, score double"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = np.asarray(vectors, dtype=np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1))[:, None]


def _sound(column: Column) -> Column:
    """Vectors that have a direction."""
    good = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return column.isNotNull() & good & F.exists(column, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def choose_pivots(items: DataFrame, n: int) -> np.ndarray:
    """`n` unit pivots at most: a few rounds of spherical k-means over the sample,
    begun at items far from each other."""
    sample = items.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column(0)
    if not len(sample):
        return np.zeros((0, 0))
    x = unit_rows(_matrix(sample.combine_chunks()))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    pivots = x[chosen]
    for _ in range(ROUNDS):
        of = (x @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, of, x)
        norms = np.sqrt((sums * sums).sum(1))
        pivots = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], pivots)
    return pivots


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


_BLOCK = "block long, cell int, low double, high double, n int, ids binary, vectors binary, groups array<string>"


@dataclass(frozen=True)
class VectorIndex:
    """Stored blocks, opened, with what travels to the tasks: pivots, and (block,
    cell, low, high) of every block."""

    spark: SparkSession
    path: str
    pivots: np.ndarray
    summary: np.ndarray

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    @property
    def graphs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/graphs")


def write_vector_index(
    items: DataFrame, path: str, group_col: str | None = None, block_items: int = BLOCK_ITEMS, graphs: bool = False
) -> VectorIndex:
    """Write blocks (and graphs) of items (vec_id, embedding[, group_col])."""
    spark = items.sparkSession
    group = F.lit(None) if group_col is None else F.col(group_col)
    rows = items.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", group.cast("string").alias("g")
    ).where(_sound(F.col("embedding")) & F.col("vec_id").isNotNull())
    n = rows.count()
    block_items = max(block_items, -(-n // MOST_BLOCKS))
    pivots = choose_pivots(rows, max(1, min(MOST_PIVOTS, n // block_items)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = unit_rows(_matrix(batch.column(1))) @ pivots.T
            cell = cosines.argmax(1)
            angle = _angles(cosines[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)],
                names=["vec_id", "embedding", "g", "cell", "angle"],
            )

    kind = rows.schema["embedding"].dataType.simpleString()
    placed_at = scratch_path(spark, "placed-vectors")
    rows.mapInArrow(place, f"vec_id long, embedding {kind}, g string, cell int, angle double").write.parquet(placed_at)
    placed = spark.read.parquet(placed_at)
    # rings by quantiles of the angle; one row per cell
    shares = [k / 32 for k in range(1, 32)]
    cells = placed.groupBy("cell").agg(
        F.percentile_approx("angle", shares, 1000).alias("cuts"), F.ceil(F.count("*") / block_items).alias("rings")
    )
    quantile = F.size(F.filter("cuts", lambda c: c < F.col("angle")))
    ring = F.floor(quantile * F.least("rings", F.lit(32)) / 32).cast("int")
    ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", ring).drop("cuts", "rings")
    sizes = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block_items).alias("cuts"))
    cut = ringed.join(F.broadcast(sizes), ["cell", "ring"]).withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        cell, ring_no, cut_no = (k.as_py() for k in key)
        group = group.sort_by("vec_id")
        angle = group.column("angle").to_numpy()
        row = {
            "block": (cell << 40) + (ring_no << 32) + cut_no,
            "cell": cell,
            "low": float(angle.min()),
            "high": float(angle.max()),
            "n": len(angle),
            "ids": group.column("vec_id").to_numpy().astype(np.int64).tobytes(),
            "vectors": _matrix(group.column("embedding").combine_chunks()).tobytes(),
            "groups": group.column("g").to_pylist(),
        }
        return pa.Table.from_pylist([row], _schema(_BLOCK))

    cut.groupBy("cell", "ring", "cut").applyInArrow(pack, _BLOCK).write.parquet(f"{path}/blocks")
    if graphs:
        spark.read.parquet(f"{path}/blocks").select("block", "ids", "vectors", "n").mapInArrow(_graphs, _GRAPH).write.parquet(
            f"{path}/graphs"
        )
    spark.createDataFrame([(pivots.tobytes(), len(pivots))], "pivots binary, n int").write.parquet(f"{path}/pivots")
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    stored = spark.read.parquet(f"{path}/pivots").first()
    pivots = np.frombuffer(stored.pivots, np.float64)
    # at most MOST_BLOCKS rows, or as many as cells have rings
    rows = spark.read.parquet(f"{path}/blocks").select("block", "cell", "low", "high").orderBy("block").collect()
    summary = np.array([tuple(r) for r in rows], [("block", np.int64), ("cell", np.int64), ("low", float), ("high", float)])
    return VectorIndex(spark, path, pivots.reshape(stored.n, -1) if stored.n else np.zeros((0, 0)), summary)


def _schema(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(),
        "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])


# --- exact search ------------------------------------------------------------------


def _bounds(vectors: np.ndarray, pivots: np.ndarray, summary: np.ndarray) -> np.ndarray:
    """Highest cosine that each query can have with an item of each block."""
    at = _angles(vectors @ pivots.T)[:, summary["cell"]]
    least = np.maximum(np.maximum(summary["low"] - at, at - summary["high"]), 0.0)
    return np.cos(least)


def _pairs(queries: DataFrame, index: VectorIndex, choose) -> DataFrame:
    """(query_id, embedding, block) of the blocks that `choose` marks for each
    query, from the bounds and the query's floor."""
    pivots, summary = index.pivots, index.summary
    kind = queries.schema["embedding"].dataType.simpleString()
    step = max(1, 4_000_000 // max(1, len(summary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if len(summary) else 0, step):
                batch = whole.slice(at, step)
                bounds = _bounds(unit_rows(_matrix(batch.column(1))), pivots, summary)
                row, block = np.nonzero(choose(bounds, batch.column(2).to_numpy(zero_copy_only=False)))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(summary["block"][block])],
                    names=["query_id", "embedding", "block"],
                )

    return queries.select("query_id", "embedding", "floor").mapInArrow(
        run, f"query_id bigint, embedding {kind}, block bigint"
    )


def _meeting(pairs: DataFrame, blocks: DataFrame, work, schema: str, query_part: int) -> DataFrame:
    """`work(queries, block row)` for every block and part of its queries; a block
    that many queries meet is many tasks, one that none meets is not read."""
    sizes = pairs.groupBy("block").agg(F.ceil(F.count("*") / query_part).alias("parts"))
    asked = pairs.join(F.broadcast(sizes), "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    zero = F.lit(0).cast("long")
    held = blocks.join(F.broadcast(sizes), "block").withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows and right.num_rows:
            row = right.to_pylist()[0]
            made = work(left.column("query_id").to_numpy(), unit_rows(_matrix(left.column("embedding").combine_chunks())), row)
        query, item, score = made or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": query, "vec_id": item, "score": score})

    return (
        asked.select("query_id", "embedding", "block", "part")
        .groupBy("block", "part")
        .cogroup(held.drop("parts").groupBy("block", "part"))
        .applyInArrow(meet, schema)
    )


def _block_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5) / 1e6


def _best_rows(query: np.ndarray, item: np.ndarray, score: np.ndarray, k: int):
    order = np.lexsort((item, -score, query))
    query, item, score = query[order], item[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], item[keep], score[keep]


def _exact(k: int, by_group: bool):
    def work(query_ids: np.ndarray, queries: np.ndarray, row: dict):
        ids, vectors = _block_of(row)
        unit, found = unit_rows(vectors), []
        groups = None
        if by_group:
            _, groups = np.unique([repr(g) for g in row["groups"]], return_inverse=True)
        step = max(1, 4_000_000 // len(ids))
        for at in range(0, len(query_ids), step):
            scores = _rounded(queries[at : at + step] @ unit.T)
            if by_group:
                # the best item of each group
                q, best = [], []
                for g in range(groups.max() + 1):
                    mine = np.nonzero(groups == g)[0]
                    best.append(mine[scores[:, mine].argmax(1)])
                    q.append(np.arange(len(scores)))
                q, col = np.concatenate(q), np.concatenate(best)
            else:
                cut = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                q, col = np.nonzero(scores >= cut[:, None])
            found.append(_best_rows(query_ids[at : at + step][q], ids[col], scores[q, col], k))
        return tuple(np.concatenate(c) for c in zip(*found))

    return work


def _slots_met(queries: DataFrame, index: VectorIndex, slot_blocks: int) -> DataFrame:
    """(query_id, embedding, floor, home, slot) of the slots in which each query
    meets a block besides its home, by its floor."""
    pivots, summary = index.pivots, index.summary
    kind = queries.schema["embedding"].dataType.simpleString()
    first = np.arange(0, len(summary), slot_blocks)
    step = max(1, 1_000_000 // max(1, len(summary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if len(summary) else 0, step):
                batch = whole.slice(at, step)
                bounds = _bounds(unit_rows(_matrix(batch.column(1))), pivots, summary)
                home = bounds.argmax(1)
                met = bounds + SLACK >= batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                met[np.arange(len(met)), home] = False
                row, slot = np.nonzero(np.logical_or.reduceat(met, first, axis=1))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(rows) for c in batch.columns), pa.array(summary["block"][home[row]]), pa.array(slot)],
                    names=["query_id", "embedding", "floor", "home", "slot"],
                )

    return queries.select("query_id", "embedding", "floor").mapInArrow(
        run, f"query_id bigint, embedding {kind}, floor double, home bigint, slot bigint"
    )


class _Sweep:
    """Queries against one block after another, each above its own floor; keeps
    the k best of each (`by_group`: the best item of the k best groups)."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, floor: np.ndarray, k: int, by_group: bool):
        self.ids, self.unit, self.floor, self.k, self.by_group = ids, unit, floor.copy(), k, by_group
        self.codes: dict[str, int] = {}
        self.query, self.item, self.group = (np.zeros(0, np.int64) for _ in range(3))
        self.score = np.zeros(0)

    def block(self, row: dict, asked: np.ndarray) -> None:
        ids, vectors = _block_of(row)
        unit, group, found = unit_rows(vectors), np.arange(len(ids)), []
        if self.by_group:
            group = np.array([self.codes.setdefault(repr(g), len(self.codes)) for g in row["groups"]], np.int64)
        step = max(1, 1_000_000 // len(ids))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            # scores are rounded: they may be half a unit of the sixth place higher
            q, col, score = self._above(self.unit[some] @ unit.T, self.floor[some] - 1e-6, group)
            score = _rounded(score)
            good = score >= self.floor[some[q]]
            q, col, score = q[good], col[good], score[good]
            if len(q):
                found.append(self._best(some[q], ids[col], group[col], score))
        if not found:
            return
        query, item, group, score = (np.concatenate(c) for c in zip(*found))
        mine = np.isin(self.query, query)
        held = self.query, self.item, self.group, self.score
        best = self._best(*(np.concatenate([old[mine], new]) for old, new in zip(held, (query, item, group, score))))
        full = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == self.k - 1
        self.floor[best[0][full]] = np.maximum(self.floor[best[0][full]], best[3][full])
        self.query, self.item, self.group, self.score = (np.concatenate([old[~mine], new]) for old, new in zip(held, best))

    def _above(self, scores: np.ndarray, floor: np.ndarray, group: np.ndarray):
        """(query, column, score) of what can be among the k best."""
        if self.by_group:
            parts = []
            for g in np.unique(group):
                mine = np.flatnonzero(group == g)
                # rounding makes ties, of which the smaller id is wanted
                here = _rounded(scores[:, mine])
                best = here.argmax(1)
                q = np.flatnonzero(here[np.arange(len(here)), best] >= floor)
                parts.append((q, mine[best[q]], scores[q, mine[best[q]]]))
            return tuple(np.concatenate(c) for c in zip(*parts))
        q, col = np.nonzero(scores >= floor[:, None])
        if len(q) > 4 * self.k * len(scores) and scores.shape[1] > self.k:
            cut = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            q, col = np.nonzero(scores >= np.maximum(cut - 1e-6, floor)[:, None])
        return q, col, scores[q, col]

    def _best(self, query: np.ndarray, item: np.ndarray, group: np.ndarray, score: np.ndarray):
        order = np.lexsort((item, -score, query))
        if self.by_group:
            _, first = np.unique(query[order] * len(self.codes) + group[order], return_index=True)
            order = order[np.sort(first)]
        query, item, group, score = query[order], item[order], group[order], score[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        return query[kept], item[kept], group[kept], score[kept]


def _swept(queries: DataFrame, index: VectorIndex, k: int, by_group: bool, sweep_part: int, slot_blocks: int) -> DataFrame:
    """(query_id, vec_id, score) that reach the floor of a query (query_id,
    embedding, floor) in the blocks besides its home."""
    spark, pivots, summary = index.spark, index.pivots, index.summary
    slots = -(-len(summary) // slot_blocks)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(shuffle_partitions(spark), 2 * cores)
    few = -(-2 * cores // max(1, slots))
    # read twice below: the slots' sizes come first
    met_at = scratch_path(spark, "slots-met")
    _slots_met(queries, index, slot_blocks).write.parquet(met_at)
    met = spark.read.parquet(met_at)
    parts = F.greatest(F.ceil(F.count("*") / sweep_part), F.least(F.lit(few), F.ceil(F.count("*") / LEAST_PART)))
    sizes = met.groupBy("slot").agg(parts.alias("parts"))
    asked = met.join(F.broadcast(sizes), "slot").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    place = spark.createDataFrame(
        [(int(b), at // slot_blocks) for at, b in enumerate(summary["block"])], "block bigint, slot bigint"
    )
    held = (
        index.blocks.join(F.broadcast(place.join(F.broadcast(sizes), "slot")), "block")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("block", "ids", "vectors", "groups", "slot", "part")
    )

    def sweep(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        query, item, score = empty, empty, np.zeros(0)
        if left.num_rows and right.num_rows:
            unit = unit_rows(_matrix(left.column("embedding").combine_chunks()))
            home = left.column("home").to_numpy()
            search = _Sweep(left.column("query_id").to_numpy(), unit, left.column("floor").to_numpy(), k, by_group)
            here = summary[np.isin(summary["block"], right.column("block").to_numpy())]
            bounds = np.concatenate([_bounds(unit[at : at + 4_096], pivots, here) for at in range(0, len(unit), 4_096)])
            for at in range(right.num_rows):
                row = right.slice(at, 1).to_pylist()[0]
                bound = bounds[:, np.searchsorted(here["block"], row["block"])]
                asked_here = np.flatnonzero((bound + SLACK >= search.floor) & (home != row["block"]))
                if len(asked_here):
                    search.block(row, asked_here)
            query, item, score = search.ids[search.query], search.item, search.score
        return pa.table({"query_id": query, "vec_id": item, "score": score})

    # few bytes, much work: a partition of few groups each, whatever their bytes
    by = ["slot", "part"]
    left = asked.select("query_id", "embedding", "floor", "home", *by).repartition(tasks, *by)
    return left.groupBy(*by).cogroup(held.repartition(tasks, *by).groupBy(*by)).applyInArrow(sweep, SCORES)


def pruned_search(
    queries: DataFrame,
    index: VectorIndex,
    k: int = 10,
    groups: DataFrame | None = None,
    query_part: int = QUERY_PART,
    sweep_part: int = SWEEP_PART,
    slot_blocks: int = SLOT_BLOCKS,
) -> DataFrame:
    """(query_id, vec_id, score, rank): exact k nearest items by cosine, reading
    only blocks that can hold them. With `groups` (vec_id, g) of an index that was
    written with a group column: the best item of each group, then the k best
    groups (and `g`)."""
    by_group = groups is not None
    sound = queries.select("query_id", "embedding").where(_sound(F.col("embedding")))
    asked = sound.withColumn("floor", F.lit(0.0))
    first = _pairs(asked, index, lambda bounds, _: np.arange(bounds.shape[1]) == bounds.argmax(1)[:, None])
    home = scratch_path(index.spark, "home-scores")
    _meeting(first, index.blocks, _exact(k, by_group), SCORES, query_part).write.parquet(home)
    found = index.spark.read.parquet(home)
    # the k-th score is a floor only where there are k
    floors = (
        found.groupBy("query_id")
        .agg(F.min("score").alias("low"), F.count("*").alias("n"))
        .select("query_id", F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).alias("floor"))
    )
    rest = _swept(sound.join(floors, "query_id"), index, k, by_group, sweep_part, slot_blocks)
    every = found.unionByName(rest)
    if by_group:
        named = every.join(groups, "vec_id")
        first_of = Window.partitionBy("query_id", "g").orderBy(F.desc("score"), "vec_id")
        every = named.withColumn("_n", F.row_number().over(first_of)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks_met(queries: DataFrame, index: VectorIndex, floor: float) -> DataFrame:
    """(query_id, met, blocks): blocks that each query has to read to find all
    that score `floor` or more."""
    asked = queries.select("query_id", "embedding", F.lit(floor).alias("floor")).where(_sound(F.col("embedding")))
    met = _pairs(asked, index, lambda bounds, low: bounds + SLACK >= low[:, None]).groupBy("query_id").agg(F.count("*").alias("met"))
    return asked.select("query_id").join(met, "query_id", "left").select(
        "query_id", F.coalesce("met", F.lit(0)).alias("met"), F.lit(len(index.summary)).alias("blocks")
    )


# --- approximate search --------------------------------------------------------------

LINKS = 16
LONG_LINKS = 6
ENTRIES = 24
BEAM = 64
_GRAPH = "block long, ids binary, vectors binary, links binary, width int, entries binary"


class Graph:
    """A navigable graph over the items of a block. `opened` counts the items
    that walks have compared with a query."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, links: np.ndarray, entries: np.ndarray):
        self.ids, self.unit, self.links, self.entries = ids, unit, links, entries
        self.opened = 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        unit = unit_rows(vectors).astype(np.float32)
        n = len(ids)
        random = np.random.default_rng(n)
        near = min(LINKS, n - 1)
        nearest = np.zeros((n, near), np.int32)
        for at in range(0, n, 512):
            scores = unit[at : at + 512] @ unit.T
            scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -2
            if near:
                nearest[at : at + 512] = np.argpartition(scores, n - near, axis=1)[:, n - near :]
        # links go both ways: the reverse of each, as many as there is room for
        source = np.repeat(np.arange(n, dtype=np.int32), near)
        back = np.full((n, LINKS), -1, np.int32)
        target = nearest.reshape(-1)
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        fits = place < LINKS
        back[target[fits], place[fits]] = source[fits]
        far = random.integers(0, n, size=(n, LONG_LINKS)).astype(np.int32)
        links = np.concatenate([nearest, back, far], axis=1)
        entries = random.permutation(n)[:ENTRIES].astype(np.int32)
        return cls(ids, unit, links, entries)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores), best first, k for each query; -1 where there is none.
        All queries walk at once, one step of each at a time."""
        n, m = len(self.ids), len(queries)
        beam = min(max(beam, k), n)
        queries = queries.astype(np.float32)
        seen = np.zeros((m, n), bool)
        at = np.broadcast_to(self.entries, (m, len(self.entries)))
        seen[:, self.entries] = True
        score = queries @ self.unit[self.entries].T
        self.opened += m * len(self.entries)
        held, best, open_ = self._kept(at, score, np.ones(at.shape, bool), beam)
        walking = np.arange(m)
        while len(walking):
            ready = np.where(open_[walking], best[walking], -np.inf)
            col = ready.argmax(1)
            on = ready[np.arange(len(walking)), col] > -np.inf
            walking, col = walking[on], col[on]
            if not len(walking):
                break
            open_[walking, col] = False
            found = self.links[held[walking, col]]
            fresh = (found >= 0) & ~seen[walking[:, None], np.maximum(found, 0)]
            # an item linked twice counts once
            ordered = np.sort(np.where(fresh, found, -1), axis=1)
            ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
            q, c = np.nonzero(ordered >= 0)
            item = ordered[q, c]
            seen[walking[q], item] = True
            self.opened += len(item)
            value = np.full(ordered.shape, -np.inf, np.float32)
            value[q, c] = np.einsum("ij,ij->i", queries[walking[q]], self.unit[item])
            held[walking], best[walking], open_[walking] = self._kept(
                np.concatenate([held[walking], ordered], axis=1),
                np.concatenate([best[walking], value], axis=1),
                np.concatenate([open_[walking], value > -np.inf], axis=1),
                beam,
            )
        order = np.argsort(-best, axis=1, kind="stable")[:, :k]
        rows = np.take_along_axis(held, order, axis=1)
        return np.where(np.take_along_axis(best, order, axis=1) > -np.inf, rows, -1), order

    @staticmethod
    def _kept(at, score, open_, beam: int):
        if at.shape[1] > beam:
            order = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            return tuple(np.ascontiguousarray(np.take_along_axis(x, order, axis=1)) for x in (at, score, open_))
        pad = beam - at.shape[1]
        return (
            np.pad(at, ((0, 0), (0, pad)), constant_values=-1),
            np.pad(score, ((0, 0), (0, pad)), constant_values=-np.inf),
            np.pad(open_, ((0, 0), (0, pad)), constant_values=False),
        )


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            graph = Graph.build(*_block_of(row))
            made = {
                "block": row["block"], "ids": row["ids"], "vectors": row["vectors"], "links": graph.links.tobytes(),
                "width": graph.links.shape[1], "entries": graph.entries.tobytes(),
            }
            yield pa.RecordBatch.from_pylist([made], _schema(_GRAPH))


def _walk(k: int, beam: int):
    def work(query_ids: np.ndarray, queries: np.ndarray, row: dict):
        ids, vectors = _block_of(row)
        unit = unit_rows(vectors)
        links = np.frombuffer(row["links"], np.int32).reshape(len(ids), row["width"])
        graph = Graph(ids, unit.astype(np.float32), links, np.frombuffer(row["entries"], np.int32))
        found, step = [], max(1, 8_000_000 // len(ids))
        for at in range(0, len(query_ids), step):
            rows, _ = graph.search(queries[at : at + step], k, beam)
            q, c = np.nonzero(rows >= 0)
            item = rows[q, c]
            exact = _rounded(np.einsum("ij,ij->i", queries[at + q], unit[item]))
            found.append(_best_rows(query_ids[at + q], ids[item], exact, k))
        return tuple(np.concatenate(c) for c in zip(*found))

    return work


def graph_search(
    queries: DataFrame,
    index: VectorIndex,
    k: int = 10,
    probes: int = 8,
    beam: int = BEAM,
    query_part: int = QUERY_PART,
) -> DataFrame:
    """(query_id, vec_id, score, rank): approximate k nearest items, by walks over
    the graphs of the `probes` blocks that come nearest to the query. The index is
    written with `graphs=True`."""
    asked = queries.select("query_id", "embedding", F.lit(0.0).alias("floor")).where(_sound(F.col("embedding")))

    def nearest(bounds: np.ndarray, _) -> np.ndarray:
        chosen = np.zeros(bounds.shape, bool)
        few = np.argsort(-bounds, axis=1, kind="stable")[:, :probes]
        np.put_along_axis(chosen, few, True, axis=1)
        return chosen

    found = _meeting(_pairs(asked, index, nearest), index.graphs, _walk(k, beam), SCORES, query_part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
