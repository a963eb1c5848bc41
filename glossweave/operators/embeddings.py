"""Exact and approximate search over supplied embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.session import spread

BROADCAST_QUERIES = 4_096
QUERY_BLOCK = 2_048
ITEM_BLOCK = 16_384
SCHEMA = "query_id bigint, vec_id bigint, score double"


def _unit(vectors) -> np.ndarray:
    wide = np.asarray(list(vectors), dtype=np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))
    norms[norms == 0] = np.nan
    return wide / norms[:, None]


def _best(query_ids, queries: np.ndarray, item_ids, items: np.ndarray, k: int):
    """The k best items per query of one block; ties go to the smaller id."""
    order = np.argsort(item_ids, kind="stable")
    item_ids, items = item_ids[order], items[order]
    step = max(1, 4_000_000 // max(1, len(query_ids)))
    floor = np.full(len(query_ids), -np.inf)
    for at in range(0, len(item_ids), step):
        scores = np.floor(items[at : at + step] @ queries.T * 1e6 + 0.5) / 1e6
        scores[~np.isfinite(scores)] = -np.inf
        n = scores.shape[0]
        if n > k:
            floor = np.maximum(floor, np.partition(scores, n - k, axis=0)[n - k])
        row, col = np.nonzero((scores >= floor) & (scores > -np.inf))
        value = scores[row, col]
        rank = np.lexsort((row, -value, col))
        row, col, value = row[rank], col[rank], value[rank]
        keep = np.arange(len(col)) - np.searchsorted(col, col, side="left") < k
        yield query_ids[col[keep]], item_ids[at + row[keep]], value[keep]


def _best_by_group(query_ids, queries, frame: pd.DataFrame, k: int):
    """Best item of each group, cut to the k best groups per query. Exact per
    block: a group left out is behind k groups whose best items are at least
    these."""
    step = max(1, 4_000_000 // max(1, len(query_ids)))
    for at in range(0, len(frame), step):
        found = [
            triple
            for _, part in frame.iloc[at : at + step].groupby("g", sort=False, dropna=False)
            for triple in _best(
                query_ids,
                queries,
                part["vec_id"].to_numpy(),
                _unit(part["embedding"]),
                1,
            )
        ]
        if not found:
            continue
        query, item, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((item, -score, query))
        query, item, score = query[order], item[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        yield query[keep], item[keep], score[keep]


def _block_scores(
    q: pd.DataFrame, items: pd.DataFrame, k: int, by_group: bool = False
) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    if q.empty or items.empty:
        return empty
    ids, unit = q["query_id"].to_numpy(), _unit(q["embedding"])
    if by_group:
        found = _best_by_group(ids, unit, items, k)
    else:
        found = _best(
            ids, unit, items["vec_id"].to_numpy(), _unit(items["embedding"]), k
        )
    return pd.concat(
        [pd.DataFrame({"query_id": a, "vec_id": b, "score": s}) for a, b, s in found]
    )


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k
    )


def vector_search(
    queries: DataFrame,
    items: DataFrame,
    k: int = 10,
    group_col: str | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    q_block: int = QUERY_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """(query_id, vec_id, score, rank): exact k nearest items by cosine.

    queries (query_id, embedding), items (vec_id, embedding[, group_col]). With
    `group_col`, the best item of each group and then the k best groups.
    """
    if group_col is not None:
        # best per (query, group): score inside each group, then rank the groups
        parts = items.select(F.col(group_col).alias("g"), "vec_id", "embedding")
        scored = _score(
            queries, parts, k, broadcast_queries, q_block, item_block, by_group=True
        )
        groups = items.select("vec_id", F.col(group_col).alias(group_col))
        scored = scored.join(groups, "vec_id")
        first = Window.partitionBy("query_id", group_col).orderBy(F.desc("score"), "vec_id")
        best = scored.withColumn("_n", F.row_number().over(first)).where("_n = 1")
        return _top(best.drop("_n"), k)
    return _top(_score(queries, items, k, broadcast_queries, q_block, item_block), k)


def _score(queries, items, k, broadcast_queries, q_block, item_block, by_group=False):
    rows = queries.select("query_id", "embedding").limit(broadcast_queries + 1).collect()
    spark = items.sparkSession
    if len(rows) <= broadcast_queries:
        packed = spark.sparkContext.broadcast(
            (
                np.array([r.query_id for r in rows], dtype=np.int64),
                [r.embedding for r in rows],
            )
        )

        def score(batches):
            ids, vectors = packed.value
            if not len(ids):
                return
            unit = _unit(vectors)
            for batch in batches:
                frame = batch.to_pandas()
                found = (
                    _best_by_group(ids, unit, frame, k)
                    if by_group
                    else _best(
                        ids,
                        unit,
                        frame["vec_id"].to_numpy(),
                        _unit(frame["embedding"]),
                        k,
                    )
                )
                for a, b, s in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), pa.array(b), pa.array(s)],
                        names=["query_id", "vec_id", "score"],
                    )

        return spread(items, "vec_id").mapInArrow(score, SCHEMA)
    n_q, n_i = queries.count(), items.count()
    left_n, right_n = -(-n_q // q_block), max(1, -(-n_i // item_block))
    left = queries.select(
        "query_id",
        "embedding",
        F.pmod(F.xxhash64("query_id"), F.lit(left_n)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(right_n - 1).cast("bigint"))).alias("ib"),
    )
    right = items.select(
        *items.columns,
        F.pmod(F.xxhash64("vec_id"), F.lit(right_n)).alias("ib"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(left_n - 1).cast("bigint"))).alias("qb"),
    )

    def block(q: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        return _block_scores(q, part, k, by_group)

    return (
        left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(block, SCHEMA)
    )


def approx_matches(
    queries: DataFrame,
    items: DataFrame,
    k: int = 10,
    cells: int = 16,
    probes: int = 4,
    item_block: int = ITEM_BLOCK,
    q_block: int = QUERY_BLOCK,
    seed: int = 17,
) -> DataFrame:
    """(query_id, vec_id, score, rank): approximate k nearest items.

    Items are clustered into cells; a query is compared, exactly, with the items
    of its `probes` nearest cells only. Cells that hold many items are cut into
    parts of bounded size, so a cell with a third of the table is many tasks.
    """
    unit = items.select("vec_id", "embedding").where(
        F.exists("embedding", lambda x: x != 0)
    )
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(
        unit.select(array_to_vector("embedding").alias("features"))
    )
    centres = _unit(model.clusterCenters())

    def nearest_cells(n: int, id_col: str):
        def assign(batches):
            for batch in batches:
                vectors = _unit(batch.column("embedding").to_pylist())
                near = np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col).take(at),
                        batch.column("embedding").take(at),
                        pa.array(near.reshape(-1).astype(np.int64)),
                    ],
                    names=[id_col, "embedding", "cell"],
                )

        return assign

    placed = unit.mapInArrow(
        nearest_cells(1, "vec_id"), "vec_id bigint, embedding array<float>, cell bigint"
    )
    asked = queries.select("query_id", "embedding").mapInArrow(
        nearest_cells(probes, "query_id"),
        "query_id bigint, embedding array<float>, cell bigint",
    )
    # one row per cell
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count("*") / item_block).alias("parts")
    )
    askers = asked.groupBy("cell").agg(F.ceil(F.count("*") / q_block).alias("q_parts"))
    plan = F.broadcast(sizes.join(askers, "cell"))
    right = (
        placed.join(plan, "cell")
        .withColumn("ib", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q_parts") - 1)))
        .select("vec_id", "embedding", "cell", "ib", "qb")
    )
    left = (
        asked.join(plan, "cell")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q_parts")))
        .withColumn("ib", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select("query_id", "embedding", "cell", "ib", "qb")
    )
    by = ["cell", "qb", "ib"]
    scored = (
        left.groupBy(*by)
        .cogroup(right.groupBy(*by))
        .applyInPandas(lambda q, i: _block_scores(q, i, k), SCHEMA)
    )
    return _top(scored, k)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact neighbours the approximate answer found."""
    pairs = exact.select("query_id", "vec_id").join(
        approx.select("query_id", "vec_id", F.lit(1).alias("hit")),
        ["query_id", "vec_id"],
        "left",
    )
    return pairs.agg(
        F.count("*").alias("exact_pairs"),
        F.count("hit").alias("found_pairs"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )
