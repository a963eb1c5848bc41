"""A search index on storage: key blocks with postings, and the lexicon's entries
ranked by key.

`write_index` computes keys' grams once. An index is a folder of three tables:

* `blocks`: distinct keys in blocks of bounded size (see `postings`);
* `signatures`: the smallest key of each vector, for queries that equal one;
* `entries`: the lexicon with each entry's rank in its key (`key_rank`) and among
  the entries of its key and word (`word_rank`), and whether its word is the
  first of its key (`first_word`). Searches filter on these ranks; a key that has
  very many entries is never ranked at search time.

Searching reads blocks where they lie: up to `BROADCAST_QUERIES` distinct queries
(counted first) travel to the tasks; more are packed, and each pack meets each
slot of blocks in a task of bounded size. A slot holds as many blocks as leave
every core its groups, so that what a query has found bounds the blocks after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.functions.grams import signature
from glossweave.operators import versions
from glossweave.operators.postings import BLOCK_KEYS, PACKED, Grams, KeyBlock, Search, pack, pack_grams
from glossweave.session import shuffle_partitions

BROADCAST_QUERIES = 100_000
KEY_SCORES = "q_key string, key string, score double"
#: Entry ids that are ranked in one place.
STRETCH = 10_000
#: Most blocks of a slot, groups of a pack and a slot for each core, and the
#: partitions for each group: hashing puts few groups together.
SLOT_BLOCKS = 32
CORE_GROUPS = 4
GROUP_PARTITIONS = 8


@dataclass(frozen=True)
class SearchIndex:
    """A stored index, opened."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def blocks(self) -> DataFrame:
        return self._table("blocks")

    @property
    def signatures(self) -> DataFrame:
        return self._table("signatures")

    @property
    def entries(self) -> DataFrame:
        return self._table("entries")


def key_blocks(keys: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """`PACKED` blocks of distinct non-empty keys (key). Hashing deals the keys
    evenly whatever they are; inside a task they are in order of length."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        held, made = [], 0
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= block_keys:
                yield _batch(pack(task + made, held[:block_keys]))
                held, made = held[block_keys:], made + 1
        if held:
            yield _batch(pack(task + made, held))

    return (
        keys.select("key")
        .repartition(shuffle_partitions(keys.sparkSession), "key")
        .sortWithinPartitions(F.length("key"), "key")
        .mapInArrow(packed, PACKED)
    )


def vector_blocks(vectors: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """`PACKED` blocks of (key, vector) with vectors as arrays of (gram, tf)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        made = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_keys):
                part = batch.slice(at, block_keys)
                counted = Grams.from_counts(part.column(0).to_pylist(), part.column(1))
                yield _batch(pack_grams(task + made, counted))
                made += 1

    return (
        vectors.select("key", "vector")
        .repartition(shuffle_partitions(vectors.sparkSession), "key")
        .sortWithinPartitions(F.length("key"), "key")
        .mapInArrow(packed, PACKED)
    )


def _batch(row: dict) -> pa.RecordBatch:
    types = {"block": pa.int64(), "keys": pa.list_(pa.string())}
    schema = pa.schema([(name, types.get(name, pa.binary())) for name in row])
    return pa.RecordBatch.from_pylist([row], schema)


def _dealt(packs: int, blocks: int, k: int | None, cores: int) -> tuple[int, int]:
    """Slots of the blocks, and tasks. Without k nothing that is found bounds the
    blocks after it, and what a group finds grows with its blocks: a slot is a
    block, and groups are so many that each core gets its share by hash."""
    if k is None:
        slots = max(1, blocks)
        return slots, min(slots * packs, cores * CORE_GROUPS) * GROUP_PARTITIONS
    slots = max(1, -(-blocks // SLOT_BLOCKS), min(blocks, -(-cores * CORE_GROUPS // packs)))
    return slots, slots * packs * GROUP_PARTITIONS


def search_blocks(
    q_keys: DataFrame,
    blocks: DataFrame,
    k: int | None,
    threshold: float | None = None,
    inclusive: bool = True,
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """(q_key, key, score): candidates of the k best keys of each query (k best
    of each task), or with k None all that reach the threshold. `q_keys` holds
    distinct non-empty keys."""
    first = [r.q_key for r in q_keys.limit(broadcast_queries + 1).collect()]

    def found(search: Search, row: dict) -> pa.RecordBatch | None:
        rows = search.block(KeyBlock(row))
        if rows is None:
            return None
        q, key, score = rows
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.string()), pa.array(key, pa.string()), pa.array(score)], names=["q_key", "key", "score"]
        )

    if len(first) <= broadcast_queries:
        packed = q_keys.sparkSession.sparkContext.broadcast(sorted(first))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(packed.value, k, threshold, inclusive)
            for batch in batches:
                for at in range(batch.num_rows):
                    made = found(search, batch.slice(at, 1).to_pylist()[0])
                    if made is not None:
                        yield made

        return blocks.mapInArrow(score, KEY_SCORES)

    packs, count = -(-q_keys.count() // broadcast_queries), blocks.count()
    slots, tasks = _dealt(packs, count, k, q_keys.sparkSession.sparkContext.defaultParallelism)
    tasks = max(shuffle_partitions(q_keys.sparkSession), tasks)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    asked = (
        q_keys.groupBy(F.pmod(F.xxhash64("q_key"), F.lit(packs)).alias("pack"))
        .agg(F.collect_list("q_key").alias("names"))
        .withColumn("slot", every(slots))
    )
    held = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).withColumn("pack", every(packs))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows:
            search = Search(sorted(left.column("names")[0].as_py()), k, threshold, inclusive)
            rows = (right.slice(at, 1).to_pylist()[0] for at in range(right.num_rows))
            made = [m for m in (found(search, row) for row in rows) if m is not None]
        empty = pa.schema([("q_key", pa.string()), ("key", pa.string()), ("score", pa.float64())])
        return pa.Table.from_batches(made, empty)

    # few bytes, much work: most groups are a task of their own, whatever their bytes
    asked, held = (df.repartition(tasks, "slot", "pack") for df in (asked, held))
    return asked.groupBy("slot", "pack").cogroup(held.groupBy("slot", "pack")).applyInArrow(meet, KEY_SCORES)


# --- on storage ------------------------------------------------------------------


def ranked_entries(lexicon: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """`lexicon` (entry_id, key, word, …) without empty keys, with key_rank,
    word_rank and first_word. Ranks are counted inside stretches of ids, after
    the sums of the stretches before, so a key with very many entries is ranked
    by many tasks. Entries are dealt out once, by key and stretch; a row with the
    sums before it stands in front of the entries of a word in a stretch."""
    tasks = shuffle_partitions(lexicon.sparkSession)
    by, by_word = ["key", "_s"], ["key", "_s", "word"]
    staged = lexicon.where("key <> ''").withColumn("_s", F.floor(F.col("entry_id") / stretch))

    def before(*keys: str):
        window = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    of_words = staged.groupBy(*by_word).agg(F.count("*").alias("_n"))
    of_keys = of_words.groupBy(*by).agg(F.sum("_n").alias("_n"), F.min("word").alias("_w"))
    first = F.min("_w").over(Window.partitionBy("key"))
    bases = of_words.select(*by_word, before("key", "word").alias("_word_base")).join(
        of_keys.select(*by, before("key").alias("_base"), first.alias("_first")), by
    )
    dealt = staged.where("_s is not null").unionByName(bases, allowMissingColumns=True).repartition(tasks, *by)

    def so_far(function, column: str, keys: list[str]):
        # rows without an id come first: the sums
        window = Window.partitionBy(*keys).orderBy("entry_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return function(column).over(window)

    return (
        dealt.withColumns(
            {
                "key_rank": so_far(F.max, "_base", by) + so_far(F.count, "entry_id", by),
                "_first": so_far(F.max, "_first", by),
            }
        )
        .withColumn("word_rank", so_far(F.max, "_word_base", by_word) + so_far(F.count, "entry_id", by_word))
        .where("entry_id is not null and word is not null")
        .withColumn("first_word", F.col("word") == F.col("_first"))
        .select(*lexicon.columns, "key_rank", "word_rank", "first_word")
    )


def write_index(lexicon: DataFrame, path: str, block_keys: int = BLOCK_KEYS) -> SearchIndex:
    """Write the index of `lexicon` (entry_id, key, word, definition, …) to a new
    folder and open it."""
    (
        ranked_entries(lexicon)
        .sortWithinPartitions("key", "entry_id")
        .write.mode("errorifexists")
        .parquet(f"{path}/entries")
    )
    index = SearchIndex(lexicon.sparkSession, path)
    keys = index.entries.where("key_rank = 1").select("key")
    key_blocks(keys, block_keys).write.mode("errorifexists").parquet(f"{path}/blocks")
    signed = keys.groupBy(signature(F.col("key")).alias("sig")).agg(F.min("key").alias("key"))
    signed.write.mode("errorifexists").parquet(f"{path}/signatures")
    return index


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(spark, path)


def publish_index(lexicon: DataFrame, base: str, name: str, keep: int = versions.KEEP) -> IndexPointer:
    """Write an index of the lexicon and commit it as the next version of `name`.
    A version stays readable until `keep` newer ones exist."""
    spark = lexicon.sparkSession
    index = write_index(lexicon, f"{base.rstrip('/')}/{name}-index-{uuid.uuid4().hex}")
    versions.commit(spark, base, f"{name}.index", index.path, keep)
    return IndexPointer(base, name)


@dataclass(frozen=True)
class IndexPointer:
    """Where an index is published."""

    base: str
    name: str

    def open(self, spark: SparkSession) -> SearchIndex:
        """The current version, in any session."""
        found = versions.current(spark, self.base, f"{self.name}.index")
        if not found:
            raise FileNotFoundError(f"no index {self.name} is published in {self.base}")
        return open_index(spark, found[1])
