"""Prefix trie of conversations, by truncation peeling.

Each distinct sequence of first d turns is a node; conversations that begin with
it are its members. The trie is peeled from its greatest depth: conversations
that end there are merged with the nodes that survive from below, their last
turns are stripped, and what is left is regrouped.

A run of turns in which nothing ends and nothing branches is stripped at once,
so rounds are as many as there are depths at which runs begin, not as turns: one
conversation may hold most of the rows. A run is all nodes of one smallest
member and one count of members: on the way down a path both change only where
something ends or branches.

1. `numbered`: rows in (conversation, turn) order, dealt by ranges of both. Each
   task numbers its rows on from what the tasks before it hold of the same
   conversation (one carried value per task).
2. A sequence of turns is known by two exclusive ors of hashes of (depth, turn),
   128 bits; stripping a turn takes its hash out again. Prefixes are such running
   values, carried from task to task like the numbers. That different prefixes of
   one depth share both values is neglected.
3. Nodes are counted by prefix, members first summed map-side.
4. `_peeled` takes runs from the deepest beginning up: leaves and saved tokens of
   a run come from the runs that begin below its end, which are done by then.

Turns are ordered by turn (null first), then role, then text. A null role or
text is empty. Rows without a conversation id take no part. Rows that repeat all
values are turns of their own. No rows: the trie has no node. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.session import cut_lineage, scratch_path, shuffle_partitions

#: Conversations that share the opening of the first of them.
FAMILY = 20
#: Turns of a run that are joined in one place.
STRETCH = 1024
RESULTS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


# --- running values over an ordered table ----------------------------------------


def _in_order(df: DataFrame, key: str, *order) -> DataFrame:
    """`df` sorted over all tasks by key and `order`, on reliable storage, so that
    a task always has the same rows."""
    tasks = shuffle_partitions(df.sparkSession)
    return cut_lineage(df.repartitionByRange(tasks, key, *order).sortWithinPartitions(key, *order))


def _running(df: DataFrame, key: str, sums: list[str], xors: list[str]) -> DataFrame:
    """`df`, ordered by key, with `run_<column>`: the sum, or exclusive or, of the
    column over the key's rows so far, this one included."""
    columns = [*sums, *xors]
    total = [F.sum(c).alias(c) for c in sums] + [F.bit_xor(c).alias(c) for c in xors]
    per = df.groupBy(F.spark_partition_id().alias("_task"), F.col(key).alias("_key")).agg(*total)
    earlier = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # only a task's first key began before it: one row per task at most
    carried = per.select(
        "_task", "_key", *(F.sum(c).over(earlier).alias(c) for c in sums), *(F.bit_xor(c).over(earlier).alias(c) for c in xors)
    ).where(F.col(columns[0]).isNotNull())
    known = {r["_task"]: (r["_key"], [r[c] for c in columns]) for r in carried.collect()}
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = known.get(TaskContext.get().partitionId(), (None, [0] * len(columns)))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(names.index(key)).to_numpy()
            starts = np.r_[True, keys[1:] != keys[:-1]]
            first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
            on = (first == 0) & (keys == last) if last is not None else np.zeros(n, bool)
            made = []
            for k, c in enumerate(columns):
                values = batch.column(names.index(c)).to_numpy().astype(np.int64)
                if c in sums:
                    so_far = np.cumsum(values)
                    so_far = so_far - (so_far - values)[first]
                    so_far = so_far + np.where(on, held[k], 0)
                else:
                    so_far = np.bitwise_xor.accumulate(values)
                    so_far = so_far ^ (so_far ^ values)[first]
                    so_far = so_far ^ np.where(on, held[k], 0)
                made.append(so_far)
            last, held = keys[-1], [int(m[-1]) for m in made]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(m) for m in made)], names=[*names, *(f"run_{c}" for c in columns)]
            )

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), *(f"run_{c} long" for c in columns)])
    return df.mapInArrow(run, schema)


# --- 1. turns --------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_a, turn_b, words): places from 1, two hashes of each
    turn, and the words of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    turns = (
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    )
    ordered = _in_order(turns, "conv_id", F.col("turn").asc_nulls_first(), "role", "text").select(
        "conv_id",
        F.xxhash64(F.lit(1), "role", "text").alias("turn_a"),
        F.xxhash64(F.lit(2), "role", "text").alias("turn_b"),
        words.alias("words"),
        F.lit(1).cast("long").alias("one"),
    )
    return _written(
        _running(ordered, "conv_id", ["one"], []).select(
            "conv_id", F.col("run_one").alias("place"), "turn_a", "turn_b", "words"
        ),
        "numbered-turns",
    )


def _opening(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns), and their turns (conv_id, n_turns, depth,
    turn_a, turn_b, words): the first h turns of the family's first conversation,
    then the own ones after the first h."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns(
        {"h": _opening(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % FAMILY}
    )
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = _written(
        own.join(bases, "base", "left").select(
            "conv_id", "base", "h", "n", taken.alias("taken"),
            (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"),
        ),
        "conversations",
    )
    # a long conversation's turns meet its row in many stretches
    stretches = convs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / STRETCH))))
    fields = ["conv_id", "n_turns", "depth", "turn_a", "turn_b", "words"]
    mine = (
        turns.withColumn("part", F.floor(F.col("place") / STRETCH))
        .join(stretches.select("conv_id", "part", "h", "taken", "n_turns"), ["conv_id", "part"])
        .where("place > h")
        .withColumn("depth", F.col("place") - F.col("h") + F.col("taken"))
        .select(fields)
    )
    first = turns.where(f"place < 4 and conv_id % {FAMILY} = 0").withColumnRenamed("conv_id", "base")
    given = (
        first.join(convs.select("base", "conv_id", "taken", "n_turns"), "base")
        .where("place <= taken")
        .withColumn("depth", F.col("place"))
        .select(fields)
    )
    return convs.select("conv_id", "n_turns"), mine.unionByName(given)


# --- 2, 3. nodes -----------------------------------------------------------------


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` with the marks of their own (a, b), of all up to them (run_a,
    run_b), and the words so far (run_words)."""
    marked = turns.select(
        "conv_id", "n_turns", "depth", "words",
        F.xxhash64(F.lit(3), "turn_a", "turn_b", "depth").alias("a"),
        F.xxhash64(F.lit(4), "turn_b", "turn_a", "depth").alias("b"),
    )
    return _written(_running(_in_order(marked, "conv_id", "depth"), "conv_id", ["words"], ["a", "b"]), "prefixes")


def _nodes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(depth, key_a, key_b, conv_id, n_convs, a, b, words, run_words)."""
    same = [F.min(c).alias(c) for c in ("a", "b", "words", "run_words")]  # alike in a group
    below = paths.groupBy("depth", F.col("run_a").alias("key_a"), F.col("run_b").alias("key_b")).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "key_a", "key_b")]
    zeros = [F.lit(0).cast("long").alias(c) for c in ("a", "b", "words", "run_words")]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    return _written(below.unionByName(root.select(*zero, "conv_id", "n_convs", *zeros)), "trie-nodes")


def _end_digests(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(depth, key_a, key_b, ends_sha256) where conversations end. A hash has one
    order: the ids of a node are streamed through one task, none is held."""
    ends = paths.where("depth = n_turns").select(
        "depth", F.col("run_a").alias("key_a"), F.col("run_b").alias("key_b"), "conv_id"
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "key_a", "key_b")]
    ends = ends.unionByName(convs.where("n_turns = 0").select(*zero, "conv_id"))
    key = ["depth", "key_a", "key_b"]
    return ends.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(
        _hashed, "depth long, key_a long, key_b long, ends_sha256 string"
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, out = None, None, []

    def batch_of(rows):
        types = [pa.int64()] * 3 + [pa.string()]
        names = ["depth", "key_a", "key_b", "ends_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for *this, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if this != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = this, hashlib.sha256(str(conv).encode())
            else:
                state.update(f",{conv}".encode())
        if out:
            yield batch_of(out)
            out = []
    if key is not None:
        yield batch_of([(*key, state.hexdigest())])


# --- 4. peeling ------------------------------------------------------------------


def _runs(nodes: DataFrame) -> DataFrame:
    """One row per run: where it begins and ends, its words, the node above it."""
    top, end = F.struct("depth", "key_a", "key_b", "a", "b", "words", "run_words"), F.struct("depth", "key_a", "key_b", "run_words")
    runs = nodes.groupBy("conv_id", "n_convs").agg(F.min(top).alias("top"), F.max(end).alias("end"))
    return _written(
        runs.select(
            "conv_id", "n_convs",
            F.col("top.depth").alias("top"),
            F.col("end.depth").alias("end"),
            F.col("end.key_a").alias("end_a"),
            F.col("end.key_b").alias("end_b"),
            F.col("end.run_words").alias("end_words"),
            # the first turn of the run stripped
            F.col("top.key_a").bitwiseXOR(F.col("top.a")).alias("up_a"),
            F.col("top.key_b").bitwiseXOR(F.col("top.b")).alias("up_b"),
            (F.col("top.run_words") - F.col("top.words")).alias("up_words"),
        ),
        "trie-runs",
    )


def _peeled(runs: DataFrame) -> DataFrame:
    """(conv_id, n_convs, n_children, n_leaves, saved): of the last node of each
    run; `saved` is what its subtrees below save."""
    fields = ["conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    # as many as depths at which something ends or branches
    tops = [r.top for r in runs.select("top").distinct().orderBy(F.desc("top")).collect()]
    done, survivors = None, None
    zero = F.lit(0).cast("long")
    for top in tops:
        here = runs.where(F.col("top") == top)
        if survivors is None:
            met = here.withColumns({"n_children": zero, "n_leaves": zero, "saved": zero})
        else:
            met = here.join(survivors, ["end", "end_a", "end_b"], "left").withColumns(
                {c: F.coalesce(c, zero) for c in ("n_children", "n_leaves", "saved")}
            )
        met = _written(met.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1))), "peeled-runs")
        own = (F.col("n_convs") - 1) * (F.col("end_words") - F.col("up_words"))
        up = (
            met.select(
                (F.col("top") - 1).alias("end"), F.col("up_a").alias("end_a"), F.col("up_b").alias("end_b"),
                "n_leaves", (F.col("saved") + own).alias("saved"),
            )
            .groupBy("end", "end_a", "end_b")
            .agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        )
        survivors = up if survivors is None else survivors.unionByName(up)
        done = met.select(fields) if done is None else done.unionByName(met.select(fields))
    return done


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node, as `RESULTS`."""
    convs, turns = rebuilt(numbered(conversations))
    paths = prefixes(turns)
    nodes = _nodes(convs, paths)
    runs = _runs(nodes)
    empty = nodes.limit(0).select(*(F.lit(None).cast(t).alias(c) for c, t in zip(RESULTS, ["long"] * 7 + ["string"])))
    peeled = _peeled(runs)
    if peeled is None:
        return empty
    # the node above a run's first node, by its own key
    above = runs.where("top > 0").select(
        "conv_id", "n_convs", (F.col("top") - 1).alias("end"), F.col("up_a").alias("end_a"), F.col("up_b").alias("end_b")
    )
    ends = runs.select("end", "end_a", "end_b", F.col("conv_id").alias("above"))
    parents = above.join(ends, ["end", "end_a", "end_b"]).select("conv_id", "n_convs", "above")
    known = (
        runs.select("conv_id", "n_convs", "top", "end", "end_words")
        .join(peeled, ["conv_id", "n_convs"])
        .join(parents, ["conv_id", "n_convs"], "left")
        .withColumn("part", F.explode(F.sequence(F.floor(F.col("top") / STRETCH), F.floor(F.col("end") / STRETCH))))
    )
    last = F.col("depth") == F.col("end")
    return (
        nodes.withColumn("part", F.floor(F.col("depth") / STRETCH))
        .join(known, ["conv_id", "n_convs", "part"])
        .join(_end_digests(convs, paths), ["depth", "key_a", "key_b"], "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
            "n_convs",
            F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
            "n_leaves",
            (F.col("saved") + (F.col("n_convs") - 1) * (F.col("end_words") - F.col("run_words") + F.col("words"))).alias(
                "saved_tokens"
            ),
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )
