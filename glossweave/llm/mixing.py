"""Mixing sources to target weights by Pfair scheduling.

A block is `block_docs` documents of a source. With the exact weight w of its
source, block i is released at slot floor(i / w) and due by slot
ceil((i + 1) / w); in each slot the released block with the earliest deadline goes
(ties: the source first in name), or, where none is released, the one due first.
A block in its window is less than one block away from its weight. Windows come
from the exact weights, so nothing drifts however long the mix is.

Slots are scheduled in periods of about `period`, which do not depend on each
other: block i belongs to the period in which w * t + phase passes i + 1, and a
period is as long as its blocks are many. Each is folded in a row of its own, with
the sources that have a block in it (no more than it has slots), so any number of
sources can be mixed. Blocks of large sources (`HEAVY`) go to the nearer period;
the phases of small ones differ, so that they do not come due together. Where
many windows cross the border of two periods, a block may be put a few slots
beyond its window: its source is then that much of its weight further away.

The default target is the natural share of each source, held to at most
`max_share`. The mix lasts as long as every source keeps up its weight; what a
source has beyond that quota is not mixed (`mixed` false, no slot, no position).
To the default target only the sources held down have such a rest, all others
are mixed whole. Documents are numbered inside their source by the order of
md5(doc_id), doc_id; a source is cut into buckets by that hash, in proportion to
its size, so a hot source is ranked by many tasks.

The schedule has a row for each source and period. It travels with the tasks up
to `BROADCAST_SLOTS` slots, which are counted first; beyond, it meets the
documents by source and period, so a hot source is as many groups as periods.

Null sources are a source of their own. Repeated rows are numbered each. Rows of
a source without target are not mixed. Extra columns stay; columns named like a
result (n_in_source, block, slot, position, mixed) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.columns import guarded
from glossweave.session import cut_lineage, spread

PERIOD = 1024
BLOCK_DOCS = 1
MAX_SHARE = 0.25
BUCKET_DOCS = 4_096
BROADCAST_SLOTS = 2_000_000
#: Periods whose lengths are added up in one place.
STRETCH = 4_096
#: Multiples of it are spread evenly between whole numbers.
GOLDEN = 0.6180339887498949
#: Sources of this share and more have their blocks in the nearer period.
HEAVY = 0.01
RESULTS = ("n_in_source", "block", "slot", "position", "mixed")


def target_weights(docs: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """(source, n_docs, weight): natural shares, none above max_share. With n
    sources none can be held below 1/n."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    every = Window.partitionBy()
    share = F.col("n_docs") / F.sum("n_docs").over(every)
    cap = F.greatest(F.lit(max_share), 1 / F.count("*").over(every))
    return (
        counts.withColumn("_share", F.least(share, cap))
        .withColumn("weight", F.col("_share") / F.sum("_share").over(every))
        .drop("_share")
    )


def shares(target: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(source, share, phase, reach, quota) of a target (source, n_docs, weight).
    The mix reaches as far as the source with the fewest documents for its weight
    lasts; to the default target that is all sources but those held back."""
    every = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("weight").desc(), F.col("source").asc_nulls_first())
    reach = F.min(F.col("n_docs") / F.col("share")).over(every)
    return (
        target.withColumn("share", F.col("weight") / F.sum("weight").over(every))
        .withColumn("phase", F.when(F.col("share") >= HEAVY, 0.5).otherwise(((F.row_number().over(order) - 0.5) * GOLDEN) % 1.0))
        .withColumn("reach", reach)
        .select(
            "source", "share", "phase", F.ceil(F.col("reach") / block_docs).alias("reach"),
            F.least(F.ceil(F.col("share") * F.col("reach") - F.lit(1e-6)), F.col("n_docs")).alias("quota"),
        )
    )


def _begun(p: Column, period: int) -> Column:
    """Blocks that a source has before period p."""
    return F.floor(F.col("share") * (p * period) + F.col("phase"))


def _period_of(block: Column, period: int) -> Column:
    """The period of a block, corrected where division has rounded."""
    near = F.floor((block + 1 - F.col("phase")) / (F.col("share") * period))
    near = F.greatest(near, F.lit(0))
    return F.when(_begun(near, period) > block, near - 1).when(_begun(near + 1, period) <= block, near + 1).otherwise(near)


def schedule(share_table: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, p, begun, slots): the slots, in all, of the blocks that each source
    has in each period, from its block `begun` on."""
    zero = F.lit(0).cast("long")
    last = F.ceil(F.col("reach") / period).cast("long") + 1
    # a source with less than a block in a period is read by its blocks
    dense = F.col("share") * period >= 1
    steps = F.when(dense, last).otherwise(_begun(last + 1, period) - 1)
    counted = (
        share_table.withColumn("_last", last)
        .where(steps >= 0)
        .withColumn("_step", F.explode(F.sequence(zero, steps)))
        .withColumn("p", F.when(dense, F.col("_step")).otherwise(_period_of(F.col("_step"), period)))
        .where(F.col("p") <= F.col("_last"))
        .select("source", "share", "phase", "p")
        .distinct()
        .withColumn("begun", _begun(F.col("p"), period))
        .withColumn("n", _begun(F.col("p") + 1, period) - F.col("begun"))
        .where("n > 0")
    )
    periods = counted.groupBy("p").agg(
        F.sum("n").alias("length"), F.sort_array(F.collect_list(F.struct("source", "n", "begun", "share"))).alias("s")
    )
    periods = cut_lineage(periods)
    picks = _earliest_deadlines(F.col("s"), F.col("length"), F.col("start"))
    # few bytes, much work: all tasks take part. Dealt by p, as the join has dealt
    # them, the rows would stay in the task or two that their bytes are worth
    dealt = spread(periods.join(_starts(periods), "p").withColumn("_deal", F.xxhash64("p")), "_deal")
    folded = dealt.withColumn("picks", picks)
    # the picks of a period, gathered by source
    slots = F.transform(
        "s",
        lambda x, i: F.struct(
            x["source"].alias("source"),
            x["begun"].alias("begun"),
            F.transform(F.filter(F.col("picks"), lambda y: y["i"] == i), lambda y: y["slot"] + F.col("start")).alias("slots"),
        ),
    )
    return folded.select("p", F.explode(slots).alias("x")).select("x.source", "p", "x.begun", "x.slots")


def _starts(periods: DataFrame) -> DataFrame:
    """(p, start): slots before each period."""
    staged = periods.select("p", "length", F.floor(F.col("p") / STRETCH).alias("stretch"))
    sums = staged.groupBy("stretch").agg(F.sum("length").alias("n"))
    so_far = Window.partitionBy().orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("stretch", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    inside = Window.partitionBy("stretch").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return (
        staged.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .join(bases, "stretch")
        .select("p", (F.col("base") + F.col("inside")).alias("start"))
    )


def _earliest_deadlines(sources: Column, length: Column, begin: Column) -> Column:
    """array<struct<i, slot>>: which source each slot of a period, the first of
    which is `begin` of all, goes to, folded over the slots of one row of bounded
    size."""

    def step(state: Column, t: Column) -> Column:
        done = state["done"]

        def due(x: Column, i: Column) -> Column:
            k = x["begun"] + F.get(done, i)
            early = F.floor(k / x["share"]) > begin + t
            due = F.ceil((k + 1) / x["share"]).cast("long")
            return F.when(F.get(done, i) < x["n"], F.struct(early.alias("early"), due.alias("due"), i.alias("i")))

        best = F.array_min(F.transform(sources, due))
        return F.element_at(
            F.transform(
                F.array(best),
                lambda b: F.struct(
                    F.transform(done, lambda k, i: F.when(i == b["i"], k + 1).otherwise(k)).alias("done"),
                    F.concat(state["out"], F.array(F.struct(b["i"].alias("i"), t.alias("slot")))).alias("out"),
                ),
            ),
            1,
        )

    start = F.struct(
        F.transform(sources, lambda x: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<struct<i:int,slot:bigint>>").alias("out"),
    )
    return F.aggregate(F.sequence(F.lit(0).cast("long"), length - 1), start, step, lambda a: a["out"])


def numbered(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """`docs` with n_in_source, 0 upward, in the order md5(doc_id), doc_id."""
    counts = docs.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n"))
    digits = F.when(
        F.col("_n") > bucket_docs, F.ceil(F.log(16.0, F.col("_n") / bucket_docs))
    ).otherwise(0)
    sizes = cut_lineage(counts.select("_s", digits.cast("int").alias("_digits")))
    keyed = (
        docs.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_bucket", F.substring(F.col("_key"), F.lit(1), F.col("_digits")))
        .drop("_s", "_digits")
    )
    per = keyed.groupBy(F.col("source").alias("_s"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("_s", "_b", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(
        Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first())
    )
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    return (
        keyed.withColumn("_rank", rank)
        .join(bases, same)
        .withColumn("n_in_source", F.col("_base") + F.col("_rank") - 1)
        .drop("_s", "_b", "_base", "_rank", "_bucket", "_key")
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    period: int = PERIOD,
    block_docs: int = BLOCK_DOCS,
    bucket_docs: int = BUCKET_DOCS,
    max_share: float = MAX_SHARE,
    broadcast_slots: int = BROADCAST_SLOTS,
) -> DataFrame:
    """`docs` with n_in_source, block, slot, position and mixed. Ordered by
    position, the mixed rows are the interleaved corpus."""
    if weights is None:
        target = target_weights(docs, max_share)
    else:
        target = weights.join(
            docs.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n_docs")),
            F.col("source").eqNullSafe(F.col("_s")),
        ).select("source", "n_docs", "weight")
    # a row per source: written once, as the quota and the schedule must agree
    known = cut_lineage(shares(target.where(F.col("weight") > 0), block_docs))
    reach = known.agg(F.max("reach")).first()[0] or 0
    slots = cut_lineage(schedule(known, period))
    return guarded(
        docs,
        ["doc_id", "source"],
        lambda d: _placed(d, known, slots, reach <= broadcast_slots, period, block_docs, bucket_docs),
        RESULTS,
    )


def _placed(
    docs: DataFrame, known: DataFrame, slots: DataFrame, small: bool, period: int, block_docs: int, bucket_docs: int
) -> DataFrame:
    sources = known.withColumnRenamed("source", "_s").drop("reach")
    few = sources.count() <= 100_000
    placed = (
        numbered(docs, bucket_docs)
        .join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumn("block", F.floor(F.col("n_in_source") / block_docs))
        .withColumn("mixed", F.coalesce(F.col("n_in_source") < F.col("quota"), F.lit(False)))
        .withColumn("_at", F.when(F.col("mixed"), _period_of(F.col("block"), period)))
        .drop("_s", "share", "phase", "quota")
    )
    table = slots.select(F.struct("source").alias("_of"), F.col("p").alias("_p"), "begun", "slots")
    met = placed.withColumn("_own", F.struct("source")).join(
        F.broadcast(table) if small else table, (F.col("_own") == F.col("_of")) & (F.col("_at") == F.col("_p")), "left"
    )
    return (
        met.withColumn("slot", F.get("slots", (F.col("block") - F.col("begun")).cast("int")))
        .withColumn("position", F.col("slot") * block_docs + F.col("n_in_source") % block_docs)
        .drop("_at", "_of", "_own", "_p", "begun", "slots")
    )


def interleaved(docs: DataFrame, partitions: int, **options) -> DataFrame:
    """The mixed documents, in files and rows ordered by position, with the
    columns they came with."""

    def ordered(d: DataFrame) -> DataFrame:
        mixed = mix(d, **options).where("mixed")
        return mixed.repartitionByRange(partitions, "position").sortWithinPartitions("position")

    return guarded(docs, ["doc_id", "source"], ordered)
