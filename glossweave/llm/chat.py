"""Chat formatting in budgeted windows.

A turn is written `<s>[INST]role[/INST]text</s>`. Control strings inside roles
and texts get a backslash after their first character, and those that have
backslashes there get one more, so `unescape` gives back every text.

A conversation becomes windows of whole turns. Prefix sums of turn tokens give
each turn its place; turns of at most `stride` tokens that start in the same
stretch of `stride` tokens share a window, a longer turn has its own. With
stride = (budget - system - history) / 2 the turns of a window, the system turn
and the history stay within the budget; only a turn (or system turn) that is too
large by itself does not, and is marked (`over_budget`). Turns are never cut.

Each window begins with the conversation's system turn (its first turn, if its
role is system), then the last turns before the window that fit into `history`
tokens. Both are repeats except where they come first. The loss mask covers the
texts of the assistant turns that are new in the window, so each is a target
once.

A hot conversation is spread: prefix sums go by stretches of `STRETCH` turn
numbers plus one sum per stretch, and history meets windows in an equi-join on
token stretches. No conversation is gathered whole.

Null roles and texts count as empty. Order is by turn (null first), then role,
then text; repeated rows are turns of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 128
STRETCH = 64

_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
_TURN = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def turn_tokens(text: Column) -> Column:
    """Words and signs, and four for the marks of the turn."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + 4


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return conversations.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("text"),
        turn_tokens(text).cast("long").alias("tokens"),
    )


def _placed(turns: DataFrame, budget: int, history: int) -> tuple[DataFrame, DataFrame]:
    """Turns with their place (`start` in tokens, `key` of their window), and
    one row per conversation with its system turn and token limits."""
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("first"))
    system = F.when(F.col("first.role") == "system", F.col("first"))
    room = F.lit(budget) - F.coalesce(system["tokens"], F.lit(0))
    past = F.greatest(F.lit(1), F.least(F.lit(history), F.floor(room / 4)))
    heads = first.select(
        F.col("conv_id").alias("_c"),
        system.alias("system"),
        room.alias("room"),
        past.alias("past"),
        F.greatest(F.lit(1), F.floor((room - past) / 2)).alias("stride"),
    )
    stretch = F.floor(F.col("turn") / STRETCH)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv_id", "stretch").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limits = heads.select("_c", F.col("system.turn").alias("_system_turn"), F.col("system").isNotNull().alias("_has"), "room", "past", "stride")
    rows = (
        turns.withColumn("stretch", stretch)
        .join(limits, F.col("conv_id").eqNullSafe(F.col("_c")))
        .drop("_c")
        .withColumn("_n", F.row_number().over(inside))
    )
    # the system turn is the first row of its conversation: the first row of
    # the stretch that holds the smallest turn
    is_system = (
        F.col("_has")
        & F.col("turn").eqNullSafe(F.col("_system_turn"))
        & (F.col("_n") == 1)
        & (F.col("role") == "system")
    )
    rows = rows.withColumns(
        {
            "is_system": is_system,
            "size": F.when(is_system, 0).otherwise(F.col("tokens")),
            "long": F.when(~is_system & (F.col("tokens") > F.col("stride")), 1).otherwise(0),
        }
    ).withColumns({"_upto": F.sum("size").over(upto), "_longs": F.sum("long").over(upto)})
    sums = rows.groupBy("conv_id", "stretch").agg(F.sum("size").alias("s"), F.sum("long").alias("l"))
    before = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("conv_id").alias("_c"),
        F.col("stretch").alias("_s"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("l").over(before), F.lit(0)).alias("_lbase"),
    )
    placed = rows.join(
        bases, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("stretch").eqNullSafe(F.col("_s"))
    ).withColumns(
        {
            "start": F.col("_base") + F.col("_upto") - F.col("size"),
            "before": F.col("_lbase") + F.col("_longs") - F.col("long"),
        }
    )
    key = F.struct(
        F.col("before"),
        F.col("long"),
        F.when(F.col("long") == 1, F.lit(0)).otherwise(F.floor(F.col("start") / F.col("stride"))).alias("slot"),
    )
    placed = placed.select(
        "conv_id", "turn", "role", "text", "size", "start", "is_system", "room", "past", key.alias("key")
    )
    return placed, heads.select("_c", "system", "room")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window_start, text, loss, n_turns, n_repeated, tokens,
    over_budget): the formatted windows, in the order of window_start. `loss`
    has (start, length) in code points of the text under the mask."""
    placed, heads = _placed(_turns(conversations), budget, history)
    body = placed.where(~F.col("is_system"))
    turn = F.struct("start", "turn", "role", "text", "size")
    fresh = body.groupBy("conv_id", "key").agg(
        F.min("start").alias("window_start"),
        F.sum("size").alias("own"),
        F.first("room").alias("room"),
        F.first("past").alias("past"),
        F.sort_array(F.collect_list(turn)).alias("new"),
    )
    # a conversation that is a system turn alone
    heads_only = placed.groupBy("conv_id").agg(
        F.max((~F.col("is_system")).cast("int")).alias("_body"), F.min("start").alias("window_start"),
        F.first("room").alias("room"), F.first("past").alias("past"),
    ).where(F.col("_body") == 0)
    fresh = fresh.drop("key").unionByName(
        heads_only.select(
            "conv_id", "window_start", F.lit(0).cast("long").alias("own"), "room", "past",
            F.array().cast(fresh.schema["new"].dataType).alias("new"),
        )
    )
    past = body.where(F.col("size") <= F.col("past")).select(
        F.col("conv_id").alias("_c"),
        F.explode(
            F.sequence(
                F.floor((F.col("start") + F.col("size")) / F.col("past")),
                F.floor((F.col("start") + F.col("past")) / F.col("past")),
            )
        ).alias("_slot"),
        turn.alias("_t"),
    )
    starts = fresh.select(
        "conv_id", "window_start", F.floor(F.col("window_start") / F.col("past")).alias("slot"),
        F.least(F.col("past"), F.col("room") - F.col("own")).alias("fits"),
    )
    kept = (
        starts.join(past, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("slot") == F.col("_slot")))
        .where(
            (F.col("_t.start") + F.col("_t.size") <= F.col("window_start"))
            & (F.col("window_start") - F.col("_t.start") <= F.col("fits"))
        )
        .groupBy(F.col("conv_id").alias("_c"), F.col("window_start").alias("_w"))
        .agg(F.sort_array(F.collect_list("_t")).alias("past_turns"))
    )
    both = (
        fresh.drop("past", "room")
        .join(kept, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("window_start") == F.col("_w")), "left")
        .drop("_c")
        .join(heads, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    )
    none = F.array().cast(fresh.schema["new"].dataType)
    system = F.when(
        F.col("system").isNotNull(),
        F.array(
            F.struct(
                F.lit(-1).cast("long").alias("start"), F.col("system.turn").alias("turn"),
                F.col("system.role").alias("role"), F.col("system.text").alias("text"),
                F.col("system.tokens").alias("size"),
            )
        ),
    ).otherwise(none)
    repeated = F.coalesce("past_turns", none)
    parts = both.select(
        "conv_id",
        "window_start",
        F.concat(system, repeated, "new").alias("turns"),
        (F.size(repeated) + F.when(F.col("window_start") > 0, F.size(system)).otherwise(0)).alias("n_repeated"),
        (F.lit(budget) - F.col("room")).alias("_system_tokens"),
    )
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.concat(F.lit("<s>[INST]"), escape(t["role"]), F.lit("[/INST]")).alias("head"),
            escape(t["text"]).alias("body"),
            ((i >= F.col("n_repeated")) & (t["role"] == "assistant")).alias("loss"),
        ),
    )
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + 4).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    a["spans"],
                    F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["size"])
    return parts.withColumns({"pieces": pieces, "tokens": total}).select(
        "conv_id",
        "window_start",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), "").alias("text"),
        spans.alias("loss"),
        F.size("turns").alias("n_turns"),
        "n_repeated",
        "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window_start, turns, targets): what is new in each window, read
    from its text: role and text of each turn, and the texts under the mask."""
    role = F.regexp_extract_all("text", F.lit(_TURN), F.lit(1))
    body = F.regexp_extract_all("text", F.lit(_TURN), F.lit(2))
    turns = F.arrays_zip(role.alias("role"), body.alias("text"))
    fresh = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns), F.lit(1)))
    return formatted.select(
        "conv_id",
        "window_start",
        F.transform(
            fresh, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))
        ).alias("turns"),
        F.transform(
            "loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))
        ).alias("targets"),
        F.length("text").alias("formatted_chars"),
    )


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long,"
    " loss_sha256 string, formatted_chars long"
)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation: hashes of its turns and of its targets, read
    back from the windows. A hash has one order, so a conversation is streamed
    through one task, window by window; none is held whole."""
    read = read_back(formatted).select(
        "conv_id",
        "window_start",
        F.size("turns").alias("n_turns"),
        F.array_join(
            F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
        ).alias("turns"),
        F.array_join("targets", "").alias("targets"),
        "formatted_chars",
    )
    # the sort key has a null conversation in a group of its own
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "window_start").mapInArrow(_hashed, DIGEST)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, out = None, None, []

    def closed():
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != conv:
                if state is not None:
                    out.append(closed())
                conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += row["n_turns"]
            state[1].update(row["turns"].encode())
            state[2] += len(row["targets"])
            state[3].update(row["targets"].encode())
            state[4] += row["formatted_chars"]
        if out:
            yield _digest_batch(out)
            out = []
    if state is not None:
        yield _digest_batch([closed()])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
