"""Entry parsing: blocks into entries.

An entry may be "idem", meaning "as the entry before". `parse_chains` follows
those references inside runs: a run is one base entry and the idem entries
after it. Nothing but idem entries ever looks at another row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions import entries as E
from glossweave.functions.variants import variants
from glossweave.operators.segment import CHUNK_LINES, block_array
from glossweave.session import cut_lineage, spread

ENTRY_STRUCT = "struct<word_raw:string,definition:string,references:array<string>>"


def split_entries(blocks: DataFrame) -> DataFrame:
    """Adds word_raw and definition to the blocks that are not brace groups and
    do have a headword."""
    position = E.split_position(F.col("block"))
    return (
        blocks.where(~E.is_group(F.col("block")))
        .withColumn("_at", position)
        .where(F.col("_at") > 0)
        .withColumns(
            {
                "word_raw": E.headword_at(F.col("block"), F.col("_at")),
                "definition": E.definition_at(F.col("block"), F.col("_at")),
            }
        )
        .where(F.col("word_raw") != "")
        .drop("_at")
    )


def parse_groups(blocks: DataFrame) -> DataFrame:
    """(…, part_no, word, definition) of brace-group blocks: one row per
    headword, sharing one definition."""
    block = F.col("block")
    kept = [c for c in blocks.columns if c != "block"]
    return (
        blocks.where(E.is_group(block) & E.reject_reason(block).isNull())
        .select(
            *kept,
            E.group_definition(block).alias("definition"),
            F.posexplode(E.group_headwords(block)).alias("part_no", "word"),
        )
        .select(*kept, "part_no", "word", "definition")
    )


def rejected_blocks(blocks: DataFrame) -> DataFrame:
    """(…, block, reject_reason): blocks that give no entry, and why."""
    return blocks.withColumn("reject_reason", E.reject_reason(F.col("block"))).where(
        F.col("reject_reason").isNotNull()
    )


def with_references(entries: DataFrame) -> DataFrame:
    """Adds the distinct referenced words of each definition, in order."""
    return entries.withColumn(
        "references", F.array_distinct(E.extract_references(F.col("definition")))
    )


# --- idem ------------------------------------------------------------------


def _entry(block: Column) -> Column:
    """Unresolved entry of a block that is known to be an entry."""
    position = E.split_position(block)
    definition = E.definition_at(block, position)
    return F.struct(
        E.headword_at(block, position).alias("word_raw"),
        definition.alias("definition"),
        F.array_distinct(E.extract_references(definition)).alias("references"),
    ).cast(ENTRY_STRUCT)


def _resolve(current: Column, previous: Column) -> Column:
    """Entry `current` with its idem replaced by the resolved entry before."""
    idem = E.is_idem(current["definition"])
    return F.struct(
        current["word_raw"].alias("word_raw"),
        F.when(
            idem, E.resolve_definition(current["definition"], previous["definition"])
        )
        .otherwise(current["definition"])
        .alias("definition"),
        F.when(
            idem,
            F.concat(
                F.array(previous["word_raw"]),
                F.coalesce(
                    previous["references"], F.array().cast("array<string>")
                ),
            ),
        )
        .otherwise(current["references"])
        .alias("references"),
    ).cast(ENTRY_STRUCT)


def _last_of_chain(chain: Column) -> Column:
    """Resolved last entry of an array of consecutive entries."""
    return F.aggregate(
        chain, F.lit(None).cast(ENTRY_STRUCT), lambda acc, x: _resolve(x, acc)
    )


_PLAIN, _IDEM, _ASIDE = "plain", "idem", "aside"


def _kind(block: Column, position: Column) -> Column:
    """Does the block start a run, continue one, or stand aside from them?"""
    return (
        F.when(E.is_group(block) | (position == 0), _ASIDE)
        .when(E.headword_at(block, position) == "", _ASIDE)
        .when(
            block.contains("_idem") & E.is_idem(E.definition_at(block, position)),
            _IDEM,
        )
        .otherwise(_PLAIN)
    )


def chained_blocks(texts: DataFrame) -> DataFrame:
    """(doc_id, block_no, block, prior) without a shuffle: every block of each
    text; for an idem block, `prior` holds the blocks of its run before it."""

    def labelled(blocks: Column) -> Column:
        split = F.transform(
            blocks,
            lambda b: F.struct(b.alias("block"), E.split_position(b).alias("at")),
        )
        return F.transform(
            split,
            lambda x: F.struct(
                _kind(x["block"], x["at"]).alias("kind"), x["block"].alias("block")
            ),
        )

    def runs(items: Column) -> Column:
        at = F.filter(
            F.transform(
                items,
                lambda x, i: F.when((i == 0) | (x["kind"] == _PLAIN), i + 1),
            ),
            lambda i: i.isNotNull(),
        )
        return F.transform(
            at,
            lambda start, j: F.slice(
                items,
                start,
                F.coalesce(F.get(at, j + 1), F.size(items) + 1) - start,
            ),
        )

    def with_prior(run: Column) -> Column:
        return F.transform(
            run,
            lambda x, k: F.struct(
                x["block"].alias("block"),
                F.when(
                    x["kind"] == _IDEM,
                    F.transform(
                        F.filter(
                            F.slice(run, F.lit(1), k), lambda y: y["kind"] != _ASIDE
                        ),
                        lambda y: y["block"],
                    ),
                ).alias("prior"),
            ),
        )

    # staged projections keep each array computed once: Catalyst does not merge
    # a projection whose result is used more than once
    staged = texts.select(
        "doc_id", labelled(block_array(F.col("text"))).alias("items")
    )
    staged = staged.select("doc_id", runs(F.col("items")).alias("runs"))
    chained = F.flatten(F.transform("runs", with_prior))
    return staged.select(
        "doc_id", F.posexplode(chained).alias("block_no", "item")
    ).select("doc_id", "block_no", "item.block", "item.prior")


def resolved_entry(entry: Column, prior: Column) -> Column:
    """STRUCT of an entry; an idem one is followed back through its `prior`
    blocks, which come with it."""
    chain = F.concat(F.transform(prior, _entry), F.array(entry))
    return F.when(
        E.is_idem(entry["definition"]), _last_of_chain(chain)
    ).otherwise(entry)


#: Entries of a run that are resolved in one place.
RUN_PIECE = 64
#: More steps than any mark needs to collapse in a text of `int` length.
SETTLE = 33
_IDEM_LENGTH = len("_idem")


def _settled(text: Column) -> Column:
    """What repeated collapsing of marks (see `resolve_definition`) ends in."""
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), r"(?:\._){2,}", "._")


def resolve_idem(entries: DataFrame, chunk: int = CHUNK_LINES, piece: int = RUN_PIECE) -> DataFrame:
    """Resolve idem in any ordered entry table (doc_id, block_no, word_raw,
    definition, references), without putting a document, or a run of idem
    entries, into one task.

    A run is an entry that is not idem and the idem entries after it. An idem
    entry is a template over the definition before it, and nearly always one that
    begins with it: what it adds is text at the end. So the templates of a run
    compose by concatenation, in pieces of `piece` entries: the text of all pieces
    before a piece is joined to it, and only the piece itself is resolved step by
    step. Collapsed marks do not compose at once, but they settle: what is left to
    collapse at a place shrinks by half with every step, so a piece begins
    `SETTLE` entries early from settled text and is exact where it counts. An
    entry that repeats the definition before it more than once begins a new level;
    levels are taken one after the other, and there cannot be many, as each at
    least doubles its text. References are the words of the run before an entry,
    last first, then those of its base.

    The number of an entry in its run comes from windows inside bounded chunks
    plus carried numbers per chunk. Entries outside idem runs pass through.
    """
    columns = ["doc_id", "block_no", "word_raw", "definition", "references"]
    # wrapped, a missing document id is a document like any other
    wrapped = entries.select(F.struct("doc_id").alias("doc_id"), *columns[1:])
    numbered = _numbered_runs(wrapped, chunk)
    single = numbered.where("alone").select(columns)
    runs = numbered.where(~F.col("alone")).drop("alone")
    # idem entries without a base follow an empty one that has no word
    lost = runs.where("run = -1").select("doc_id").distinct().select(
        "doc_id", F.lit(None).cast("long").alias("block_no"), F.lit(None).cast("string").alias("word_raw"),
        F.lit("").alias("definition"), F.array().cast("array<string>").alias("references"),
        F.lit(-1).cast("long").alias("run"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("level"),
    )
    # read by every step below
    runs = cut_lineage(runs.unionByName(lost).withColumn("piece", F.floor(F.col("k") / piece)))
    resolved = runs.join(_definitions(runs, piece), ["doc_id", "run", "k"], "left")
    # few bytes become many here: all tasks take part
    place = ["doc_id", "run", "piece"]
    resolved, words = spread(resolved, *place), spread(_words_before(runs), *place)
    idem = F.col("resolved").isNotNull()
    own = F.slice("words", F.lit(1), (F.col("k") - F.col("piece") * piece).cast("int"))
    done = (
        resolved.join(words, place)
        .where(F.col("block_no").isNotNull())
        .select(
            "doc_id",
            "block_no",
            "word_raw",
            F.coalesce("resolved", "definition").alias("definition"),
            F.when(idem, F.concat(F.reverse(own), "earlier", "base_references")).otherwise(F.col("references")).alias("references"),
        )
    )
    return single.unionByName(done).select("doc_id.doc_id", *columns[1:])


def _numbered_runs(entries: DataFrame, chunk: int) -> DataFrame:
    """Adds run (block number of its base; -1 for idem entries without one), k
    (place in the run, the base is 0), level (entries so far, of the run, that
    repeat the definition before them) and alone (no idem entry is concerned)."""
    idem = E.is_idem(F.col("definition"))
    rest = F.substr(F.col("definition"), F.lit(_IDEM_LENGTH + 1))
    marked = entries.withColumns(
        {
            "_chunk": F.floor(F.col("block_no") / chunk),
            "_base": ~F.coalesce(idem, F.lit(False)),
            "_again": F.coalesce(idem & rest.contains("_idem"), F.lit(False)).cast("long"),
        }
    )
    inside = Window.partitionBy("doc_id", "_chunk").orderBy("block_no")
    local = marked.withColumns(
        {
            "_n": F.row_number().over(inside),
            "_levels": F.sum("_again").over(inside),
            "_next": F.lead("_base").over(inside),
        }
    ).withColumn("_begun", F.max(F.when(F.col("_base"), F.struct("block_no", "_n", "_levels"))).over(inside))
    ends = marked.groupBy("doc_id", "_chunk").agg(
        F.count("*").alias("_size"), F.sum("_again").alias("_sum")
    )
    last = local.where("_base").groupBy("doc_id", "_chunk").agg(
        F.max(F.struct("block_no", "_n", "_levels")).alias("_base_at")
    )
    before = Window.partitionBy("doc_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = {
        "_n_before": F.coalesce(F.sum("_size").over(before), F.lit(0)),
        "_levels_before": F.coalesce(F.sum("_sum").over(before), F.lit(0)),
    }
    placed = ends.join(last, ["doc_id", "_chunk"], "left").withColumns(sums)
    # the base of a run that began in a chunk before, numbered in the document
    at = F.struct(
        F.col("_base_at.block_no").alias("block_no"),
        (F.col("_base_at._n") + F.col("_n_before")).alias("n"),
        (F.col("_base_at._levels") + F.col("_levels_before")).alias("levels"),
    )
    carried = placed.withColumn("_at", F.when(F.col("_base_at").isNotNull(), at)).select(
        "doc_id", "_chunk", "_n_before", "_levels_before", F.max("_at").over(before).alias("_carried")
    )
    here = F.struct(
        F.col("_begun.block_no").alias("block_no"),
        (F.col("_begun._n") + F.col("_n_before")).alias("n"),
        (F.col("_begun._levels") + F.col("_levels_before")).alias("levels"),
    )
    joined = local.join(carried, ["doc_id", "_chunk"]).withColumn(
        "_run", F.coalesce(F.when(F.col("_begun").isNotNull(), here), F.col("_carried"))
    )
    return joined.select(
        *entries.columns,
        F.coalesce("_run.block_no", F.lit(-1)).cast("long").alias("run"),
        (F.col("_n") + F.col("_n_before") - F.coalesce("_run.n", F.lit(0))).cast("long").alias("k"),
        (F.col("_levels") + F.col("_levels_before") - F.coalesce("_run.levels", F.lit(0))).cast("long").alias("level"),
        # the last entry of a chunk may be followed by an idem in the next one
        (F.col("_base") & F.coalesce("_next", F.lit(False))).alias("alone"),
    )


def _definitions(runs: DataFrame, piece: int) -> DataFrame:
    """(doc_id, run, k, resolved) of the idem entries, level by level."""
    idem = runs.where("k > 0")
    start = runs.where("k = 0").select("doc_id", "run", F.coalesce("definition", F.lit("")).alias("text"))
    # as many as can double a text
    levels = idem.agg(F.max("level")).first()[0]
    if levels is None:
        return idem.select("doc_id", "run", "k", F.col("definition").alias("resolved"))
    done = None
    for level in range(levels + 1):
        found = cut_lineage(_level(idem.where(F.col("level") == level), start, piece))
        done = found if done is None else done.unionByName(found)
        # the last definition of a run: of this level, or from before
        last = found.groupBy("doc_id", "run").agg(F.max_by("resolved", "k").alias("last"))
        start = cut_lineage(
            start.join(last, ["doc_id", "run"], "left").select("doc_id", "run", F.coalesce("last", "text").alias("text"))
        )
    return done


def _level(entries: DataFrame, start: DataFrame, piece: int) -> DataFrame:
    """(doc_id, run, k, resolved) of one level: only its first entry may repeat
    the definition before it, the text of `start`; all others add to it."""
    key = ["doc_id", "run"]
    heads = entries.groupBy(*key).agg(F.min(F.struct("k", "definition")).alias("head"))
    begun = cut_lineage(
        heads.join(start, key).select(
            *key, F.col("head.k").alias("head"), E.resolve_definition(F.col("head.definition"), F.col("text")).alias("text")
        )
    )
    place = F.col("k") - F.col("head") - 1
    added = entries.join(begun.select(*key, "head"), key).where(F.col("k") > F.col("head")).select(
        *key, "k", F.floor(place / piece).alias("at"), F.substr(F.col("definition"), F.lit(_IDEM_LENGTH + 1)).alias("rest")
    )
    added = cut_lineage(added)
    early = -(-SETTLE // piece)  # pieces that a piece resolves before itself
    last = added.groupBy(*key).agg(F.max("at").alias("last"))
    # each piece's text goes to the pieces that begin after it
    texts = added.groupBy(*key, "at").agg(F.array_sort(F.collect_list(F.struct("k", "rest"))).alias("items"))
    sent = texts.join(last, key).select(
        *key,
        F.col("at").alias("of"),
        F.array_join(F.transform("items", lambda x: x["rest"]), "").alias("rest"),
        F.explode(F.when(F.col("at") + early < F.col("last"), F.sequence(F.col("at") + early + 1, F.col("last")))).alias("at"),
    )
    before = sent.groupBy(*key, "at").agg(F.array_sort(F.collect_list(F.struct("of", "rest"))).alias("texts"))
    joined = F.array_join(F.transform("texts", lambda x: x["rest"]), "")
    before = before.select(*key, "at", joined.alias("before"))
    # and its entries to itself and the next `early` ones
    held = (
        texts.join(last, key)
        .withColumn("own", F.col("at"))
        .withColumn("at", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + early, F.col("last")))))
        .groupBy(*key, "at")
        .agg(F.array_sort(F.collect_list(F.struct("own", "items"))).alias("pieces"))
    )
    steps = F.flatten(
        F.transform(
            "pieces",
            lambda p: F.transform(
                p["items"], lambda x: F.struct(x["k"].alias("k"), x["rest"].alias("rest"), (p["own"] == F.col("at")).alias("own"))
            ),
        )
    )
    state = "struct<text:string,done:array<struct<k:bigint,resolved:string>>>"

    def step(acc: Column, x: Column) -> Column:
        text = E.resolve_definition(F.concat(F.lit("_idem"), x["rest"]), acc["text"])
        return F.transform(
            F.array(text),
            lambda t: F.struct(
                t.alias("text"),
                F.when(x["own"], F.concat(acc["done"], F.array(F.struct(x["k"].alias("k"), t.alias("resolved")))))
                .otherwise(acc["done"])
                .alias("done"),
            ).cast(state),
        )[0]

    begin = F.when(F.col("before").isNull(), F.col("text")).otherwise(_settled(F.concat("text", "before")))
    zero = F.struct(begin.alias("text"), F.array().alias("done")).cast(state)
    # dealt by other columns than the joins, which would keep it in few tasks
    dealt = F.xxhash64("doc_id", "run", "at")
    resolved = (
        spread(
            held.join(begun.select(*key, "text"), key).join(before, [*key, "at"], "left").withColumn("_deal", dealt), "_deal"
        )
        .select(*key, F.aggregate(steps, zero, step, lambda s: s["done"]).alias("done"))
        .select(*key, F.explode("done").alias("d"))
        .select(*key, "d.k", "d.resolved")
    )
    return resolved.unionByName(begun.select(*key, F.col("head").alias("k"), F.col("text").alias("resolved")))


def _words_before(runs: DataFrame) -> DataFrame:
    """(doc_id, run, piece, words, earlier, base_references): the words of each
    piece in order, and those of the pieces before it, last first."""
    key = ["doc_id", "run"]
    pieces = runs.groupBy(*key, "piece").agg(F.array_sort(F.collect_list(F.struct("k", "word_raw"))).alias("items"))
    pieces = cut_lineage(pieces.select(*key, "piece", F.transform("items", lambda x: x["word_raw"]).alias("words")))
    last = pieces.groupBy(*key).agg(F.max("piece").alias("last"))
    sent = pieces.join(last, key).where("piece < last").select(
        *key, F.col("piece").alias("of"), F.reverse("words").alias("words"),
        F.explode(F.sequence(F.col("piece") + 1, F.col("last"))).alias("piece"),
    )
    earlier = sent.groupBy(*key, "piece").agg(F.sort_array(F.collect_list(F.struct("of", "words")), asc=False).alias("all"))
    earlier = earlier.select(*key, "piece", F.flatten(F.transform("all", lambda x: x["words"])).alias("earlier"))
    none = F.array().cast("array<string>")
    base = runs.where("k = 0").select(*key, F.coalesce("references", none).alias("base_references"))
    return (
        pieces.join(earlier, [*key, "piece"], "left")
        .join(base, key)
        .select(*key, "piece", "words", F.coalesce("earlier", none).alias("earlier"), "base_references")
    )


# --- forms -----------------------------------------------------------------


def expand_variants(entries: DataFrame) -> DataFrame:
    """One row per form of the headword; the other columns are copied."""
    kept = [F.col(c) for c in entries.columns]
    return entries.select(
        *kept, F.posexplode(variants("word_raw")).alias("variant_no", "word")
    )
