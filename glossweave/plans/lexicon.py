"""Whole jobs from text to entry table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions import entries as E
from glossweave.functions.text import vector_key
from glossweave.functions.variants import variants
from glossweave.operators import parse as P
from glossweave.operators.segment import CHUNK_LINES, entry_blocks
from glossweave.session import cut_lineage, shuffle_partitions

ENTRY_COLUMNS = [
    "doc_id",
    "block_no",
    "part_no",
    "variant_no",
    "word",
    "definition",
    "referenced_words",
]
ORDER_COLUMNS = ["doc_id", "block_no", "part_no", "variant_no"]


def _entry_table(resolved: DataFrame, groups: DataFrame) -> DataFrame:
    forms = P.expand_variants(resolved).select(
        "doc_id",
        F.col("block_no").cast("bigint").alias("block_no"),
        F.lit(0).alias("part_no"),
        "variant_no",
        "word",
        "definition",
        F.col("references").alias("referenced_words"),
    )
    grouped = groups.select(
        "doc_id",
        F.col("block_no").cast("bigint").alias("block_no"),
        "part_no",
        F.lit(0).alias("variant_no"),
        "word",
        "definition",
        F.array().cast("array<string>").alias("referenced_words"),
    )
    return forms.unionByName(grouped)


def parse_lexicon(texts: DataFrame) -> DataFrame:
    """Entries of (doc_id, text) rows: one narrow pass, no shuffle."""
    block, group = F.col("block"), F.col("is_group")
    parsed = (
        P.chained_blocks(texts)
        .withColumn("is_group", E.is_group(block))
        .withColumn("at", F.when(~group, E.split_position(block)))
        .withColumns(
            {
                "word_raw": F.when(F.col("at") > 0, E.headword_at(block, F.col("at"))),
                "text": F.when(F.col("at") > 0, E.definition_at(block, F.col("at"))),
            }
        )
        .where(
            F.when(group, E.reject_reason(block).isNull()).otherwise(
                F.col("word_raw") != ""
            )
        )
    )
    own = F.struct(
        F.col("word_raw"),
        F.col("text").alias("definition"),
        F.array_distinct(E.extract_references(F.col("text"))).alias("references"),
    ).cast(P.ENTRY_STRUCT)
    resolved = parsed.withColumn("own", F.when(~group, own)).withColumn(
        "entry", F.when(~group, P.resolved_entry(F.col("own"), F.col("prior")))
    )
    listed = resolved.select(
        "doc_id",
        F.col("block_no").cast("bigint").alias("block_no"),
        "is_group",
        F.when(group, E.group_headwords(block))
        .otherwise(variants("word_raw"))
        .alias("words"),
        F.when(group, E.group_definition(block))
        .otherwise(F.col("entry.definition"))
        .alias("definition"),
        F.when(group, F.array().cast("array<string>"))
        .otherwise(F.col("entry.references"))
        .alias("referenced_words"),
    )
    # the outer form keeps Catalyst from adding a filter on the array's size,
    # which would compute every form twice
    exploded = listed.select("*", F.posexplode_outer("words").alias("i", "word"))
    return exploded.where(F.col("word").isNotNull()).select(
        "doc_id",
        "block_no",
        F.when(group, F.col("i")).otherwise(0).alias("part_no"),
        F.when(group, 0).otherwise(F.col("i")).alias("variant_no"),
        "word",
        "definition",
        "referenced_words",
    )


def ranged_texts(texts: DataFrame) -> DataFrame:
    """Texts, or what they are derived from, split by ranges of doc_id and not
    parsed yet: their entries are in source order once each task has sorted its
    own (`store.write_lexicon`)."""
    return texts.repartitionByRange(shuffle_partitions(texts.sparkSession), "doc_id")


def parse_lexicon_lines(lines: DataFrame, chunk: int = CHUNK_LINES) -> DataFrame:
    """Entries of (doc_id, line_no, line) rows, for documents of any size."""
    # read by both kinds of entries, and by the jobs that resolve idem
    blocks = cut_lineage(entry_blocks(lines, chunk))
    entries = P.with_references(P.split_entries(blocks))
    return _entry_table(P.resolve_idem(entries, chunk), P.parse_groups(blocks))


def consecutive_blocks(entries: DataFrame, chunk: int = CHUNK_LINES) -> DataFrame:
    """`entries` with the blocks of each document numbered 0, 1, 2, … in place of
    their line numbers: ranks inside bounded chunks of lines, after the counts of
    the chunks before."""
    staged = entries.withColumn("_chunk", F.floor(F.col("block_no") / chunk))
    counts = staged.groupBy("doc_id", "_chunk").agg(F.count_distinct("block_no").alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("doc_id", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.dense_rank().over(Window.partitionBy("doc_id", "_chunk").orderBy("block_no"))
    return (
        staged.withColumn("_in", inside)
        .join(bases, ["doc_id", "_chunk"])
        .withColumn("block_no", F.col("_base") + F.col("_in") - 1)
        .select(entries.columns)
    )


def with_key(entries: DataFrame) -> DataFrame:
    return entries.withColumn("key", vector_key(F.col("word")))
