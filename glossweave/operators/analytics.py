"""Corpus statistics and quality reports over an entry table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave import constants as K
from glossweave.functions.text import printable_normalised, vector_key
from glossweave.operators.search import as_index, find_closest, find_matches
from glossweave.operators.search_index import SearchIndex


def entry_count(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"))


def longest(entries: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row (length, value): the first longest value in the given order. Each
    task keeps one candidate."""
    size = F.length(column)
    best = F.min(F.struct((-size).alias("neg"), *order, F.col(column).alias("value")))
    return entries.agg(best.alias("b")).select(
        (-F.col("b.neg")).alias("length"), F.col("b.value").alias("value")
    )


def suspect_variants(entries: DataFrame) -> DataFrame:
    """Entries whose word starts with a lower-case letter."""
    return entries.where(F.col("word").rlike(r"^\p{Ll}"))


def leftover_brackets(entries: DataFrame) -> DataFrame:
    """Entries whose raw word has unbalanced square brackets."""
    opened = F.length("word") - F.length(F.translate("word", "[", ""))
    closed = F.length("word") - F.length(F.translate("word", "]", ""))
    return entries.where(opened != closed)


def _characters(df: DataFrame, text) -> DataFrame:
    return (
        df.select(F.explode(F.split(text, "")).alias("character"))
        .where(F.col("character") != "")
        .groupBy("character")
        .agg(F.count("*").alias("n"))
    )


def character_inventory(entries: DataFrame) -> DataFrame:
    """(character, n) of the printable-normalised words."""
    return _characters(entries, printable_normalised(F.col("word")))


def vector_alphabet(entries: DataFrame) -> DataFrame:
    """(character, n) of the search keys."""
    return _characters(entries, vector_key(F.col("word")))


def words_with_unexpected(
    entries: DataFrame, characters=K.UNEXPECTED_CHARACTERS
) -> DataFrame:
    """One row per entry and unexpected character in its printable word."""
    norm = printable_normalised(F.col("word"))
    found = F.filter(
        F.array(*[F.lit(c) for c in characters]), lambda c: F.contains("_norm", c)
    )
    kept = [c for c in entries.columns]
    return entries.withColumn("_norm", norm).select(
        *kept, F.col("_norm").alias("norm"), F.explode(found).alias("character")
    )


def decomposed_words(entries: DataFrame) -> DataFrame:
    """Entries whose word holds loose combining marks (not composed text), on
    which position rules may differ."""
    return entries.where(F.col("word").rlike(r"\p{M}"))


def readiness_check(
    lexicon: DataFrame | SearchIndex,
    min_keys: int = K.READY_KEY_GROUPS,
    probes=K.READY_PROBES,
    **kw,
) -> DataFrame:
    """One row: key groups, probes with a closest match, and `ready`."""
    index = as_index(lexicon)
    asked = index.spark.createDataFrame(
        [(i, p) for i, p in enumerate(probes)], "query_id int, q_key string"
    )
    hits = find_closest(asked, index, **kw).agg(
        F.count_distinct("query_id").alias("probes_found")
    )
    keys = index.entries.where("key_rank = 1").agg(F.count("*").alias("key_groups"))
    ready = (F.col("key_groups") > min_keys) & (
        F.col("probes_found") == len(tuple(probes))
    )
    return keys.crossJoin(hits).withColumn("ready", ready)


def search_report(queries: DataFrame, lexicon: DataFrame | SearchIndex, k: int = K.TOP_K) -> DataFrame:
    """(query_id, section, rank, key, word, definition, score): the top k
    entries of each term and its best match, or one 'none' row."""
    fields = ["query_id", "rank", "key", "word", "definition", "score"]
    index = as_index(lexicon)
    top = find_matches(queries, index, k).select(*fields, F.lit("top").alias("section"))
    best = find_closest(queries, index).select(*fields, F.lit("best").alias("section"))
    none = (
        queries.select("query_id")
        .join(best.select("query_id").distinct(), "query_id", "left_anti")
        .select("query_id", F.lit("none").alias("section"))
    )
    return top.unionByName(best).unionByName(none, allowMissingColumns=True)
