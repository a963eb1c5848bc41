"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import (
    bpe,
    chat,
    decontamination,
    fingerprints,
    hard_negatives,
    jaccard,
    line_dedup,
    mixing,
    ppm,
    prefix_trie,
    quality_model,
    quality_rules,
    url_filter,
)
from glossweave.llm.oracle import SQL
from glossweave.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# Host, path and verdict of the production url rules.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, d)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return run


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_format_chat(spark, d):
    """Hashes of what the formatted windows of each conversation hold."""
    own = spark.createDataFrame(
        [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(given.unionByName(own)))


@query
def op2_line_dedup(spark, d):
    """Boilerplate lines of each source dropped from its documents."""
    return line_dedup.drop_boilerplate(table(spark, d, "documents")).select(
        "doc_id", "source", "n_lines", "n_dropped", "text"
    )


@query
def op3_quality_rules(spark, d):
    """Measures and verdict of every document."""
    found = quality_rules.judge(table(spark, d, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", *(f"ok_{r.name}" for r in quality_rules.RULES),
    )


@query
def op4_fingerprints(spark, d):
    """Fingerprint of every document beside that of its edited text."""
    return fingerprints.compare_edited(table(spark, d, "documents"))


@query
def op5_url_filter(spark, d):
    """Verdict on the url of every page."""
    rules = url_filter.rule_table(spark, URL_RULES)
    return url_filter.judge(table(spark, d, "pages"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query
def op6_mix_sources(spark, d):
    """Place of every document in the interleaved corpus."""
    return mixing.mix(table(spark, d, "documents").select("doc_id", "source")).select(
        "doc_id", "source", *mixing.RESULTS
    )


@query
def op7_lm_score(spark, d):
    """Word base and PPM score of every document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = quality_model.fold("doc_id", 7) == 2
    return ppm.score(docs, docs.where(~held_out)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op8_jaccard_join(spark, d):
    """Set size and component of every document."""
    return jaccard.components(table(spark, d, "documents"))


@query
def op9_quality_classifier(spark, d):
    """Score and class of every document."""
    return quality_model.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op10_byte_bpe(spark, d):
    """Ids of every document, and its bytes decoded from them."""
    return bpe.digests(table(spark, d, "documents"), RANK_FILE, public_tokenizers.PATTERN)


@query
def op11_hard_negatives(spark, d):
    """The hardest rows of other labels of each anchor and positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_rows(table(spark, d, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


@query
def op12_decontaminate(spark, d):
    """Words of every document that stand in windows of benchmark items."""
    return decontamination.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op13_prefix_trie(spark, d):
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(table(spark, d, "conversations"))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
