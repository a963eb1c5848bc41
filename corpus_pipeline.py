"""Documents to token ids: quality rules, line dedup, near copies, mix, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept; all but the last return the columns of `documents`. The last numbers the
documents by the order of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.llm import bpe, jaccard, line_dedup, mixing, quality_rules
from glossweave.llm.columns import guarded
from glossweave.llm.queries import RANK_FILE
from glossweave.session import scratch_path, ship_package, shuffle_partitions


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return guarded(docs, ["text"], lambda d: quality_rules.judge(d).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of their source."""

    def cleaned(d: DataFrame) -> DataFrame:
        return line_dedup.drop_boilerplate(d).withColumn("n_chars", F.length("text").cast("long"))

    return guarded(docs, ["source", "text", "n_chars"], cleaned)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8)."""
    ship_package(spark)
    return jaccard.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sources interleaved to their natural weights, in the order
    of the files. With no source held down, every document is in the mix."""
    return mixing.interleaved(docs, shuffle_partitions(spark), max_share=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(position, doc_id, source, n_tokens, ids): the ids of the documents at the
    places that the mix has given them, from 0."""
    ship_package(spark)
    placed = _in_files(docs)
    files = placed.groupBy(F.col("_file").alias("_f")).agg(F.count("*").alias("_n"))
    part = F.regexp_extract("_f", r"^part-(\d+)", 1).cast("long")
    # one row for each file
    before = Window.orderBy(part, "_f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    encoded = bpe.encode(placed.select("_file", "_row", "doc_id", "source", "text"), RANK_FILE, public_tokenizers.PATTERN)
    return encoded.join(F.broadcast(files), F.col("_file") == F.col("_f")).select(
        (F.col("_before") + F.col("_row")).alias("position"),
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
    )


def _in_files(docs: DataFrame) -> DataFrame:
    """`docs` with the file of each row and its row there; rows that were not read
    from files have their partition's."""
    try:
        return docs.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        part = F.concat(F.lit("part-"), F.spark_partition_id().cast("string"))
        return docs.withColumns({"_file": part, "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("mix_sources", mix),
    ("byte_bpe", tokens),
]

#: SQL can express neither the near copies of whole tables nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
