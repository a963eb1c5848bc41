"""Text sources: whole texts in cells, and lines of files of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.session import shuffle_partitions

LINE_BREAK = r"\r\n|\r|\n"
#: Most tasks that read whole texts, for each shuffle partition.
TEXT_TASKS = 4
#: Line numbers of one chunk.
CHUNK_LINES = 1 << 16
#: Folder, hidden from plain reads, with the rows before each file of a lexicon.
FILE_ROWS = "_file_rows"
BOM = "﻿"

LEXICON_SCHEMA = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        T.StructField("word", T.StringType()),
        T.StructField("definition", T.StringType()),
        T.StructField("referenced_words", T.ArrayType(T.StringType())),
        T.StructField("key", T.StringType()),
    ]
)


def _without_bom(c):
    return F.when(c.startswith(BOM), F.substr(c, F.lit(2))).otherwise(c)


def texts_from_table(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text) from any table with a text column."""
    return df.select(
        F.col(id_col).alias("doc_id"), _without_bom(F.col(text_col)).alias("text")
    )


def lines_from_table(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, line_no, line) of texts held in a table. No shuffle."""
    texts = texts_from_table(df, id_col, text_col)
    return texts.select(
        "doc_id", F.posexplode(F.split("text", LINE_BREAK)).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row per file, for many files of moderate size. A task
    reads one after the other: starting a task of a few small files, with the
    parser's plan, takes longer than its work."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("doc_id"),
        _without_bom(F.col("value")).alias("text"),
    ).coalesce(TEXT_TASKS * shuffle_partitions(spark))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of text files, in parallel inside each file.

    A large file is cut into byte ranges like any Spark text scan. `line_no` is
    unique and increasing in file order, not consecutive: twice the byte offset
    of the range plus the row's place in its scan task. A task reads at most one
    range's length in bytes and a line has at least one, so ranges cannot
    overlap, and no shuffle, join or global sort is needed.
    """
    raw = spark.read.text(path)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select(
        F.col("_metadata.file_path").alias("doc_id"),
        (F.col("_metadata.file_block_start") * 2 + place).alias("line_no"),
        F.when(
            F.col("_metadata.file_block_start") == 0, _without_bom(F.col("value"))
        )
        .otherwise(F.col("value"))
        .alias("line"),
    )


def lines_below(lines: DataFrame, by: str, is_mark: Column, value: Column, chunk: int = CHUNK_LINES) -> DataFrame:
    """`lines` (`by`, line_no, line) without the marks, with `of`: the value of the
    last mark before the line. Lines before the first mark are left out. A mark is
    carried inside chunks of lines, and from the chunks before, so the work does
    not grow with the marks of a file."""
    mark = F.when(is_mark, F.struct("line_no", value.alias("value")))
    staged = lines.withColumns({"_chunk": F.floor(F.col("line_no") / chunk), "_mark": mark})
    last = staged.groupBy(by, "_chunk").agg(F.max("_mark").alias("_last"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(by, "_chunk", F.max("_last").over(before).alias("_carried"))
    so_far = Window.partitionBy(by, "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        staged.withColumn("_here", F.max("_mark").over(so_far))
        .join(carried, [by, "_chunk"])
        .withColumn("_at", F.coalesce("_here", "_carried"))
        .where(F.col("_mark").isNull() & F.col("_at").isNotNull())
        .select(*lines.columns, F.col("_at.value").alias("of"))
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Stored entries with the explicit lexicon schema. Ids are the rows' places:
    the rows of the files before, and the row in the file."""
    stored = T.StructType([f for f in LEXICON_SCHEMA if f.name != "entry_id"])
    rows = spark.read.schema(stored).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    files = spark.read.parquet(f"{path}/{FILE_ROWS}")
    return rows.join(F.broadcast(files), "file").select(
        (F.col("before") + F.col("row") + 1).alias("entry_id"), *(f.name for f in stored)
    )
