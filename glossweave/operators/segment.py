"""Segmentation: lines of a document into entry blocks.

Two equal routes lead to blocks.

* `blocks_of_texts` works inside each row of a (doc_id, text) table with string
  and array functions: no shuffle at all.
* The line route works on (doc_id, line_no, line) and never puts a whole
  document into one task. Lines are cut into chunks of bounded length; running
  state is a window inside a chunk plus a carried value from the chunks before
  it, worked out on one small summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave import constants as K
from glossweave.functions.entries import is_definition_line
from glossweave.functions.text import trim_ws

CHUNK_LINES = 1 << 16


# --- line route ------------------------------------------------------------


def is_end(line: Column) -> Column:
    return trim_ws(line) == K.END_MARKER


def is_heading(line: Column) -> Column:
    return line.rlike(K.HEADING_PATTERN) & ~line.contains("\n")


def is_blank(line: Column) -> Column:
    return trim_ws(line) == ""


def mark_definition_lines(lines: DataFrame) -> DataFrame:
    """Adds `is_mark`: the line can open an entry."""
    return lines.withColumn("is_mark", is_definition_line(F.col("line")))


def _first_line(lines: DataFrame, condition: Column, name: str) -> DataFrame:
    """(doc_id, name): first matching line of each document. Lines are filtered
    before the shuffle and pre-aggregated, so one row per task and document
    moves."""
    return (
        lines.where(condition).groupBy("doc_id").agg(F.min("line_no").alias(name))
    )


def cut_at_end(lines: DataFrame) -> DataFrame:
    """Lines before the end marker, all lines where there is none."""
    end = _first_line(lines, is_end(F.col("line")), "end_line")
    return (
        lines.join(end, "doc_id", "left")
        .where(F.col("end_line").isNull() | (F.col("line_no") < F.col("end_line")))
        .select("doc_id", "line_no", "line")
    )


def skip_to_first_heading(lines: DataFrame) -> DataFrame:
    """Lines after the first all-capitals line; none where there is no such
    line."""
    heading = _first_line(lines, is_heading(F.col("line")), "heading_line")
    return (
        lines.join(heading, "doc_id")
        .where(F.col("line_no") > F.col("heading_line"))
        .select("doc_id", "line_no", "line")
    )


def entry_lines(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(doc_id, para, line_no, line): the lines that belong to entry blocks.

    A line belongs to one if it is not blank, lies after the first heading and
    before the end marker, and a definition line was met since the last blank.
    `para` is the line number of the last blank line before it.
    """
    line, line_no = F.col("line"), F.col("line_no")
    chunked = lines.select(
        "doc_id",
        F.floor(line_no / chunk_lines).alias("chunk"),
        "line_no",
        "line",
        F.when(is_blank(line), line_no).alias("blank_at"),
        F.when(is_definition_line(line), line_no).alias("mark_at"),
    )
    summary = chunked.groupBy("doc_id", "chunk").agg(
        F.min(F.when(is_heading(line), line_no)).alias("heading_at"),
        F.min(F.when(is_end(line), line_no)).alias("end_at"),
        F.max("blank_at").alias("last_blank"),
        F.max("mark_at").alias("last_mark"),
    )
    whole = Window.partitionBy("doc_id")
    before = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "doc_id",
        "chunk",
        F.min("heading_at").over(whole).alias("heading"),
        F.min("end_at").over(whole).alias("end"),
        F.max("last_blank").over(before).alias("blank_before"),
        F.max("last_mark").over(before).alias("mark_before"),
    ).where(F.col("heading").isNotNull())
    so_far = (
        Window.partitionBy("doc_id", "chunk")
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = chunked.select(
        "doc_id",
        "chunk",
        "line_no",
        "line",
        "blank_at",
        F.max("blank_at").over(so_far).alias("blank_here"),
        F.max("mark_at").over(so_far).alias("mark_here"),
    )
    para = F.greatest("blank_here", "blank_before", F.lit(-1))
    mark = F.greatest("mark_here", "mark_before", F.lit(-1))
    return (
        running.join(carried, ["doc_id", "chunk"])
        .where(
            F.col("blank_at").isNull()
            & (line_no > F.col("heading"))
            & (F.col("end").isNull() | (line_no < F.col("end")))
            & (mark > F.col("heading"))
            & (mark > para)
        )
        .select("doc_id", para.alias("para"), "line_no", "line")
    )


def _piece(line: Column) -> Column:
    """A line as it is appended to its block."""
    return F.when(line.contains("}"), F.concat(line, F.lit("\n"))).otherwise(
        F.concat(F.lit(" "), trim_ws(line))
    )


def join_block(lines: DataFrame) -> DataFrame:
    """(doc_id, block_no, block): lines of each block joined in order. One
    output cell holds one block, so a group is never larger than its result."""
    pieces = F.sort_array(F.collect_list(F.struct("line_no", "piece")))
    joined = F.array_join(F.transform(pieces, lambda x: x["piece"]), "")
    return (
        lines.withColumn("piece", _piece(F.col("line")))
        .groupBy("doc_id", "para")
        .agg(F.min("line_no").alias("block_no"), joined.alias("block"))
        .select("doc_id", "block_no", trim_ws(F.col("block")).alias("block"))
    )


def entry_blocks(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(doc_id, block_no, block) by the line route."""
    return join_block(entry_lines(lines, chunk_lines))


# --- whole-text route ------------------------------------------------------

_MARK = "(?:{})".format(
    "|".join(
        [r"[^\n]*(?: _|,_|\})"]
        + [p.replace("[", r"\[").replace("]", r"\]") for p in K.MARK_PREFIXES]
    )
)
_END_LINE = "(?md)^[{ws}&&[^\\n]]*{end}[{ws}&&[^\\n]]*$".format(
    ws=K.WS, end=K.END_MARKER.replace(".", r"\.")
)


def _marked_part(paragraph: Column) -> Column:
    """The paragraph from its first marked line on, '' without one."""
    return F.regexp_extract(paragraph, rf"(?sd)(?:\A|\n)({_MARK}.*)\z", 1)


def _block_of_part(marked: Column) -> Column:
    plain = F.regexp_replace(marked, rf"[{K.WS}]*\n[{K.WS}]*", " ")
    braces = F.array_join(F.transform(F.split(marked, "\n"), _piece), "")
    return trim_ws(F.when(marked.contains("}"), braces).otherwise(plain))


def block_array(text: Column) -> Column:
    """ARRAY<STRING> of the entry blocks of one text, in order."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    before_end = F.get(F.split(unix, _END_LINE, 2), F.lit(0))
    body = F.get(F.split(before_end, "(?md)^[A-Z]+$", 2), F.lit(1))
    paragraphs = F.split(body, rf"\n[{K.WS}]*\n")
    marked = F.filter(F.transform(paragraphs, _marked_part), lambda p: p != "")
    return F.transform(marked, _block_of_part)


def blocks_of_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, block_no, block) by the whole-text route."""
    return texts.select(
        "doc_id",
        F.posexplode(block_array(F.col("text"))).alias("block_no", "block"),
    )
