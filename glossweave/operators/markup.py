"""Table jobs over words, definitions and search terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions import text as T


def normalise_terms(df: DataFrame, column: str) -> DataFrame:
    """Adds stripped, printable, printable_normalised and vector_key."""
    c = F.col(column)
    return df.withColumns(
        {
            "stripped": T.strip_marks(c),
            "printable": T.printable(c),
            "printable_normalised": T.printable_normalised(c),
            "vector_key": T.vector_key(c),
        }
    )


def markup_table(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """(…, run_no, text, style, superscripts): one row per markup run."""
    runs = df.select(
        *id_cols, F.inline(T.markup_runs(F.col("definition")))
    )
    return runs.select(
        *id_cols,
        "run_no",
        "text",
        F.when(F.col("italic"), "italic").otherwise("roman").alias("style"),
        T.superscripts(F.col("text")).alias("superscripts"),
    )


def render_definitions(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """(…, html): definition with brackets, italics and superscripts as tags."""
    html = T.italic_toggle(
        T.superscript_tags(T.html_brackets(F.col("definition")))
    )
    return df.select(*id_cols, html.alias("html"))


def search_term_counts(df: DataFrame, term_col: str) -> DataFrame:
    """(key, n): how often each decoded search term was asked for."""
    decoded = df.select(T.decode_term(F.col(term_col)).alias("term"))
    return (
        decoded.where(F.col("term").isNotNull())
        .groupBy(T.vector_key(F.col("term")).alias("key"))
        .agg(F.count("*").alias("n"))
    )
