"""Line dedup by site-relative frequency.

A line (trimmed of white space) is boilerplate of its host when it stands on
more than `ratio` of the host's pages, and on `min_pages` of them at least: two,
so that the lines of a host with one page are not all boilerplate. Such lines
are dropped from every page of the host; all other lines stay in order.

Pages are counted per host with map-side sums, lines are made distinct inside
their page, so a hot line or host is a partial count before it moves. The
boilerplate of a host is at most (mean lines per page) / ratio lines; it is
written out, measured, and travels with the tasks while small
(`BROADCAST_BYTES`). Larger tables are joined on (host, salt): the lines of a
host go to each of `salts` parts, so no host's pages meet in one task.

Null hosts are one host of their own. Null texts stay null, blank lines stay.
Repeated rows count as pages each. Extra columns stay; columns named n_lines and
n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.columns import guarded
from glossweave.session import cut_lineage

RATIO = 0.05
# once on one page is no repetition
MIN_PAGES = 2
BROADCAST_BYTES = 16 << 20
SALTS = 64


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def boilerplate(
    docs: DataFrame,
    host_column: str = "source",
    text_column: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, line, n_pages, host_pages) of the lines to drop."""
    host = F.col(host_column).alias("host")
    lines = F.array_distinct(F.transform(F.split(text_column, "\n"), line_key))
    counted = (
        docs.select(host, F.explode(lines).alias("line"))
        .where(F.col("line") != "")
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    totals = docs.groupBy(host).agg(F.count("*").alias("host_pages"))
    return (
        counted.join(totals, counted["host"].eqNullSafe(totals["host"]))
        .select(counted["host"], "line", "n_pages", "host_pages")
        .where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host_column: str = "source",
    text_column: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """`docs` with the text cleaned, n_lines (before) and n_dropped."""
    found = boilerplate(docs, host_column, text_column, ratio, min_pages)
    lines = cut_lineage(
        found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_drop"))
    )
    size = lines.agg(
        F.coalesce(F.sum(F.aggregate("_drop", F.lit(0), lambda a, x: a + 16 + F.octet_length(x))), F.lit(0))
    ).first()[0]
    return guarded(
        docs,
        [host_column, text_column],
        lambda pages: _cleaned(pages, lines, size <= broadcast_bytes, host_column, text_column, salts),
        ["n_lines", "n_dropped"],
    )


def _cleaned(
    pages: DataFrame, lines: DataFrame, small: bool, host_column: str, text_column: str, salts: int
) -> DataFrame:
    same = F.col(host_column).eqNullSafe(F.col("_host"))
    if small:
        joined = pages.join(F.broadcast(lines), same, "left")
    else:
        salted = lines.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = pages.withColumn("_salt", F.pmod(F.xxhash64(text_column), F.lit(salts)).cast("int"))
        joined = spread.join(salted, same & (F.col("_salt") == F.col("_part")), "left").drop("_salt", "_part")
    split = F.split(text_column, "\n")
    kept = F.when(F.col("_drop").isNull(), split).otherwise(
        F.filter(split, lambda s: ~F.array_contains(F.col("_drop"), line_key(s)))
    )
    return (
        joined.withColumn("_kept", kept)
        .withColumns(
            {
                "n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"),
                "n_dropped": F.coalesce(F.size(split) - F.size("_kept"), F.lit(0)).cast("long"),
                text_column: F.array_join("_kept", "\n"),
            }
        )
        .drop("_host", "_drop", "_kept")
    )
