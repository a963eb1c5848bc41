"""Streaming counterparts of lookup, ingest and quota reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossweave.operators.search import as_index, closest_or_search, query_keys
from glossweave.operators.search_index import IndexPointer, SearchIndex
from glossweave.plans.lexicon import parse_lexicon, with_key
from glossweave.sources.lines import _without_bom


def stream_lookup(
    terms: DataFrame, lexicon: DataFrame | SearchIndex | IndexPointer, path: str, checkpoint: str, **kw
) -> StreamingQuery:
    """Answer each arriving term (query_id, term) by a stored index: its closest
    match or a search, appended to a Parquet table.

    A pointer is read anew by each batch, so an index that is published while
    the stream runs answers from the next batch on. Keys, postings and ranks are
    read as they are stored, none is computed in a batch; a lexicon table is
    indexed once, before the first. The batch number is part of the folder, so a
    batch that is run again after a failure replaces its own rows."""
    held = lexicon if isinstance(lexicon, IndexPointer) else as_index(lexicon)

    def answer(batch: DataFrame, batch_id: int) -> None:
        index = held.open(batch.sparkSession) if isinstance(held, IndexPointer) else held
        found = closest_or_search(query_keys(batch), index, **kw)
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        terms.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (doc_id, text) for text files arriving in a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    return raw.select(
        F.col("_metadata.file_path").alias("doc_id"),
        _without_bom(F.col("value")).alias("text"),
    )


def stream_ingest(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse arriving texts (doc_id, text) into the entry table at `path`.
    Parsing is row by row, so the job is a plain append stream and the file
    sink's own log makes it exactly-once."""
    return (
        with_key(parse_lexicon(texts))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_quota_report(
    events: DataFrame, path: str, checkpoint: str, window: str = "10 seconds", permits: int = 20, **kw
) -> StreamingQuery:
    """The quota report of a stream of events, as a Parquet table of changed
    windows: each batch writes the windows it has counted further, state older
    than the watermark is dropped. A repeated batch replaces its own rows."""

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        quota_report(events, window, permits, **kw)
        .writeStream.outputMode("update")
        .foreachBatch(changed)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_quota_report(changes: DataFrame) -> DataFrame:
    """One row per window and client: the counts only grow."""
    return changes.groupBy("window_start", "client").agg(
        F.max("requests").alias("requests"), F.max("over_limit").alias("over_limit")
    )


def quota_report(
    events: DataFrame,
    window: str = "10 seconds",
    permits: int = 20,
    by: str = "user_id",
    lateness: str = "1 hour",
) -> DataFrame:
    """(window_start, client, requests, over_limit) per fixed window. The same
    plan serves a table and a stream of events (ts, client)."""
    timed = events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col(by).alias("client")
    )
    if events.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    return (
        timed.groupBy(F.window("ts", window).alias("w"), "client")
        .agg(F.count("*").alias("requests"))
        .select(
            F.col("w.start").alias("window_start"),
            "client",
            "requests",
            F.greatest(F.col("requests") - permits, F.lit(0)).alias("over_limit"),
        )
    )
