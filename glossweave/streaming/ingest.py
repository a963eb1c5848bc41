"""Ingest that replaces: arriving texts become entries, and a document that
arrives again takes the place of what it was.

The table is a folder of parts, one per batch, and a manifest that names the parts
that count, oldest first (a version of `versions`, created exclusively). A part
holds the entries of its documents and one row per document, also for documents
without entries: that row is the tombstone of the document's entries in all parts
before. So

* a batch is its folder until its manifest is written: one that is killed changes
  nothing, and the folder of its next try is another;
* a batch that is repeated after its manifest was written is known by its number
  and left out;
* readers see the parts of one manifest, and of each document the last part.

A null text removes its document. Of rows that repeat a document in one batch the
one with the greatest text counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossweave.operators import versions
from glossweave.plans.lexicon import parse_lexicon, with_key

#: Stale (document, part) rows that may travel with the tasks.
BROADCAST_ROWS = 500_000
_NAME = "manifest"


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(version, {"parts": [[number, folder], …], "last": {stream: batch}})."""
    found = versions.current(spark, path, _NAME)
    return (found[0], json.loads(found[1])) if found else (0, {"parts": [], "last": {}})


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """The next manifest, if `version` is still the current one. Parts that no
    kept manifest names are dropped."""
    before = versions.versions(spark, path, _NAME)
    versions.commit(spark, path, _NAME, json.dumps(manifest), after=version, folders=False)
    kept = {part[1] for _, text in versions.versions(spark, path, _NAME) for part in json.loads(text)["parts"]}
    for folder in {part[1] for _, text in before for part in json.loads(text)["parts"]} - kept:
        versions.drop(spark, folder)


def merge_batch(texts: DataFrame, path: str, stream: str, batch_id: int) -> bool:
    """Merge one batch of (doc_id, text) into the table at `path`. False if this
    batch of the stream is in it already."""
    spark = texts.sparkSession
    version, manifest = _manifest(spark, path)
    if manifest["last"].get(stream, -1) >= batch_id:
        return False
    number = max((n for n, _ in manifest["parts"]), default=0) + 1
    folder = f"{path}/part-{number}-{uuid.uuid4().hex}"
    docs = texts.groupBy("doc_id").agg(F.max("text").alias("text"))
    docs.write.parquet(f"{folder}/texts")
    docs = spark.read.parquet(f"{folder}/texts")
    with_key(parse_lexicon(docs.where("text is not null"))).write.parquet(f"{folder}/entries")
    docs.select("doc_id").write.parquet(f"{folder}/docs")
    versions.drop(spark, f"{folder}/texts")
    manifest["parts"].append([number, folder])
    manifest["last"][stream] = batch_id
    _commit(spark, path, version, manifest)
    return True


def _parts(spark: SparkSession, manifest: dict, table: str) -> DataFrame | None:
    found = None
    for number, folder in manifest["parts"]:
        rows = spark.read.parquet(f"{folder}/{table}").withColumn("_part", F.lit(number))
        found = rows if found is None else found.unionByName(rows)
    return found


def _latest(spark: SparkSession, manifest: dict) -> tuple[DataFrame, DataFrame] | None:
    """(entries, docs), the last part of each document."""
    docs = _parts(spark, manifest, "docs")
    if docs is None:
        return None
    last = docs.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_part").alias("_last"))
    stale = docs.join(last, F.col("doc_id").eqNullSafe(F.col("_doc"))).where("_part < _last")
    stale = stale.select("_doc", F.col("_part").alias("_old"))
    # few documents are replaced between compactions, whatever their size
    if stale.count() <= BROADCAST_ROWS:
        stale = F.broadcast(stale)
    entries = _parts(spark, manifest, "entries")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_part") == F.col("_old"))
    return entries.join(stale, same, "left_anti").drop("_part"), last.select(F.col("_doc").alias("doc_id"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the current manifest."""
    found = _latest(spark, _manifest(spark, path)[1])
    if found is None:
        raise FileNotFoundError(f"nothing was ingested into {path}")
    return found[0]


def compact(spark: SparkSession, path: str) -> None:
    """One part in the place of all. RuntimeError if a batch was merged meanwhile:
    nothing changes then. Readers of the manifest before can finish."""
    version, manifest = _manifest(spark, path)
    found = _latest(spark, manifest)
    if found is None or len(manifest["parts"]) == 1:
        return
    number = manifest["parts"][-1][0]
    folder = f"{path}/part-{number}-{uuid.uuid4().hex}"
    found[0].write.parquet(f"{folder}/entries")
    found[1].write.parquet(f"{folder}/docs")
    _commit(spark, path, version, manifest | {"parts": [[number, folder]]})


def stream_merge(texts: DataFrame, path: str, checkpoint: str, stream: str = "texts", compact_after: int = 32) -> StreamingQuery:
    """Merge a stream of (doc_id, text) into the table at `path`. `stream` names
    the source: each has its own batch numbers. More than `compact_after` parts
    are made one."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if merge_batch(batch, path, stream, batch_id) and len(_manifest(spark, path)[1]["parts"]) > compact_after:
            compact(spark, path)

    return (
        texts.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
