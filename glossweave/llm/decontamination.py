"""Benchmark decontamination: a prefix-filtered set join of item windows.

A window is `WINDOW` consecutive words of a benchmark item (an item of fewer is
one window). Its set are its shingles of `SHINGLE` words. A window stands in a
document only where all its shingles do, so of any order one shingle is a
sufficient prefix: the order is by rarity in the documents, and the rarest
shingle joins.

1. One pass over the texts explodes the shingles of each document and keeps
   those that some window has, with their places; one more row per document
   carries its id and length. This table is written, all later steps read it.
2. The shingles of the table are counted, each window takes its rarest.
3. Places of that shingle, less its offset in the window, are candidate places
   of the window, where the whole window fits between the document's ends.
4. A candidate is verified word by word: the shingles that cover the window must
   stand at their places. Shingles are strings, nothing is decided by a hash.
5. Words under verified windows are counted as the union of intervals.

DataFrame functions only. The windows' tables travel with the tasks up to
`BROADCAST_ROWS` rows, which are counted first; beyond, both sides are dealt by
shingle and a salt, so that a frequent shingle is many tasks. No step gathers a
document's words or a window's documents.

A null text has no words. Every row has a result, also where ids repeat or are
null. A null item id counts as the id ''; rows that repeat an item id are one
item with all their windows; an item without words has none. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.session import scratch_path

WINDOW = 10
SHINGLE = 3
# what is not a word, before lower-casing
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    known = F.coalesce(text, F.lit(""))
    # the general function maps letters beyond A-Z as well
    lowered = F.when(F.octet_length(known) == F.length(known), F.lower(known)).otherwise(
        F.translate(known, _UPPER, _LOWER)
    )
    return F.filter(F.split(lowered, WORD_GAP), lambda w: w != "")


def _shingles(words: Column, k: int) -> Column:
    """All runs of k words, in order."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))),
        lambda w, i: F.concat_ws(" ", w, *(F.get(words, i + j) for j in range(1, k))),
    )


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(wid, length, tokens, items): distinct windows, their shingles in order,
    and the ids of the items that hold them. Written."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = items.select("item", "words", F.explode(starts).alias("at")).select(
        "item", F.slice("words", F.col("at"), window).alias("words")
    )
    spans = cut.groupBy("words").agg(F.collect_set("item").alias("items"))
    tokens = _shingles(F.col("words"), shingle)
    for k in range(shingle - 1, 0, -1):
        tokens = F.when(F.size("words") == k, _shingles(F.col("words"), k)).otherwise(tokens)
    return _written(
        spans.select(
            F.monotonically_increasing_id().alias("wid"), F.size("words").alias("length"), tokens.alias("tokens"), "items"
        ),
        "item-windows",
    )


def _meet(left: DataFrame, right: DataFrame, on: str, salt: Column, broadcast_rows: int) -> DataFrame:
    """Inner join on one column. `right` travels if it is small; else `left` is
    dealt by the column and `salt`, and `right` goes to every salt."""
    if right.count() <= broadcast_rows:
        return left.join(F.broadcast(right), on)
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return (
        left.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
        .join(right.withColumn("_salt", F.explode(salts)), [on, "_salt"])
        .drop("_salt")
    )


def _places(docs: DataFrame, tokens: DataFrame, sizes: list[int], broadcast_rows: int) -> DataFrame:
    """(rid, doc_id, n_words, pos, sid): known shingles of each document; the row
    with sid -1 is the document's own."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), words_of(F.col("text")).alias("words")
    ).withColumn("n_words", F.size("words"))
    runs = F.concat(F.array(F.lit("")), *(_shingles(F.col("words"), k) for k in sizes))
    place = F.col("at") - 1
    pos = place
    before = F.lit(0)
    for a, _ in zip(sizes, sizes[1:]):
        before = before + F.greatest(F.col("n_words") - (a - 1), F.lit(0))
        pos = F.when(place >= before, place - before).otherwise(pos)
    found = numbered.select("rid", "doc_id", "n_words", F.posexplode(runs).alias("at", "token")).select(
        "rid", "doc_id", "n_words", pos.cast("int").alias("pos"), "token"
    )
    own = docs.sparkSession.createDataFrame([(-1, "")], "sid long, token string")
    met = _meet(found, tokens.unionByName(own), "token", F.xxhash64("rid", "pos"), broadcast_rows)
    return _written(
        met.select(
            "rid", F.when(F.col("sid") < 0, F.col("doc_id")).alias("doc_id"), "n_words", "pos", "sid"
        ),
        "shingle-places",
    )


def _occurrences(places: DataFrame, windows: DataFrame, tokens: DataFrame, shingle: int, broadcast_rows: int) -> DataFrame:
    """(rid, wid, start, length): verified places of windows."""
    inside = places.where("sid >= 0").select("rid", "n_words", "pos", "sid")
    members = windows.select("wid", "length", F.posexplode("tokens").alias("offset", "token")).join(tokens, "token")
    members = _written(members.select("wid", "length", "offset", "sid"), "window-shingles")
    counts = inside.groupBy("sid").agg(F.count("*").alias("n"))
    # a window with a shingle that no document has drops out here: it has no count
    rarest = (
        members.join(counts, "sid", "left")
        .groupBy("wid", "length")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sid", "offset")).alias("first"))
        .where("first.n > 0")
        .select("wid", "length", "first.sid", "first.offset")
    )
    salt = F.xxhash64("rid", "pos")
    candidates = _written(
        _meet(inside, _written(rarest, "window-prefixes"), "sid", salt, broadcast_rows)
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .select("rid", "wid", "start", "length"),
        "window-candidates",
    )
    # every word of the window lies under one of these shingles
    covering = members.where(
        (F.col("offset") % shingle == 0) | (F.col("offset") == F.col("length") - F.least(F.lit(shingle), F.col("length")))
    ).select("wid", "offset", "sid")
    asked = _meet(candidates, covering, "wid", F.xxhash64("rid", "start"), broadcast_rows).select(
        "rid", "wid", "start", "length", "sid", (F.col("start") + F.col("offset")).alias("pos")
    )
    needed = F.ceil((F.col("length") - F.least(F.lit(shingle), F.col("length"))) / shingle) + 1
    return (
        asked.join(inside.select("rid", "pos", "sid"), ["rid", "pos", "sid"])
        .groupBy("rid", "wid", "start", "length")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == needed)
        .select("rid", "wid", "start", "length")
    )


def _hit_words(found: DataFrame) -> DataFrame:
    """(rid, n_hit): words under at least one window."""
    spans = found.groupBy("rid", "start").agg(F.max("length").alias("length"))
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    fresh = F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0))
    return spans.select("rid", fresh.alias("fresh")).groupBy("rid").agg(F.sum("fresh").alias("n_hit"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row
    per row of `docs`."""
    shingle = min(shingle, window)
    windows = item_windows(benchmark, window, shingle)
    tokens = _written(
        windows.select(F.explode("tokens").alias("token"))
        .distinct()
        .select(F.monotonically_increasing_id().alias("sid"), "token"),
        "window-tokens",
    )
    # at most `shingle` numbers
    short = F.least(F.col("length"), F.lit(shingle)).alias("k")
    sizes = sorted((r.k for r in windows.select(short).distinct().collect()), reverse=True)
    places = _places(docs, tokens, sizes, broadcast_rows)
    found = _written(_occurrences(places, windows, tokens, shingle, broadcast_rows), "window-places")
    held = windows.select("wid", F.explode("items").alias("item"))
    items = (
        _meet(found.select("rid", "wid").distinct(), held, "wid", F.xxhash64("rid"), broadcast_rows)
        .groupBy("rid")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    own = places.where("sid < 0").select("rid", "doc_id", "n_words")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        own.join(_hit_words(found), "rid", "left")
        .join(items, "rid", "left")
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )
