"""Similarity search: batches of search terms against a lexicon.

Every function scores distinct query keys against distinct lexicon keys and
joins the few winners back to queries and entries, so repeated terms and
repeated keys cost nothing. Searches read a stored index (`search_index`); a
lexicon table that is given in its place is indexed first. Scores come from

* postings with score bounds, for everything that searches a lexicon;
* the blocked product of whole vectors (`nearest_keys`), which needs no index.

Both give the same rows, and both have two routes: few queries (a checked bound)
travel with the tasks, each of which reduces its share of the keys to the best k
per query; many are cut into blocks, every pair of blocks meets in one task, and
again only the best k per query leave it.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave import constants as K
from glossweave.functions.grams import signature
from glossweave.functions.text import (
    html_brackets,
    italic_toggle,
    markup_runs,
    printable_normalised,
    vector_key,
)
from glossweave.operators.kernel import QueryBlock, gram_matrix
from glossweave.operators.search_index import SearchIndex, key_blocks, search_blocks, vector_blocks, write_index
from glossweave.session import cut_lineage, scratch_path, spread

BROADCAST_QUERIES = 8_192
#: Queries of a key, and entries of it, that meet in one place.
MEET_ROWS = 2_048
#: Queries (rows, with repeats) whose best keys travel to the entries.
FEW_QUERIES = 1_000
#: Pairs of a query key and a key whose hits lie on disk at once.
ROUND_PAIRS = 1 << 33
QUERY_BLOCK = 4_096
ITEM_BLOCK = 65_536
# Up to this key length (squared norm <= 929) only an equal vector rounds to a
# cosine of 1: markers force the other vector to nearly the same length, and two
# different integer vectors that short are then at least 1.1e-6 below 1.
EXACT_KEY_LENGTH = 22

KEY_SCORES = "q_key string, key string, score double"


def query_keys(queries: DataFrame, term_col: str = "term") -> DataFrame:
    """Queries with their search key."""
    return queries.withColumn("q_key", vector_key(F.col(term_col)))


def _score_sorted(block: QueryBlock, q_names, names: list[str]):
    names = sorted(names)
    step = block.rows_per_step()
    for at in range(0, len(names), step):
        part = names[at : at + step]
        query, item, score = block.best(gram_matrix(part))
        if len(query):
            yield (
                np.asarray(q_names, dtype=object)[query],
                np.asarray(part, dtype=object)[item],
                score,
            )


def _top(scored: DataFrame, k: int) -> DataFrame:
    """k best rows per query key; each task has already cut its rows to k."""
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "key")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("q_key", "key", "score", "rank")
    )


def _score_few(q_list, keys: DataFrame, k, threshold, inclusive) -> DataFrame:
    packed = keys.sparkSession.sparkContext.broadcast(sorted(q_list))

    def score(batches):
        q_names = packed.value
        block = QueryBlock(gram_matrix(q_names), k, threshold, inclusive)
        for batch in batches:
            for q, item, s in _score_sorted(
                block, q_names, batch.column("key").to_pylist()
            ):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.string()), pa.array(item, pa.string()), pa.array(s)],
                    names=["q_key", "key", "score"],
                )

    return spread(keys, "key").mapInArrow(score, KEY_SCORES)


def _blocks(df: DataFrame, name: str, size: int, count: int) -> tuple[DataFrame, int]:
    blocks = max(1, -(-count // size))
    return df.withColumn(name, F.pmod(F.xxhash64(df.columns[0]), F.lit(blocks))), blocks


def _score_many(
    q_keys: DataFrame, keys: DataFrame, k, threshold, inclusive, q_block, item_block
) -> DataFrame:
    """Every query block meets every item block in one bounded task group. Keys
    are distinct, so hashing fills the blocks evenly whatever the words are."""
    counts = q_keys.agg(F.count("*")).first()[0], keys.agg(F.count("*")).first()[0]
    left, n_left = _blocks(q_keys, "qb", q_block, counts[0])
    right, n_right = _blocks(keys, "ib", item_block, counts[1])
    zero = F.lit(0).cast("bigint")
    left = left.withColumn("ib", F.explode(F.sequence(zero, F.lit(n_right - 1).cast("bigint"))))
    right = right.withColumn("qb", F.explode(F.sequence(zero, F.lit(n_left - 1).cast("bigint"))))
    # much work on few bytes: not put together by bytes
    left, right = (spread(df, "qb", "ib") for df in (left, right))

    def score(q: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        names = sorted(q["q_key"])
        if not names or items.empty:
            return pd.DataFrame({"q_key": [], "key": [], "score": []})
        block = QueryBlock(gram_matrix(names), k, threshold, inclusive)
        parts = [
            pd.DataFrame({"q_key": a, "key": b, "score": s})
            for a, b, s in _score_sorted(block, names, list(items["key"]))
        ]
        if not parts:
            return pd.DataFrame({"q_key": [], "key": [], "score": []})
        found = pd.concat(parts)
        if k is None:
            return found
        found = found.sort_values(["q_key", "score", "key"], ascending=[True, False, True])
        return found.groupby("q_key", sort=False).head(k)

    return (
        left.groupBy("qb", "ib")
        .cogroup(right.groupBy("qb", "ib"))
        .applyInPandas(score, KEY_SCORES)
    )


def nearest_keys(
    q_keys: DataFrame,
    keys: DataFrame,
    k: int = K.TOP_K,
    threshold: float | None = None,
    inclusive: bool = True,
    broadcast_queries: int = BROADCAST_QUERIES,
    q_block: int = QUERY_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """(q_key, key, score, rank): the k best lexicon keys of each query key.

    `q_keys` (q_key) and `keys` (key) hold distinct non-empty keys.
    """
    return _top(_score(q_keys, keys, k, threshold, inclusive, broadcast_queries, q_block, item_block), k)


def _score(
    q_keys, keys, k, threshold, inclusive, broadcast_queries=BROADCAST_QUERIES, q_block=QUERY_BLOCK, item_block=ITEM_BLOCK
) -> DataFrame:
    first = [r.q_key for r in q_keys.limit(broadcast_queries + 1).collect()]
    if len(first) <= broadcast_queries:
        return _score_few(first, keys, k, threshold, inclusive)
    return _score_many(q_keys, keys, k, threshold, inclusive, q_block, item_block)


def all_reaching(q_keys: DataFrame, keys: DataFrame, threshold: float = K.SCORE_THRESHOLD, **kw) -> DataFrame:
    """(q_key, key, score) of all pairs scoring at least `threshold`, by the
    blocked product: what `cosine_postings` is compared with. No bound on a
    query's keys is needed, since none is ranked here."""
    return _score(q_keys, keys, None, threshold, True, **kw)


def cosine_postings(
    q_keys: DataFrame, keys: DataFrame, threshold: float = K.SCORE_THRESHOLD, **kw
) -> DataFrame:
    """(q_key, key, score) of all pairs scoring at least `threshold`, by postings
    of bigrams with score bounds: a pair that cannot reach the threshold never
    becomes a row. `keys` is cut into blocks by hash, each indexed in its task."""
    return search_blocks(q_keys, key_blocks(keys), None, threshold, **kw)


def nearest_indexed(
    q_keys: DataFrame, blocks: DataFrame, k: int = K.TOP_K, threshold: float | None = None, inclusive: bool = True, **kw
) -> DataFrame:
    """(q_key, key, score, rank), as `nearest_keys`, from blocks of an index."""
    return _top(search_blocks(q_keys, blocks, k, threshold, inclusive, **kw), k)


# --- queries against a lexicon ---------------------------------------------


def as_index(lexicon: DataFrame | SearchIndex) -> SearchIndex:
    """The index itself, or that of a lexicon table, written to scratch."""
    if isinstance(lexicon, SearchIndex):
        return lexicon
    return write_index(lexicon, scratch_path(lexicon.sparkSession, "search-index"))


def _distinct(df: DataFrame, column: str, name: str) -> DataFrame:
    return (
        df.select(F.col(column).alias(name))
        .where((F.col(name) != "") & F.col(name).isNotNull())
        .distinct()
    )


def _ranked(df: DataFrame, by, order, name: str, limit: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def _with_queries(queries: DataFrame, found: DataFrame) -> DataFrame:
    return queries.select("query_id", "q_key").join(found, "q_key")


ENTRY_FIELDS = ["entry_id", "key", "word", "definition"]


def _with_entries(queries: DataFrame, best: DataFrame, index: SearchIndex) -> tuple[DataFrame, DataFrame]:
    """The best keys of `queries`, and the entries that they are joined with. The
    keys of few queries travel to the entries, and no others are dealt out."""
    if not _few(queries):
        return best, index.entries
    best = cut_lineage(best)
    return best, _entries_with(best, index)


def _few(queries: DataFrame) -> bool:
    return queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES


def _entries_with(best: DataFrame, index: SearchIndex) -> DataFrame:
    return index.entries.join(F.broadcast(best.select("key").distinct()), "key", "left_semi")


def _entries_of(best: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k best entries of the best keys (q_key, key, score, rank), ranked per query."""
    # the keys' sizes say which entries are among the k, before entries are joined
    sizes = entries.where(F.col("key_rank") <= k).groupBy("key").agg(F.max("key_rank").alias("_n"))
    before = Window.partitionBy("q_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    wanted = best.join(sizes, "key").withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        wanted.where(F.col("_before") < k)
        .drop("rank", "_n")
        .join(entries.where(F.col("key_rank") <= k).select(*ENTRY_FIELDS, "key_rank"), "key")
        .withColumn("rank", (F.col("_before") + F.col("key_rank")).cast("int"))
        .where(F.col("rank") <= k)
        .drop("_before", "key_rank")
    )


def _meet_entries(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """Queries with their best keys (query_id, key, …) joined with all entries
    (entry_id, …) of the keys. A frequent key has very many rows on both sides:
    these are cut into pieces of about `MEET_ROWS`, and every piece of its queries
    meets every piece of its entries in a place of its own."""

    def pieces(rows: DataFrame, name: str) -> DataFrame:
        counted = rows.groupBy("key").agg(F.ceil(F.count("*") / MEET_ROWS).alias(name))
        return counted.where(F.col(name) > 1)

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        n_own, n_other = (F.coalesce(F.col(f"_n{c}"), F.lit(1)) for c in (own, other))
        cut = rows.join(F.broadcast(large), "key", "left").select(
            *rows.columns,
            F.pmod(F.xxhash64(by), n_own).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), n_other - 1)).alias(other),
        )
        return spread(cut, "key", "_q", "_e")

    # at most a row for each MEET_ROWS rows of either side
    large = pieces(asked, "_n_q").join(pieces(entries, "_n_e"), "key", "full")
    left, right = dealt(asked, "query_id", "_q", "_e"), dealt(entries, "entry_id", "_e", "_q")
    return left.join(right, ["key", "_q", "_e"]).drop("_q", "_e")


def _cut_by_query(queries: DataFrame, near: DataFrame, cut, repeats: bool) -> DataFrame:
    """`cut(rows, by)` of each query's rows of `near` (q_key, …). Queries of one key
    are cut once by key, however many they are; only those whose id has several
    keys are cut by their id. Without `repeats` an equal query counts once."""
    asked = queries.select(F.struct("query_id").alias("_of"), "q_key").where("q_key <> ''")
    if not repeats:
        asked = asked.distinct()
    several = asked.groupBy("_of").agg((F.min("q_key") < F.max("q_key")).alias("_s")).where("_s").select("_of")
    single = asked.join(several, "_of", "left_anti").join(cut(near, "q_key"), "q_key")
    mixed = cut(asked.join(several, "_of", "left_semi").join(near, "q_key"), "_of")
    found = single.unionByName(mixed).withColumn("query_id", F.col("_of.query_id"))
    return found.select("query_id", *(c for c in found.columns if c not in ("_of", "query_id")))


def find_matches(
    queries: DataFrame, lexicon: DataFrame | SearchIndex, k: int = K.TOP_K, unit: str = "entry", **kw
) -> DataFrame:
    """Top-k search without a threshold. `unit='entry'` returns the k best
    entries, `unit='key'` all entries of the k best key groups.

    queries (query_id, q_key); lexicon: an index, or a table (entry_id, key,
    word, definition, …).
    """
    index = as_index(lexicon)
    if unit == "entry":
        return _with_queries(queries, _matches(queries, index, k, **kw))
    best = cut_lineage(nearest_indexed(_distinct(queries, "q_key", "q_key"), index.blocks, k, **kw))
    entries = _entries_with(best, index) if _few(queries) else index.entries
    found = _meet_entries(_with_queries(queries, best), entries.select(ENTRY_FIELDS))
    return found.select("q_key", "query_id", "key", "score", "rank", "entry_id", "word", "definition")


def _matches(queries: DataFrame, index: SearchIndex, k: int, **kw) -> DataFrame:
    """As `find_matches` of entries, by q_key."""
    best = nearest_indexed(_distinct(queries, "q_key", "q_key"), index.blocks, k, **kw)
    return _entries_of(*_with_entries(queries, best, index), k)


def find_by_word(
    queries: DataFrame,
    lexicon: DataFrame | SearchIndex,
    k: int = K.TOP_K,
    unit: str = "word",
    nearest: int = K.MAX_HITS,
    **kw,
) -> DataFrame:
    """One entry per group for the best groups. `unit='word'`: the k best words,
    first entry of each; `unit='key'`: the k best keys, first entry of each;
    `unit='entry'`: the first entry per word among the `nearest` entries."""
    index = as_index(lexicon)
    if unit == "entry":

        def first_by_word(near: DataFrame, by: str) -> DataFrame:
            first = _ranked(near, [by, "word"], ["rank"], "_n", 1).drop("_n")
            return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank")))

        return _cut_by_query(queries, cut_lineage(_matches(queries, index, nearest, **kw)), first_by_word, False)
    best = nearest_indexed(_distinct(queries, "q_key", "q_key"), index.blocks, k, **kw)
    best, entries = _with_entries(queries, best, index)
    first = entries.where(F.col("word_rank" if unit == "word" else "key_rank") == 1).select(ENTRY_FIELDS)
    if unit == "word":
        first = _ranked(first, ["key"], ["word"], "_n", k).drop("_n")
    found = best.withColumnRenamed("rank", "group_rank").join(first, "key")
    found = _ranked(found, ["q_key"], ["group_rank", "word"], "rank", k).drop("group_rank")
    return _with_queries(queries, found)


def _equal_vectors(
    q_keys: DataFrame, signatures: DataFrame, threshold: float, inclusive: bool
) -> tuple[DataFrame, DataFrame]:
    """Queries whose vector is that of a key (q_key, key, score), and the
    others (q_key)."""
    signed = q_keys.select(
        "q_key",
        signature(F.col("q_key")).alias("sig"),
        (F.length("q_key") <= EXACT_KEY_LENGTH).alias("short"),
    )
    joined = signed.join(signatures, "sig", "left").withColumn("same", F.col("short") & F.col("key").isNotNull())
    allowed = F.lit(1.0) >= threshold if inclusive else F.lit(1.0) > threshold
    same = joined.where(F.col("same") & allowed).select("q_key", "key", F.lit(1.0).alias("score"))
    return same, joined.where(~F.col("same")).select("q_key")


def closest_keys(
    q_keys: DataFrame,
    keys: DataFrame | SearchIndex,
    threshold: float = K.SCORE_THRESHOLD,
    inclusive: bool = True,
    **kw,
) -> DataFrame:
    """(q_key, key, score): the single best lexicon key at or above (or strictly
    above) the threshold. `keys`: an index, or a table of distinct keys (key).

    A query whose vector equals a lexicon vector is answered by an equi-join on
    the vector's signature; only the others are scored.
    """
    if isinstance(keys, SearchIndex):
        signatures, blocks = keys.signatures, keys.blocks
    else:
        signatures = keys.groupBy(signature(F.col("key")).alias("sig")).agg(F.min("key").alias("key"))
        blocks = key_blocks(keys)
    same, rest = _equal_vectors(q_keys, signatures, threshold, inclusive)
    scored = nearest_indexed(rest, blocks, 1, threshold, inclusive, **kw)
    return same.unionByName(scored.select("q_key", "key", "score"))


def _closest_entries(best: DataFrame, entries: DataFrame, unit: str, max_hits: int) -> DataFrame:
    """Entries of the single best key (q_key, key, score) of each query."""
    if unit == "word":
        wanted = entries.where(F.col("first_word") & (F.col("word_rank") <= max_hits)).withColumnRenamed("word_rank", "rank")
    else:
        wanted = entries.withColumnRenamed("key_rank", "rank")
    return best.join(wanted.select(*ENTRY_FIELDS, F.col("rank").cast("int").alias("rank")), "key")


def find_closest(
    queries: DataFrame,
    lexicon: DataFrame | SearchIndex,
    threshold: float = K.SCORE_THRESHOLD,
    inclusive: bool = True,
    unit: str = "word",
    max_hits: int = K.MAX_HITS,
    **kw,
) -> DataFrame:
    """Entries of the single best group of each query, if it scores high enough.

    `unit='word'`: up to `max_hits` entries of the best word, in entry order;
    `unit='key'`: all entries of the best key; `unit='entry'`: the entries of
    the best word among the `max_hits` nearest ones.
    """
    index = as_index(lexicon)
    if unit == "entry":
        near = _matches(queries, index, max_hits, threshold=threshold, inclusive=inclusive, **kw)

        def of_best_word(near: DataFrame, by: str) -> DataFrame:
            first = Window.partitionBy(by).orderBy("rank")
            return near.withColumn("_w", F.first("word").over(first)).where(F.col("word") == F.col("_w")).drop("_w")

        return _cut_by_query(queries, cut_lineage(near), of_best_word, True)
    best = closest_keys(_distinct(queries, "q_key", "q_key"), index, threshold, inclusive, **kw)
    if unit == "word":
        return _with_queries(queries, _closest_entries(*_with_entries(queries, best, index), unit, max_hits))
    best = cut_lineage(best)
    entries = _entries_with(best, index) if _few(queries) else index.entries
    found = _meet_entries(_with_queries(queries, best), entries.select(*ENTRY_FIELDS, F.col("key_rank").cast("int").alias("rank")))
    return found.select("q_key", "query_id", "key", "score", "entry_id", "word", "definition", "rank")


def closest_or_search(
    queries: DataFrame,
    lexicon: DataFrame | SearchIndex,
    k: int = K.TOP_K,
    threshold: float = K.SCORE_THRESHOLD,
    inclusive: bool = True,
    unit: str = "word",
    max_hits: int = K.MAX_HITS,
    **kw,
) -> DataFrame:
    """The closest match of each query where there is one (`route='exact'`),
    else its top-k search (`route='search'`). One scoring pass serves both: the
    best key of a search is the closest one, if it scores high enough."""
    index = as_index(lexicon)
    same, rest = _equal_vectors(_distinct(queries, "q_key", "q_key"), index.signatures, threshold, inclusive)
    # read twice below, computed once
    best = cut_lineage(nearest_indexed(rest, index.blocks, k, **kw))
    enough = F.col("score") >= threshold if inclusive else F.col("score") > threshold
    close = best.where((F.col("rank") == 1) & enough)
    closest = same.unionByName(close.select("q_key", "key", "score"))
    entries = index.entries
    if _few(queries):
        closest = cut_lineage(closest)
        entries = _entries_with(closest.select("key").union(best.select("key")), index)
    closest = _closest_entries(closest, entries, unit, max_hits)
    search = _entries_of(best.join(close.select("q_key"), "q_key", "left_anti"), entries, k)
    fields = ["q_key", "rank", "score", *ENTRY_FIELDS]
    found = (
        closest.select(*fields)
        .withColumn("route", F.lit("exact"))
        .unionByName(search.select(*fields).withColumn("route", F.lit("search")))
    )
    return _with_queries(queries, found).drop("q_key")


def search_groups(queries: DataFrame, groups: DataFrame, k: int = K.TOP_K, **kw) -> DataFrame:
    """The documents of the k best key groups of each query, with score and rank.
    Scores come from the vectors that the documents carry (`store.key_groups`)."""
    documents = groups.where(F.col("key") != "")
    blocks = vector_blocks(documents.where("part = 0").select("key", "vector"))
    best = nearest_indexed(_distinct(queries, "q_key", "q_key"), blocks, k, **kw)
    return _with_queries(queries, best.join(documents, "key"))


def autocomplete(queries: DataFrame, lexicon: DataFrame | SearchIndex, k: int = K.TOP_K) -> DataFrame:
    """(query_id, suggestions): printable words of the best groups, best first,
    repeats kept."""
    found = find_by_word(queries, lexicon, k)
    ordered = F.sort_array(
        F.collect_list(F.struct("rank", printable_normalised(F.col("word")).alias("s")))
    )
    return found.groupBy("query_id").agg(
        F.transform(ordered, lambda x: x["s"]).alias("suggestions")
    )


def link_references(entries: DataFrame, lexicon: DataFrame | SearchIndex, **kw) -> DataFrame:
    """One row per referenced word of each entry: where its link leads.

    entries (entry_id, referenced_words). Distinct reference keys are looked up
    once for the whole table. `target` is 'word' with the popover text of the
    best match, or 'search' where nothing scores high enough.
    """
    refs = entries.select(
        "entry_id", F.posexplode("referenced_words").alias("ref_no", "reference")
    ).where(F.col("reference").isNotNull())
    refs = refs.withColumns(
        {
            "term": printable_normalised(F.col("reference")),
            "q_key": vector_key(printable_normalised(F.col("reference"))),
        }
    )
    terms = _distinct(refs, "q_key", "q_key").withColumn("query_id", F.col("q_key"))
    found = find_closest(terms, lexicon, **kw)
    cards = found.groupBy("q_key").agg(
        F.max("score").alias("score"),
        F.min("key").alias("key"),
        F.min(F.struct("entry_id", "definition")).alias("first"),
        (F.count("*") - 1).alias("more"),
    )
    popover = F.concat(
        italic_toggle(html_brackets(F.col("first.definition"))),
        F.when(
            F.col("more") > 0,
            F.concat(
                F.lit("<br />...and "), F.col("more").cast("string"), F.lit(" more.")
            ),
        ).otherwise(""),
    )
    # made once for each distinct key, not for each reference
    cards = cards.select("q_key", "key", "score", popover.alias("popover"))
    return refs.join(cards, "q_key", "left").select(
        "entry_id",
        "ref_no",
        "reference",
        "term",
        F.when(F.col("key").isNotNull(), "word").otherwise("search").alias("target"),
        "key",
        "score",
        "popover",
    )


def locate_reference_spans(entries: DataFrame) -> DataFrame:
    """(entry_id, ref_no, reference, run_no, start): where each referenced word
    stands in the roman runs of its definition, found left to right; the rest
    of a run is given up at the first word not in it."""
    runs = F.filter(markup_runs(F.col("definition")), lambda r: ~r["italic"])
    state = "struct<next:int,spans:array<struct<ref_no:int,run_no:int,start:int>>>"
    step = "struct<next:int,cursor:int,open:boolean,spans:array<struct<ref_no:int,run_no:int,start:int>>>"
    refs = F.col("referenced_words")

    def in_run(acc: Column, run: Column) -> Column:
        begin = F.struct(
            acc["next"].alias("next"),
            F.lit(1).alias("cursor"),
            F.lit(True).alias("open"),
            acc["spans"].alias("spans"),
        ).cast(step)

        def take(s: Column, ref: Column) -> Column:
            # an empty word stands at the cursor
            at = F.when(ref == "", s["cursor"]).otherwise(
                F.position(ref, run["text"], s["cursor"])
            )
            hit = s["open"] & (at > 0)
            return F.struct(
                F.when(hit, s["next"] + 1).otherwise(s["next"]).alias("next"),
                F.when(hit, at + F.length(ref)).otherwise(s["cursor"]).alias("cursor"),
                hit.alias("open"),
                F.when(
                    hit,
                    F.concat(
                        s["spans"],
                        F.array(
                            F.struct(
                                s["next"].alias("ref_no"),
                                run["run_no"].alias("run_no"),
                                (at - 1).alias("start"),
                            )
                        ),
                    ),
                )
                .otherwise(s["spans"])
                .alias("spans"),
            ).cast(step)

        left = F.slice(refs, acc["next"] + 1, F.size(refs))
        return F.aggregate(
            left,
            begin,
            take,
            lambda s: F.struct(s["next"].alias("next"), s["spans"].alias("spans")).cast(
                state
            ),
        )

    empty = F.struct(
        F.lit(0).alias("next"), F.array().alias("spans")
    ).cast(state)
    spans = F.aggregate(runs, empty, in_run, lambda s: s["spans"])
    return (
        entries.where(F.size(refs) > 0)
        .select("entry_id", "referenced_words", F.explode(spans).alias("s"))
        .select(
            "entry_id",
            F.col("s.ref_no").alias("ref_no"),
            F.get("referenced_words", F.col("s.ref_no")).alias("reference"),
            F.col("s.run_no").alias("run_no"),
            F.col("s.start").alias("start"),
        )
    )


def in_rounds(
    q_keys: DataFrame,
    keys: DataFrame,
    answer: Callable[[DataFrame, DataFrame], DataFrame],
    round_pairs: int = ROUND_PAIRS,
) -> DataFrame:
    """`answer(q_keys, keys)`, which gives rows by query key, in rounds of some of
    the query keys against all keys. The hits of all pairs grow as one times the
    other; what a round has shuffled is let go before the next one."""
    spark = q_keys.sparkSession
    q_keys, keys = cut_lineage(q_keys), cut_lineage(keys)
    rounds = -(-q_keys.count() * keys.count() // round_pairs)
    if rounds <= 1:
        return answer(q_keys, keys)
    path = scratch_path(spark, "rounds")
    for n in range(rounds):
        some = q_keys.where(F.pmod(F.xxhash64("q_key"), F.lit(rounds)) == n)
        answer(some, keys).write.mode("append").parquet(path)
        # Spark deletes shuffled files when the plans that made them are collected
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)


def compare_results(a: DataFrame, b: DataFrame, by=("query_id", "key")) -> DataFrame:
    """Per query: hits of each answer, hits in both, overlap share, and the
    largest difference of rank among the shared ones."""
    joined = (
        a.select(*by, F.col("rank").alias("rank_a"))
        .join(b.select(*by, F.col("rank").alias("rank_b")), list(by), "full")
    )
    both = F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()
    n_both = F.count(F.when(both, 1))
    return joined.groupBy(by[0]).agg(
        F.count("rank_a").alias("hits_a"),
        F.count("rank_b").alias("hits_b"),
        n_both.alias("hits_both"),
        (n_both / F.greatest(F.count("rank_a"), F.count("rank_b"))).alias("overlap"),
        F.max(F.when(both, F.abs(F.col("rank_a") - F.col("rank_b")))).alias(
            "max_rank_difference"
        ),
    )
