"""Registered queries: each runs one operator over whole source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.fixtures import lexicon_texts, words_of
from glossweave.functions import text as T
from glossweave.functions.grams import char_grams
from glossweave.functions.variants import variants
from glossweave.constants import REPORT_TERMS, SCORE_THRESHOLD
from glossweave.operators import analytics as A
from glossweave.operators import embeddings as E
from glossweave.operators import markup as M
from glossweave.operators import parse as P
from glossweave.operators import search as S
from glossweave.operators import search_index as I
from glossweave.operators import segment as G
from glossweave.operators import store as W
from glossweave.operators import vector_index as X
from glossweave.operators import vectors as V
from glossweave.plans.lexicon import (
    ORDER_COLUMNS,
    consecutive_blocks,
    parse_lexicon,
    parse_lexicon_lines,
    ranged_texts,
    with_key,
)
from glossweave.session import scratch_path, spread
from glossweave.sources.lines import (
    lines_below,
    lines_from_table,
    read_lexicon,
    read_lines,
    read_texts,
)
from glossweave.streaming import ingest as N
from glossweave.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- shared inputs ---------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return lexicon_texts(table(spark, d, "documents"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_from_table(texts(spark, d))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return G.blocks_of_texts(texts(spark, d))


def entries(spark: SparkSession, d: str) -> DataFrame:
    return with_key(parse_lexicon(texts(spark, d)))


def ranged_entries(spark: SparkSession, d: str) -> DataFrame:
    """The same, from texts in ranges of ids."""
    return with_key(parse_lexicon(lexicon_texts(ranged_texts(table(spark, d, "documents").select("doc_id", "text")))))


def word_keys(spark: SparkSession, d: str) -> DataFrame:
    """(key): distinct non-empty search keys of all words of `documents`."""
    words = table(spark, d, "documents").select(
        F.explode(words_of(F.col("text"))).alias("word")
    )
    return V.distinct_keys(words).where(F.col("key") != "")


def part_keys(spark: SparkSession, d: str) -> DataFrame:
    """(q_key): distinct search keys of the part names."""
    return (
        table(spark, d, "part")
        .select(T.vector_key(F.col("p_name")).alias("q_key"))
        .where(F.col("q_key") != "")
        .distinct()
    )


def user_terms(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, term, q_key): every word of each user turn."""
    return S.query_keys(_user_words(table(spark, d, "conversations")))


def _user_words(conversations: DataFrame) -> DataFrame:
    return (
        conversations.where(F.col("role") == "user")
        .select("conv_id", "turn", F.posexplode(words_of(F.col("text"))).alias("at", "term"))
        .select(F.concat_ws("-", "conv_id", "turn", "at").alias("query_id"), "term")
    )


def term_keys(spark: SparkSession, d: str) -> DataFrame:
    """(q_key): distinct search keys of the user terms."""
    terms = user_terms(spark, d)
    return terms.select("q_key").where(F.col("q_key") != "").distinct()


_STORED: dict[tuple[str, str], str] = {}


def stored_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon of the derived texts, written once per session and source,
    as a service that answers many searches would hold it."""
    slot = (spark.sparkContext.applicationId, d)
    if slot not in _STORED:
        path = scratch_path(spark, "lexicon")
        W.write_lexicon(ranged_entries(spark, d), path, ORDER_COLUMNS, ranged=True)
        _STORED[slot] = path
    return read_lexicon(spark, _STORED[slot])


_INDEXED: dict[tuple[str, str], I.IndexPointer] = {}


def stored_index(spark: SparkSession, d: str) -> I.SearchIndex:
    """The search index of the stored lexicon, published once per session and
    source, opened by its pointer."""
    slot = (spark.sparkContext.applicationId, d)
    if slot not in _INDEXED:
        _INDEXED[slot] = I.publish_index(stored_lexicon(spark, d), scratch_path(spark, "indexes"), "lexicon")
    return _INDEXED[slot].open(spark)


_VECTORS: dict[tuple[str, str], str] = {}


def vector_index(spark: SparkSession, d: str) -> X.VectorIndex:
    """The index of the embeddings, with labels and graphs, written once per
    session and source."""
    slot = (spark.sparkContext.applicationId, d)
    if slot not in _VECTORS:
        path = scratch_path(spark, "vector-index")
        X.write_vector_index(table(spark, d, "embeddings"), path, "label", graphs=True)
        _VECTORS[slot] = path
    return X.open_vector_index(spark, _VECTORS[slot])


def _references(c: str = "referenced_words"):
    return F.array_join(c, "|").alias("refs")


# --- sources and sinks -----------------------------------------------------


@query
def src1_read_lines(spark, d):
    path = scratch_path(spark, "texts")
    texts(spark, d).select("text").write.text(path)
    found = read_lines(spark, path)
    return found.groupBy("line").agg(F.count("*").alias("n"))


@query
def src1_read_lines_in_order(spark, d):
    """Lines of files that hold many texts each, with the text and the place of
    each line: a line with the id stands before every text."""
    path = scratch_path(spark, "marked")
    marked = F.concat(F.lit("@text "), F.col("doc_id"), F.lit("\n"), F.col("text"))
    texts(spark, d).select(marked).write.text(path)
    number = F.regexp_extract("line", r"^@text (\d+)$", 1)
    found = lines_below(read_lines(spark, path).withColumnRenamed("doc_id", "file"), "file", number != "", number.cast("bigint"))
    return consecutive_blocks(
        found.select(F.col("of").alias("doc_id"), F.col("line_no").alias("block_no"), "line")
    ).select("doc_id", F.col("block_no").alias("line_no"), "line")


@query
def src1_read_texts(spark, d):
    """A file for each text, all in one folder; its first line names the text."""
    path = scratch_path(spark, "books")
    # texts of one id are in one file
    each = spread(texts(spark, d).select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    name = F.concat(F.lit("@text "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # a folder for each text is made, listed and read in twice the time; and tasks
    # put their own files in place: the driver would move a file for each text
    own = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "maxRecordsPerFile": 1}
    each.select(F.array_join(F.concat(F.array(name), "texts"), "\n")).write.options(**own).text(path)
    # a task without texts may leave an empty file
    found = read_texts(spark, path).where(F.col("text").startswith("@text "))
    number = F.regexp_extract("text", r"^@text (\d+)", 1).cast("bigint")
    named = found.select(number.alias("doc_id"), F.substr("text", F.instr("text", "\n") + 1).alias("text"))
    return parse_lexicon(named).select("doc_id", "block_no", "part_no", "variant_no", "word", "definition")


@query
def src2_lines_from_table(spark, d):
    return lines_from_table(table(spark, d, "documents"))


@query
def src3_read_lexicon(spark, d):
    return stored_lexicon(spark, d).select(
        "entry_id", "word", "definition", _references(), "key"
    )


@query
def snk1_write_lexicon(spark, d):
    path = scratch_path(spark, "lexicon")
    W.write_lexicon(ranged_entries(spark, d), path, ORDER_COLUMNS, ranged=True)
    return read_lexicon(spark, path).select("entry_id", "word", "key")


@query
def snk2_write_key_groups(spark, d):
    path = scratch_path(spark, "groups")
    W.write_key_groups(stored_lexicon(spark, d), path)
    found = spark.read.parquet(path)
    return found.select(
        "key",
        "part",
        F.col("partition_key").cast("string").alias("partition_key"),
        "n_entries",
        F.array_join(F.transform("word_definitions", lambda e: e["entry_id"].cast("string")), ",").alias("entries"),
    )


@query
def snk2_key_group_vectors(spark, d):
    """The vector that every document of a key carries."""
    path = scratch_path(spark, "groups")
    W.write_key_groups(stored_lexicon(spark, d), path)
    listed = F.transform("vector", lambda g: F.concat_ws(":", g["gram"], g["tf"].cast("string")))
    return spark.read.parquet(path).select("key", "part", F.array_join(F.array_sort(listed), "|").alias("vector"))


@query
def snk2_search_key_groups(spark, d):
    """Best key groups of the user terms, from the vectors of the documents."""
    path = scratch_path(spark, "groups")
    W.write_key_groups(stored_lexicon(spark, d), path)
    found = S.search_groups(user_terms(spark, d), spark.read.parquet(path), 10)
    return found.select("query_id", "rank", "key", "score", "n_entries").where("part = 0")


@query
def snk3_json_payload(spark, d):
    payload = W.to_json_payload(stored_lexicon(spark, d))
    return W.from_json_payload(payload).select(
        "entry_id", "word", "definition", _references()
    )


@query
def snk4_export_by_letter(spark, d):
    path = scratch_path(spark, "letters")
    W.export_by_letter(stored_lexicon(spark, d), path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return back.select(
        F.col("letter").cast("string").alias("letter"),
        "word",
        "definition",
        F.coalesce("references", F.lit("")).alias("refs"),
    )


@query
def snk5_upsert_by_id(spark, d):
    """References become the changed entries; search entries keep theirs."""
    lex = stored_lexicon(spark, d).select("entry_id", "word", "definition")
    changes = lex.where(F.col("definition").startswith("_as_")).withColumn(
        "definition", F.concat(F.lit("changed "), "definition")
    )
    return W.upsert_by_id(lex, changes, "entry_id")


@query
def snk6_index_on_word(spark, d):
    path = scratch_path(spark, "by_word")
    W.index_on_word(stored_lexicon(spark, d), path)
    return spark.read.parquet(path).groupBy("word").agg(F.count("*").alias("n"))


# --- segmentation ----------------------------------------------------------


@query
def seg1_cut_at_end(spark, d):
    return G.cut_at_end(lines(spark, d))


@query
def seg2_skip_to_first_heading(spark, d):
    return G.skip_to_first_heading(lines(spark, d))


@query
def seg3_mark_definition_lines(spark, d):
    return G.mark_definition_lines(lines(spark, d))


@query
def seg4_entry_lines(spark, d):
    return G.entry_lines(lines(spark, d)).select("doc_id", "line_no", "line")


@query
def seg5_join_block(spark, d):
    return G.join_block(G.entry_lines(lines(spark, d)))


@query
def seg6_flush_tail(spark, d):
    """The last block of each document, by the whole-text route."""
    found = blocks(spark, d)
    return found.groupBy("doc_id").agg(
        F.max_by("block", "block_no").alias("block"), F.count("*").alias("blocks")
    )


# --- parsing ---------------------------------------------------------------


@query
def par1_split_entry(spark, d):
    return P.split_entries(blocks(spark, d)).select(
        "doc_id", "block_no", "word_raw", "definition"
    )


@query
def par2_clean_headword(spark, d):
    """Whole pages read as headwords, emphasis as brackets."""
    from glossweave.functions.entries import clean_headword

    tagged = F.concat(F.lit("<i>"), F.col("html"), F.lit("</i>[er]"))
    return table(spark, d, "pages").select(
        "page_id", clean_headword(tagged).alias("word")
    )


@query
def par3_reject_empty(spark, d):
    """Lines read as blocks: those with a headword, counted by document."""
    found = _line_blocks(spark, d)
    kept = P.split_entries(found).groupBy("doc_id").agg(F.count("*").alias("kept"))
    return kept


@query
def par3_rejected_blocks(spark, d):
    """Lines read as blocks, every second one with its mark put before the word:
    those whose headword is empty."""
    moved = F.when(F.col("block_no") % 2 == 1, F.concat(F.lit(", _"), "block")).otherwise(F.col("block"))
    rejected = P.rejected_blocks(_line_blocks(spark, d).withColumn("block", moved))
    return rejected.where("reject_reason = 'empty_word'").select("doc_id", "block_no", "block")


def _line_blocks(spark, d):
    """Every line of the derived texts taken as a block of its own."""
    return lines(spark, d).select(
        "doc_id", F.col("line_no").alias("block_no"), F.col("line").alias("block")
    )


@query
def par4_quarantine(spark, d):
    return P.rejected_blocks(_line_blocks(spark, d)).select(
        "doc_id", "block_no", "reject_reason"
    )


@query
def par5_parse_group(spark, d):
    return P.parse_groups(blocks(spark, d))


@query
def par6_resolve_idem(spark, d):
    """Idem entries by the distributed route for documents of any size."""
    split = P.with_references(P.split_entries(blocks(spark, d)))
    return P.resolve_idem(split.drop("block")).select(
        "doc_id", "block_no", "word_raw", "definition", _references("references")
    )


@query
def par7_extract_references(spark, d):
    from glossweave.functions.entries import extract_references

    return P.split_entries(blocks(spark, d)).select(
        "doc_id",
        "block_no",
        F.array_join(extract_references(F.col("definition")), "|").alias("refs"),
    )


@query
def par8_distinct_references(spark, d):
    """Distinct words of each whole page, in order."""
    # each word in a roman run of its own
    runs = F.concat(F.lit("_x_ "), F.array_join(words_of(F.col("html")), " _x_ "))
    found = table(spark, d, "pages").select("page_id", runs.alias("definition"))
    return P.with_references(found).select("page_id", _references("references"))


@query
def par9_expand_variants(spark, d):
    return P.expand_variants(
        P.split_entries(blocks(spark, d)).select("doc_id", "block_no", "word_raw")
    ).select("doc_id", "block_no", "variant_no", "word")


@query
def par10_variants(spark, d):
    """Forms of every pair of neighbouring words "First, second" in documents."""
    words = table(spark, d, "documents").select(
        F.transform(words_of(F.col("text")), F.lower).alias("w")
    )
    pairs = words.select(
        F.explode(
            F.transform(
                F.slice("w", F.lit(2), F.size("w")),
                lambda x, i: F.concat(
                    T.simple_upper(F.substring(F.get("w", i), 1, 1)),
                    F.substr(F.get("w", i), F.lit(2)),
                    F.lit(", "),
                    x,
                ),
            )
        ).alias("raw")
    ).distinct()
    return spread(pairs, "raw").select("raw", F.array_join(variants("raw"), "|").alias("forms"))


@query
def par11_char_variants(spark, d):
    """Letters that each letter of the documents may stand on."""
    from glossweave.functions.variants import char_variants

    letters = (
        table(spark, d, "documents")
        .select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c"))
        .where(F.col("c").rlike(r"^\p{L}$"))
        .distinct()
    )
    return letters.select("c", char_variants("c").alias("letters"))


@query
def par12_capitalise(spark, d):
    words = table(spark, d, "documents").select(
        F.explode(words_of(F.col("text"))).alias("word")
    )
    return words.distinct().select("word", T.capitalise(F.col("word")).alias("capital"))


@query
def par13_parse_lexicon(spark, d):
    return parse_lexicon(texts(spark, d)).select(
        *ORDER_COLUMNS, "word", "definition", _references()
    )


@query
def par13_parse_lexicon_lines(spark, d):
    """The same by the line route; its block numbers are line numbers."""
    found = consecutive_blocks(parse_lexicon_lines(lines(spark, d)))
    return found.select(*ORDER_COLUMNS, "word", "definition", _references())


# --- normalisation and markup ----------------------------------------------


@query
def str1_4_normalise_terms(spark, d):
    words = (
        table(spark, d, "documents")
        .select(F.explode(words_of(F.col("text"))).alias("word"))
        .distinct()
    )
    return M.normalise_terms(words, "word")


@query
def str1_4_normalise_parts(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return M.normalise_terms(parts, "p_name").drop("p_name")


@query
def str5_7_markup_table(spark, d):
    found = M.markup_table(entries(spark, d), ORDER_COLUMNS)
    return found.drop("superscripts")


@query
def str6_8_render_definitions(spark, d):
    return M.render_definitions(entries(spark, d), ORDER_COLUMNS)


@query
def str7_superscripts(spark, d):
    """Superscripts after putting `^` in front of every vowel pair of a text."""
    marked = F.regexp_replace("text", "([aeiou]{2})", "^$1")
    return table(spark, d, "documents").select(
        "doc_id",
        F.array_join(T.superscripts(marked), "|").alias("superscripts"),
        F.md5(T.superscript_tags(marked)).alias("tagged_md5"),
    )


@query
def str9_search_term_counts(spark, d):
    asked = table(spark, d, "pages").select(
        F.regexp_extract("url", r"\?([^#]*)", 1).alias("term")
    )
    return M.search_term_counts(asked, "term")


@query
def str10_vector_report(spark, d):
    keys = word_keys(spark, d)
    return V.vector_report(V.dense_vectors(keys, V.fit_vocabulary(keys, True)))


# --- vectors ---------------------------------------------------------------


@query
def vec1_distinct_keys(spark, d):
    return word_keys(spark, d)


@query
def vec2_char_grams(spark, d):
    return word_keys(spark, d).select(
        "key", F.array_join(F.array_sort(char_grams(F.col("key"))), "|").alias("grams")
    )


@query
def vec3_fit_vocabulary(spark, d):
    return V.fit_vocabulary(word_keys(spark, d))


@query
def vec4_term_frequencies(spark, d):
    return V.term_frequencies(word_keys(spark, d))


@query
def vec5_dense_vectors(spark, d):
    """Dense vectors of all keys, shown by their size, sum and weighted sum."""
    keys = word_keys(spark, d)
    vectors = V.dense_vectors(keys, V.fit_vocabulary(keys))
    add = F.lit(0.0)
    return vectors.select(
        "key",
        F.size("vector").alias("dims"),
        F.aggregate("vector", add, lambda s, x: s + x).cast("bigint").alias("total"),
        F.aggregate(
            F.transform("vector", lambda x, i: x * i), add, lambda s, x: s + x
        )
        .cast("bigint")
        .alias("weighted"),
    )


@query
def vec6_vector_once_per_key(spark, d):
    lex = entries(spark, d).drop("key")
    keys = V.distinct_keys(lex).where(F.col("key") != "")
    joined = V.vector_once_per_key(lex, V.fit_vocabulary(keys))
    return joined.select(
        *ORDER_COLUMNS,
        "key",
        F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("total"),
    )


@query
def vec7_model_card(spark, d):
    return V.model_card(word_keys(spark, d))


@query
def vec8_sample_nonzero_check(spark, d):
    keys = word_keys(spark, d)
    return V.sample_nonzero_check(V.dense_vectors(keys, V.fit_vocabulary(keys)))


# --- search ----------------------------------------------------------------


@query
def sim1_cosine_postings(spark, d):
    return S.cosine_postings(term_keys(spark, d), word_keys(spark, d))


@query
def sim2_nearest_keys(spark, d):
    return S.nearest_keys(part_keys(spark, d), word_keys(spark, d), 10)


@query
def sim2_nearest_keys_blocked(spark, d):
    """The route for query tables too large to travel with the tasks, with many
    blocks on both sides."""
    return S.nearest_keys(
        part_keys(spark, d), word_keys(spark, d), 10, broadcast_queries=0, q_block=16, item_block=4_096
    )


_MATCH = ["query_id", "rank", "entry_id", "key", "word", "score"]


@query
def sim3_find_matches(spark, d):
    return S.find_matches(user_terms(spark, d), stored_index(spark, d)).select(_MATCH)


@query
def sim3_find_matches_by_key(spark, d):
    return S.find_matches(
        user_terms(spark, d), stored_index(spark, d), unit="key"
    ).select(_MATCH)


@query
def sim4_find_by_word(spark, d):
    return S.find_by_word(user_terms(spark, d), stored_index(spark, d)).select(_MATCH)


@query
def sim4_find_by_word_by_key(spark, d):
    return S.find_by_word(
        user_terms(spark, d), stored_index(spark, d), unit="key"
    ).select(_MATCH)


@query
def sim4_find_by_word_nearest(spark, d):
    return S.find_by_word(
        user_terms(spark, d), stored_index(spark, d), unit="entry"
    ).select(_MATCH)


@query
def sim5_find_closest(spark, d):
    return S.find_closest(user_terms(spark, d), stored_index(spark, d)).select(_MATCH)


@query
def sim5_find_closest_by_key(spark, d):
    return S.find_closest(
        user_terms(spark, d), stored_index(spark, d), inclusive=False, unit="key"
    ).select(_MATCH)


@query
def sim5_find_closest_nearest(spark, d):
    return S.find_closest(
        user_terms(spark, d), stored_index(spark, d), unit="entry"
    ).select(_MATCH)


@query
def sim6_closest_or_search(spark, d):
    return S.closest_or_search(user_terms(spark, d), stored_index(spark, d)).select(
        *_MATCH, "route"
    )


@query
def sim7_autocomplete(spark, d):
    found = S.autocomplete(user_terms(spark, d), stored_index(spark, d))
    return found.select("query_id", F.array_join("suggestions", "|").alias("suggestions"))


@query
def sim8_link_references(spark, d):
    return S.link_references(stored_lexicon(spark, d), stored_index(spark, d))


@query
def sim9_locate_reference_spans(spark, d):
    return S.locate_reference_spans(stored_lexicon(spark, d))


@query
def sim10_compare_results(spark, d):
    """Inverted index against blocked product: the same hits, the same ranks."""
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "key")

    def compared(q: DataFrame, keys: DataFrame) -> DataFrame:
        a = S.cosine_postings(q, keys).withColumn("rank", F.row_number().over(order))
        b = S.all_reaching(q, keys, SCORE_THRESHOLD).withColumn("rank", F.row_number().over(order))
        return S.compare_results(a, b, ("q_key", "key"))

    return S.in_rounds(term_keys(spark, d), word_keys(spark, d), compared)


@query
def sim11_approx_matches(spark, d):
    items = table(spark, d, "embeddings")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    return E.approx_matches(asked, items, 10)


@query
def sim11_recall(spark, d):
    items = table(spark, d, "embeddings")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    return E.recall(E.approx_matches(asked, items, 10), E.vector_search(asked, items, 10))


@query
def sim11_graph_matches(spark, d):
    """Approximate neighbours by walks over stored graphs."""
    items = table(spark, d, "embeddings")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    return X.graph_search(asked, vector_index(spark, d), 10)


@query
def sim11_graph_recall(spark, d):
    """Exact neighbours that the graphs are asked for, and whether they find nine
    in ten."""
    items = table(spark, d, "embeddings")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index(spark, d)
    found = E.recall(X.graph_search(asked, index, 10), X.pruned_search(asked, index, 10))
    return found.select("exact_pairs", (F.col("recall") >= 0.9).alias("enough"))


@query
def sim12_pruned_search(spark, d):
    """Exact neighbours from stored blocks that bounds can skip."""
    items = table(spark, d, "embeddings")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    return X.pruned_search(asked, vector_index(spark, d), 10)


@query
def sim12_pruned_search_by_label(spark, d):
    items = table(spark, d, "embeddings")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    groups = items.select("vec_id", F.col("label").alias("g"))
    found = X.pruned_search(asked, vector_index(spark, d), 5, groups)
    return found.withColumnRenamed("g", "label")


@query
def sim12_vector_search(spark, d):
    items = table(spark, d, "embeddings")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    return E.vector_search(asked, items, 10)


@query
def sim12_vector_search_by_label(spark, d):
    items = table(spark, d, "embeddings")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    return E.vector_search(asked, items, 5, group_col="label")


# --- reports ---------------------------------------------------------------


@query
def ana1_entry_count(spark, d):
    return A.entry_count(entries(spark, d))


@query
def ana2_longest(spark, d):
    found = entries(spark, d)
    word = A.longest(found, "word", ORDER_COLUMNS).withColumn("what", F.lit("word"))
    definition = A.longest(found, "definition", ORDER_COLUMNS).withColumn(
        "what", F.lit("definition")
    )
    return word.unionByName(definition)


@query
def ana3_suspect_variants(spark, d):
    words = table(spark, d, "documents").select(
        F.explode(words_of(F.col("text"))).alias("word")
    )
    return A.suspect_variants(words).groupBy("word").agg(F.count("*").alias("n"))


@query
def ana4_leftover_brackets(spark, d):
    """Lines of the documents, as words, with unbalanced brackets."""
    found = lines_from_table(table(spark, d, "documents")).withColumnRenamed(
        "line", "word"
    )
    return A.leftover_brackets(found).select("doc_id", "line_no")


@query
def ana4_leftover_brackets_of_tags(spark, d):
    """Pieces of page markup, as words in square brackets, that are unbalanced."""
    pieces = F.explode(F.split(F.translate("html", "<>", "[]"), " ", -1))
    found = table(spark, d, "pages").select("page_id", pieces.alias("word"))
    return A.leftover_brackets(found).groupBy("page_id", "word").agg(F.count("*").alias("n"))


@query
def ana5_character_inventory(spark, d):
    return A.character_inventory(entries(spark, d))


@query
def ana6_words_with_unexpected(spark, d):
    found = lines_from_table(table(spark, d, "documents")).withColumnRenamed(
        "line", "word"
    )
    return A.words_with_unexpected(found).select("doc_id", "line_no", "character")


@query
def ana7_vector_alphabet(spark, d):
    return A.vector_alphabet(entries(spark, d))


@query
def ana8_readiness_check(spark, d):
    return A.readiness_check(stored_index(spark, d), min_keys=1_000)


@query
def ana9_search_report(spark, d):
    terms = spark.createDataFrame([(t, t) for t in REPORT_TERMS], "query_id string, term string")
    return A.search_report(S.query_keys(terms), stored_index(spark, d)).select(
        "query_id", "section", "rank", "key", "word", "definition", "score"
    )


# --- versions --------------------------------------------------------------


@query
def pub1_needs_rebuild(spark, d):
    """Does a lexicon without its reference entries differ from the whole one?"""
    lex = stored_lexicon(spark, d)
    target = W.lexicon_stats(lex)
    older = W.lexicon_stats(lex.where(~F.col("definition").startswith("_as_")))
    return (
        W.needs_rebuild(older, target)
        .withColumn("against", F.lit("older"))
        .unionByName(
            W.needs_rebuild(target, target).withColumn("against", F.lit("same"))
        )
    )


@query
def pub2_publish_version(spark, d):
    base = scratch_path(spark, "published")
    # a second time with the same counts: the first must not be touched by it
    for _ in range(2):
        W.publish_version(stored_lexicon(spark, d), base, "published_lexicon")
    return W.published(spark, base, "published_lexicon").select("entry_id", "word", "key")


@query
def pub3_lexicon_stats(spark, d):
    return W.lexicon_stats(stored_lexicon(spark, d))


# --- streaming -------------------------------------------------------------


def _stream(spark, d, name):
    """A stream over one source table's file."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


@query
def stm1_stream_lookup(spark, d):
    terms = _user_words(_stream(spark, d, "conversations"))
    path = scratch_path(spark, "answers")
    pointer = I.publish_index(stored_lexicon(spark, d), scratch_path(spark, "indexes"), "lexicon")
    J.stream_lookup(terms, pointer, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).select(*_MATCH, "route")


@query
def stm2_stream_ingest(spark, d):
    arriving = lexicon_texts(_stream(spark, d, "documents"))
    path = scratch_path(spark, "ingested")
    J.stream_ingest(arriving, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).select(
        *ORDER_COLUMNS, "word", "definition", _references()
    )


@query
def stm2_stream_merge(spark, d):
    """Every text arrives twice, the first time cut short: the table has the
    entries of the second."""
    path = scratch_path(spark, "merged")
    whole = lexicon_texts(_stream(spark, d, "documents"))
    short = whole.withColumn("text", F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    for name, arriving in (("first", short), ("second", whole)):
        N.stream_merge(arriving, path, scratch_path(spark, "checkpoint"), stream=name).awaitTermination()
    N.compact(spark, path)
    return N.read_entries(spark, path).select(*ORDER_COLUMNS, "word", "definition", _references())


@query
def stm3_quota_report(spark, d):
    return J.quota_report(table(spark, d, "events"), "1 day", 5)


@query
def stm3_quota_report_stream(spark, d):
    path = scratch_path(spark, "quota")
    J.stream_quota_report(
        _stream(spark, d, "events"), path, scratch_path(spark, "checkpoint"), "1 day", 5
    ).awaitTermination()
    return J.latest_quota_report(spark.read.parquet(path))
