import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.functions.grams import char_grams, gram_counts, signature
from glossweave.operators import embeddings as E
from glossweave.operators import kernel
from glossweave.operators import search as S
from glossweave.operators import search_index as I
from glossweave.operators import vectors as V

rng = random.Random(3)
KEYS = sorted(
    {"".join(rng.choices("abcde ", k=rng.randint(1, 9))) for _ in range(400)}
    | {"a", "aa", "aaa", "xistone", "z" * 40}
)
QUERIES = ["a", "abc", "aabb", "xiston", "eddd", "zzzz", "q", "abc de"]


def grams(key):
    text = f"^{key}$"
    return Counter(text) + Counter(text[i : i + 2] for i in range(len(text) - 1))


def cosine(a, b):
    x, y = grams(a), grams(b)
    dot = sum(n * y[g] for g, n in x.items())
    norm = math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
    return math.floor(dot / norm * 1e6 + 0.5) / 1e6


def brute(q, k, threshold=-1.0):
    scored = sorted((-cosine(q, key), key) for key in KEYS)
    return [(key, -s) for s, key in scored if -s >= threshold][:k]


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def entries(spark):
    rows = []
    for i, key in enumerate(KEYS):
        rows.append((2 * i, key, key.capitalize(), f"_d{i}_"))
        if i % 3 == 0:
            rows.append((2 * i + 1, key, key, f"_e{i}_"))
    return spark.createDataFrame(
        rows, "entry_id bigint, key string, word string, definition string"
    )


def queries(spark):
    return spark.createDataFrame(
        list(enumerate(QUERIES)), "query_id int, q_key string"
    )


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("k, threshold", [(7, None), (3, 0.5)])
def test_nearest_keys_equals_brute_force(spark, many, k, threshold):
    options = {"broadcast_queries": 2, "q_block": 3, "item_block": 50} if many else {}
    rows = S.nearest_keys(
        frame(spark, QUERIES, "q_key"), frame(spark, KEYS, "key"), k, threshold, **options
    ).collect()
    got = {q: [] for q in QUERIES}
    for r in sorted(rows, key=lambda r: (r.q_key, r["rank"])):
        got[r.q_key].append((r.key, r.score))
    assert got == {q: brute(q, k, -1 if threshold is None else threshold) for q in QUERIES}


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("threshold", [-1.0, 0.4, 0.75, 1.0])
def test_blocked_product_scores_only_what_comes_near(monkeypatch, threshold, inclusive):
    """All pairs that reach a threshold, without a score for every pair."""
    scored = []

    def counted(cosine):
        scored.append(np.size(cosine))
        return rounded(cosine)

    rounded = kernel.rounded
    monkeypatch.setattr(kernel, "rounded", counted)
    asked, keys = QUERIES + ["", "z" * 2100], KEYS + ["", "z" * 2100]
    block = kernel.QueryBlock(kernel.gram_matrix(asked), None, threshold, inclusive)
    query, at, score = block.best(kernel.gram_matrix(keys))
    got = [(asked[q], keys[i], s) for q, i, s in zip(query, at, score)]
    every = [(q, key, cosine(q, key)) for key in keys if key for q in asked if q]
    assert got == [x for x in every if (x[2] >= threshold if inclusive else x[2] > threshold)]
    if threshold > 0:
        assert sum(scored) < len(every) / 2 and len(block.columns) < kernel.DIMS / 10


@pytest.mark.parametrize("threshold", [0.4, 0.75])
def test_postings_equal_brute_force(spark, threshold):
    rows = S.cosine_postings(
        frame(spark, QUERIES, "q_key"), frame(spark, KEYS, "key"), threshold
    ).collect()
    got = sorted((r.q_key, r.key, r.score) for r in rows)
    assert got == sorted(
        (q, key, s) for q in QUERIES for key, s in brute(q, 10**6, threshold)
    )


def test_postings_of_many_queries_hold_a_block_at_once(spark):
    """What a group of a pack and a slot finds without k is bounded: the keys of a
    block, on average, for a pack of queries."""
    for packs, blocks, cores in ((2, 3, 8), (4, 560, 12), (40, 4_000, 12)):
        slots, tasks = I._dealt(packs, blocks, None, cores)
        assert slots == blocks and min(slots * packs, cores) <= tasks <= 8 * max(slots * packs, 4 * cores)
    blocks = I.key_blocks(frame(spark, KEYS, "key"), 20)
    rows = I.search_blocks(frame(spark, QUERIES, "q_key"), blocks, None, 0.4, broadcast_queries=2).collect()
    assert sorted((r.q_key, r.key, r.score) for r in rows) == sorted(
        (q, key, s) for q in QUERIES for key, s in brute(q, 10**6, 0.4)
    )


def test_closest_keys_with_and_without_shortcut(spark):
    asked = QUERIES + KEYS
    got = {
        r.q_key: (r.key, r.score)
        for r in S.closest_keys(
            frame(spark, sorted(set(asked)), "q_key"), frame(spark, KEYS, "key"), 0.6
        ).collect()
    }
    want = {q: brute(q, 1, 0.6) for q in set(asked)}
    assert got == {q: w[0] for q, w in want.items() if w}
    strict = S.closest_keys(
        frame(spark, ["a"], "q_key"), frame(spark, ["a"], "key"), 1.0, inclusive=False
    )
    assert strict.count() == 0


def test_matches_units(spark):
    lex, q = entries(spark), queries(spark)
    all_entries = lex.collect()
    got = S.find_matches(q, lex, 5).orderBy("query_id", "rank").collect()
    for i, term in enumerate(QUERIES):
        want = sorted(
            ((-cosine(term, e.key), e.key, e.entry_id) for e in all_entries)
        )[:5]
        assert [(-r.score, r.key, r.entry_id) for r in got if r.query_id == i] == want
    whole = S.find_matches(q, lex, 2, unit="key").collect()
    for i, term in enumerate(QUERIES):
        keys = [key for key, _ in brute(term, 2)]
        want = {e.entry_id for e in all_entries if e.key in keys}
        assert {r.entry_id for r in whole if r.query_id == i} == want


def test_by_word_units(spark):
    lex, q = entries(spark), queries(spark)
    for unit in ("word", "key", "entry"):
        rows = S.find_by_word(q, lex, 4, unit).collect()
        for i in range(len(QUERIES)):
            mine = [r for r in rows if r.query_id == i]
            group = [r.key if unit == "key" else r.word for r in mine]
            assert len(group) == len(set(group))
            assert sorted(r["rank"] for r in mine) == list(range(1, len(mine) + 1))
    first = S.find_by_word(q, lex, 4, "word").where("query_id = 0").orderBy("rank")
    words = sorted(
        {(-cosine("a", e.key), e.key, e.word) for e in lex.collect()}
    )[:4]
    assert [r.word for r in first.collect()] == [w[2] for w in words]


def test_closest_units_and_fallback(spark):
    lex, q = entries(spark), queries(spark)
    word = S.find_closest(q, lex, 0.7).collect()
    key = S.find_closest(q, lex, 0.7, unit="key").collect()
    near = S.find_closest(q, lex, 0.7, unit="entry").collect()
    for i, term in enumerate(QUERIES):
        best = brute(term, 1, 0.7)
        of_key = [e for e in lex.collect() if best and e.key == best[0][0]]
        assert {r.entry_id for r in key if r.query_id == i} == {
            e.entry_id for e in of_key
        }
        low = min((e.word for e in of_key), default=None)
        assert {r.entry_id for r in word if r.query_id == i} == {
            e.entry_id for e in of_key if e.word == low
        }
        assert {r.key for r in near if r.query_id == i} == {b[0] for b in best}
    routes = S.closest_or_search(q, lex, 3, threshold=0.7).collect()
    for i, term in enumerate(QUERIES):
        mine = {r.route for r in routes if r.query_id == i}
        assert mine == ({"exact"} if brute(term, 1, 0.7) else {"search"})


def frequent(spark, monkeypatch):
    """One key with many queries and many entries, among others."""
    monkeypatch.setattr(S, "MEET_ROWS", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    asked = [(None, "abc"), (7, "abc"), (7, "abc"), (8, ""), (9, None), (10, "xyz")] + [(i, "abc") for i in range(100, 190)]
    held = [(i, "abc", f"w{i % 3}", "_d_") for i in range(120)] + [(200, "abd", "abd", "_d_"), (201, "xyz", "xyz", "_d_"), (202, "", "-", "_d_")]
    return (
        spark.createDataFrame(asked, "query_id int, q_key string"),
        spark.createDataFrame(held, "entry_id bigint, key string, word string, definition string"),
    )


def widest(rows):
    """Rows, and the largest share of them in one place."""
    places = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    return sum(places), max(places) / sum(places)


def test_closest_by_key_of_a_frequent_word(spark, monkeypatch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        asked, lex = frequent(spark, monkeypatch)
        found = S.find_closest(asked, lex, 0.75, unit="key").cache()
        got = sorted((r.query_id or 0, r.q_key, r.key, r.entry_id, r["rank"]) for r in found.collect())
        want = [(r.query_id or 0, "abc", "abc", e, e + 1) for r in asked.where("q_key = 'abc'").collect() for e in range(120)]
        assert got == sorted(want + [(10, "xyz", "xyz", 201, 1)])
        n, share = widest(found)
        assert n == len(got) and share < 0.6
        found.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_matches_by_key_of_a_frequent_word(spark, monkeypatch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        asked, lex = frequent(spark, monkeypatch)
        found = S.find_matches(asked, lex, 2, unit="key").cache()
        got = sorted((r.query_id or 0, r.key, r["rank"], r.entry_id) for r in found.collect())
        want = []
        for r in asked.where("q_key = 'abc'").collect():
            want += [(r.query_id or 0, "abc", 1, e) for e in range(120)] + [(r.query_id or 0, "abd", 2, 200)]
        assert [g for g in got if g[0] != 10] == sorted(want)
        assert {g[1:3] for g in got if g[0] == 10} == {("xyz", 1), ("abc", 2)}
        n, share = widest(found)
        assert n == len(got) and share < 0.6
        found.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_queries_that_share_an_id(spark):
    """Equal queries count once by word and each by closest; an id with two keys is
    one query; entries are taken by key before they are joined."""
    lex = entries(spark)
    asked = spark.createDataFrame(
        [(1, "abc"), (1, "abc"), (2, "a"), (2, "xiston"), (3, "abc"), (None, "eddd"), (4, None)], "query_id int, q_key string"
    )
    near = S.find_matches(asked.distinct(), lex, 6).collect()
    words = S.find_by_word(asked, lex, 4, "entry", nearest=6).collect()
    close = S.find_closest(asked, lex, 0.5, unit="entry", max_hits=6).collect()
    for i in (1, 2, 3, None):
        mine = [r for r in near if r.query_id == i]
        got = [r for r in words if r.query_id == i]
        assert {r.word for r in got} == {r.word for r in mine} and len(got) == len({r.word for r in got})
        assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    assert len([r for r in close if r.query_id == 1]) == 2 * len([r for r in close if r.query_id == 3]) > 0
    plan = S.find_matches(asked, lex, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "_before" in plan and "row_number" not in plan.split("_before")[0]


def test_autocomplete_and_links(spark):
    lex = entries(spark)
    rows = S.autocomplete(queries(spark), lex, 3).collect()
    assert all(len(r.suggestions) == 3 for r in rows)
    source = spark.createDataFrame(
        [(1, ["Xistóne", "qqqq"]), (2, [])], "entry_id bigint, referenced_words array<string>"
    )
    links = S.link_references(source, lex).orderBy("ref_no").collect()
    assert [(r.term, r.target) for r in links] == [("xistone", "word"), ("qqqq", "search")]
    assert links[0].popover.startswith("<i>d") and links[1].popover is None


def test_spans(spark):
    rows = spark.createDataFrame(
        [
            (1, "_as_ Alfa, Beta, _or_ Gamma.", ["Alfa", "Beta", "Gamma"]),
            (2, "_as_ Beta, Alfa.", ["Alfa", "Beta"]),
            (3, "_x._", []),
            # an empty reference stands at the cursor and moves nothing
            (4, "_as_ Foo, Foo._x_", ["Foo", "", "Foo"]),
        ],
        "entry_id bigint, definition string, referenced_words array<string>",
    )
    got = S.locate_reference_spans(rows).orderBy("entry_id", "ref_no").collect()
    assert [(r.entry_id, r.reference, r.run_no, r.start) for r in got] == [
        (1, "Alfa", 1, 1),
        (1, "Beta", 1, 7),
        (1, "Gamma", 3, 1),
        (2, "Alfa", 1, 7),
        (4, "Foo", 1, 1),
        (4, "", 1, 4),
        (4, "Foo", 1, 6),
    ]


def test_compare(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, key string, rank int")
    row = S.compare_results(a, b).first()
    assert (row.hits_a, row.hits_b, row.hits_both, row.overlap, row.max_rank_difference) == (
        2, 2, 1, 0.5, 1,
    )


def test_grams_and_vectors(spark):
    keys = frame(spark, KEYS + [""], "key")
    rows = keys.select(
        "key",
        char_grams(F.col("key")).alias("g"),
        gram_counts(F.col("key")).alias("c"),
        signature(F.col("key")).alias("s"),
    ).collect()
    for r in rows:
        want = grams(r.key) if r.key else Counter()
        assert Counter(r.g) == want
        assert {x.gram: x.tf for x in r.c} == dict(want)
    vocabulary = V.fit_vocabulary(frame(spark, KEYS, "key"))
    names = [r.gram for r in vocabulary.orderBy("idx").collect()]
    assert names == sorted({g for key in KEYS for g in grams(key)})
    for r in V.dense_vectors(frame(spark, KEYS, "key"), vocabulary).collect():
        want = grams(r.key)
        assert r.vector == [want.get(g, 0) for g in names]
    card = V.model_card(frame(spark, KEYS, "key")).first()
    assert (card.number_of_vectors, card.vector_size) == (len(KEYS), len(names))
    tf = V.term_frequencies(frame(spark, ["aba"], "key")).collect()
    assert {(r.gram, r.tf, r.norm2) for r in tf} == {
        (g, n, sum(v * v for v in grams("aba").values())) for g, n in grams("aba").items()
    }
    check = V.sample_nonzero_check(
        V.dense_vectors(frame(spark, KEYS + [""], "key"), vocabulary)
    ).first()
    assert (check.sampled, check.zero_vectors) == (25, 1)


def test_vector_search_with_null_groups(spark):
    rows = [(i, [float(i + 1), 1.0], None if i % 2 else "a") for i in range(6)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>, g string")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    found = E.vector_search(asked, items, 5, group_col="g").where("query_id = 0").collect()
    assert {r.g for r in found} == {None, "a"}
    nulls = items.where("g is null")
    assert {r.g for r in E.vector_search(asked, nulls, 5, group_col="g").collect()} == {None}


def test_pairs_are_compared_in_rounds(spark, tmp_path, monkeypatch):
    """Every query key meets all keys, and no round has more pairs than it may;
    what a round has shuffled is gone after it."""
    from glossweave.catalog import queries as Q

    docs = [(k, " ".join(KEYS[k : k + 40])) for k in range(0, 400, 40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(1, k, "user", " ".join(KEYS[k : k + 6])) for k in range(0, 120, 6)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    whole = Q.sim10_compare_results(spark, str(tmp_path)).collect()
    pairs = []
    found = S.in_rounds

    def small(q, keys, answer):
        def counted(some, all_keys):
            pairs.append(some.count() * all_keys.count())
            return answer(some, all_keys)

        return found(q, keys, counted, 2_000)

    monkeypatch.setattr(S, "in_rounds", small)
    parts = Q.sim10_compare_results(spark, str(tmp_path))
    assert sorted(parts.collect()) == sorted(whole)
    assert len(whole) > 40 and parts.columns == ["q_key", "hits_a", "hits_b", "hits_both", "overlap", "max_rank_difference"]
    # hashing deals the keys out, some more to one round than to another
    assert len(pairs) > 5 and max(pairs) <= 6_000
    assert sum(pairs) == len(whole) * Q.word_keys(spark, str(tmp_path)).count()
