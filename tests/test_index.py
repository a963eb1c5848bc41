"""The stored search index: blocks, ranks, pointer, and who may read what."""

import random
import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import KEYS, QUERIES, brute, cosine, entries, frame, queries

from glossweave.operators import postings as P
from glossweave.operators import search as S
from glossweave.operators import search_index as I
from glossweave.operators import versions
from glossweave.streaming import jobs as J

rng = random.Random(11)


def test_bounds_drop_nothing():
    """Every block, threshold and query against all scores."""
    names = sorted({"".join(rng.choices("abcdeo n", k=rng.randint(1, 14))) for _ in range(600)}, key=lambda x: (len(x), x))
    block = P.KeyBlock(P.pack(0, names))
    asked = ["a", "banana", "aaaaaaaa", "no bread on code", "z", *rng.sample(names, 20)]
    for name, q in zip(asked, P.queries_of(asked)):
        scores = {n: cosine(name, n) for n in names}
        for least in (-np.inf, 0.3, 0.75, 0.9, 1.0):
            row, score = block.reaching(q, least)
            assert dict(zip(block.names[row], score)) == {n: s for n, s in scores.items() if s >= least}


def test_few_keys_are_touched():
    """What has no chance is dropped before it is scored."""
    names = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 14))) for _ in range(3000)}, key=lambda x: (len(x), x))
    block, seen = P.KeyBlock(P.pack(0, names)), []
    single = block.single

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(len(at))
            return single[at]

    block.single = single.view(Counted)
    for q in P.queries_of(names[-50:]):
        block.reaching(q, 0.75)
    assert sum(seen) < 0.02 * 50 * len(names)


@pytest.mark.parametrize("k, threshold, inclusive", [(3, None, True), (1, 0.75, True), (2, 0.75, False), (None, 0.6, True)])
def test_tiles_equal_single_queries(monkeypatch, k, threshold, inclusive):
    """Queries of several tiles, with ties, against blocks of which one is small."""
    made = sorted({"".join(rng.choices("abcd n", k=rng.randint(1, 12))) for _ in range(900)})
    parts = [sorted(made[at::3], key=lambda x: (len(x), x)) for at in range(3)] + [["b"]]
    blocks = [P.KeyBlock(P.pack(i, part)) for i, part in enumerate(parts)]
    asked = [*made[:300], "zq", "a" * 60]
    tiled = P.Search(asked, k, threshold, inclusive)
    monkeypatch.setattr(P, "TILED", len(asked) + 1)
    single = P.Search(asked, k, threshold, inclusive)
    rows = []
    for search, count in ((tiled, P.TILED - 1), (single, P.TILED)):
        monkeypatch.setattr(P, "TILED", count)
        found = [search.block(b) for b in blocks]
        rows.append([f and sorted(zip(*f)) for f in found])
    assert rows[0] == rows[1] and rows[0][0]


def test_packs_carry_their_bounds(spark):
    """What a pack of queries has found bounds the blocks after it: far fewer rows
    leave the tasks than k for each query and block."""
    names = sorted({"".join(rng.choices("abcde", k=rng.randint(3, 9))) for _ in range(1500)})
    blocks = I.key_blocks(frame(spark, names, "key"), block_keys=20).cache()
    n = blocks.count()
    rows = I.search_blocks(frame(spark, names[:60], "q_key"), blocks, 5, broadcast_queries=20).count()
    assert n >= 60 and 60 * 5 <= rows < 0.6 * 60 * 5 * n


@pytest.mark.parametrize("options", [{}, {"broadcast_queries": 3}])
@pytest.mark.parametrize("k, threshold", [(7, None), (3, 0.5), (1, 0.75)])
def test_blocks_equal_brute_force(spark, tmp_path, options, k, threshold):
    index = I.write_index(entries(spark), str(tmp_path / "index"), block_keys=60)
    assert index.blocks.count() >= len(KEYS) // 60
    rows = S.nearest_indexed(frame(spark, QUERIES, "q_key"), index.blocks, k, threshold, **options).collect()
    got = {q: [] for q in QUERIES}
    for r in sorted(rows, key=lambda r: (r.q_key, r["rank"])):
        got[r.q_key].append((r.key, r.score))
    assert got == {q: brute(q, k, -1 if threshold is None else threshold) for q in QUERIES}


def test_postings_by_both_routes(spark):
    q, keys = frame(spark, QUERIES, "q_key"), frame(spark, KEYS, "key")
    few, many = S.cosine_postings(q, keys, 0.5), S.cosine_postings(q, keys, 0.5, broadcast_queries=3)
    product = S.all_reaching(q, keys, 0.5)
    blocked = S.all_reaching(q, keys, 0.5, broadcast_queries=2, q_block=3, item_block=50)
    rows = [sorted(tuple(r) for r in df.select("q_key", "key", "score").collect()) for df in (few, many, product, blocked)]
    assert rows[0] == rows[1] == rows[2] == rows[3] != []


def test_ranks_of_a_hot_key(spark):
    """One key with most entries is ranked in stretches."""
    lex = spark.range(1, 501).select(
        F.col("id").alias("entry_id"),
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("k"), F.col("id") % 3)).otherwise(F.lit("hot")).alias("key"),
        F.concat(F.lit("w"), F.col("id") % 2).alias("word"),
        F.lit("d").alias("definition"),
    )
    rows = I.ranked_entries(lex, stretch=20).collect()
    assert len(rows) == 500
    for r in rows:
        same = [x for x in rows if x.key == r.key and x.entry_id <= r.entry_id]
        assert r.key_rank == len(same)
        assert r.word_rank == sum(x.word == r.word for x in same)
        assert r.first_word == (r.word == min(x.word for x in rows if x.key == r.key))


def test_entries_are_dealt_out_once(spark, tmp_path):
    """Repeated and missing ids and words are ranked as before; definitions meet
    one exchange, not one for each rank."""
    rows = [(i if i % 11 else None, f"k{i % 3}", f"w{i % 4}" if i % 13 else None, f"definition {i}") for i in range(300)]
    rows += rows[:50]
    spark.createDataFrame(rows, "entry_id long, key string, word string, definition string").write.parquet(str(tmp_path / "lex"))
    lex = spark.read.parquet(str(tmp_path / "lex"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = I.ranked_entries(lex, stretch=30)
        text = ranked._jdf.queryExecution().executedPlan().toString()
        found = ranked.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert text.count("REPARTITION_BY_NUM") == 1
    # above that one exchange of whole entries, there is no other
    assert "Exchange" not in text[: text.index("REPARTITION_BY_NUM")].rsplit("Exchange", 1)[0]
    kept = [r for r in rows if r[0] is not None and r[2] is not None]
    assert sorted((r.entry_id, r.key, r.word, r.definition) for r in found) == sorted(kept)
    for r in found:
        # entries without an id are counted before those that have one, by key
        mine = [x for x in rows if x[1] == r.key]
        lower = [x for x in mine if x[0] is None or x[0] < r.entry_id]
        same = [x for x in mine if x[0] == r.entry_id]
        assert len(lower) < r.key_rank <= len(lower) + len(same)
        assert r.word_rank > sum(x[2] == r.word for x in lower)
        assert r.first_word == (r.word == min(x[2] for x in mine if x[2] is not None))


def test_few_queries_deal_out_few_entries(spark, tmp_path, monkeypatch):
    """Their keys travel to the entries; the results are those of many queries."""
    index = I.write_index(entries(spark), str(tmp_path / "index"))
    q = queries(spark)

    def found():
        return [
            sorted(map(str, df.collect()))
            for df in (S.find_matches(q, index, 5), S.find_matches(q, index, 5, unit="key"), S.find_by_word(q, index, 5),
                       S.find_by_word(q, index, 5, unit="key"), S.find_by_word(q, index, unit="entry"),
                       S.find_closest(q, index, 0.6), S.find_closest(q, index, 0.6, unit="key"), S.autocomplete(q, index, 4),
                       S.closest_or_search(q, index, 5, 0.6), S.closest_or_search(q, index, 5, 0.6, unit="key"))
        ]

    few = found()
    text = S.find_matches(q, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    monkeypatch.setattr(S, "FEW_QUERIES", 0)
    assert found() == few and all(few)


def test_groups_have_tasks_of_their_own(spark, monkeypatch):
    """A pack and a slot are much work: there are more partitions than groups, and
    the rows are those of queries that travel."""
    monkeypatch.setattr(I, "SLOT_BLOCKS", 1)
    q = queries(spark).select("q_key").distinct()
    blocks = I.key_blocks(entries(spark).select("key").distinct(), 20)
    many = I.search_blocks(q, blocks, None, 0.3, broadcast_queries=3)
    groups = -(-q.count() // 3) * blocks.count()
    assert many.rdd.getNumPartitions() >= 4 * groups > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, I.search_blocks(q, blocks, None, 0.3).collect())) != []


def test_empty_lexicon_and_odd_entries(spark, tmp_path):
    none = I.write_index(entries(spark).where("false"), str(tmp_path / "none"))
    assert S.find_matches(queries(spark), none).count() == 0
    assert S.closest_or_search(queries(spark), none).count() == 0
    odd = spark.createDataFrame(
        [(1, "", "?", "d"), (2, None, None, None), (3, "a", "A", None)], entries(spark).schema
    )
    index = I.write_index(odd, str(tmp_path / "odd"))
    found = S.find_matches(queries(spark).union(spark.createDataFrame([(90, None), (91, "")], "i int, q string")), index)
    assert {(r.query_id, r.entry_id) for r in found.collect()} == {(i, 3) for i in range(len(QUERIES))}


def test_searches_compute_no_grams_of_the_lexicon(spark, tmp_path):
    index = I.publish_index(entries(spark), str(tmp_path), "lex").open(spark)
    q = queries(spark)
    for found in (
        S.find_matches(q, index, 5), S.find_by_word(q, index, 5), S.find_closest(q, index, 0.7),
        S.closest_or_search(q, index, 5), S.autocomplete(q, index),
    ):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # grams are made by transforms over a key's places; queries have a signature only
        assert "transform(sequence(1, (length(key" not in plan
        assert "distinct" not in plan.lower() or "q_key" in plan


OTHER_SESSION = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
from test_search import entries
from glossweave.operators import search_index as I
I.publish_index(entries(spark), {base!r}, "lex")
"""


def test_index_of_another_session(spark, tmp_path):
    root, tests = __file__.rsplit("/tests/", 1)[0], __file__.rsplit("/", 1)[0]
    code = OTHER_SESSION.format(root=root, tests=tests, base=str(tmp_path))
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    index = I.IndexPointer(str(tmp_path), "lex").open(spark)
    q = queries(spark)
    for search in (
        lambda lex: S.find_matches(q, lex, 5), lambda lex: S.find_by_word(q, lex, 5),
        lambda lex: S.find_closest(q, lex, 0.6, unit="key"), lambda lex: S.closest_or_search(q, lex, 5),
    ):
        a, b = (sorted(map(str, search(lex).collect())) for lex in (index, entries(spark)))
        assert a == b != []


def test_publishing_during_a_stream(spark, tmp_path):
    lex = entries(spark)
    pointer = I.publish_index(lex.where("key <> 'xistone'"), str(tmp_path / "base"), "lex")
    terms = spark.createDataFrame([(1, "xistone")], "query_id int, term string")
    terms.write.parquet(str(tmp_path / "terms"))
    stream = spark.readStream.schema(terms.schema).parquet(str(tmp_path / "terms"))

    def run():
        J.stream_lookup(stream, pointer, str(tmp_path / "found"), str(tmp_path / "c")).awaitTermination(120)

    run()
    I.publish_index(lex, str(tmp_path / "base"), "lex")
    terms.withColumn("query_id", F.lit(2)).write.mode("append").parquet(str(tmp_path / "terms"))
    run()
    found = spark.read.parquet(str(tmp_path / "found")).select("query_id", "route", "key").distinct().collect()
    assert {(r.query_id, r.route) for r in found} == {(1, "search"), (2, "exact")}


def test_two_publishers_at_once(spark, tmp_path):
    base, got = str(tmp_path), []

    def publish(folder):
        got.append((versions.commit(spark, base, "t", folder, keep=50), folder))

    threads = [threading.Thread(target=publish, args=(f"{base}/f{k}",)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in got) == [1, 2, 3, 4, 5, 6]
    assert sorted(got) == versions.versions(spark, base, "t")
    # who insists on the version it has read loses
    with pytest.raises(RuntimeError):
        versions.commit(spark, base, "t", f"{base}/late", after=5)
    assert versions.current(spark, base, "t") == max(got)


def test_a_reader_of_the_version_before_finishes(spark, tmp_path):
    base, lex = str(tmp_path), entries(spark)
    before = I.publish_index(lex, base, "lex").open(spark)
    I.publish_index(lex.limit(10), base, "lex")
    assert before.entries.count() == lex.count()
    assert I.IndexPointer(base, "lex").open(spark).entries.count() == 10
    I.publish_index(lex.limit(5), base, "lex")
    assert len(versions.versions(spark, base, "lex.index")) == 2
