import math

import golden
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.operators import analytics as A
from glossweave.operators import embeddings as V
from glossweave.operators import markup as M
from glossweave.operators import store as S
from glossweave.operators.search import query_keys
from glossweave.plans.lexicon import ORDER_COLUMNS, parse_lexicon, ranged_texts, with_key
from glossweave.sources.lines import lines_below, read_lexicon
from glossweave.streaming import jobs as J


@pytest.fixture(scope="module")
def lexicon(spark, tmp_path_factory):
    texts = spark.createDataFrame([(1, golden.LONG_TEXT)], "doc_id bigint, text string")
    path = str(tmp_path_factory.mktemp("lex") / "lexicon")
    S.write_lexicon(with_key(parse_lexicon(texts)), path, ORDER_COLUMNS)
    return read_lexicon(spark, path)


def test_ids_follow_source_order(lexicon):
    rows = lexicon.orderBy("entry_id").collect()
    assert [r.entry_id for r in rows] == list(range(1, 53))
    assert [(r.word, r.definition, r.referenced_words) for r in rows] == golden.LONG_ENTRIES


def test_ranged_texts_are_parsed_once(spark, tmp_path):
    """The same lexicon from texts in ranges, without a range exchange of entries."""
    rows = [(i * 37 % 50, golden.LONG_TEXT) for i in range(50)] + [(7, golden.LONG_TEXT), (None, golden.LONG_TEXT)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    ranged = with_key(parse_lexicon(ranged_texts(texts)))
    for name, df, known in (("sorted", with_key(parse_lexicon(texts)), False), ("ranged", ranged, True)):
        S.write_lexicon(df, str(tmp_path / name), ORDER_COLUMNS, known)
    a, b = (read_lexicon(spark, str(tmp_path / n)).orderBy("entry_id").collect() for n in ("sorted", "ranged"))
    assert a == b and [r.entry_id for r in b] == list(range(1, 52 * 52 + 1))
    plan = ranged.sortWithinPartitions(*ORDER_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_lines_below_their_marks(spark):
    """Marks inside a chunk and from chunks before, without a join by file alone."""
    rows = [("f", n, f"@{n}" if n in (3, 4, 40) else f"x{n}") for n in range(60)] + [("g", 5, "y"), ("h", 0, "@9"), ("h", 99, "z")]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, line string")
    number = F.regexp_extract("line", r"^@(\d+)$", 1)
    found = lines_below(lines, "file", number != "", number.cast("bigint"), chunk=8)
    want = [("f", n, 4 if n < 40 else 40) for n in range(5, 60) if n != 40] + [("h", 99, 9)]
    assert sorted((r.file, r.line_no, r.of) for r in found.collect()) == want
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 1 and "_chunk" in joins[0]


def test_ids_over_many_partitions(spark):
    df = spark.range(0, 5000, numPartitions=13).select(
        F.expr("(id * 7919) % 5003").alias("v")
    )
    got = S.with_entry_ids(df.repartition(7), ["v"]).orderBy("entry_id").collect()
    assert [r.entry_id for r in got] == list(range(1, 5001))
    assert [r.v for r in got] == sorted(r.v for r in got)


def test_key_groups_split_hot_keys(spark, lexicon, tmp_path):
    whole = S.key_groups(lexicon).collect()
    assert sum(r.n_entries for r in whole) == 52 and {r.part for r in whole} == {0}
    split = S.key_groups(lexicon, max_entries=1).where("key = 'a'").collect()
    assert sorted((r.part, r.n_entries) for r in split) == [(0, 1), (1, 1), (2, 1)]
    assert {r.partition_key for r in split} == {"A"}
    pairs = S.key_groups(lexicon, max_entries=2).where("key = 'a'").collect()
    assert sorted((r.part, r.n_entries) for r in pairs) == [(0, 2), (1, 1)]
    S.write_key_groups(lexicon, str(tmp_path / "groups"))
    back = spark.read.parquet(str(tmp_path / "groups"))
    assert back.where("partition_key = 'A'").agg(F.sum("n_entries")).first()[0] == 10


def test_json_payload_round_trip(lexicon):
    back = S.from_json_payload(S.to_json_payload(lexicon))
    assert back.exceptAll(lexicon.drop("key")).count() == 0


def test_export_by_letter(spark, lexicon, tmp_path):
    S.export_by_letter(lexicon, str(tmp_path / "letters"))
    back = spark.read.csv(
        str(tmp_path / "letters"), header=True, multiLine=True, escape='"'
    )
    assert back.count() == 52
    letters = {r.letter for r in back.select("letter").distinct().collect()}
    assert letters == set("ADEFMOPRSTVX")
    refs = back.where("word = 'Fátta'").first().references
    assert refs == "Sì\nC[o]sì"


def test_upsert(spark, lexicon):
    new = lexicon.where("entry_id = 1").withColumn("definition", F.lit("new"))
    added = new.withColumn("entry_id", F.lit(99).cast("bigint"))
    out = S.upsert_by_id(lexicon, new.union(added), "entry_id")
    assert out.count() == 53
    assert {r.entry_id for r in out.where("definition = 'new'").collect()} == {1, 99}


def test_index_and_publish(spark, lexicon, tmp_path):
    S.index_on_word(lexicon, str(tmp_path / "idx"))
    assert S.lookup_word(spark, str(tmp_path / "idx"), "A").count() == 3
    path = S.publish_version(lexicon, str(tmp_path / "pub"), "lex_view")
    stats = S.lexicon_stats(lexicon).first()
    assert f"-{stats.vector_size}_{stats.number_of_vectors}-" in path
    assert spark.table("lex_view").count() == 52
    target = S.lexicon_stats(lexicon)
    assert S.needs_rebuild(target, target).first().rebuild is False
    assert S.needs_rebuild(target.limit(0), target).first().rebuild is True
    fewer = S.lexicon_stats(lexicon.where("word <> 'A'"))
    assert S.needs_rebuild(fewer, target).first().rebuild is True


def test_upsert_keeps_one_of_a_repeated_id(spark, lexicon):
    change = lexicon.where("entry_id = 1")
    changes = change.withColumn("definition", F.lit("a")).union(change.withColumn("definition", F.lit("b")))
    out = S.upsert_by_id(lexicon, changes, "entry_id")
    assert out.count() == 52
    assert out.where("entry_id = 1").first().definition == "b"


def test_publish_twice_with_equal_counts(spark, lexicon, tmp_path):
    base = str(tmp_path / "twice")
    first = S.publish_version(lexicon, base, "twice")
    # what is published may be read from the version before
    changed = spark.table("twice").withColumn("definition", F.lit("changed"))
    second = S.publish_version(changed, base, "twice")
    assert first != second
    for found in (spark.table("twice"), S.published(spark, base, "twice")):
        assert found.where("definition = 'changed'").count() == 52
    assert S.current_version(spark, base, "twice") == (2, second)
    assert not (tmp_path / "twice" / first.rsplit("/", 1)[1]).exists()


def test_failed_publish_leaves_the_old_version(spark, lexicon, tmp_path):
    base = str(tmp_path / "failed")
    S.publish_version(lexicon, base, "failed")
    broken = lexicon.withColumn(
        "definition", F.when(F.col("entry_id") == 52, F.raise_error(F.lit("no"))).otherwise("x")
    )
    with pytest.raises(Exception):
        S.publish_version(broken, base, "failed")
    assert S.published(spark, base, "failed").count() == 52
    assert spark.table("failed").where("definition = 'x'").count() == 0


def test_rebuild_if_stale(spark, lexicon, tmp_path):
    base, entries = str(tmp_path / "job"), lexicon.drop("entry_id")
    assert S.rebuild_if_stale(entries, base, "job", ["word", "definition"])
    assert not S.rebuild_if_stale(entries, base, "job", ["word", "definition"])
    fewer = entries.where("word <> 'Fátta'")
    assert S.rebuild_if_stale(fewer, base, "job", ["word", "definition"])
    assert S.published(spark, base, "job").count() == fewer.count()


def test_reports(spark, lexicon):
    assert A.entry_count(lexicon).first().entries == 52
    word = A.longest(lexicon, "word", ["entry_id"]).first()
    assert word.value.startswith("Fáre a guísa") and word.length == len(word.value)
    tie = A.longest(lexicon.where("word = 'A'"), "word", ["entry_id"]).first()
    assert tie.value == "A"
    bad = spark.createDataFrame([("ábc",), ("[o",), ("X-y & z",), ("é",)], "word string")
    assert [r.word for r in A.suspect_variants(bad).collect()] == ["ábc", "é"]
    assert [r.word for r in A.leftover_brackets(bad).collect()] == ["[o"]
    assert [r.word for r in A.decomposed_words(bad).collect()] == ["é"]
    found = A.words_with_unexpected(bad).collect()
    assert sorted((r.norm, r.character) for r in found) == [("x-y & z", "&"), ("x-y & z", "-")]
    chars = {r.character: r.n for r in A.vector_alphabet(lexicon).collect()}
    assert chars["x"] == 2 and set(chars) <= set("abcdefghijklmnopqrstuvwxyz ")
    assert "'" in {r.character for r in A.character_inventory(lexicon).collect()}


def test_readiness_and_search_report(spark, lexicon):
    ready = A.readiness_check(lexicon, min_keys=40).first()
    assert ready.ready and ready.probes_found == 2
    assert not A.readiness_check(lexicon).first().ready
    terms = spark.createDataFrame([(0, "Xistóne"), (1, "qq")], "query_id int, term string")
    rows = A.search_report(query_keys(terms), lexicon, 4).collect()
    sections = sorted((r.query_id, r.section) for r in rows)
    assert sections.count((0, "top")) == 4 and (0, "best") in sections
    assert (1, "none") in sections and (1, "best") not in sections


def test_markup_jobs(spark):
    df = spark.createDataFrame([(1, "_as_ M^r. [o]x")], "id int, definition string")
    runs = M.markup_table(df, ["id"]).orderBy("run_no").collect()
    assert [(r.text, r.style, r.superscripts) for r in runs] == [
        ("as", "italic", []),
        (" M^r. [o]x", "roman", ["r"]),
    ]
    assert M.render_definitions(df, ["id"]).first().html == (
        "<i>as</i> M<sup>r</sup>. <em>o</em>x"
    )
    terms = spark.createDataFrame([("C%C3%B3sa",), ("cosa",), (" ",)], "t string")
    assert [tuple(r) for r in M.search_term_counts(terms, "t").collect()] == [("cosa", 2)]


# --- embeddings ------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)], int(i % 4)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def brute_vectors(rows, k):
    m = np.array([np.float32(r[1]) for r in rows], dtype=np.float64)
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    scores = np.floor(m @ m.T * 1e6 + 0.5) / 1e6
    return {
        i: sorted(range(len(rows)), key=lambda j: (-scores[i, j], j))[:k]
        for i in range(len(rows))
    }, scores


@pytest.mark.parametrize("limit", [1000, 10])
def test_vector_search(vectors, limit):
    rows, df = vectors
    q = df.selectExpr("vec_id AS query_id", "embedding")
    options = {"broadcast_queries": limit, "q_block": 70, "item_block": 90}
    want, scores = brute_vectors(rows, 5)
    got = {}
    for r in V.vector_search(q, df, 5, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
    grouped = V.vector_search(q, df, 3, group_col="label", **options).collect()
    for i in (0, 17):
        best = {}
        for j in range(len(rows)):
            best.setdefault(rows[j][2], []).append((-scores[i, j], j))
        firsts = sorted(min(v) for v in best.values())[:3]
        mine = sorted((r["rank"], r.vec_id) for r in grouped if r.query_id == i)
        assert [v for _, v in mine] == [j for _, j in firsts]


def test_approximate_search(vectors):
    rows, df = vectors
    q = df.selectExpr("vec_id AS query_id", "embedding")
    exact = V.vector_search(q, df, 5)
    all_cells = V.approx_matches(q, df, 5, cells=6, probes=6, item_block=20, q_block=50)
    assert V.recall(all_cells, exact).first().recall == 1.0
    some = V.approx_matches(q, df, 5, cells=6, probes=2, item_block=20)
    share = V.recall(some, exact).first().recall
    assert 0.4 < share <= 1.0 and not math.isnan(share)


# --- streaming -------------------------------------------------------------


def test_stream_ingest_and_lookup_equal_batch(spark, lexicon, tmp_path):
    books = tmp_path / "books"
    books.mkdir()
    (books / "one.txt").write_text(golden.LONG_TEXT, encoding="utf-8")
    (books / "two.txt").write_text(golden.LONG_TEXT, encoding="utf-8")
    out = str(tmp_path / "entries")
    query = J.stream_ingest(
        J.stream_texts(spark, str(books)), out, str(tmp_path / "c1")
    )
    query.awaitTermination(120)
    rows = spark.read.parquet(out).orderBy(*ORDER_COLUMNS).collect()
    assert [(r.word, r.definition, r.referenced_words) for r in rows] == golden.LONG_ENTRIES * 2

    terms = spark.createDataFrame(
        [(0, "Xistóne"), (1, "qq"), (2, "essere")], "query_id bigint, term string"
    )
    terms.write.parquet(str(tmp_path / "terms"))
    stream = spark.readStream.schema(terms.schema).parquet(str(tmp_path / "terms"))
    found = str(tmp_path / "found")
    J.stream_lookup(stream, lexicon, found, str(tmp_path / "c2")).awaitTermination(120)
    from glossweave.operators.search import closest_or_search

    batch = closest_or_search(query_keys(terms), lexicon)
    streamed = spark.read.parquet(found).drop("batch").select(batch.columns)
    assert streamed.exceptAll(batch).count() == 0 == batch.exceptAll(streamed).count()


def test_stream_quota_equals_batch(spark, tmp_path):
    events = spark.range(500).select(
        F.expr("timestamp_seconds(id * 3)").alias("ts"), (F.col("id") % 3).alias("user_id")
    )
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    report = J.quota_report(stream, "1 minute", 5)
    query = (
        report.writeStream.outputMode("complete").format("memory")
        .queryName("quota").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = J.quota_report(events, "1 minute", 5)
    streamed = spark.table("quota")
    assert streamed.exceptAll(batch).count() == 0 == batch.exceptAll(streamed).count()
    assert batch.agg(F.max("over_limit")).first()[0] > 0


def test_texts_are_read_from_one_folder(spark, tmp_path, monkeypatch):
    """Every text is a file of its own, with its id, and no folder is made for it."""
    from glossweave.catalog import queries as Q
    from glossweave.plans.lexicon import parse_lexicon

    docs = [(k, f"able word {k}\nbaker two\nchance of a line") for k in range(30)] + [(40, None), (41, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    books = tmp_path / "books"
    monkeypatch.setattr(Q, "scratch_path", lambda s, name: str(books))
    found = Q.src1_read_texts(spark, str(tmp_path))
    expected = parse_lexicon(Q.texts(spark, str(tmp_path))).select(found.columns)
    assert sorted(found.collect()) == sorted(expected.collect())
    assert found.select("doc_id").distinct().count() == 30
    assert not [p for p in books.iterdir() if p.is_dir()]
    assert len([p for p in books.iterdir() if p.name.startswith("part-") and p.stat().st_size]) == 30


def test_small_texts_share_tasks(spark, tmp_path):
    from glossweave.sources.lines import TEXT_TASKS, read_texts

    for k in range(90):
        (tmp_path / f"t{k}.txt").write_text(f"text {k}\nof two lines")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        found = read_texts(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    tasks = TEXT_TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len({r.task for r in found}) <= tasks < 90
    assert sorted(r.text for r in found) == sorted(f"text {k}\nof two lines" for k in range(90))
    assert len({r.doc_id for r in found}) == 90
