"""The pipeline and the registered queries."""

import public_tokenizers
import tiktoken
from cases import DOCS, PLAIN, doc, no_docs, odd_docs

import __spark_entry__ as entry
import corpus_pipeline
from glossweave.llm import bpe, jaccard, line_dedup, mixing, quality_rules
from glossweave.llm.queries import RANK_FILE

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def through(spark, docs, stages=None):
    for _, stage in corpus_pipeline.STAGES[:stages]:
        docs = stage(spark, docs, SMALL)
    return docs


def test_stages_keep_columns_and_take_odd_rows(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()


def test_each_decision_takes_effect(spark):
    words = PLAIN.split()
    rows = [doc(i, f"NAV BAR\n{' '.join(words[i % 9:])} {i} {' '.join(words[::-1])} {i * 7} {i * 11}", f"s{i % 3}") for i in range(60)]
    rows += [doc(100, rows[5][1], "s1"), doc(101, "### $$$ %%%", "s1"), doc(102, None, "s1")]
    docs = spark.createDataFrame(rows, DOCS)
    ruled = through(spark, docs, 1).collect()
    assert {r.doc_id for r in ruled} == {*range(60), 100}
    cleaned = through(spark, docs, 2).collect()
    assert all("NAV BAR" not in r.text and r.n_chars == len(r.text) for r in cleaned)
    assert {r.doc_id for r in through(spark, docs, 3).collect()} == {*range(60)}
    assert through(spark, docs, 4).count() <= 60
    out = through(spark, docs).collect()
    ranks = bpe.read_ranks(RANK_FILE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in cleaned}
    assert out and all(r.ids == library.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    by_hand = quality_rules.judge(docs).where("kept").select(docs.columns)
    by_hand = line_dedup.drop_boilerplate(by_hand).select(docs.columns)
    by_hand = jaccard.drop_near_copies(by_hand)
    by_hand = mixing.mix(by_hand).where("mixed")
    ran = corpus_pipeline.run(spark, SMALL)
    assert sorted(r.doc_id for r in ran.select("doc_id").collect()) == sorted(
        r.doc_id for r in by_hand.select("doc_id").collect()
    )


def test_the_mix_keeps_a_hot_source_whole(spark):
    rows = [doc(i, f"text {i}", "hot") for i in range(90)] + [doc(100 + i, f"text {i}", f"s{i % 3}") for i in range(9)]
    rows += [doc(200, "x", None), doc(200, "x", None), doc(None, "x", "hot")]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = dict(corpus_pipeline.STAGES)["mix_sources"](spark, docs, SMALL)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, docs.collect()))


def test_tokens_stand_in_the_order_of_the_mix(spark, tmp_path):
    rows = [doc(i, f"text {i}", f"s{i % 7 % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    want = [r.doc_id for r in mixing.mix(docs, max_share=1.0).orderBy("position").collect()]
    mixed = stages["mix_sources"](spark, docs, SMALL)
    mixed.write.parquet(str(tmp_path / "mixed"))
    for source in (spark.read.parquet(str(tmp_path / "mixed")), mixed):
        out = stages["byte_bpe"](spark, source, SMALL).orderBy("position").collect()
        assert [r.position for r in out] == list(range(200)) and [r.doc_id for r in out] == want
