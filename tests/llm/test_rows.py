"""Rows told apart by more than their id, and columns named like results."""

from cases import DOCS, PLAIN, doc, odd_docs, rows
from pyspark.sql import functions as F

from glossweave.llm import bpe, decontamination, jaccard, line_dedup, mixing, quality_rules, url_filter
from glossweave.llm.columns import guarded
from glossweave.llm.queries import RANK_FILE
from glossweave.session import ship_package

OTHER = "an altogether different text of more than a few words about nothing that the first one says"
THIRD = "one more of its own kind with other words in another order for the sake of this test alone"


def test_near_copies_are_decided_by_row(spark):
    ship_package(spark)
    given = [
        doc(1, PLAIN),
        doc(5, PLAIN),  # a copy of 1
        doc(5, OTHER),  # its own text
        doc(6, THIRD),
        doc(6, " ".join(reversed(THIRD.split()))),  # two texts of one id
        doc(7, THIRD + " x"),  # a near copy of 6
        doc(None, OTHER + " y"),  # a near copy without an id
        doc(None, "only here and nowhere else is this text to be found by anyone at all"),
        doc(None, "only here and nowhere else is this text to be found by anyone at all"),
        doc(8, ""), doc(8, ""), doc(None, None), doc(None, None),
        doc(9, "twice " * 40), doc(9, "twice " * 40),
    ]
    docs = spark.createDataFrame(given, DOCS)
    for again in (docs, docs.repartition(7)):
        kept = jaccard.drop_near_copies(again)
        assert kept.columns == docs.columns
        found = sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect())))
        left = [given[k] for k in (0, 2, 3, 4, 7, 9, 10, 11, 12, 13)]
        assert found == sorted(map(repr, ((r[0], r[1]) for r in left)))


def test_near_copies_without_repeats_or_rows(spark):
    ship_package(spark)
    docs = spark.createDataFrame([doc(1, PLAIN), doc(2, PLAIN), doc(3, OTHER)], DOCS)
    assert sorted(r.doc_id for r in jaccard.drop_near_copies(docs).collect()) == [1, 3]
    assert jaccard.drop_near_copies(docs.where("false")).count() == 0
    odd = odd_docs(spark)
    assert jaccard.drop_near_copies(odd).count() == odd.count() - 4  # one text twice, with another source, in capitals, and nearly


def clashing(spark):
    names = ["Kept", "N_Lines", "Slot", "IDS", "_url", "URL_", "_extra", "a.b", "a`b"]
    docs = spark.createDataFrame([(1, PLAIN, "a"), (2, None, None)], "doc_id long, text string, source string")
    return docs.withColumns({n: F.lit(k) for k, n in enumerate(names)}), names


def test_names_are_compared_without_case(spark, tmp_path):
    ship_package(spark)
    docs, names = clashing(spark)
    results = {
        "rules": (quality_rules.judge(docs), {"kept", "n_lines"}),
        "lines": (line_dedup.drop_boilerplate(docs), {"n_lines"}),
        "mixed": (mixing.mix(docs), {"slot"}),
        "tokens": (bpe.encode(docs, RANK_FILE, r"\S+|\s+"), {"ids"}),
    }
    for name, (found, replaced) in results.items():
        found.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        assert back.count() == 2
        stay = [n for n in names if n.lower() not in replaced]
        assert set(stay) < set(back.columns)
        first = back.where("doc_id = 1").first()
        assert [first[n] for n in stay] == [names.index(n) for n in stay]


def test_url_columns_stay(spark):
    urls, names = clashing(spark)
    urls = urls.withColumns({"url": F.lit("http://x.net/fr/1"), "Host": F.lit("mine"), "rule": F.lit("http://com/")})
    rules = url_filter.rule_table(spark, [("net", "/fr/", "block"), ("com", "/", "allow")])
    found = url_filter.judge(urls, rules).first()
    assert (found["_url"], found["URL_"], found.host, found.verdict) == (4, 5, "x.net", "block")
    # the url itself may be named like a result
    named = url_filter.judge(urls, rules, url_column="rule").first()
    assert (named.host, named.rule, named.url) == ("com", "com/", "http://x.net/fr/1")


def test_guarded_keeps_order_and_values(spark):
    df = spark.createDataFrame([(1, 2, 3)], "B int, a int, C int")
    out = guarded(df, ["a"], lambda d: d.withColumn("c", F.col("a") + 10), ["c"])
    assert out.columns == ["B", "a", "c"] and rows(out) == [(1, 2, 12)]


def test_more_columns_do_not_disturb(spark):
    docs, _ = clashing(spark)
    items = spark.createDataFrame([(1, PLAIN)], "item_id long, text string")
    found = decontamination.contamination(docs, items)
    assert [r.n_hit for r in found.orderBy("doc_id").collect()] == [len(PLAIN.split()), 0]
