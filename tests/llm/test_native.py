"""Quality rules, line dedup, url filter, source mixing."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import PLAIN, doc, DOCS, no_docs, odd_docs
from pyspark.sql import functions as F

from glossweave.llm import line_dedup, mixing, quality_rules, url_filter
from glossweave.llm.oracle import KEPT, LINE_DEDUP, MIXED, QUALITY_RULES


def ours(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def theirs(docs, sql):
    con = duckdb.connect()
    con.register("given", docs.drop("_extra", "kept", "n_words").toPandas())
    # pandas turns null ids into floats
    con.execute("create view docs as select * replace (doc_id::bigint as doc_id) from given")
    return sorted(map(repr, con.execute(sql).fetchall()))


def test_quality_rules_odd_rows(spark):
    docs = odd_docs(spark)
    found = quality_rules.judge(docs)
    columns = ["n_chars", "_extra", "lang"]
    assert ours(found, *columns) == ours(docs, *columns)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    long = found.where("doc_id = 7").first()
    assert (long.n_words, long.n_repeat_words, long.base_failed) == (120_000, 0, False)
    # the SQL copies a text's words for each of its windows
    short = docs.where("doc_id is null or doc_id <> 7")
    expected = theirs(short, QUALITY_RULES.format(docs="docs") + f"select {', '.join(names[:6])}, ({KEPT}) kept from q")
    assert ours(quality_rules.judge(short), *names) == expected
    assert quality_rules.judge(no_docs(spark)).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e f a b c d e", "a " * 30, "a b c d", "a b c d e a b c d e f g a b c d e", "p q r s t u v w x y"]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(docs).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
        assert found[i] == len(covered)


def test_threshold_table_is_one_projection(spark):
    rules = [quality_rules.Rule("short", "n_words", high=3)]
    found = quality_rules.judge(odd_docs(spark), rules)
    assert "ok_short" in found.columns and "ok_symbols" not in found.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def boiler_docs(spark):
    rows = [doc(i, f"HOME | NAV\n{PLAIN} {i}\n\nfooter", "a" if i % 3 else None) for i in range(60)]
    rows += [doc(100 + i, f" HOME | NAV \nown {i}", "b") for i in range(3)]
    rows += [doc(200, None, "a"), doc(201, "", "a"), doc(3, f"HOME | NAV\n{PLAIN} 3\n\nfooter", None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup_matches_sql(spark, limit):
    docs = boiler_docs(spark)
    found = line_dedup.drop_boilerplate(docs, broadcast_bytes=limit, salts=3)
    sql = LINE_DEDUP.format(docs="docs") + (
        "select doc_id, source, coalesce(len(ls), 0)::bigint, coalesce(len(ls) - len(kept), 0)::bigint,"
        " array_to_string(kept, chr(10)) from c"
    )
    assert ours(found, "doc_id", "source", "n_lines", "n_dropped", "text") == theirs(docs, sql)
    # the ratio decides, however few pages a host has
    assert found.where("source = 'b'").agg(F.sum("n_dropped")).first()[0] == 3
    assert set(found.where("_extra = 7").columns) > {"kept", "n_words"}


def test_line_dedup_odd_rows(spark):
    docs = odd_docs(spark)
    found = line_dedup.drop_boilerplate(docs)
    # the row that is given twice is most of its host's repeated lines
    cleaned = docs.withColumn("text", F.when(F.col("doc_id") == 1, "").otherwise(F.col("text")))
    assert ours(found, *docs.columns) == ours(cleaned, *docs.columns)
    assert line_dedup.drop_boilerplate(no_docs(spark)).count() == 0


URLS = [
    "https://WWW.Example.com/en/1?x#y", "http://a.example.com/en/", "http://example.com/en", "http://x.net/fr/1",
    "http://net/es/", "ftp://com", "http://com/", "no scheme", "", None, "a://b://com/", "http://com?x://net/es/",
    "http://evilcom/", "http://example.com/en/../", "http://x.net:80/es/",
]
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0]) or not r[0]) and path.startswith(r[1])]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (url_filter.rank(*r), r[0] + r[1]))
    return host, path, best[0] + best[1], best[2]


@pytest.mark.parametrize("most", [url_filter.MAX_TRIE_RULES, 0])
@pytest.mark.parametrize("more", [[], [("x.net", "/fr/1", "allow"), ("com", "/en/", "block"), ("net", "/f", "allow"), ("com", "/", "block")]])
def test_url_filter(spark, most, more):
    rules = RULES + more
    rows = [(i, u, "mine") for i, u in enumerate(URLS + URLS[:2])]
    urls = spark.createDataFrame(rows, "page_id long, url string, rule string")
    found = url_filter.judge(urls, url_filter.rule_table(spark, rules), max_trie_rules=most)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: judged(u, rules) for i, u, _ in rows}
    assert url_filter.judge(urls.where("false"), url_filter.rule_table(spark, rules), max_trie_rules=most).count() == 0


def source_docs(spark):
    rows = [doc(i, str(i), "big") for i in range(400)]
    rows += [doc(1000 + i, "x", f"s{i % 7}") for i in range(210)]
    rows += [doc(2000, "x", None), doc(2000, "x", None), doc(None, None, "s1")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("bucket", [mixing.BUCKET_DOCS, 16])
def test_mixing_matches_sql(spark, bucket):
    docs = source_docs(spark)
    found = mixing.mix(docs, bucket_docs=bucket)
    sql = MIXED.format(docs="docs") + "select doc_id, source, n_in_source, block, slot, coalesce(mixed, false) from x"
    assert ours(found, "doc_id", "source", "n_in_source", "block", "slot", "mixed") == theirs(docs, sql)
    assert set(docs.columns) < set(found.columns)


def worst_deviation(order, shares):
    """Largest distance, after any slot, of a source's blocks from its share."""
    t = np.arange(1, len(order) + 1)
    return max(np.abs(np.cumsum(order == s) - w * t).max() for s, w in shares.items())


def test_mixing_deviates_by_less_than_a_block(spark):
    # 100,000 blocks by weights that no period of whole units holds
    shares = {"a": 0.5, "b": 0.25, "c": 0.1234567, "d": 0.0765433, "e": 0.0499, "f": 0.0001}
    docs = spark.range(300_000).select(
        F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, shares)), (F.col("id") % 6 + 1).cast("int")).alias("source")
    )
    weights = spark.createDataFrame(list(shares.items()), "source string, weight double")
    found = mixing.mix(docs, weights).where("mixed").select("slot", "source").orderBy("slot").toPandas()
    # at the end of the mix a few slots are of blocks that are not there
    assert len(found) >= 99_990 and (np.diff(found["slot"][:99_990]) == 1).all()
    whole = {s: w / sum(shares.values()) for s, w in shares.items()}
    assert worst_deviation(found["source"].to_numpy(), whole) < 1


def test_mixing_of_thousands_of_sources(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 2999)).alias("source"),
    )
    for options in ({"max_share": 1.0}, {"max_share": 1.0, "broadcast_slots": 0}):
        found = mixing.mix(docs, **options).toPandas()
        assert found["mixed"].all() and found["position"].is_unique and len(found) == 30_000
        order = found.sort_values("position")["source"].to_numpy()
        shares = {s: n / len(order) for s, n in Counter(order).items()}
        assert len(shares) == 3000
        # a third of 2,999 windows that cross a border of periods is in the way
        assert worst_deviation(order, {s: w for s, w in shares.items() if s != "hot"}) < 1.1
        assert worst_deviation(order, {"hot": shares["hot"]}) < 3


def test_mixing_blocks_and_order(spark):
    docs = source_docs(spark)
    found = mixing.mix(docs, block_docs=8).where("mixed").collect()
    assert len({r.position for r in found}) == len(found)
    assert all(r.block == r.n_in_source // 8 for r in found)
    ordered = mixing.interleaved(docs, 4)
    assert ordered.columns == docs.columns
    kept = ordered.groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in kept}["s0"] == 30  # only the large source is held down
    assert {r["source"]: r["count"] for r in kept}["big"] < 400
    assert mixing.mix(no_docs(spark)).count() == 0
    assert mixing.mix(odd_docs(spark)).count() == odd_docs(spark).count()
    # more sources than a period has slots
    short = mixing.mix(docs, period=4, max_share=1.0).collect()
    assert len({r.position for r in short}) == docs.count() and all(r.mixed for r in short)
