"""Hard negatives, benchmark decontamination, conversation trie."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from cases import DOCS, doc, no_docs, odd_docs, rows
from pyspark.sql import functions as F

import duckdb

from glossweave.llm import decontamination, hard_negatives, prefix_trie
from glossweave.llm.oracle import CONTAMINATED, PREFIX_TRIE
from glossweave.session import ship_package


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


# --- hard negatives ----------------------------------------------------------------


def mined(vectors, positives=5, negatives=3, every=50, low=50, high=95):
    """All scores of all anchors, sorted."""
    whole = {(i, l, tuple(math.floor(256 * float(x)) for x in v)) for i, l, v in vectors}
    out = []
    for i, label, v in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in whole if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k, _) in enumerate(fits[:negatives])]
    return sorted(out)


def vector_table(spark, given):
    return spark.createDataFrame(given, "vec_id long, label int, embedding array<double>, row string, anchor_no long")


def mine(df, **kw):
    rows_in = hard_negatives.integer_rows(df, "vec_id", F.col("label"), "embedding")
    return hard_negatives.mine(rows_in, F.col("id") % kw.pop("every", 50) == 0, **kw)


@pytest.mark.parametrize("sizes", [{}, {"anchor_block": 5, "item_block": 40}])
@pytest.mark.parametrize("shape", ["spread", "close", "one label", "ties"])
def test_hard_negatives(spark, shape, sizes):
    ship_package(spark)
    random = np.random.default_rng(3)
    x = random.normal(size=(300, 12))
    if shape == "close":  # a group of near copies beside the others
        x[:120] = x[0] + random.normal(size=(120, 12)) * 0.05
    if shape == "ties":
        x = random.integers(-1, 2, size=(300, 12)) / 2
    labels = random.integers(0, 1 if shape == "one label" else 4, size=300)
    given = [(i, int(l), [float(c) for c in v]) for i, (l, v) in enumerate(zip(labels, x))]
    found = mine(vector_table(spark, [(*g, "x", 5) for g in given]), every=10, **sizes)
    assert sorted(rows(found)) == mined(given, every=10)


def test_hard_negatives_odd_rows(spark):
    ship_package(spark)
    near = [float(c) for c in np.random.default_rng(5).normal(size=4)]
    given = [(i, i % 2, [c + i / 50 for c in near]) for i in range(1, 30)] + [(0, 0, near)]
    odd = [
        (None, 1, near), (31, None, near), (32, 1, None), (33, 1, [1.0, None, 2.0, 3.0]), (34, 1, [float("nan")] * 4),
        (35, 1, [1.0, float("inf"), 2.0, 3.0]), (36, 1, [1e300, 0.0, 0.0, 0.0]), (37, 0, [-1e15, 0.0, 0.0, 0.0]),
    ]
    short = [(38, 0, []), (39, 1, near[:2]), (0, 1, near), (0, 0, near)]
    table = vector_table(spark, [(*g, None, None) for g in given + odd + short + given[:3]])
    filled = [(i, l, (v + [0.0] * 4)[:4]) for i, l, v in given + short]
    assert sorted(rows(mine(table))) == mined(filled)
    # large numbers: exact beyond doubles
    large = [(i, i % 2, [2.0**22 + i, 1.0, 2.0**20 + 3 * i]) for i in range(20)]
    assert sorted(rows(mine(vector_table(spark, [(*g, None, None) for g in large]), high=100))) == mined(large, high=100)
    empty = vector_table(spark, [])
    assert mine(empty).count() == 0
    only_empty = vector_table(spark, [(0, 1, [], None, None), (1, 1, [], None, None), (2, 0, [], None, None)])
    assert rows(mine(only_empty)) == [(0, 1, 1, 2, 0, 0)]


def test_index_leaves_out_leading_dimensions():
    random = np.random.default_rng(1)
    items, anchors = random.integers(-200, 200, size=(400, 32)), random.integers(-200, 200, size=(20, 32))
    index = hard_negatives.BlockIndex.of(items)
    turned = anchors[:, index.order]
    exact = anchors @ items.T
    for threshold in (1, 100_000, 400_000):
        least = np.full(20, threshold)
        out = index.left_out(threshold, np.linalg.norm(turned, axis=1).max())
        assert threshold == 1 or out.max() > 0
        a, r, s = index.reaching(turned, least)
        assert {(i, j, v) for i, j, v in zip(a, r, s)} == {(i, j, exact[i, j]) for i, j in zip(*np.nonzero(exact >= threshold))}


# --- decontamination ---------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return ordered(out)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs off into the wood again"),
    (2, "the quick brown fox jumps over the lazy dog and runs home"),  # shares windows with 1
    (10, "Two words"), (11, "single"), (12, "a a a"), (3, "na na na na na na na na na na na na"),
    (None, "Ünïcödé wörds İ stand here for all of the tests to come and to go"), (4, None), (5, " ... "),
    (1, "of one item there may be two rows with texts of their own to be found"), (13, "one two three four five"),
]


def item_table(spark, given):
    return spark.createDataFrame([(*g, "x", 1) for g in given], "item_id long, text string, doc_id string, rid int")


def dirty_docs(spark):
    fox = ITEMS[0][1]
    texts = [
        fox, fox.upper() + "!", "x " + " ".join(fox.split()[:9]), "start, " + " - ".join(fox.split()[2:13]) + " end",
        f"{fox} {fox}", "two, Words and two words", "SINGLE", "a a", "a a a a b a a a", "na " * 40, "two", "",
        " ".join(f"one two three four{' five' * (k % 2)}" for k in range(50)), ITEMS[6][1] + " " + ITEMS[1][1],
        "ünïcödé wörds i̇ stand here for all of the tests to come and to go", "single " * 5000 + fox,
        "of one item there may be two rows\nwith texts of their own to be\x00found", "the quick brown fox " * 300,
    ]
    given = [doc(100 + k, t) for k, t in enumerate(texts)] + [doc(100, "two words"), doc(None, fox), doc(None, fox)]
    return spark.createDataFrame(given, DOCS).union(odd_docs(spark))


@pytest.mark.parametrize("most", [decontamination.BROADCAST_ROWS, 0])
def test_decontamination(spark, most):
    docs, items = dirty_docs(spark), item_table(spark, ITEMS)
    found = decontamination.contamination(docs, items, broadcast_rows=most)
    expected = contaminated(rows(docs.select("doc_id", "text")), ITEMS)
    assert ordered(rows(found)) == expected
    assert sum(r[5] for r in expected) > 10


def test_decontamination_matches_sql(spark):
    docs = dirty_docs(spark).where("length(text) < 100000 or text is null")
    con = duckdb.connect()
    con.register("docs", docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").toPandas())
    con.register("given", item_table(spark, ITEMS).select(F.col("item_id").cast("string"), "text").toPandas())
    sql = CONTAMINATED.format(docs="docs", items="given") + "select * from x"
    found = decontamination.contamination(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text"), item_table(spark, ITEMS))
    assert ordered(rows(found)) == ordered(con.execute(sql).fetchall())


def test_decontamination_without_rows(spark):
    items = item_table(spark, ITEMS)
    assert decontamination.contamination(no_docs(spark), items).count() == 0
    none = decontamination.contamination(odd_docs(spark), items.where("false"))
    assert none.count() == odd_docs(spark).count() and none.where("contaminated or n_items > 0").count() == 0
    short = decontamination.contamination(dirty_docs(spark), items, window=2, shingle=3)
    assert short.where("contaminated").count() > 10


def test_decontamination_is_native(spark):
    found = decontamination.contamination(dirty_docs(spark), item_table(spark, ITEMS))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


# --- trie of conversations ---------------------------------------------------------


def trie(given):
    """Members of every prefix, gathered."""
    convs = {}
    for c, t, role, text in given:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    whole, nodes, below = {}, {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(whole[c][:d], []).append(c)
    for s in nodes:
        if s:
            below.setdefault(s[:-1], []).append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(nodes, key=len, reverse=True):
        under = below.get(s, [])
        leaves[s] = sum(leaves[x] for x in under) or 1
        own = (len(nodes[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        saved[s] = sum(saved[x] for x in under) + own
        ends = ",".join(str(c) for c in sorted(nodes[s]) if whole[c] == s)
        up = min(nodes[s[:-1]]) if s else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(nodes[s]), len(s), up, len(nodes[s]), len(under), leaves[s], saved[s], digest))
    return ordered(out)


def conversation_table(spark, given):
    return spark.createDataFrame(
        [(*g, "x", 3) for g in given], "conv_id long, turn long, role string, text string, depth string, place int"
    )


def talk():
    random = np.random.default_rng(7)
    lines = [f"line {k} of talk" for k in range(4)]
    given = [
        (int(c), t, ("user", "assistant")[t % 2], lines[random.integers(0, 2 if t < 4 else 4)])
        for c in random.choice(400, 150, replace=False)
        for t in range(random.integers(1, 9))
    ]
    same = [(c, t, "user", "the same") for c in range(1000, 1100) for t in range(5)]
    odd = [
        (None, 1, "user", "x"), (500, None, "user", "first"), (500, 1, None, None), (500, 1, None, ""), (500, 0, "", ""),
        (501, 2, "a", "tie b"), (501, 2, "a", "tie a"), (501, 2, "a", "tie a"), (-7, 0, "user", "below"), (-7, 1, "user", "zero"),
        (-20, 0, "user", " \t\n "), (560, 0, "user", "only\x1cone word x"), (561, 0, "u", ""), (562, 0, "u", ""), (563, 0, "u", ""),
        (2**62, 0, "user", "far"), (2**62 + 1, 3, "user", "far"),
    ]
    return given + same + odd


def test_trie(spark):
    ship_package(spark)
    given = talk()
    found = prefix_trie.trie(conversation_table(spark, given))
    assert found.columns == prefix_trie.RESULTS
    assert ordered(rows(found)) == trie(given)
    assert prefix_trie.trie(conversation_table(spark, [])).count() == 0
    assert prefix_trie.trie(conversation_table(spark, [(None, 1, "a", "b")])).count() == 0


def test_trie_matches_sql(spark):
    ship_package(spark)
    given = [g for g in talk() if g[1] is not None and g[2] and g[0] is not None and g[0] < 2**60]
    con = duckdb.connect()
    con.execute("create table talk (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into talk values (?, ?, ?, ?)", given)
    sql = PREFIX_TRIE.format(conversations="talk") + "select * from x"
    assert ordered(rows(prefix_trie.trie(conversation_table(spark, given)))) == ordered(con.execute(sql).fetchall())


def test_trie_of_long_conversations(spark):
    """Most rows in a few conversations: rounds follow branches, not turns."""
    ship_package(spark)
    given = [(c, t, "user", f"turn {t} words") for c in (1, 2, 3, 40) for t in range(1500 if c < 40 else 2600)]
    given += [(c, t, "user", f"turn {t} words" if t < 3 else f"own {c}") for c in range(41, 60) for t in range(5)]
    found = prefix_trie.trie(conversation_table(spark, given))
    assert ordered(rows(found)) == trie(given)


def test_running_values_cross_tasks(spark):
    ship_package(spark)
    given = spark.createDataFrame([(k // 700, k, k * 7919 % 1000 - 500) for k in range(2000)], "key long, at long, v long")
    found = prefix_trie._running(prefix_trie._in_order(given, "key", "at"), "key", ["at"], ["v"])
    sums, xors = {}, {}
    for key, at, v, run_at, run_v in sorted(rows(found)):
        sums[key], xors[key] = sums.get(key, 0) + at, xors.get(key, 0) ^ v
        assert (run_at, run_v) == (sums[key], xors[key])
