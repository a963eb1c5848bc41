import random

import golden
import pytest
from pyspark.sql import functions as F

from glossweave.operators import parse as P
from glossweave.operators import segment as S
from glossweave.plans.lexicon import ORDER_COLUMNS, parse_lexicon, parse_lexicon_lines
from glossweave.sources.lines import lines_from_table, read_lines, read_texts

TEXTS = golden.SHORT_TEXTS + [(golden.LONG_TEXT, golden.LONG_ENTRIES)]


def texts_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def entries_by_doc(df, n):
    got = [[] for _ in range(n)]
    for r in df.orderBy(*ORDER_COLUMNS).collect():
        got[r.doc_id].append((r.word, r.definition, r.referenced_words))
    return got


@pytest.mark.parametrize("chunk", [None, 3, 1 << 16])
def test_golden_texts(spark, chunk):
    texts = texts_df(spark, [t for t, _ in TEXTS])
    if chunk is None:
        entries = parse_lexicon(texts)
    else:
        entries = parse_lexicon_lines(lines_from_table(texts), chunk)
    assert entries_by_doc(entries, len(TEXTS)) == [list(e) for _, e in TEXTS]


def test_golden_has_29_blocks(spark):
    texts = texts_df(spark, [golden.LONG_TEXT])
    assert S.blocks_of_texts(texts).count() == 29
    assert S.entry_blocks(lines_from_table(texts), 5).count() == 29


def test_whole_text_route_has_no_shuffle(spark):
    texts = texts_df(spark, [golden.LONG_TEXT])
    plan = parse_lexicon(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


IDEM = """A

Basẻ, _base._

Primo, _idem, also z._

Second, _idem._ _as_ Q.

  Gr[o]up.  } _shared._

_note without headword_

Third, _idem._

Other, _plain._

Again, _idem._
"""


@pytest.mark.parametrize("chunk", [None, 2, 1000])
def test_idem_chains(spark, chunk):
    texts = texts_df(spark, [IDEM])
    if chunk is None:
        entries = parse_lexicon(texts)
    else:
        entries = parse_lexicon_lines(lines_from_table(texts), chunk)
    assert entries_by_doc(entries, 1)[0] == [
        ("Basẻ", "_base._", []),
        ("Primo", "_base._, also z._", ["Basẻ"]),
        ("Second", "_base._, also z._ _as_ Q.", ["Primo", "Basẻ"]),
        ("Gr[o]up", "_shared._", []),
        ("Third", "_base._, also z._ _as_ Q.._", ["Second", "Primo", "Basẻ"]),
        ("Other", "_plain._", []),
        ("Again", "_plain._", ["Other"]),
    ]


def test_rejects(spark):
    texts = texts_df(
        spark,
        ["A\n\n_note_ AV, _x_\n\nno dot } _d_\n\n  w. }\n\nVliuígn[o] rest"],
    )
    rows = P.rejected_blocks(S.blocks_of_texts(texts)).collect()
    assert sorted((r.block_no, r.reject_reason) for r in rows) == [
        (0, "empty_word"),
        (1, "group_no_dot"),
        (2, "group_no_definition"),
        (3, "no_split"),
    ]
    assert parse_lexicon(texts).count() == 0


# --- segmentation against a sequential model -------------------------------


def model_blocks(lines):
    """Plain sequential reading of the block rules, as an independent check."""
    out, block, started, inside = [], "", False, False
    for line in lines:
        if line.strip() == "FINIS.":
            break
        if not started:
            started = line.isascii() and line.isalpha() and line.isupper()
            continue
        if not line.strip():
            if inside:
                out.append(block.strip())
            block, inside = "", False
            continue
        marked = " _" in line or ",_" in line or "}" in line
        inside = inside or marked
        if inside:
            block += line + "\n" if "}" in line else " " + line.strip()
    if block:
        out.append(block.strip())
    return out


LINE_KINDS = [
    "", "  ", "\t", "A", "AB", "A ", "word, _def._", " x,_y_ ", "plain text",
    "  w.  }", "     } more", "FINIS.", "  tail words  ", "Abc, _idem._",
]


def test_both_routes_equal_the_sequential_model(spark):
    rng = random.Random(7)
    docs = []
    for _ in range(150):
        n = rng.randint(0, 30)
        lines = rng.choices(LINE_KINDS, weights=[8] * 3 + [3] * 2 + [1] + [8] * 5 + [0.5] + [8] * 2, k=n)
        docs.append(lines)
    expected = [model_blocks(lines) for lines in docs]
    texts = texts_df(spark, ["\n".join(lines) for lines in docs])
    for blocks in (
        S.blocks_of_texts(texts),
        S.entry_blocks(lines_from_table(texts), 4),
        S.entry_blocks(lines_from_table(texts).repartition(5), 1000),
    ):
        got = [[] for _ in docs]
        for r in blocks.orderBy("doc_id", "block_no").collect():
            got[r.doc_id].append(r.block)
        assert got == expected
    one = entries_by_doc(parse_lexicon(texts), len(docs))
    two = entries_by_doc(parse_lexicon_lines(lines_from_table(texts), 4), len(docs))
    assert one == two and any(one)


def test_cut_and_skip(spark):
    lines = spark.createDataFrame(
        [(0, i, s) for i, s in enumerate(["x", "A ", "AB", "y", " FINIS. ", "z"])]
        + [(1, 0, "no heading")],
        "doc_id bigint, line_no bigint, line string",
    )
    cut = S.cut_at_end(lines).orderBy("doc_id", "line_no").collect()
    assert [r.line for r in cut] == ["x", "A ", "AB", "y", "no heading"]
    kept = S.skip_to_first_heading(lines).orderBy("line_no").collect()
    assert [r.line for r in kept] == ["y", " FINIS. ", "z"]


def test_read_lines_splits_one_file(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "" for i in range(5000)]
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_text("﻿" + "\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        rows = df.orderBy("doc_id", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line for r in rows] == lines * 2
    assert len({(r.doc_id, r.line_no) for r in rows}) == len(rows)


def test_read_texts_golden(spark, tmp_path):
    (tmp_path / "book.txt").write_bytes(
        ("﻿" + golden.LONG_TEXT.replace("\n", "\r\n")).encode("utf-8")
    )
    for entries in (
        parse_lexicon(read_texts(spark, str(tmp_path))),
        parse_lexicon_lines(read_lines(spark, str(tmp_path)), 64),
    ):
        rows = entries.orderBy(*ORDER_COLUMNS).collect()
        got = [(r.word, r.definition, r.referenced_words) for r in rows]
        assert got == golden.LONG_ENTRIES
