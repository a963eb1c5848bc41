"""Runs of idem entries against a sequential reading."""

import random

import pytest
from pyspark.sql import functions as F

from glossweave.operators import parse as P

SCHEMA = "doc_id bigint, block_no bigint, word_raw string, definition string, references array<string>"


def read_in_order(entries):
    """Each entry after the one before it."""
    out, before = [], {}
    for doc, block, word, definition, refs in sorted(entries, key=lambda e: (str(e[0]), e[1])):
        last_word, last_definition, last_refs = before.get(doc, (None, None, None))
        if definition.startswith("_idem"):
            filled = definition.replace("_idem", last_definition or "")
            definition = filled.replace("__", "_").replace("._._", "._")
            refs = [last_word, *(last_refs or [])]
        before[doc] = word, definition, refs
        out.append((doc, block, word, definition, refs))
    return out


def resolved(spark, entries, **kw):
    df = spark.createDataFrame(entries, SCHEMA).repartition(5)
    rows = P.resolve_idem(df, **kw).collect()
    return sorted((tuple(r) for r in rows), key=lambda e: (str(e[0]), e[1]))


def some_entries(seed, docs=6, longest=40):
    rng = random.Random(seed)
    tails = ["._", "_", "__", ", also z._", "._ _as_ Q.", "_" * 9, "._._._._", "._" * 40 + "_", " x_._y", "", "__._", ". "]
    out = []
    for doc in [*range(docs), None]:
        block = 0
        for _ in range(rng.randint(1, 3)):
            base = rng.choice(["_base._", "_a__b", "plain", "_x_, _idem._", "_" * 21, ""])
            if rng.random() < 0.8:
                out.append((doc, block, f"w{block}", base, rng.choice([None, [], ["r", "s"]])))
                block += rng.randint(1, 3)
            for k in range(rng.choice([0, 1, 3, longest])):
                again = " or _idem" if rng.random() < 0.06 and k < 60 else ""
                out.append((doc, block, f"w{block}", f"_idem{again}{rng.choice(tails)}", ["own"]))
                block += rng.randint(1, 3)
    return out


@pytest.mark.parametrize("seed, chunk, piece", [(1, 7, 2), (2, 1 << 16, 64), (3, 13, 5)])
def test_runs_equal_the_sequential_reading(spark, seed, chunk, piece):
    entries = some_entries(seed, longest=40 if piece < 64 else 150)
    assert resolved(spark, entries, chunk=chunk, piece=piece) == read_in_order(entries)


def test_a_run_of_20000_is_spread(spark):
    """Most entries are one run: it is resolved piece by piece, by many tasks."""
    n = 20_000
    run = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"),
        F.col("id").alias("block_no"),
        F.concat(F.lit("w"), F.col("id")).alias("word_raw"),
        F.when(F.col("id") == 0, "_base._").when(F.col("id") % 5000 == 7, "_idem, also_").otherwise("_idem._").alias("definition"),
        F.array().cast("array<string>").alias("references"),
    )
    found = P.resolve_idem(run, chunk=1000)
    tasks = found.withColumn("task", F.spark_partition_id())
    checked = tasks.select(
        "task", "block_no", F.length("definition").alias("size"), F.size("references").alias("n"),
        F.element_at("references", 1).alias("first"),
        F.when(F.size("references") > 0, F.element_at("references", -1)).alias("last"), "definition",
    )
    rows = sorted(checked.where("block_no > 0").collect(), key=lambda r: r.block_no)
    assert len(rows) == n - 1 and len({r.task for r in rows}) > 1
    definition = "_base._"
    for k, r in enumerate(rows, 1):
        tail = ", also_" if k % 5000 == 7 else "._"
        definition = (definition + tail).replace("__", "_").replace("._._", "._")
        assert (r.block_no, r.n, r.first, r.last, r.definition) == (k, k, f"w{k - 1}", "w0", definition)


def test_no_entries(spark):
    assert resolved(spark, []) == []
    alone = [(1, 0, "a", "_x_", ["r"]), (1, 1, "b", "_y_", [])]
    assert resolved(spark, alone) == alone
