"""Ingest that replaces: repeats, kills, compaction."""

import golden
import pytest
from pyspark.sql import functions as F

from glossweave.operators import versions
from glossweave.plans.lexicon import ORDER_COLUMNS, parse_lexicon
from glossweave.streaming import ingest as N


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, text string")


def stored(spark, path):
    found = N.read_entries(spark, path).select(*ORDER_COLUMNS, "word", "definition")
    return sorted(map(repr, (tuple(r) for r in found.collect())))


def parsed(df):
    return sorted(map(repr, (tuple(r) for r in parse_lexicon(df).select(*ORDER_COLUMNS, "word", "definition").collect())))


SMALL = "A\n\nBase, _one._\n\nOther, _idem._"
LARGER = "A\n\nBase, _two._\n\nOther, _idem._\n\nThird, _x._"


def test_a_text_that_arrives_again_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    assert N.merge_batch(texts(spark, (1, golden.LONG_TEXT), (2, SMALL)), path, "s", 0)
    assert N.merge_batch(texts(spark, (2, LARGER), (3, SMALL), (None, SMALL)), path, "s", 1)
    want = parsed(texts(spark, (1, golden.LONG_TEXT), (2, LARGER), (3, SMALL), (None, SMALL)))
    assert stored(spark, path) == want
    # a batch that repeats is known
    assert not N.merge_batch(texts(spark, (2, SMALL)), path, "s", 1)
    assert stored(spark, path) == want
    # numbers belong to their stream
    assert N.merge_batch(texts(spark, (2, SMALL), (2, SMALL), (None, LARGER)), path, "other", 0)
    want = parsed(texts(spark, (1, golden.LONG_TEXT), (2, SMALL), (3, SMALL), (None, LARGER)))
    assert stored(spark, path) == want
    N.compact(spark, path)
    assert stored(spark, path) == want and len(N._manifest(spark, path)[1]["parts"]) == 1


def test_texts_without_entries_and_removed_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    N.merge_batch(texts(spark, (1, SMALL), (2, SMALL)), path, "s", 0)
    N.merge_batch(texts(spark, (1, "nothing here"), (2, None)), path, "s", 1)
    assert stored(spark, path) == []
    N.compact(spark, path)
    assert stored(spark, path) == []
    N.merge_batch(texts(spark), path, "s", 2)
    N.merge_batch(texts(spark, (1, LARGER)), path, "s", 3)
    assert stored(spark, path) == parsed(texts(spark, (1, LARGER)))
    with pytest.raises(FileNotFoundError):
        N.read_entries(spark, str(tmp_path / "none"))


def test_a_killed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    N.merge_batch(texts(spark, (1, SMALL)), path, "s", 0)
    before = stored(spark, path)
    # killed while it writes entries, and just before its manifest
    broken = texts(spark, (1, LARGER)).withColumn("text", F.when(F.lit(True), F.raise_error(F.lit("killed")).cast("string")))
    with pytest.raises(Exception):
        N.merge_batch(broken, path, "s", 1)
    assert stored(spark, path) == before
    with monkeypatch.context() as m:
        m.setattr(versions, "_create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            N.merge_batch(texts(spark, (1, LARGER)), path, "s", 1)
    assert stored(spark, path) == before
    assert N.merge_batch(texts(spark, (1, LARGER)), path, "s", 1)
    assert stored(spark, path) == parsed(texts(spark, (1, LARGER)))


def test_a_merge_during_compaction_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for k in range(3):
        N.merge_batch(texts(spark, (k, SMALL)), path, "s", k)
    commit = N._commit

    def late(*args):
        monkeypatch.setattr(N, "_commit", commit)
        N.merge_batch(texts(spark, (0, LARGER)), path, "s", 3)
        commit(*args)

    monkeypatch.setattr(N, "_commit", late)
    with pytest.raises(RuntimeError):
        N.compact(spark, path)
    want = parsed(texts(spark, (0, LARGER), (1, SMALL), (2, SMALL)))
    assert stored(spark, path) == want
    N.compact(spark, path)
    N.compact(spark, path)
    assert stored(spark, path) == want


def test_a_reader_of_the_parts_before_finishes(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        N.merge_batch(texts(spark, (k, SMALL)), path, "s", k)
    reader = N.read_entries(spark, path)
    N.compact(spark, path)
    assert reader.count() == 8
    N.merge_batch(texts(spark, (9, SMALL)), path, "s", 4)
    # no kept manifest names the four parts: they are gone
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]) == 2


def test_stream(spark, tmp_path):
    arriving = texts(spark, (1, SMALL), (2, LARGER))
    arriving.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(arriving.schema).parquet(str(tmp_path / "in"))

    def run():
        N.stream_merge(source, str(tmp_path / "t"), str(tmp_path / "c"), compact_after=1).awaitTermination(120)

    run()
    texts(spark, (1, LARGER)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert stored(spark, str(tmp_path / "t")) == parsed(texts(spark, (1, LARGER), (2, LARGER)))
    assert len(N._manifest(spark, str(tmp_path / "t"))[1]["parts"]) == 1
