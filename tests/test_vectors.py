"""Stored indexes over embeddings: bounds, blocks, graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.operators import embeddings as E
from glossweave.operators import vector_index as X


def clustered(seed=2, centres=12, each=60, dims=16, spread=0.05):
    random = np.random.default_rng(seed)
    middle = random.normal(size=(centres, dims))
    return np.concatenate([c + spread * random.normal(size=(each, dims)) for c in middle])


def item_table(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), "vec_id long, embedding array<double>, label int")


def asked(items):
    return items.select(F.col("vec_id").alias("query_id"), "embedding")


def rows(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select("query_id", "rank", "vec_id", "score", *columns).collect())))


ODD = [
    (9000, [0.0] * 16, 1), (9001, None, 1), (9002, [float("nan")] + [1.0] * 15, 1), (9003, [None] + [1.0] * 15, 1),
    (9004, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1),
]


@pytest.mark.parametrize("shape", ["clustered", "spread", "copies"])
def test_pruned_search_is_exact(spark, tmp_path, shape):
    x = clustered() if shape == "clustered" else np.random.default_rng(1).normal(size=(500, 16))
    if shape == "copies":
        x[:300] = x[0]
    items = item_table(spark, x)
    index = X.write_vector_index(item_table(spark, x, ODD), str(tmp_path / "index"), "label", block_items=40)
    assert index.blocks.agg(F.sum("n")).first()[0] == len(x)
    assert index.blocks.agg(F.max("n")).first()[0] < 120
    for k in (1, 10):
        found = X.pruned_search(asked(items), index, k, query_part=100)
        assert rows(found) == rows(E.vector_search(asked(items), items, k))
    groups = items.select("vec_id", F.col("label").alias("g"))
    found = X.pruned_search(asked(items), index, 3, groups).withColumnRenamed("g", "label")
    assert rows(found, "label") == rows(E.vector_search(asked(items), items, 3, group_col="label"), "label")


def test_search_in_many_slots_and_parts(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(700, 16))
    x[100:260] = x[3]
    items = item_table(spark, x)
    index = X.write_vector_index(item_table(spark, x, ODD), str(tmp_path / "index"), "label", block_items=40)
    assert len(index.summary) > 12
    options = {"sweep_part": 60, "slot_blocks": 3}
    for k in (1, 7):
        assert rows(X.pruned_search(asked(items), index, k, **options)) == rows(E.vector_search(asked(items), items, k))
    groups = items.select("vec_id", F.col("label").alias("g"))
    for k in (2, 6):  # more than there are groups
        found = X.pruned_search(asked(items), index, k, groups, **options).withColumnRenamed("g", "label")
        assert rows(found, "label") == rows(E.vector_search(asked(items), items, k, group_col="label"), "label")


def test_a_query_travels_once_to_a_slot(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(600, 16))
    index = X.write_vector_index(item_table(spark, x), str(tmp_path / "index"), block_items=20)
    queries = asked(item_table(spark, x)).withColumn("floor", F.lit(-2.0))
    met = X._slots_met(queries, index, 8)
    assert len(index.summary) > 24
    assert met.count() == met.select("query_id", "slot").distinct().count() <= len(x) * -(-len(index.summary) // 8)
    # what leaves the tasks: k of a query and slot at most, from the floor on
    found = X._swept(queries, index, 5, False, 200, 8)
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5 * -(-len(index.summary) // 8)
    assert X._swept(queries.withColumn("floor", F.lit(0.99)), index, 5, False, 200, 8).where("score < 0.99").count() == 0


def test_far_blocks_are_not_read(spark, tmp_path):
    x = clustered(each=100)
    items = item_table(spark, x)
    index = X.write_vector_index(items, str(tmp_path / "index"), block_items=50)
    met = X.blocks_met(asked(items), index, 0.9).agg(F.sum("met"), F.sum("blocks")).first()
    assert met[0] < 0.25 * met[1]
    # none that holds an item of that score
    best = E.vector_search(asked(items), items, 300).where("score >= 0.9").count()
    assert best > len(x) * 50
    opposite = items.where("vec_id = 0").select(F.lit(1).alias("query_id"), F.transform("embedding", lambda c: -c).alias("embedding"))
    assert X.blocks_met(opposite, index, 0.99).first().met == 0


def test_empty_and_odd(spark, tmp_path):
    none = X.write_vector_index(item_table(spark, np.zeros((0, 4))), str(tmp_path / "none"), graphs=True)
    q = asked(item_table(spark, np.ones((2, 4))))
    assert X.pruned_search(q, none, 3).count() == 0 and X.graph_search(q, none, 3).count() == 0
    one = X.write_vector_index(item_table(spark, np.ones((1, 16)), ODD), str(tmp_path / "one"), graphs=True)
    for search in (X.pruned_search, X.graph_search):
        found = search(asked(item_table(spark, np.ones((1, 16)), ODD[:5])), one, 3)
        assert [(r.query_id, r.vec_id, r.score) for r in found.collect()] == [(0, 0, 1.0)]


def test_graph_recall_over_parts(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(1500, 24))
    items = item_table(spark, x)
    index = X.write_vector_index(items, str(tmp_path / "index"), block_items=400, graphs=True)
    few = items.where("vec_id % 5 = 0")
    found = X.graph_search(asked(few), index, 10, probes=8)
    share = E.recall(found, E.vector_search(asked(few), items, 10)).first().recall
    assert share >= 0.9
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0


def test_graph_work_grows_slowly():
    opened = []
    for n in (1000, 4000, 16000):
        random = np.random.default_rng(n)
        x = random.normal(size=(n, 12))
        graph = X.Graph.build(np.arange(n), x)
        q = X.unit_rows(random.normal(size=(50, 12)))
        graph.opened = 0
        found, _ = graph.search(q, 10)
        opened.append(graph.opened / 50)
        exact = np.argsort(-(q @ X.unit_rows(x).T), axis=1)[:, :10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, exact)]) >= 0.9
    # sixteen times the items, less than twice the work
    assert opened[2] < 2 * opened[0] and opened[2] < 0.2 * 16000
