"""Character n-gram vectors of distinct keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions.grams import char_grams, gram_counts
from glossweave.functions.text import sparse_text, vector_key
from glossweave.operators.kernel import DIMS, gram_index, gram_matrix
from glossweave.session import spread


def distinct_keys(entries: DataFrame, word_col: str = "word") -> DataFrame:
    """(key): distinct search keys, counted down inside each task first."""
    return entries.select(vector_key(F.col(word_col)).alias("key")).distinct()


def term_frequencies(keys: DataFrame, markers: bool = True) -> DataFrame:
    """(key, gram, tf, norm2) of distinct keys. Each key is one row, so its
    grams are counted in place and nothing is shuffled."""
    counted = keys.select("key", gram_counts(F.col("key"), markers).alias("grams"))
    norm2 = F.aggregate(
        "grams", F.lit(0).cast("bigint"), lambda s, g: s + g["tf"] * g["tf"]
    )
    # outer: a plain inline would add a filter that counts the grams again
    rows = counted.select("key", norm2.alias("norm2"), F.inline_outer("grams"))
    return rows.where(F.col("gram").isNotNull()).select(
        "key", "gram", F.col("tf").cast("bigint").alias("tf"), "norm2"
    )


def fit_vocabulary(keys: DataFrame, markers: bool = True) -> DataFrame:
    """(gram, idx): the grams seen in the keys, numbered in gram order. At most
    29 + 29 * 29 distinct grams exist, so one small ordered list is enough."""
    grams = keys.select(
        F.explode(char_grams(F.col("key"), markers)).alias("gram")
    ).distinct()
    listed = grams.agg(F.array_sort(F.collect_list("gram")).alias("grams"))
    return listed.select(F.posexplode("grams").alias("idx", "gram")).select(
        "gram", "idx"
    )


def model_card(keys: DataFrame) -> DataFrame:
    """One row: number_of_vectors (distinct keys) and vector_size (grams)."""
    # one row more for each key, under a name that no gram has
    grams = F.explode(F.concat(F.array(F.lit("")), F.array_distinct(char_grams(F.col("key")))))
    counted = keys.select("key").distinct().select(grams.alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    own = F.col("gram") == ""
    return counted.agg(
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("number_of_vectors"),
        F.count(F.when(~own, 1)).alias("vector_size"),
    )


def dense_vectors(keys: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, vector ARRAY<FLOAT>) over the vocabulary's index order; grams
    outside the vocabulary count for nothing. The vocabulary, bounded by the
    alphabet, is read once and travels with the tasks."""
    grams = [r.gram for r in vocabulary.orderBy("idx").limit(DIMS + 1).collect()]
    if len(grams) > DIMS:
        raise ValueError(f"a vocabulary has at most {DIMS} grams")
    columns = np.array([gram_index(g) for g in grams], dtype=np.int64)

    def to_vectors(batches):
        for batch in batches:
            texts = batch.column("key").to_pylist()
            for at in range(0, len(texts), 2048):
                part = texts[at : at + 2048]
                matrix = gram_matrix(part)[:, columns]
                flat = pa.array(matrix.reshape(-1), type=pa.float32())
                offsets = pa.array(
                    np.arange(len(part) + 1, dtype=np.int32) * len(columns)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, type=pa.string()),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    names=["key", "vector"],
                )

    return spread(keys.select("key"), "key").mapInArrow(to_vectors, "key string, vector array<float>")


def vector_once_per_key(
    entries: DataFrame, vocabulary: DataFrame, word_col: str = "word"
) -> DataFrame:
    """Entries with their vector: computed once per distinct key, joined back.
    A key shared by very many entries makes a skewed join, which adaptive
    execution splits."""
    keyed = entries.withColumn("key", vector_key(F.col(word_col)))
    vectors = dense_vectors(keyed.select("key").distinct(), vocabulary)
    return keyed.join(vectors, "key")


def vector_report(vectors: DataFrame) -> DataFrame:
    """(key, sparse): readable form of each vector's positive components."""
    return vectors.select("key", sparse_text(F.col("vector")).alias("sparse"))


def sample_nonzero_check(
    vectors: DataFrame, n: int = 25, seed: int = 17
) -> DataFrame:
    """One row: of a seeded random sample of `n` vectors, how many have a
    positive component, and how many vectors of the whole table have none."""
    positive = F.exists("vector", lambda x: x > 0)
    sample = vectors.orderBy(F.rand(seed)).limit(n)
    return sample.agg(
        F.count("*").alias("sampled"),
        F.count(F.when(positive, 1)).alias("sampled_nonzero"),
    ).crossJoin(
        vectors.agg(
            F.count("*").alias("vectors"),
            F.count(F.when(~positive, 1)).alias("zero_vectors"),
        )
    )
