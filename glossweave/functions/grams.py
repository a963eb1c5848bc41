"""Character unigrams and bigrams of a key, as column expressions.

A key holds only a-z and space, so `^` and `$` serve as start and end markers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "^", "$"


def _padded(key: Column, markers: bool) -> Column:
    return F.concat(F.lit(START), key, F.lit(END)) if markers else key


def bigrams(key: Column, markers: bool = True) -> Column:
    text = _padded(key, markers)
    return F.when(
        F.length(text) > 1,
        F.transform(
            F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2))
        ),
    ).otherwise(F.array().cast("array<string>"))


def char_grams(key: Column, markers: bool = True) -> Column:
    """ARRAY<STRING> of all unigrams and bigrams; an empty key has none."""
    unigrams = F.split(_padded(key, markers), "")
    return F.when(key == "", F.array().cast("array<string>")).otherwise(
        F.concat(unigrams, bigrams(key, markers))
    )


def gram_counts(key: Column, markers: bool = True) -> Column:
    """ARRAY<STRUCT<gram, tf>> in gram order, counted inside the row: sort, find
    where each run of equal grams starts, take the distances."""

    def count(sorted_grams: Column) -> Column:
        starts = F.filter(
            F.transform(
                sorted_grams,
                lambda g, i: F.when(
                    (i == 0) | (g != F.get(sorted_grams, i - 1)), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.element_at(
            F.transform(
                F.array(starts),
                lambda s: F.transform(
                    s,
                    lambda at, j: F.struct(
                        F.get(sorted_grams, at).alias("gram"),
                        (
                            F.coalesce(F.get(s, j + 1), F.size(sorted_grams)) - at
                        ).alias("tf"),
                    ),
                ),
            ),
            1,
        )

    grams = F.array_sort(char_grams(key, markers))
    return F.element_at(F.transform(F.array(grams), count), 1)


def signature(key: Column) -> Column:
    """Text that is equal for two keys exactly when their vectors are equal:
    with markers, the sorted bigrams fix all unigram counts too."""
    return F.array_join(F.array_sort(bigrams(key)), "")
