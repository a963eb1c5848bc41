"""Marked-up lexicon text derived from plain documents.

Each source line with a word becomes one entry. Lines of one or two words are
plain; of the others the shape goes by the line number: plain, two forms, idem
with a suffix, cross-reference, brace group. The text of a document is derived
inside its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of a word in the source tables.
WORD_PATTERN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def _capital(word: Column) -> Column:
    # a first letter without a capital of its own stays
    return F.when(word.startswith("ß"), word).otherwise(
        F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))
    )


def _entry(line: Column, i: Column) -> Column:
    def shape(w: Column) -> Column:
        head, second = _capital(F.get(w, F.lit(0))), _capital(F.get(w, F.lit(1)))
        low = F.lower(F.get(w, F.lit(1)))
        body = F.array_join(F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1))), " ")
        rest = F.array_join(F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), " ")
        kind = i % 5
        text = (
            F.when(F.size(w) < 3, F.concat(head, F.lit(", _"), rest, F.lit("._")))
            .when(kind == 0, F.concat(head, F.lit(", _"), second, F.lit(" "), body, F.lit("._")))
            .when(
                kind == 1,
                F.concat(head, F.lit(", "), low, F.lit(", _"), body, F.lit("._")),
            )
            .when(kind == 2, F.concat(head, F.lit(", _idem._ "), second, F.lit(" "), body))
            .when(
                kind == 3,
                F.concat(
                    head, F.lit(", _as_ "), second, F.lit(", _"), body, F.lit("._")
                ),
            )
            .otherwise(
                F.concat(
                    F.lit("  "), head, F.lit(".  }\n  "), second, F.lit(".  } "), body
                )
            )
        )
        return F.when(F.size(w) > 0, text)

    return F.element_at(F.transform(F.array(words_of(line)), shape), 1)


def lexicon_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with front matter, heading, entries, end marker, tail."""
    entries = F.filter(
        F.transform(F.split("text", "\n"), _entry), lambda x: x.isNotNull()
    )
    # exploding a one-element array filters on the entries without computing
    # them twice, as a pushed-down filter would
    kept = F.filter(F.array(entries), lambda e: F.size(e) > 0)
    return documents.select("doc_id", F.explode(kept).alias("entries")).select(
        "doc_id",
        F.concat(
            F.lit("Front, _ignored._\n\nA\n\n"),
            F.array_join("entries", "\n\n"),
            F.lit("\n\n   FINIS.\nAfter, _ignored._"),
        ).alias("text"),
    )
