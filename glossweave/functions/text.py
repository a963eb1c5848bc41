"""Column rules for normalising words and reading the `_italic_` markup."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave.constants import WS

ACUTE = "´"


@lru_cache(maxsize=1)
def mark_table() -> tuple[str, str]:
    """(accented, base) characters: every BMP character whose canonical
    decomposition is one base character followed only by non-spacing marks."""
    accented, base = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        char = chr(code)
        if not unicodedata.decomposition(char) or 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", char)
        head, tail = parts[0], parts[1:]
        if tail and all(unicodedata.category(m) == "Mn" for m in tail):
            accented.append(char)
            base.append(head)
    return "".join(accented), "".join(base)


def trim_ws(c: Column) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def trim_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def base_letters(c: Column) -> Column:
    """Accented letters replaced by their base letters, loose marks removed."""
    accented, base = mark_table()
    return F.regexp_replace(F.translate(c, accented, base), r"\p{Mn}", "")


def strip_marks(c: Column) -> Column:
    return F.replace(base_letters(c), F.lit(ACUTE), F.lit(""))


def printable(c: Column) -> Column:
    return F.translate(c, "[]", "")


def printable_normalised(c: Column) -> Column:
    return F.lower(printable(strip_marks(c)))


def vector_key(c: Column) -> Column:
    """Search key: lower case, no marks, only a-z and space. Not trimmed."""
    accented, base = mark_table()
    return F.regexp_replace(F.translate(F.lower(c), accented, base), "[^a-z ]", "")


def simple_upper(letter: Column) -> Column:
    """Upper case of one letter, unless that takes two letters (as for ß)."""
    upper = F.upper(letter)
    return F.when(F.length(upper) == 1, upper).otherwise(letter)


def capitalise(c: Column) -> Column:
    """Upper-case the first letter; initial u is printed V, initial U V`."""
    first, rest = F.substring(c, 1, 1), F.substr(c, F.lit(2))
    return (
        F.when(first == "u", F.concat(F.lit("V"), rest))
        .when(first == "U", F.concat(F.lit("V`"), rest))
        .otherwise(F.concat(simple_upper(first), rest))
    )


def markup_runs(definition: Column) -> Column:
    """ARRAY<STRUCT<run_no, text, italic>>: text between underscores, with the
    empty pieces removed; even runs are italic."""
    pieces = F.filter(F.split(definition, "_"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x, i: F.struct(
            i.alias("run_no"), x.alias("text"), (i % 2 == 0).alias("italic")
        ),
    )


def italic_toggle(definition: Column) -> Column:
    """Each underscore opens or closes <i>; an open one is closed at the end."""
    pieces = F.split(definition, "_")
    tagged = F.transform(
        pieces,
        lambda x, i: F.concat(
            F.when(i == 0, "").when(i % 2 == 1, "<i>").otherwise("</i>"), x
        ),
    )
    closing = F.when(F.size(pieces) % 2 == 0, "</i>").otherwise("")
    return F.concat(F.array_join(tagged, ""), closing)


SUPERSCRIPT = r"\^([^ ,.]*)"


def superscripts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(SUPERSCRIPT), F.lit(1))


def superscript_tags(c: Column) -> Column:
    return F.regexp_replace(c, SUPERSCRIPT, "<sup>$1</sup>")


def html_brackets(c: Column) -> Column:
    return F.replace(
        F.replace(c, F.lit("["), F.lit("<em>")), F.lit("]"), F.lit("</em>")
    )


def decode_term(c: Column) -> Column:
    """URL-decoded search term; blank or undecodable text gives NULL."""
    return F.when(trim_ws(c) != "", F.try_url_decode(c))


def sparse_text(vector: Column) -> Column:
    """`[{i: v}, ...]` for the positive components in index order."""
    positive = F.filter(
        F.transform(vector, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull()
    )

    def number(v: Column) -> Column:
        whole = v == F.floor(v)
        return F.when(whole, v.cast("bigint").cast("string")).otherwise(
            v.cast("string")
        )

    text = F.transform(
        positive,
        lambda i: F.concat(
            F.lit("{"), i.cast("string"), F.lit(": "), number(F.get(vector, i)), F.lit("}")
        ),
    )
    return F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]"))
