"""Column rules that turn one entry block into headword, definition and
references. Positions are 1-based; 0 means "not found"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave import constants as K
from glossweave.functions.text import capitalise, trim_chars, trim_ws


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_definition_line(line: Column) -> Column:
    """Does this line begin (or continue) a dictionary entry?"""
    return any_of(
        [line.contains(s) for s in K.MARK_SUBSTRINGS]
        + [line.startswith(p) for p in K.MARK_PREFIXES]
    )


def is_group(block: Column) -> Column:
    return block.contains("}")


def last_position(text: Column, piece: Column) -> Column:
    """1-based start of the last occurrence of `piece`, 0 if there is none."""
    back = F.position(F.reverse(piece), F.reverse(text))
    return F.when(
        back > 0, F.length(text) - back - F.length(piece) + 2
    ).otherwise(F.lit(0))


def split_position(block: Column) -> Column:
    """Where the definition starts inside the block."""
    comma_mark = F.instr(block, ", _")
    spaced_or = F.instr(block, " _or_ ")
    forms_with_or = (spaced_or > 0) & (comma_mark > 0) & (spaced_or < comma_mark)
    irregular = any_of([block.startswith(p) for p in K.LAST_OR_PREFIXES]) | (
        block.startswith(K.LAST_OR_PREFIX_WITH_COMMA_OR) & block.contains(", _or_ ")
    )
    last_or = last_position(block, F.lit("_or_"))
    after_last_or = F.when(
        last_or > 0, F.position(F.lit(", _"), block, last_or)
    ).otherwise(F.lit(0))
    return (
        F.when(
            block.startswith(K.COMMA_SPLIT_PREFIX) & ~block.contains("_"),
            F.instr(block, ","),
        )
        .when(
            forms_with_or | irregular,
            F.when(block.startswith(K.FIRST_MARK_PREFIX), comma_mark).otherwise(
                after_last_or
            ),
        )
        .otherwise(F.instr(block, "_"))
    )


def clean_headword(word: Column) -> Column:
    return reduce(
        lambda c, fix: F.replace(c, F.lit(fix[0]), F.lit(fix[1])),
        K.HEADWORD_FIXES,
        word,
    )


def headword_at(block: Column, position: Column) -> Column:
    left = F.substr(block, F.lit(1), position - 1)
    return clean_headword(trim_chars(left, ",; "))


def definition_at(block: Column, position: Column) -> Column:
    return trim_chars(F.substr(block, position), ", ")


def is_idem(definition: Column) -> Column:
    return definition.startswith("_idem")


def resolve_definition(definition: Column, previous: Column) -> Column:
    """Put the previous definition in place of every `_idem`."""
    filled = F.replace(definition, F.lit("_idem"), F.coalesce(previous, F.lit("")))
    single = F.replace(filled, F.lit("__"), F.lit("_"))
    return F.replace(single, F.lit("._._"), F.lit("._"))


def references_of_part(part: Column) -> Column:
    """Referenced words named in one roman-type part of a definition."""
    p = trim_chars(part, ",.")
    spaces = F.regexp_count(p, F.lit(" "))
    commas = F.regexp_count(p, F.lit(","))
    first_space, first_dot = F.instr(p, " "), F.instr(p, ".")
    listed = (F.instr(p, ",") > 1) & (
        (spaces == commas) | p.startswith(K.LIST_PREFIX)
    )
    sentences = (first_dot > 0) & ~p.endswith(".") & (first_space > first_dot)
    pieces_of_list = F.transform(
        F.filter(
            F.transform(F.split(part, "[,.]"), trim_ws),
            lambda x: (x != "") & ~x.startswith("&c"),
        ),
        lambda x: capitalise(trim_chars(x, " ,:;.")),
    )
    pieces_of_sentences = F.transform(
        F.filter(F.transform(F.split(p, r"\."), trim_ws), lambda x: x != ""),
        lambda x: trim_chars(x, " ,"),
    )
    single = F.array(trim_chars(F.regexp_replace(p, "(?i)&c", ""), " ,:;."))
    return F.when(listed, pieces_of_list).when(sentences, pieces_of_sentences).otherwise(
        single
    )


def extract_references(definition: Column) -> Column:
    """ARRAY<STRING> of the words a definition refers to, in text order,
    repeats included. Empty pieces are removed before odd/even is decided."""
    parts = F.filter(F.transform(F.split(definition, "_"), trim_ws), lambda x: x != "")
    roman = F.filter(
        parts,
        lambda x, i: (i % 2 == 1) & ~F.lower(x).startswith(K.ALPHABET_LISTING),
    )
    # one italic run, the usual case, needs no array work
    one_run = definition.rlike("^_?[^_]*_?$")
    return F.when(one_run, F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(roman, references_of_part))
    )


# --- brace groups ----------------------------------------------------------


def group_lines(block: Column) -> Column:
    return F.filter(
        F.transform(F.split(block, r"[\r\n]+"), trim_ws),
        lambda x: (x != "") & (x != "}"),
    )


def group_headword_lines(block: Column) -> Column:
    return F.filter(group_lines(block), lambda x: ~x.startswith("}"))


def group_headwords(block: Column) -> Column:
    return F.transform(
        group_headword_lines(block), lambda x: F.substring_index(x, ".", 1)
    )


def group_definition(block: Column) -> Column:
    """The definition shared by all headwords left of the brace."""
    right = F.transform(
        group_lines(block),
        lambda x: F.when(
            x.contains("}"), trim_ws(F.substr(x, F.position(F.lit("}"), x) + 1))
        ).otherwise(x),
    )
    text = trim_ws(F.array_join(F.filter(right, lambda x: x != ""), " "))
    return F.when(text.startswith("_"), text).otherwise(
        F.concat(F.lit("_"), text, F.lit("_"))
    )


def reject_reason(block: Column) -> Column:
    """Why a block gives no entry; NULL for a good block."""
    position = split_position(block)
    heads = group_headword_lines(block)
    return (
        F.when(
            is_group(block),
            F.when(F.exists(heads, lambda x: ~x.contains(".")), "group_no_dot").when(
                group_definition(block) == "__", "group_no_definition"
            ),
        )
        .when(position == 0, "no_split")
        .when(headword_at(block, position) == "", "empty_word")
    )
