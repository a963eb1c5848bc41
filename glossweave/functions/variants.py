"""Inflected forms of a headword list, as one Spark SQL array expression.

`variants(column)` reads "headword, suffix, suffix" left to right. Each later
token becomes an action: add a form, or stop with another reading of the whole
list. The first stopping action decides; without one the added forms stand.

The expression is written as SQL text: it is large, and parsing it once in the
JVM is far cheaper than building it call by call from Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave import constants as K
from glossweave.functions.text import mark_table

# Marks a matched position; cannot occur in a headword.
HIT = r"'\u0001'"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to `value`, so that value is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, r'^[{K.WS}]+|[{K.WS}]+$', '')"


def _last(text: str, piece: str) -> str:
    """1-based position of the last occurrence, 0 without one."""
    back = f"position(reverse({piece}), reverse({text}))"
    return f"if({back} > 0, length({text}) - {back} - length({piece}) + 2, 0)"


def _base(x: str) -> str:
    accented, base = mark_table()
    return f"translate({x}, {_quoted(accented)}, {_quoted(base)})"


def _capital(x: str) -> str:
    return (
        f"CASE WHEN startswith({x}, 'u') THEN concat('V', substring({x}, 2))"
        f" WHEN startswith({x}, 'U') THEN concat('V`', substring({x}, 2))"
        f" WHEN length(upper(left({x}, 1))) > 1 THEN {x}"
        f" ELSE concat(upper(left({x}, 1)), substring({x}, 2)) END"
    )


def _letters_like(first: str) -> str:
    """The letters that a suffix's first letter may stand on in the headword:
    itself, u and v in place of each other, and its base letter."""
    return _let(
        "b",
        _base(first),
        f"concat({first}, CASE WHEN b = 'u' THEN if(b = {first}, 'vú', 'v')"
        f" WHEN b = 'v' THEN 'u' ELSE '' END, if(b = {first}, '', b))",
    )


def char_variants(c: str) -> Column:
    return F.expr(_letters_like(c))


def _tokens(raw: str) -> str:
    return (
        f"filter(transform(split({raw}, r'{K.FORM_SEPARATORS}'), t -> {_trim('t')}),"
        " t -> t <> '')"
    )


def _matches(word: str, token: str) -> str:
    """Where the token's first letter stands in the headword: first and last."""
    return _let(
        "v",
        f"named_struct('text', {token}, 'low', lower({token}), 'on', lower({word}))",
        _let(
            "letters",
            _letters_like("left(v.low, 1)"),
            _let(
                "hits",
                f"translate(v.on, letters, repeat({HIT}, length(letters)))",
                "named_struct('text', v.text, 'low', v.low, 'on', v.on,"
                f" 'first', position({HIT}, hits), 'last', {_last('hits', HIT)})",
            ),
        ),
    )


def _longest_prefix_at(m: str) -> str:
    """Last position in the headword of the longest beginning of the suffix
    that occurs there, no longer than the range of its first letter."""
    lengths = f"sequence(least(length({m}.text), {m}.last - {m}.first), 1, -1)"
    found = f"filter({lengths}, z -> contains({m}.on, left({m}.low, z)))"
    return _let(
        "z",
        f"get({found}, 0)",
        f"if(z IS NULL, 0, {_last(f'{m}.on', f'left({m}.low, z)')})",
    )


def _action(word: str, raw: str, m: str, compound: bool) -> str:
    """STRUCT<stop, form>: the reading of one token."""
    initial = f"if({m}.first = 1 AND {m}.last = 1 AND startswith({word}, '{K.ACUTE_V_PREFIX}'), 2, 1)"
    stop = (
        f"if(startswith({raw}, '{K.COMPOUND_PREFIX}'), 'compound', 'capitals')"
        if compound
        else "'capitals'"
    )
    joined = (
        f"CASE WHEN p = 0 THEN NULL"
        f" WHEN p = 1 THEN concat(left({word}, {initial}), substring({m}.text, 2))"
        f" ELSE concat(left({word}, p - 1), {m}.text) END"
    )
    place = f"if({m}.first = {m}.last, {m}.first, {_longest_prefix_at(m)})"
    return (
        "CASE"
        rf" WHEN {m}.text RLIKE r'^\p{{Lu}}' THEN struct(CAST(NULL AS STRING) AS stop, {m}.text AS form)"
        f" WHEN {m}.text RLIKE '[ .]' THEN struct('raw' AS stop, CAST(NULL AS STRING) AS form)"
        f" WHEN {m}.first = 0 THEN struct({stop} AS stop, CAST(NULL AS STRING) AS form)"
        f" ELSE struct(CAST(NULL AS STRING) AS stop, {_let('p', place, joined)} AS form) END"
    )


def _forms(raw: str, depth: int = 0) -> str:
    r, a, s = f"r{depth}", f"a{depth}", f"s{depth}"
    word = f"{r}.tokens[0]"
    actions = (
        f"transform(transform(slice({r}.tokens, 2, size({r}.tokens)),"
        f" t -> {_matches(word, 't')}), m -> {_action(word, f'{r}.raw', 'm', depth == 0)})"
    )
    compound = (
        f"WHEN {s} = 'compound' THEN {_compound_forms(r)} " if depth == 0 else ""
    )
    read = _let(
        a,
        actions,
        _let(
            s,
            f"get(filter({a}, x -> x.stop IS NOT NULL), 0).stop",
            f"CASE WHEN {s} = 'raw' THEN array({r}.raw)"
            f" WHEN {s} = 'capitals' THEN transform({r}.tokens, t -> {_capital('t')}) "
            f"{compound}"
            f"ELSE concat(slice({r}.tokens, 1, 1), filter(transform({a}, x -> x.form),"
            " x -> x IS NOT NULL)) END",
        ),
    )
    return _let(
        r,
        f"named_struct('raw', {raw}, 'tokens', {_tokens(raw)})",
        f"CASE WHEN size({r}.tokens) = 0 THEN array({r}.raw)"
        f" WHEN size({r}.tokens) = 1 THEN {r}.tokens ELSE {read} END",
    )


def _compound_forms(r: str) -> str:
    """Forms of a verb compounded with the fixed prefix: read the list without
    the prefix, give each form the casing it has in the list, put it back."""
    inner = rf"regexp_replace({r}.raw, r'(?i)s\[o\]pra', '')"
    same = f"get(filter({r}.tokens, t -> lower({_capital('t')}) = lower(form)), 0)"
    cased = (
        f"if(contains(lower({r}.raw), lower(form)),"
        f" substring({r}.raw, position(lower(form), lower({r}.raw)), length(form)),"
        f" coalesce({same}, form))"
    )
    return (
        f"transform({_forms(inner, 1)},"
        f" form -> concat('{K.COMPOUND_PREFIX}', btrim({cased}, 'a')))"
    )


def variants(column: str) -> Column:
    """ARRAY<STRING> of the forms a raw headword column stands for, in order."""
    unsplit = ", ".join(_quoted(w) for w in K.UNSPLIT_HEADWORDS)
    return F.expr(
        f"CASE WHEN contains({column}, '&') OR {column} IN ({unsplit})"
        f" THEN array({column})"
        f" WHEN NOT {column} RLIKE r'{K.FORM_SEPARATORS}' THEN array({_trim(column)})"
        f" ELSE {_forms(column)} END"
    )
