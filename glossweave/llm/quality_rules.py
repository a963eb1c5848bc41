"""Quality rules: a threshold table compiled into one Spark projection.

`RULES` names a measure and the range in which a text may lie. `judge` computes
the measures with built-in functions only, then one boolean column per rule and
`kept`. No shuffle, no user function.

Words are `[^\\x20\\x09-\\x0D]+`. Base measures: n_words, word_chars, n_symbols,
n_dup_lines (lines with a word, equal to an earlier line) and n_repeat_words
(words inside five-word windows that occur twice or more, the first included).
A window is told by a 64-bit hash of its words, inside its own text only.

Null and empty texts have no words: all counts 0, ratios 0.0, base_failed.
Repeated rows are judged each. Extra columns stay; a column that is named like
a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.columns import guarded

WORD_GAP = r"[ \t-\r]+"
WINDOW = 5

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on with as was by at this are be from or not"
    " der die das und zu den von im des mit ist für dem nicht ein eine auf sich"
    " le la les de et en un une des du que est dans qui pour sur au avec par pas"
    " el los las del y se por con su para una como más o lo"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: Ranges that a good text keeps. Measures are those of `MEASURES`.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("marks", "marks_per_word", high=0.5),
    Rule("stop_words", "stop_word_ratio", 0.03),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def _let(value: Column, body) -> Column:
    """`body(v)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    n = F.size(words)
    windows = F.transform(
        F.slice(words, 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))),
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(
            F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        )
        found = _let(
            ordered,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: F.coalesce(x["v"] == F.get(s, k - 1)["v"], F.lit(False))
                        | F.coalesce(x["v"] == F.get(s, k + 1)["v"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        steps = _let(
            found,
            lambda p: F.transform(
                p,
                lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)),
            ),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


MEASURES = (
    "n_words", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars",
    "n_symbols", "n_marks", "mean_word_chars", "symbols_per_word", "marks_per_word",
    "stop_word_ratio", "dup_line_ratio",
)


def _measured(docs: DataFrame, text_column: str) -> DataFrame:
    """`docs` with all measures."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^ \t-\r]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeated(w).alias("n_repeat_words"),
        )

    def of_lines(s: Column) -> Column:
        return F.struct(
            F.size(s).cast("long").alias("n_lines"),
            (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        )

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))

    counted = docs.withColumns({"_words": _let(words, of_words), "_lines": _let(lines, of_lines)})
    names = ["n_words", "n_stop_words", "n_repeat_words"]
    return (
        counted.withColumns(
            {c: F.col(f"_words.{c}") for c in names}
            | {c: F.col(f"_lines.{c}") for c in ["n_lines", "n_dup_lines"]}
            | {
                "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
                "n_marks": F.regexp_count(text, F.lit("[!?]")).cast("long"),
            }
        )
        .drop("_words", "_lines")
        .withColumns(
            {
                "mean_word_chars": per("word_chars", "n_words"),
                "symbols_per_word": per("n_symbols", "n_words"),
                "marks_per_word": per("n_marks", "n_words"),
                # one more than found: a few words need not have one
                "stop_word_ratio": F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(
                    (F.col("n_stop_words") + 1) / F.col("n_words")
                ),
                "dup_line_ratio": per("n_dup_lines", "n_lines"),
            }
        )
    )


def judge(docs: DataFrame, rules=RULES, text_column: str = "text") -> DataFrame:
    """`docs` with measures, base_failed, one `ok_<rule>` per rule, and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passed = {f"ok_{r.name}": F.col(r.measure).between(r.low, r.high) for r in rules}
    kept = ~base
    for test in passed.values():
        kept = kept & test
    verdicts = {"base_failed": base, **passed, "kept": kept}
    return guarded(
        docs,
        [text_column],
        lambda d: _measured(d, text_column).withColumns(verdicts),
        [*MEASURES, *verdicts],
    )
