"""Keeps columns that an operator does not know out of its way."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTRA = "_extra"


def guarded(
    df: DataFrame,
    needed: Sequence[str],
    operation: Callable[[DataFrame], DataFrame],
    results: Sequence[str] = (),
) -> DataFrame:
    """`operation` on the `needed` columns of `df`, all others packed in one, so
    that no name of theirs meets a name used inside. Returns the columns of `df`
    in their order, without those that `results` names, then `results`. Names are
    compared without case, as Spark compares them."""
    known = {c.lower() for c in needed}
    replaced = {c.lower() for c in results}
    extra = {c: f"c{i}" for i, c in enumerate(df.columns) if c.lower() not in known}
    pack = F.struct(*(named(c).alias(inside) for c, inside in extra.items())) if extra else F.lit(None).cast("int")
    out = operation(df.select(*(named(c) for c in dict.fromkeys(needed)), pack.alias(EXTRA)))
    kept = [
        F.col(EXTRA).getField(extra[c]).alias(c) if c in extra else named(c)
        for c in df.columns
        if c.lower() not in replaced
    ]
    return out.select(*kept, *results)


def named(name: str) -> Column:
    quoted = name.replace("`", "``")
    return F.col(f"`{quoted}`")
