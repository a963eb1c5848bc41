"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, at each position, the sum of code point times
base^position modulo a prime, for two bases. From it any span's hash follows in
constant time, so any two spans are compared at once (`spans_equal`), and the
longest common extension of two positions is found by binary search
(`common_extension`).

A fingerprint is the prefix array at block borders: `<chars>:<step>:<hashes>`,
`step` the smallest power of two that leaves at most `BLOCKS` blocks, so borders
of a coarser fingerprint are borders of a finer one. `likeness` finds the runs
of equal aligned blocks by the same binary search and gives their share of the
longer text. Blocks are aligned, so text that is put in or taken out moves all
after it: where the prefix arrays are at hand (`near`), what the texts have in
common from their beginnings on and from their ends back counts as well, wherever
it stands. Equal texts have equal fingerprints and likeness 1; unequal texts
collide with a chance of about 2^-60.

Null and empty texts have the fingerprint of no characters, and are alike among
themselves. Every text is hashed whole. Repeated rows get a row each. Extra
columns stay; a column named like a result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.arrow_text import slices, text_column
from glossweave.session import shuffle_partitions

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_003)
BLOCKS = 64


class Powers:
    """base^i modulo the prime, for as many i as were asked for."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            next_power = int(self.table[-1]) * self.base % PRIME
            self.table = np.concatenate(
                [self.table, self.table * np.uint64(next_power) % np.uint64(PRIME)]
            )
        return self.table[:n]


_POWERS = [Powers(b) for b in BASES]


def _terms(codes: np.ndarray, first: int, powers: Powers) -> np.ndarray:
    """code * base^position, folded below 2^32, so that 2^32 of them add up."""
    x = codes * powers.upto(first + len(codes))[first:]
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class PrefixHashes:
    """The prefix arrays of a text."""

    def __init__(self, codes: np.ndarray, head: PrefixHashes | None = None, keep: int = 0):
        """With `head`, its first `keep` characters and then `codes`."""
        self.n = keep + len(codes)
        self.sums = []
        for k, powers in enumerate(_POWERS):
            before = head.sums[k][: keep + 1] if head else np.zeros(1, np.uint64)
            added = before[-1] + np.cumsum(_terms(codes, keep, powers))
            self.sums.append(np.concatenate([before, added]))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Hash of the characters i..j-1, the same wherever they stand."""
        out = []
        for s, base in zip(self.sums, BASES):
            value = (int(s[j]) - int(s[i])) % PRIME
            out.append(value * pow(base, -i, PRIME) % PRIME)
        return tuple(out)

    def fingerprint(self) -> str:
        step = 1
        while self.n > step * BLOCKS:
            step *= 2
        borders = [*range(step, self.n, step), self.n] if self.n else []
        hashes = "".join(f"{int(s[b]) % PRIME:08x}" for b in borders for s in self.sums)
        return f"{self.n}:{step}:{hashes}"


def spans_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def _longest(limit: int, equal) -> int:
    """The largest length up to `limit` for which `equal` holds, where it holds
    for all shorter ones."""
    low, high = 0, limit
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal(middle) else (low, middle - 1)
    return low


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """How many characters from i in `a` and from j in `b` agree."""
    return _longest(min(a.n - i, b.n - j), lambda n: spans_equal(a, i, b, j, n))


def _parsed(fingerprint: str) -> tuple[int, int, list[tuple[int, int]]]:
    n, step, hashes = fingerprint.split(":")
    pairs = [
        (int(hashes[k : k + 8], 16), int(hashes[k + 8 : k + 16], 16))
        for k in range(0, len(hashes), 16)
    ]
    return int(n), int(step), [(0, 0), *pairs]


def likeness(one: str, other: str) -> float:
    """Share of the longer text that stands in equal aligned blocks, 0 to 1."""
    if one == other:
        return 1.0
    (n, s, a), (m, t, b) = _parsed(one), _parsed(other)
    if not n or not m:
        return 0.0
    step = max(s, t)
    borders = list(range(0, min(n, m), step)) + ([n] if n == m else [])
    pa_, pb = [-(-x // s) for x in borders], [-(-x // t) for x in borders]

    def equal_from(k: int, length: int) -> bool:
        return all(
            (a[pa_[k + length]][h] - a[pa_[k]][h] - b[pb[k + length]][h] + b[pb[k]][h]) % PRIME == 0
            for h in (0, 1)
        )

    k, same = 0, 0
    while k < len(borders) - 1:
        run = _longest(len(borders) - 1 - k, lambda length: equal_from(k, length))
        same += borders[k + run] - borders[k]
        k += run + 1
    return same / max(n, m)


def shared_ends(a: PrefixHashes, b: PrefixHashes) -> float:
    """Share of the longer text that both begin and end with, 0 to 1. The ends are
    compared at different places: their hashes differ by a power of the base."""
    shorter, longer = min(a.n, b.n), max(a.n, b.n)
    if not longer:
        return 1.0
    sums = list(zip(a.sums, b.sums))

    def begin(k: int) -> bool:
        return all((int(x[k]) - int(y[k])) % PRIME == 0 for x, y in sums)

    first = _longest(shorter, begin)
    if first == longer:
        return 1.0
    moved = [pow(base, longer - shorter, PRIME) for base in BASES]
    x_moves, y_moves = (moved, (1, 1)) if a.n < b.n else ((1, 1), moved)

    def end(k: int) -> bool:
        return all(
            ((int(x[a.n]) - int(x[a.n - k])) * p - (int(y[b.n]) - int(y[b.n - k])) * q) % PRIME == 0
            for (x, y), p, q in zip(sums, x_moves, y_moves)
        )

    return (first + _longest(shorter - first, end)) / longer


def near(a: PrefixHashes, one: str, b: PrefixHashes, other: str) -> float:
    """Likeness of two texts by their prefix arrays and fingerprints."""
    return 1.0 if one == other else max(likeness(one, other), shared_ends(a, b))


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_chars and fingerprint: one narrow pass."""

    @F.pandas_udf("n_chars long, fingerprint string")
    def made(texts):
        import pandas as pd

        rows = []
        for value in texts:
            hashes = PrefixHashes(code_points(value or ""))
            rows.append((hashes.n, hashes.fingerprint()))
        return pd.DataFrame(rows, columns=["n_chars", "fingerprint"])

    return (
        docs.withColumn("_made", made(text))
        .withColumns({"n_chars": F.col("_made.n_chars"), "fingerprint": F.col("_made.fingerprint")})
        .drop("_made")
    )


def _in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text) in descending doc_id (ties by text, null last), cut into
    buckets by approximate quantiles of the id. The first document after a
    bucket is in it too, with `border` 1; after the last bucket that is the
    first document of all. Only ids and one number per bucket are looked at
    before the one exchange of texts."""
    cuts = docs.agg(
        F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets)
    ).first()[0]
    cuts = sorted(set(cuts or []))
    if len(cuts):
        above = F.array(*(F.lit(int(c)) for c in cuts))
        bucket: Column = F.coalesce(
            F.size(F.filter(above, lambda c: c > F.col("doc_id"))), F.lit(len(cuts))
        )
        bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(bucket)
    else:
        bucket = F.lit(0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.alias("bucket"))
    firsts = dict(rows.groupBy("bucket").agg(F.max("doc_id")).collect())  # one row per bucket
    held = sorted(firsts)
    before = dict(zip(held, [held[-1:][0], *held[:-1]])) if held else {}
    slots = range(held[-1] + 1 if held else 1)

    def by_bucket(values: list) -> Column:
        return F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket"))

    is_first = F.col("doc_id").eqNullSafe(by_bucket([firsts.get(k) for k in slots]))
    border = F.when(is_first, by_bucket([before.get(k) for k in slots])).cast("int")
    goes_to = F.filter(
        F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("border")),
            F.struct(border.alias("bucket"), F.lit(1).alias("border")),
        ),
        lambda x: x["bucket"].isNotNull(),
    )
    return (
        rows.withColumn("to", F.explode(goes_to))
        .select("doc_id", "text", F.col("to.bucket").alias("bucket"), F.col("to.border").alias("border"))
        .repartition(shuffle_partitions(docs.sparkSession), "bucket")
        .sortWithinPartitions("bucket", "border", F.col("doc_id").desc_nulls_last(), "text")
    )


PAIRS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a sorted partition, holding one document."""
    held = None  # (bucket, border, doc_id, text, hashes, fingerprint)
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("bucket", "border", "doc_id")]
            for bucket, border, doc_id, text in zip(*columns, text_column(part, "text").to_pylist()):
                hashes = PrefixHashes(code_points(text))
                now = (bucket, border, doc_id, text, hashes, hashes.fingerprint())
                if held and held[0] == bucket and not held[1]:
                    rows.append(_pair(held, now))
                held = now
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW
                )


def _pair(this, following) -> tuple:
    _, _, doc_id, text, hashes, fingerprint = this
    cut = hashes.n // 3
    keep = hashes.n - cut
    edited = text[:keep] + following[3][:cut]
    edited_hashes = PrefixHashes(code_points(edited[keep:]), hashes, keep)
    edited_fingerprint = edited_hashes.fingerprint()
    return (
        doc_id,
        hashes.n,
        hashlib.sha256(edited.encode()).hexdigest(),
        fingerprint,
        edited_fingerprint,
        near(hashes, fingerprint, edited_hashes, edited_fingerprint),
        near(hashes, fingerprint, following[4], following[5]),
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document against its edited text (the last third, rounded down,
    replaced by the beginning of the next document) and the next document, in
    descending doc_id; the first follows the last."""
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    return _in_order(docs, buckets).mapInArrow(_compared, PAIRS)
