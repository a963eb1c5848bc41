"""Quality classifier: random Fourier features over document statistics.

`statistics` reads every text whole, once, and gives a few numbers per document.
They are standardised and mapped to `n_features` random cosines, whose inner
products approximate a Gaussian kernel. Each task adds up its rows' normal
equations, Spark sums them, and one solve of that fixed size gives the ridge
weights. Raw scores of rows left out of the fit are counted per score bin, and
isotonic regression over the bins turns raw scores into probabilities.

Only bounded sums reach the driver: (n_features + 1)^2 numbers and `BINS` rows,
whatever the data. Inputs of a score are the text's statistics alone.

Null and empty texts have zero statistics and a score like any other. Labels
that are null, or of unknown documents, are not used; a label that is repeated
counts again. Without a single label the score is 0.5. Extra columns stay out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.arrow_text import slices, text_column
from glossweave.llm.quality_rules import STOP_WORDS
from glossweave.session import cut_lineage

N_FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-3
BINS = 400
LOW, HIGH = -0.5, 1.5
SEED = 20

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_chars", "word_spread",
    "upper", "digit", "sentence_mark", "shout_mark", "symbol", "space",
    "stop_words", "distinct_words", "adjacent_repeats", "distinct_pairs",
    "capital_words", "distinct_lines", "words_per_line",
)

_STOP = frozenset(STOP_WORDS)


def _classes() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        kind, char = unicodedata.category(chr(c)), chr(c)
        if kind == "Lu":
            table[c] = 1
        elif kind.startswith("N"):
            table[c] = 2
        elif char in ".,;:'\"()-":
            table[c] = 3
        elif char in "!?":
            table[c] = 4
        elif kind.startswith(("S", "P")):
            table[c] = 5
        elif char.isspace():
            table[c] = 6
    return table


_CLASS: list[np.ndarray] = []


def text_statistics(text: str) -> list[float]:
    if not _CLASS:
        _CLASS.append(_classes())
    if not text:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.bincount(_CLASS[0][np.minimum(codes, 0xFFFF)], minlength=7) / len(codes)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    low = text.lower().split()
    return [
        np.log1p(len(codes)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        *kinds[1:7],
        sum(map(_STOP.__contains__, low)) / n,
        len(set(low)) / n,
        sum(map(eq, low, low[1:])) / n,
        len(set(zip(low, low[1:]))) / n,
        sum(map(str.isupper, words)) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
    ]


_STATS = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            made = [text_statistics(t) for t in text_column(part, "text").to_pylist()]
            ids = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, _STATS[1].type)], schema=_STATS)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): one narrow pass over the texts."""
    return docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray
    n_features: int = N_FEATURES

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random cosines of the standardised statistics, and a constant."""
        random = np.random.default_rng(SEED)
        directions = random.normal(0, 1 / WIDTH, (len(self.mean), self.n_features))
        phases = random.uniform(0, 2 * np.pi, self.n_features)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / self.n_features) * np.cos(x @ directions + phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.knots, self.values)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(STATISTICS))


def _sums(model: Model):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column(0)))
                rows = np.hstack([z, np.asarray(batch.column(1), np.float64)[:, None]])
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "v"]
            )

    return add


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means per bin, made non-decreasing by pooling neighbours. `counts` > 0."""
    blocks: list[list[float]] = []
    for c, s in zip(counts, sums):
        blocks.append([c, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return np.concatenate([[s / c] * n for c, s, n in blocks])


def fit(stats: DataFrame, labels: DataFrame, n_features: int = N_FEATURES) -> Model:
    """`labels`: (doc_id, label 0 or 1, calibrate boolean). Rows to calibrate
    are left out of the ridge fit."""
    rows = cut_lineage(
        stats.join(labels.where(F.col("label").isNotNull()), "doc_id").select(
            "stats", F.col("label").cast("double").alias("label"), "calibrate"
        )
    )
    size = len(STATISTICS)
    moments = rows.select(
        *(F.avg(F.get("stats", F.lit(k))).alias(f"m{k}") for k in range(size)),
        *(F.stddev_pop(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(size)),
        F.avg("label").alias("base"),
    ).first()
    if moments["base"] is None:
        zero = np.zeros(size)
        return Model(zero, zero + 1, None, zero[:1], zero[:1] + 0.5, n_features)
    mean = np.array([moments[f"m{k}"] for k in range(size)])
    scale = np.maximum([moments[f"s{k}"] for k in range(size)], 1e-6)
    model = Model(mean, scale, None, np.zeros(1), np.zeros(1), n_features)
    sums = (
        rows.where(~F.col("calibrate"))
        .select("stats", "label")
        .mapInArrow(_sums(model), "i long, j long, v double")
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    wide = n_features + 2
    total = np.zeros((wide, wide))
    for r in sums:
        total[r.i, r.j] = r.v
    count = max(1.0, total[-2, -2])
    ridge = np.eye(wide - 1) * RIDGE * count
    ridge[-1, -1] = 1e-9 * count + 1e-9
    model.weights = np.linalg.solve(total[:-1, :-1] + ridge, total[:-1, -1])
    raw = rows.where("calibrate").mapInArrow(_raw(model), "raw double, label double")
    step = (HIGH - LOW) / BINS
    bins = (
        raw.groupBy(F.floor((F.least(F.greatest("raw", F.lit(LOW)), F.lit(HIGH)) - LOW) / step).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("s"), F.avg("raw").alias("at"))
        .orderBy("bin")
        .collect()
    )
    if bins:
        # one row of the base rate in each bin keeps thin bins from 0 and 1
        n = np.array([b["n"] for b in bins], float)
        s = np.array([b["s"] for b in bins], float)
        thin = 0.5
        model.knots = np.array([b["at"] for b in bins])
        model.values = isotonic(n + thin, s + thin * moments["base"])
    else:
        model.knots, model.values = np.array([LOW, HIGH]), np.array([0.0, 1.0])
    model.values = np.clip(model.values, 0.0, 1.0)
    return model


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], names=["raw", "label"])

    return run


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from `labels` (doc_id,
    quality) of folds 0, 1 (ridge) and 3 (calibration) of four."""
    stats = cut_lineage(statistics(docs))
    taught = labels.where(fold("doc_id", 4) != 2).select(
        "doc_id", F.col("quality").alias("label"), (fold("doc_id", 4) == 3).alias("calibrate")
    )
    scored = score(stats, fit(stats, taught))
    return scored.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
