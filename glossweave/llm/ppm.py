"""Language-model scores by prediction by partial matching (PPM).

A text is its words (lower-cased A-Z, runs of white space as one space) and an
end. A trie of byte contexts up to `ORDER` bytes predicts each byte: the longest
known context gives count / (total + distinct), or escapes with
distinct / (total + distinct) to the context one byte shorter, where the symbols
already offered are excluded; below the empty context all bytes are alike.

Pretrained: tasks count byte strings of ORDER + 1 bytes, Spark sums them, and
shorter contexts follow by summation. Every counted string has its place in the
trie; totals and distinct counts are of all training bytes. The logarithms of
the most frequent strings (2^22 at most) travel with the tasks. All other bytes
are asked for where the counts are: strings and questions are dealt by the last
LOW + 1 bytes of the context, so that a part has all longer contexts it needs,
and the orders up to LOW (2^24 entries at most) are known to every part. Since a
context's symbols are among those of each shorter context, what exclusion takes
away is a fixed number per context; a byte is then scored with array look-ups.
Adaptive (`adaptive_score`): the trie grows along the text itself and starts
empty.

The word base model needs the count of every word. Words that make up at least
2^-20 of the training words travel with the tasks (2^20 at most); the others are
joined, one row per document and distinct rare word.

Null and empty texts are the end alone. Without training documents all counts
are zero. Every row is scored, repeated ones each. Texts are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.arrow_text import slices, text_column
from glossweave.session import cut_lineage, shuffle_partitions

ORDER = 5
#: Orders whose tables every task can hold, whatever the corpus.
LOW = 2
TRIE_SHARE = 1 << 22
#: Distinct strings in a part, about.
PART_GRAMS = 1 << 20
WORD_SHARE = 1 << 20
#: Entries that a task holds before it hands on partial counts.
HELD = 1 << 18
END = b"\n"
END_WORD = b""


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def sequence(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def _masks(order: int) -> list[np.uint64]:
    return [np.uint64((1 << (8 * (k + 1))) - 1) for k in range(order + 1)]


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the sequences, the `order` bytes before it and itself as
    one number; and where each sequence starts."""
    pad = END * order
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    keys = data.copy()
    for k in range(1, order + 1):
        keys[k:] |= data[:-k] << np.uint64(8 * k)
    begins = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]) + order
    real = np.ones(len(data), bool)
    for k in range(1, order + 1):
        real[begins - k] = False
    return keys[real], np.concatenate([[0], np.cumsum(sizes)[:-1]])


# --- training ----------------------------------------------------------------

_COUNTS = pa.schema([("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys = np.concatenate([k for k, _ in held])
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def gram_rows():
            keys, n = merged()
            nulls = pa.nulls(len(keys), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), nulls, pa.array(n)], schema=_COUNTS)

        def word_rows():
            nulls = pa.nulls(len(words), pa.int64())
            return pa.RecordBatch.from_arrays(
                [nulls, pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], schema=_COUNTS
            )

        for batch in batches:
            for part in slices(batch, "text"):
                texts = []
                for text in text_column(part, "text").to_pylist():
                    found = words_of(text)
                    words.update(found)
                    words[END_WORD] += 1
                    texts.append(sequence(found))
                keys, _ = grams(texts, order)
                unique, n = np.unique(keys, return_counts=True)
                held.append((unique, n))
                if sum(len(k) for k, _ in held) > 8 * HELD:
                    held = [merged()]
                    if len(held[0][0]) > 4 * HELD:
                        yield gram_rows()
                        held = []
                if len(words) > HELD:
                    yield word_rows()
                    words.clear()
        if held:
            yield gram_rows()
        if words:
            yield word_rows()

    return run


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, word, n): counts of byte strings and of words, written out."""
    counted = docs.select("text").mapInArrow(_count(order), "gram long, word binary, n long")
    return cut_lineage(counted.groupBy("gram", "word").agg(F.sum("n").alias("n")))


class Table:
    """Sorted numbers that answer "at which place is this one" for arrays."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        buckets = self._bucket(keys)
        self.place = np.argsort(buckets, kind="stable")
        self.keys = keys[self.place]
        self.starts = np.searchsorted(buckets[self.place], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max(initial=0))

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of `wanted`, -1 for what is not there."""
        found = np.full(len(wanted), -1, np.int64)
        buckets = self._bucket(wanted)
        at, ends = self.starts[buckets], self.starts[buckets + 1]
        open_ = np.flatnonzero(at < ends)
        for _ in range(self.deepest):
            if not len(open_):
                break
            here = at[open_]
            hit = self.keys[here] == wanted[open_]
            found[open_[hit]] = self.place[here[hit]]
            at[open_] += 1
            open_ = open_[~hit & (here + 1 < ends[open_])]
        return found


class Trie:
    """Contexts and their symbols per order, with the logarithms of what each
    leads to."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]], below: Trie | None = None):
        """`orders[k]`: sorted (context of k bytes, symbol) numbers and counts; of
        the orders after those of `below`, if given."""
        self.levels = list(below.levels) if below else []
        self.order = len(self.levels) + len(orders) - 1
        for k, (pairs, counts) in enumerate(orders, len(self.levels)):
            contexts, of = np.unique(pairs >> np.uint64(8), return_inverse=True)
            total = np.bincount(of, counts, len(contexts))
            distinct = np.bincount(of, minlength=len(contexts))
            level = {
                "pairs": Table(pairs),
                "contexts": Table(contexts),
                "count": np.log(counts),
                "direct": np.log(counts) - np.log(total + distinct)[of],
                "escape": np.log(distinct) - np.log(total + distinct),
                "total": total,
                "distinct": distinct,
            }
            if k:
                below = self.levels[k - 1]
                # the same symbols after the context one byte shorter
                shorter = below["pairs"].find(pairs & _masks(k)[k - 1])
                taken = np.bincount(of, np.exp(below["count"])[shorter], len(contexts))
                suffix = below["contexts"].find(
                    contexts & np.uint64((1 << (8 * (k - 1))) - 1) if k > 1 else contexts * np.uint64(0)
                )
                free = below["distinct"][suffix] - distinct
                rest = np.maximum(np.rint(below["total"][suffix] - taken), 0) + free
                with np.errstate(divide="ignore", invalid="ignore"):
                    level["rest"] = np.log(rest)
                    level["escape_below"] = np.where(free > 0, np.log(free) - np.log(rest), 0.0)
            self.levels.append(level)
        known = int(self.levels[0]["distinct"].sum())
        # a byte that all 256 known ones exclude cannot be asked for
        self.unknown = -math.log(max(1, 256 - known))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm for each byte, from its number as `grams` gives it."""
        masks = _masks(self.order)
        out = np.zeros(len(keys))
        active = np.arange(len(keys))
        parent = np.full(len(keys), -1, np.int64)  # context escaped from
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            asked = keys[active] & masks[k]
            at = level["pairs"].find(asked)
            hit = at >= 0
            direct = parent < 0
            one = hit & direct
            out[active[one]] += level["direct"][at[one]]
            two = hit & ~direct
            if two.any():
                out[active[two]] += level["count"][at[two]] - self.levels[k + 1]["rest"][parent[two]]
            active, parent, direct = active[~hit], parent[~hit], direct[~hit]
            if not len(active):
                return out
            context = level["contexts"].find(asked[~hit] >> np.uint64(8))
            first = (context >= 0) & direct
            out[active[first]] += level["escape"][context[first]]
            if (~direct).any():
                out[active[~direct]] += self.levels[k + 1]["escape_below"][parent[~direct]]
            parent = context
        out[active] += self.unknown
        return out


def trie_of(counts: DataFrame, order: int = ORDER, share: int = TRIE_SHARE) -> Trie:
    """The trie of the counted byte strings; only entries of at least
    1 / share of all bytes, at most `share` an order, reach the driver."""
    grams_ = counts.where(F.col("gram").isNotNull())
    total = grams_.agg(F.sum("n")).first()[0] or 0
    levels = grams_.select(
        F.explode(F.array(*(F.lit(k) for k in range(order + 1)))).alias("k"), "gram", "n"
    ).withColumn(
        "gram",
        F.col("gram").bitwiseAND(
            F.element_at(F.array(*(F.lit(int(m)) if m < 1 << 63 else F.lit(-1) for m in map(int, _masks(order)))), F.col("k") + 1)
        ),
    )
    kept = (
        levels.groupBy("k", "gram").agg(F.sum("n").alias("n")).where(F.col("n") * share >= total).toArrow()
    )
    k, gram, n = (kept.column(c).to_numpy() for c in ("k", "gram", "n"))
    orders = []
    for level in range(order + 1):
        mine = k == level
        pairs = gram[mine].astype(np.int64).view(np.uint64)
        ranked = np.argsort(pairs)
        orders.append((pairs[ranked], n[mine][ranked].astype(np.float64)))
    return Trie(orders)


def orders_of(grams_: np.ndarray, counts: np.ndarray, orders: range, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What `Trie` takes for these orders, from strings of order + 1 bytes."""
    out = []
    for k in orders:
        pairs, at = np.unique(grams_ & _masks(order)[k], return_inverse=True)
        out.append((pairs, np.bincount(at, counts, len(pairs))))
    return out


def low_of(order: int) -> int:
    """The last order that all parts share."""
    return min(LOW, order - 1)


def low_trie(grams_: DataFrame, order: int) -> Trie | None:
    low = low_of(order)
    if low < 0:
        return None
    short = F.col("gram").bitwiseAND(F.lit(int(_masks(order)[low])))
    found = grams_.groupBy(short.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    pairs, n = (found.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    return Trie(orders_of(pairs.view(np.uint64), n.astype(np.float64), range(low + 1), order))


def frequent(grams_: DataFrame, most: int) -> tuple[Table, np.ndarray, int]:
    """The most frequent strings, at most `most`, with the logarithm of each
    last byte; and how many strings there are."""
    sizes = grams_.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toArrow()
    n, k = (sizes.column(c).to_numpy().astype(np.int64) for c in ("n", "k"))
    fits = int(np.searchsorted(np.cumsum(k), most, side="right"))
    least = int(n[fits - 1]) if fits else (1 << 63) - 1
    top = grams_.where(F.col("n") >= least).toArrow()
    keys = top.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    contexts = (
        grams_.groupBy(F.shiftrightunsigned("gram", 8).alias("context"))
        .agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.max("n").alias("most"))
        .where(F.col("most") >= least)
        .orderBy("context")
        .toArrow()
    )
    total, distinct = (contexts.column(c).to_numpy() for c in ("total", "distinct"))
    at = np.searchsorted(contexts.column("context").to_numpy().astype(np.int64), (keys >> np.uint64(8)).astype(np.int64))
    logs = np.log(top.column("n").to_numpy().astype(np.float64)) - np.log((total + distinct).astype(np.float64))[at]
    return Table(keys), logs, int(k.sum())


def part_of(keys: np.ndarray, order: int, parts: int) -> np.ndarray:
    """The part of each string, by the last bytes of its context."""
    width = low_of(order) + 1
    context = keys >> np.uint64(8) & np.uint64((1 << (8 * width)) - 1)
    return (context * Table.MULTIPLIER >> np.uint64(33)).astype(np.int64) % parts


def packs(keys: np.ndarray, beside: np.ndarray, order: int, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, strings, what stands beside them) of each part that has some."""
    part = part_of(keys, order, parts)
    ranked = np.argsort(part, kind="stable")
    keys, beside, part = keys[ranked], beside[ranked], part[ranked]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield int(part[a]), keys[a:b].tobytes(), beside[a:b].tobytes()


# --- scoring -----------------------------------------------------------------

_SCORED = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("n", pa.int64()),
        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
    ]
)
_SCORED_DDL = (
    "row long, doc_id long, word binary, n long, n_tokens long, n_known long, base double, score double"
)
#: Beside these: the part that a row goes to, and packed strings with their
#: counts (`counts`) or with the rows that ask for them (`asking`).
_DEALT = pa.schema(
    [*_SCORED, ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("asking", pa.binary())]
)
_DEALT_DDL = _SCORED_DDL + ", part int, grams binary, counts binary, asking binary"


def _packed(found: list[tuple[int, bytes, bytes]], kind: str) -> pa.RecordBatch:
    part, keys, beside = zip(*found)
    columns = {"part": part, "grams": keys, kind: beside}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(f.name, [None] * len(part)), f.type) for f in _DEALT], schema=_DEALT
    )


def _deal_counts(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, n = (np.asarray(batch.column(c), np.int64) for c in (0, 1))
                yield _packed(list(packs(keys.view(np.uint64), n, order, parts)), "counts")

    return run


def _answer(shared):
    """Scores of the packed questions of a part, whose counts come first; other
    rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, order = shared.value
        keys, counts, trie = [], [], None
        for batch in batches:
            plain = batch.filter(pc.is_null(batch.column("grams"))).select(_SCORED.names)
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays(plain.columns, schema=_SCORED)
            given = batch.filter(pc.is_valid(batch.column("counts")))
            keys += [np.frombuffer(x, np.uint64) for x in given.column("grams").to_pylist()]
            counts += [np.frombuffer(x, np.int64) for x in given.column("counts").to_pylist()]
            asked = batch.filter(pc.is_valid(batch.column("asking")))
            if not asked.num_rows:
                continue
            if trie is None:
                every = np.concatenate([np.zeros(0, np.uint64), *keys])
                n = np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.float64)
                trie = Trie(orders_of(every, n, range(low_of(order) + 1, order + 1), order), low)
                del every, n
                keys, counts = [], []
            if keys:
                raise ValueError("counts after questions")
            wanted = np.frombuffer(b"".join(asked.column("grams").to_pylist()), np.uint64)
            rows, at = np.unique(np.frombuffer(b"".join(asked.column("asking").to_pylist()), np.int64), return_inverse=True)
            logs = np.bincount(at, trie.log_probabilities(wanted)) / math.log(10)
            columns = {"row": rows, "word": [b" %d" % r for r in rows], "score": logs}
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in _SCORED], schema=_SCORED
            )

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, table_logs, order, parts, common, ground = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                texts, docs, rare = [], [], []
                for doc_id, text in zip(ids, text_column(part, "text").to_pylist()):
                    found = words_of(text)
                    texts.append(sequence(found))
                    found.append(END_WORD)
                    known, base = 0, 0.0
                    for word, n in Counter(found).items():
                        c = common.get(word)
                        if c is None:
                            rare.append((row, word, n))
                        else:
                            known += n * (c > 0)
                            base += n * (math.log10(c + 1) - ground)
                    docs.append((row, doc_id, len(found), known, base))
                    row += 1
                if not texts:
                    continue
                keys, starts = grams(texts, order)
                at = table.find(keys)
                missed = at < 0
                logs = np.zeros(len(keys))
                logs[~missed] = table_logs[at[~missed]]
                logs = np.add.reduceat(logs, starts) / math.log(10)
                rows, ids, sizes, known, bases = zip(*docs)
                if missed.any():
                    asking = np.repeat(np.array(rows, np.int64), np.diff(starts, append=len(keys)))[missed]
                    yield _packed(list(packs(keys[missed], asking, order, parts)), "asking")
                # a document's own row has a key that no word can equal
                own = [b" %d" % r for r in rows]
                yield _passing(rows, ids, own, [None] * len(rows), sizes, known, bases, logs, parts)
                if rare:
                    rows, words, n = zip(*rare)
                    nulls = [None] * len(rows)
                    yield _passing(rows, nulls, words, n, nulls, nulls, nulls, nulls, parts)

    return run


def _passing(rows, *columns) -> pa.RecordBatch:
    *columns, parts = columns
    part = np.arange(len(rows)) % parts
    nulls = [None] * len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip((rows, *columns, part, nulls, nulls, nulls), _DEALT.types)], schema=_DEALT
    )


def score(docs: DataFrame, training: DataFrame, order: int = ORDER, share: int = TRIE_SHARE, word_share: int = WORD_SHARE) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of `docs`,
    learned from the texts of `training`; scores are base-10 logarithms."""
    counts = count(training, order)
    grams_ = counts.where(F.col("gram").isNotNull()).select("gram", "n")
    low = low_trie(grams_, order)
    table, table_logs, distinct = frequent(grams_, share)
    parts = max(shuffle_partitions(docs.sparkSession), -(-distinct // PART_GRAMS))
    words = counts.where(F.col("word").isNotNull()).select(F.col("word").alias("_word"), F.col("n").alias("_c"))
    n, v = words.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count("*")).first()
    # the end, a word of every text, is known to the tasks in any case
    travels = (F.col("_c") * word_share >= n) | (F.octet_length("_word") == 0)
    common = words.where(travels).toArrow()
    common = dict(zip(common.column(0).to_pylist(), common.column(1).to_pylist()))
    common.setdefault(END_WORD, 0)  # nothing to train on
    ground = math.log10(n + (v + 1))
    send = docs.sparkSession.sparkContext.broadcast
    shared = send((table, table_logs, order, parts, common, ground))
    asked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shared), _DEALT_DDL)
    scored = (
        grams_.mapInArrow(_deal_counts(order, parts), _DEALT_DDL)
        .union(asked)
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions(F.col("counts").isNull())
        .mapInArrow(_answer(send((low, order))), _SCORED_DDL)
    )
    rare = words.where(~travels)
    c = F.coalesce("_c", F.lit(0))
    return (
        scored.join(rare, F.col("word") == F.col("_word"), "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("n_known", F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"),
            F.sum(F.coalesce("base", F.col("n") * (F.log10(c + 1) - ground))).alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )


# --- adaptive ----------------------------------------------------------------


class AdaptiveTrie:
    """Context counts that grow as bytes are seen."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(Counter)

    def log_probability(self, before: bytes, symbol: int) -> float:
        log, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(before[len(before) - k :])
            if not seen:
                continue
            free = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(free.values()) + len(free)
            if symbol in free:
                return log + math.log(free[symbol] / total)
            if free:
                log += math.log(len(free) / total)
                excluded |= free.keys()
        return log - math.log(256 - len(excluded))

    def add(self, before: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.counts[before[len(before) - k :]][symbol] += 1

    def code(self, data: bytes, learn: bool = True) -> float:
        """Natural logarithm of the probability of `data`."""
        whole, log = END * self.order + data, 0.0
        for i in range(self.order, len(whole)):
            before = whole[i - self.order : i]
            log += self.log_probability(before, whole[i])
            if learn:
                self.add(before, whole[i])
        return log


def adaptive_score(docs: DataFrame, order: int = 3, text: str = "text") -> DataFrame:
    """`docs` with adaptive_score: log10 probability of each text under a trie
    that learns from that text alone."""

    @F.pandas_udf("double")
    def coded(texts):
        return texts.map(lambda t: AdaptiveTrie(order).code(sequence(words_of(t or ""))) / math.log(10))

    return docs.withColumn("adaptive_score", coded(F.col(text)))
