"""Byte-level BPE encoding and decoding with a given rank file.

Text is split by the tokenizer's pattern; each piece becomes bytes, and of all
neighbours whose joint bytes have a rank, the pair with the lowest rank (the
leftmost of equals) is merged, until none has. Decoding concatenates the bytes
of the ids.

Pieces of all texts are counted, by their words: a text is cut at its spaces, and
a task matches each distinct word once. (A piece that takes part of two words, or
none, is counted otherwise; the counts say only which pieces are common.) Distinct
pieces that make up at least 2^-20 of all (2^20 at most), and have at most `LONG`
bytes, are encoded once, by Spark higher-order functions: a fold
over the piece's byte array, with the ranks as a literal. A literal map is
searched from its start, so the literal is an array of small maps, one per hash
of the joint bytes. The result, of bounded size, travels with the tasks that put
the documents together. All other pieces, half of which stand in one document
only, are merged there with the same ranks: in arrays, or by a heap where they
are long.

Null and empty texts have no ids. Every text is encoded whole; repeated rows get
a row each. Extra columns stay in `encode`; a column named ids is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from glossweave.llm.arrow_text import slices, text_column
from glossweave.llm.columns import guarded
from glossweave.llm.ppm import Table
from glossweave.session import cut_lineage, shuffle_partitions

PIECE_SHARE = 1 << 20
#: Distinct pieces that a task holds before it hands on partial counts.
HELD = 1 << 17
#: Bytes of a piece beyond which a heap merges it.
LONG = 64
RANK_BUCKETS = 1 << 13


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return parse_ranks(file.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


# --- the fold over distinct pieces -------------------------------------------


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<string, int>>: ranks by the hash bucket of their bytes, bytes
    as characters of the same number."""
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        hashed = xxhash.xxh64_intdigest(text.encode(), seed=42)
        signed = hashed - (1 << 64) if hashed >> 63 else hashed
        buckets[signed % RANK_BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(piece: Column, ranks: Column) -> Column:
    """Ids of a binary piece."""

    def rank(token: Column) -> Column:
        bucket = F.pmod(F.xxhash64(token), F.lit(RANK_BUCKETS)).cast("int")
        return F.element_at(F.get(ranks, bucket), token)

    def merged(parts: Column, _step: Column) -> Column:
        offers = F.transform(
            F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda x, i: rank(F.concat(x, F.get(parts, i + 1))),
        )

        def at(found: Column) -> Column:
            place = F.array_position(found, F.array_min(found)).cast("int")
            return F.when(F.array_min(found).isNull(), parts).otherwise(
                _let(
                    place,
                    lambda p: F.concat(
                        F.slice(parts, 1, p - 1),
                        F.array(F.concat(F.get(parts, p - 1), F.get(parts, p))),
                        F.slice(parts, p + 2, F.size(parts)),
                    ),
                )
            )

        return _let(offers, at)

    bytes_ = F.filter(F.split(F.decode(piece, "ISO-8859-1"), ""), lambda c: c != "")
    parts = F.aggregate(F.sequence(F.lit(1), F.octet_length(piece)), bytes_, merged)
    return F.transform(parts, rank)


# --- merges inside a task ------------------------------------------------------


class Merger:
    """Ranks for pieces that no table holds."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(rank)
        self.shift = np.uint64(32)
        keys = np.array(left, np.uint64) << self.shift | np.array(right, np.uint64)
        self.pairs, self.whole = Table(keys), np.array(whole + [1 << 40], np.int64)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = [rank]
            elif len(piece) > LONG:
                out[k] = self.by_heap(piece)
            else:
                short.append(k)
        for k, ids in zip(short, self.in_arrays([pieces[k] for k in short])):
            out[k] = ids
        return out

    def in_arrays(self, pieces: list[bytes]) -> list[list[int]]:
        """One merge in each piece per round, in all pieces at once."""
        if not pieces:
            return []
        none = 1 << 40
        tokens = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])

        def offered(at: np.ndarray) -> np.ndarray:
            """Rank of each token joined with the next."""
            found = np.full(len(at), none, np.int64)
            inside = at + 1 < len(tokens)
            a = at[inside]
            keys = tokens[a].astype(np.uint64) << self.shift | tokens[a + 1].astype(np.uint64)
            found[inside] = np.where(piece[a] == piece[a + 1], self.whole[self.pairs.find(keys)], none)
            return found

        offer = offered(np.arange(len(tokens)))
        done_piece, done_token = [], []
        while True:
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            best = np.minimum.reduceat(offer, starts)
            sizes = np.diff(np.r_[starts, len(tokens)])
            over = np.repeat(best == none, sizes)
            done_piece.append(piece[over])
            done_token.append(tokens[over])
            best, sizes, open_ = best[best != none], sizes[best != none], ~over
            tokens, piece, offer = tokens[open_], piece[open_], offer[open_]
            if not len(tokens):
                break
            hits = np.flatnonzero(offer == np.repeat(best, sizes))
            # the leftmost of each piece
            hits = hits[np.r_[True, piece[hits][1:] != piece[hits][:-1]]]
            tokens[hits] = offer[hits]
            keep = np.ones(len(tokens), bool)
            keep[hits + 1] = False
            tokens, piece, offer = tokens[keep], piece[keep], offer[keep]
            # only the merged token and the one before it have other neighbours
            at = hits - np.arange(len(hits))
            offer[at] = offered(at)
            before = at[at > 0] - 1
            offer[before] = offered(before)
        pieces_, tokens_ = np.concatenate(done_piece), np.concatenate(done_token)
        order = np.argsort(pieces_, kind="stable")
        cuts = np.searchsorted(pieces_[order], np.arange(len(pieces) + 1)).tolist()
        ids = tokens_[order].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def by_heap(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: none starts
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids


# --- documents -----------------------------------------------------------------


def _counted(pattern: str):
    """Counts of the pieces of words: a text is cut at its spaces, and each
    distinct word is matched once, with a space before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, words = regex.compile(pattern).findall, Counter()

        def rows():
            held: dict[str, int] = {}
            for word, n in words.items():
                for piece in find(" " + word):
                    held[piece] = held.get(piece, 0) + n
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "n"]
            )

        for batch in batches:
            for text in text_column(batch, "text").to_pylist():
                words.update(text.split(" "))
                if len(words) > HELD:
                    yield rows()
                    words.clear()
        if words:
            yield rows()

    return run


def piece_table(docs: DataFrame, ranks: dict[bytes, int], pattern: str, share: int = PIECE_SHARE) -> pa.Table:
    """(piece, ids) of the common pieces; ids as decimal numbers joined by
    commas."""
    counts = cut_lineage(
        docs.select("text")
        .mapInArrow(_counted(pattern), "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    # long pieces are merged by a heap in the tasks: a fold takes their length
    # squared. Cut off here, the literal stands in one plan without exchanges.
    common = cut_lineage(
        counts.where((F.col("n") * share >= total) & (F.octet_length("piece") <= LONG))
        .select("piece")
        .repartition(shuffle_partitions(docs.sparkSession), "piece")
    )
    ids = fold_merges(F.encode("piece", "UTF-8"), rank_literal(ranks))
    joined = F.array_join(ids.cast("array<string>"), ",").alias("ids")
    return common.select("piece", joined).toArrow()


class Encoder:
    """Encodes the texts of a task."""

    def __init__(self, rank_data: bytes, pattern: str, common: bytes):
        """The rank file's content; the piece table as an Arrow stream."""
        self.ranks = parse_ranks(rank_data)
        self.find, self.merger = regex.compile(pattern).findall, Merger(self.ranks)
        self.common = {}
        for batch in pa.ipc.open_stream(common):
            self.common.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, as decimal numbers joined by commas."""
        return [",".join(ids) for ids in self.by_piece(texts)]

    def by_piece(self, texts: list[str]) -> list[list[str]]:
        """The same for each piece of each text."""
        found = [self.find(t) for t in texts]
        common = self.common
        rare = list(set().union(*found).difference(common))
        ids = self.merger.encode([p.encode() for p in rare])
        known = {p: ",".join(map(str, i)) for p, i in zip(rare, ids)}
        return [[common.get(p) or known[p] for p in pieces] for pieces in found]


class Decoded(dict):
    """Bytes of ids that are decimal numbers joined by commas: those of a piece are
    decoded once, not wherever it stands."""

    def __init__(self, ranks: dict[bytes, int]):
        self.piece_of = {str(rank): token for token, rank in ranks.items()}.__getitem__

    def __missing__(self, ids: str) -> bytes:
        self[ids] = found = b"".join(map(self.piece_of, ids.split(",")))
        return found


_LAST: list = []


def _encoder(shared) -> Encoder:
    """The encoder of a worker's last task, if it was for the same broadcast."""
    value = shared.value
    if not _LAST or _LAST[0] is not value:
        _LAST[:] = value, Encoder(*value)
    return _LAST[1]


def _shared(docs: DataFrame, rank_file: str, pattern: str, share: int):
    """What tasks need, in bytes: the driver holds no table of pieces as objects."""
    with open(rank_file, "rb") as file:
        data = file.read()
    table = piece_table(docs, parse_ranks(data), pattern, share)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return docs.sparkSession.sparkContext.broadcast((data, pattern, sink.getvalue().to_pybytes()))


def encode(docs: DataFrame, rank_file: str, pattern: str, share: int = PIECE_SHARE) -> DataFrame:
    """`docs` with ids (array<int>)."""
    shared = _shared(docs, rank_file, pattern, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                made = encoder.encode(text_column(part, "text").to_pylist())
                ids = [np.array(m.split(","), np.int32) if m else np.zeros(0, np.int32) for m in made]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "ids"])

    def encoded(d: DataFrame) -> DataFrame:
        return d.mapInArrow(run, StructType([*d.schema.fields, StructField("ids", ArrayType(IntegerType()))]))

    return guarded(docs, ["text"], encoded, ["ids"])


def decode(ids: DataFrame, rank_file: str) -> DataFrame:
    """`ids` with decoded (binary): the bytes of the ids, concatenated."""
    pieces = {rank: token for token, rank in read_ranks(rank_file).items()}
    shared = ids.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("binary")
    def joined(column):
        get = shared.value.__getitem__
        return column.map(lambda i: b"".join(map(get, i)) if i is not None else b"")

    return ids.withColumn("decoded", joined("ids"))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, rank_file: str, pattern: str, share: int = PIECE_SHARE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded."""
    shared = _shared(docs.select("doc_id", "text"), rank_file, pattern, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        decode = Decoded(encoder.ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                made = encoder.by_piece(text_column(part, "text").to_pylist())
                sizes, hashes, decoded = [], [], []
                for pieces in made:
                    ids = ",".join(pieces)
                    sizes.append(ids.count(",") + 1 if ids else 0)
                    hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(decode.__getitem__, pieces))).hexdigest())
                if len(decode) > HELD:
                    decode.clear()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
