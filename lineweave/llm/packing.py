"""Packing by shortest-pack-first over the length histogram.

Documents are tokenized once and cut into pieces of at most a sequence. Only the histogram of piece lengths
(at most `capacity` counts) comes to the driver. Lengths are placed longest first into the packs with the most
free space, many packs of one pattern at a time, by updating pattern counts. The patterns then name, for each
length, which ranks go to which sequence at which offset; pieces are ranked within their length and joined.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare_python, stash
from .word_tokens import WordTokens

CAPACITY = 2048
END_ID = 1
#: Rows of one length that one task ranks, about; salts split longer groups.
RANK_ROWS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Bounds of the pieces of a document of n tokens: whole sequences, then the rest."""
    return [*range(0, n, capacity), n]


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order of placing) with their counts.

    The longest length goes to the shortest packs that have room, all packs of a pattern at once; what finds no
    room opens new packs and fills them. A length meets each fill level once, so that the patterns stay a few times the lengths.
    """
    by_fill: dict[int, dict[tuple[int, ...], int]] = {}
    fills: list[int] = []

    def put(pattern: tuple[int, ...], fill: int, count: int) -> None:
        if fill not in by_fill:
            by_fill[fill] = {}
            heapq.heappush(fills, fill)
        by_fill[fill][pattern] = by_fill[fill].get(pattern, 0) + count

    for length in sorted((k for k, v in histogram.items() if v > 0 and k > 0), reverse=True):
        if length > capacity:
            raise ValueError("a length is beyond the capacity")
        left = histogram[length]
        while left:
            while fills and not by_fill.get(fills[0]):
                by_fill.pop(heapq.heappop(fills), None)
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                pattern, count = next(iter(by_fill[fill].items()))
                used = min(left, count)
                if used == count:
                    del by_fill[fill][pattern]
                else:
                    by_fill[fill][pattern] = count - used
                put((*pattern, length), fill + length, used)
                left -= used
            else:
                # placed one by one, the pack just opened is the shortest with room until it is full
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put((length,) * each, each * length, full)
                if rest:
                    put((length,) * rest, rest * length, 1)
                left = 0
    return sorted(((p, c) for patterns in by_fill.values() for p, c in patterns.items()), key=lambda x: (-sum(x[0]), x[0]))


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """length, first_rank, sequence_id (of the first rank), offset: one row for each place of each pattern."""
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, ranks.get(length, 0), base, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        base += count
    return pd.DataFrame(rows, columns=["length", "first_rank", "sequence_id", "offset"], dtype="int64")


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens."""
    prepare_python(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = WordTokens(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for doc_id, encoded in zip(batch["doc_id"], tokens.encode(batch["text"].tolist()), strict=True):
                ids = np.concatenate((encoded, end))
                bounds = cut_points(len(ids), capacity)
                rows += [(doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)) for a, b in zip(bounds, bounds[1:], strict=False)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of docs(doc_id, text, ...).

    Null and empty texts are one token (the end id); repeated rows and null ids are packed like any other; very
    long texts become many pieces; other columns are ignored; no rows give no rows. Equal lengths are
    interchangeable: ties in rank go by doc_id and start within a group.
    """
    pieces = tokenize_pieces(docs, vocabulary, capacity, end_id)
    # deal: a number of its own for each piece, read from the stored table ever after
    pieces = stash(pieces.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(shortest_pack_first(histogram, capacity)).sort_values(["length", "first_rank"])
    # pieces of a length are ranked in as many groups as its count asks for; at most `capacity` rows are broadcast
    per_length = docs.sparkSession.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(per_length), "length").withColumn("salt", F.pmod("deal", "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = stash(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "lengths")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "deal")) - 1
    ranked = salted.withColumn("rank", rank).join(counts.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))

    length, first = slots["length"].to_numpy(), slots["first_rank"].to_numpy()
    # ranks of a length lie in a range of their own, so that one sorted array serves all lengths
    step = int(max(histogram.values(), default=0)) + 1
    held = docs.sparkSession.sparkContext.broadcast((length * step + first, first, slots["sequence_id"].to_numpy(), slots["offset"].to_numpy()))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        keys, firsts, sequences, offsets = held.value
        at = np.searchsorted(keys, lengths.to_numpy() * step + ranks.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + ranks.to_numpy() - firsts[at], "offset": offsets[at]})

    placed = ranked.withColumn("p", place("length", "rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")
