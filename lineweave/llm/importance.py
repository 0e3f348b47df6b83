"""Target-distribution importance resampling: documents drawn by how much they look like the target's texts.

Features are runs of one to three words. The tokenizers library's regex Split (untrained) cuts the ASCII-lowered text
into words with their offsets; each word's CRC-32 comes from its offsets' bytes, and those of longer windows are
combined from their words' (CRCs are linear, so no window is put together as text). Windows fall into buckets; the
bucket histograms of corpus and target give each bucket a gain, and a document's weight is the sum over its features.
Texts are cut once: the buckets of each document are stored, two bytes a feature, and read for histogram and weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Regex, pre_tokenizers

from .common import CHUNK_CHARS, prepare_python, stash

BUCKETS, RUN = 10_000, 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing: where a long text may be cut.
_CUT = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Characters that the library cuts at once.
PIECE_CHARS = 3_000
#: Windows that grow by fewer bytes are carried on by one look at a table.
SHORT = 64
#: Distinct words that a task remembers.
REMEMBERED = 400_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _shift_tables(bits: int = 32) -> np.ndarray:
    """Tables [k, byte position, byte value] that carry a CRC over 2**k further bytes."""
    columns = np.array([0xEDB88320, *(1 << i for i in range(31))], dtype=np.uint32)  # one bit further, by input bit
    apply = lambda columns, x: np.bitwise_xor.reduce(np.where((x[..., None] >> np.arange(32, dtype=np.uint32)) & 1, columns, 0), axis=-1).astype(np.uint32)
    for _ in range(3):
        columns = apply(columns, columns)
    tables, values = [], np.arange(256, dtype=np.uint32)
    for _ in range(bits):
        tables.append([apply(columns, values << np.uint32(8 * k)) for k in range(4)])
        columns = apply(columns, columns)
    return np.array(tables)


class WindowBuckets:
    """Buckets of the windows of a text's words."""

    def __init__(self) -> None:
        self.split = pre_tokenizers.Split(Regex(NOT_WORD), behavior="removed")
        self.shift = _shift_tables()
        size, k, value = np.meshgrid(np.arange(SHORT + 1), np.arange(4), np.arange(256, dtype=np.uint32), indexing="ij")
        self.short = self.shifted((value << (8 * k).astype(np.uint32)).ravel(), size.ravel())
        self.known: dict[str, int] = {}

    def _crcs(self, word: str) -> int:
        """CRC of the word's bytes, and in the upper half that of a space and the word."""
        raw = word.encode()
        self.known[word] = both = zlib.crc32(raw) | zlib.crc32(b" " + raw) << 32
        return both

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """For each word its two CRCs, and the size of its window (offset pair) in bytes."""
        crcs, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        known, start = self.known, 0
        while start < len(text):
            cut = _CUT.search(text, start + CHUNK_CHARS)
            end = cut.start() if cut else len(text)
            lowered = text[start:end].encode().translate(_LOWER)
            words, offsets = self._cut(lowered.decode())
            if words:
                if len(lowered) > end - start:  # offsets are in characters
                    begins = (np.frombuffer(lowered, dtype=np.uint8) & 0xC0) != 0x80
                    offsets = np.append(np.flatnonzero(begins), len(lowered))[offsets]
                crcs.append(np.fromiter((known.get(w) or self._crcs(w) for w in words), dtype=np.uint64, count=len(words)))
                sizes.append(offsets[1::2] - offsets[::2])
            start = end + 1
            if len(known) > REMEMBERED:
                known.clear()
        return np.concatenate(crcs), np.concatenate(sizes)

    def _cut(self, text: str) -> tuple[list[str], np.ndarray]:
        """Words and their offsets (start, end, start, end ...); the library is quickest on short pieces."""
        words, offsets, start = [], [np.zeros(0, dtype=np.int64)], 0
        while start < len(text):
            cut = _CUT.search(text, start + PIECE_CHARS)
            end = cut.start() if cut else len(text)
            found = self.split.pre_tokenize_str(text[start:end])
            if found:
                piece, spans = zip(*found, strict=True)
                words.extend(piece)
                offsets.append(np.fromiter(chain.from_iterable(spans), dtype=np.int64, count=2 * len(spans)) + start)
            start = end + 1
        return words, np.concatenate(offsets)

    def joined(self, crcs: np.ndarray, spaced: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """CRCs of windows of these CRCs, each followed by a space and a word of so many bytes."""
        sizes = sizes + 1
        at = np.minimum(sizes, SHORT) << 10
        out = self.short.take(at | crcs & 255)
        for k in (1, 2, 3):
            out ^= self.short.take(at + 256 * k | crcs >> 8 * k & 255)
        long = np.flatnonzero(sizes >= SHORT)
        if len(long):
            out[long] = self.shifted(crcs[long], sizes[long])
        return out ^ spaced

    def shifted(self, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """CRCs carried over so many further bytes, bit by bit of their number."""
        out = crcs.copy()
        for k in range(int(sizes.max(initial=0)).bit_length()):
            at = np.flatnonzero(sizes >> k & 1)
            x, table = out[at], self.shift[k]
            out[at] = table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]
        return out

    def __call__(self, text: str | None) -> tuple[int, bytes]:
        """Number of words, and the buckets of all windows: unsigned, 16 bits each."""
        both, sizes = self.words(text or "")
        spaced = (both >> np.uint64(32)).astype(np.uint32)
        windows = [both.astype(np.uint32)]
        for run in range(1, RUN):
            windows.append(self.joined(windows[-1][:-1], spaced[run:], sizes[run:]))
        return len(both), (np.concatenate(windows) % BUCKETS).astype("<u2").tobytes()


def stored_features(rows: DataFrame, label: str) -> DataFrame:
    """rows(doc_id, text) as a table of doc_id, n_words and buckets."""

    @F.pandas_udf("n_words long, buckets binary")
    def featured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        buckets = WindowBuckets()
        for texts in batches:
            yield pd.DataFrame([buckets(t) for t in texts], columns=["n_words", "buckets"])

    return stash(rows.select("doc_id", featured("text").alias("f")).select("doc_id", "f.*"), label)


def histogram(features: DataFrame) -> np.ndarray:
    """Features of each bucket over all rows: each task sums its own, then BUCKETS numbers come to the driver."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for raw in batch["buckets"]:
                total += np.bincount(np.frombuffer(raw, dtype="<u2"), minlength=BUCKETS) if len(raw) > BUCKETS else 0
            total += np.bincount(np.frombuffer(b"".join(raw for raw in batch["buckets"] if len(raw) <= BUCKETS), dtype="<u2"), minlength=BUCKETS)
        yield pd.DataFrame({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    counted = features.select("buckets").mapInPandas(own, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[counted["bucket"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def gumbel(doc_id: Column) -> Column:
    """The draw's noise, from the id alone: -1000 ln(-ln(u)), rounded down."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """rows with `rank`, 1, 2, 3 ... in this order, without a task that sees them all.

    Range partitions are stored with their numbers; each is counted, and counts on from those before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = stash(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), label)
    sizes = sorted((r["__range"], r["count"]) for r in stored.groupBy("__range").count().collect())
    before = {k: sum(n for j, n in sizes if j < k) for k, _ in sizes}
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("__range")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return stored.withColumn("rank", (place + offset).cast("long")).drop("__range")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs(doc_id, text, ...), drawn towards target(text, ...).

    Of the rows with at least min_words words, percent per cent with the highest scores get ranks 1, 2, 3 ...; ties go
    to the smaller id, null ids first. All others have a null rank. Null and empty texts have no features and weight 0; a row
    without an id draws by the empty id. Repeated rows count, weigh and rank each for itself; other columns are
    ignored; an empty target still draws, from gains of an empty histogram; no documents give no rows.
    """
    spark = docs.sparkSession
    prepare_python(spark, 500)
    features = stored_features(docs, "importance")
    wanted = histogram(stored_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "importance-target"))
    sent = spark.sparkContext.broadcast(gains(histogram(features), wanted))

    @F.pandas_udf("long")
    def weighed(stored: pd.Series) -> pd.Series:
        return pd.Series([int(sent.value[np.frombuffer(raw, dtype="<u2")].sum()) for raw in stored], dtype="int64")

    rows = features.select("doc_id", "n_words", F.floor(F.length("buckets") / 2).alias("n_features"), weighed("buckets").alias("weight"))
    rows = stash(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))), "importance-scores")
    able = F.col("n_words") >= min_words
    drawn = percent * rows.filter(able).count() // 100
    placed = ranked(rows.filter(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "importance-ranks")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
