"""What the operators of this package share: reading tables, lineage cuts, text chunks, word hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import join_spread, send_package, settle, spread  # noqa: F401 - join_spread for the operators

#: Characters that one numpy step looks at; bounds the memory of a task whatever the texts are.
CHUNK_CHARS = 400_000
#: Words of the digest contracts: ASCII letters (lower case), digits and everything beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = re.compile(r"\s")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key's text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def prepare_python(spark: SparkSession, rows: int = 1000) -> None:
    """The package on the executors, and Arrow batches of few rows, so that a batch of long texts stays small."""
    send_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back; this survives lost executors."""
    return settle(df, label)


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[list[str], list[int]]]:
    """Deal texts into chunks of about `limit` characters: the pieces and the index of each piece's text.

    A text beyond the limit is cut at white space (after it, where the limit lies within a word); its later pieces
    come first in their chunks. Null and empty texts give no piece.
    """
    pieces: list[str] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        start = 0
        while start < len(text):
            end = min(len(text), start + limit)
            if end < len(text):
                cut = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
                if cut <= start:
                    blank = _BLANK.search(text, end)
                    cut = blank.start() if blank else len(text)
                end = cut
            if held and (start or held + end - start > limit):
                yield pieces, owners
                pieces, owners, held = [], [], 0
            pieces.append(text[start:end])
            owners.append(i)
            held += end - start
            start = end
    if pieces:
        yield pieces, owners


def code_points(pieces: list[str], gap: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """The pieces as one array of code points, `gap` after each; and where each piece starts."""
    joined = gap.join(pieces) + gap
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(p) + len(gap) for p in pieces), dtype=np.int64, count=len(pieces))
    return points, np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(of: np.uint64, name: str, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        seed = np.full(n + n // 4, of, dtype=np.uint64)
        seed[0] = 1
        _powers[name] = np.cumprod(seed, dtype=np.uint64)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; the top bits are then usable as buckets."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (contract's word class after lower-casing) in an array of code points."""
    lower = (points >= 97) & (points <= 122)
    word = lower | (points >= 128) | ((points >= 48) & (points <= 57))
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(points: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """Polynomial hashes of points[start:end], one array for each array of ends, without a loop over words."""
    n = len(points)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(_R, "r", n), out=sums[1:])
    back = _power(_R_INVERSE, "inverse", n)[starts]
    return [mix((sums[e] - sums[starts]) * back) for e in ends]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
