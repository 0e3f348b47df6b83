"""SimHash near-dedup with vantage-point trees.

Fingerprints at most 3 bits apart have a half (32 bits) that differs in at most one bit. So each half gets its
own forest: a vantage-point tree over a bounded sample deals the fingerprints into shards by their Hamming
distance to the vantage points; triangle bounds tell which other shards a fingerprint's neighbours may lie in,
and it visits those as well. Within a shard a deeper vantage-point tree prunes branches the same way, whole
fingerprints are compared exactly, and a union-find keeps one link for each fingerprint that is not alone.
Components are then joined across shards by label propagation on links between distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, prepare_python, stash

BITS, SEED, SHINGLE, RADIUS = 64, 42, 3, 3
#: Distance within which one half of two linked fingerprints lies.
HALF_RADIUS = RADIUS // 2
#: Distinct fingerprints that shape the upper trees, and those that a shard should hold.
SAMPLE_ROWS = 16_384
SHARD_ROWS = 16_384
#: Shards of a tree: the bound of what is broadcast. Beyond, shards are dealt into blocks, and pairs of blocks meet.
MAX_SHARDS = 4_096
LEAF = 128


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hash_of = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((hash_of(s, SEED) for s in shingles), dtype="<u8", count=n)
    for start in range(0, n, 65_536):
        bits = np.unpackbits(hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) and row (a number of its own) of every row."""
    prepare_python(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
            yield pd.Series(found.view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints("text").alias("fp"), F.monotonically_increasing_id().alias("row"))


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unsigned = fps.view(np.uint64)
    return (unsigned & np.uint64(0xFFFFFFFF)).astype(np.uint32), (unsigned >> np.uint64(32)).astype(np.uint32)


class VantageTree:
    """Nodes (vantage point, threshold): distances up to the threshold go left, others right."""

    def __init__(self, points: np.ndarray, leaf: int, max_leaves: int = 1 << 30) -> None:
        self.vantage: list[int] = []
        self.threshold: list[int] = []
        self.children: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []
        depth = max(0, max_leaves.bit_length() - 1)
        self.root = self._grow(points, np.arange(len(points)), leaf, depth)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int, depth: int) -> int:
        """Index of a node, or -1 - index of a leaf."""
        best = None
        if len(rows) > leaf and depth:
            for candidate in points[rows[:: max(1, len(rows) // 5)][:5]]:
                distance = np.bitwise_count(points[rows] ^ candidate)
                counts = np.bincount(distance, minlength=34)
                below = np.cumsum(counts)
                # the cut that leaves the fewest points to both sides, among those that divide the rows well
                for cut in np.flatnonzero((below >= 0.25 * len(rows)) & (below <= 0.75 * len(rows))):
                    both = counts[max(0, cut - HALF_RADIUS + 1) : cut + HALF_RADIUS + 1].sum()
                    cost = both + abs(2 * below[cut] - len(rows)) / 4
                    if best is None or cost < best[0]:
                        best = (cost, candidate, int(cut), distance)
        if best is None:
            self.leaves.append(rows)
            return -len(self.leaves)
        _, vantage, cut, distance = best
        node = len(self.vantage)
        self.vantage.append(int(vantage))
        self.threshold.append(cut)
        self.children.append((0, 0))
        left = self._grow(points, rows[distance <= cut], leaf, depth - 1)
        right = self._grow(points, rows[distance > cut], leaf, depth - 1)
        self.children[node] = (left, right)
        return node

    def visits(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) of the leaves that hold all points within the radius of each row; radius 0 is home."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            distance = np.bitwise_count(points[rows] ^ np.uint32(self.vantage[node])).astype(np.int16)
            left, right = self.children[node]
            todo.append((left, rows[distance <= self.threshold[node] + radius]))
            todo.append((right, rows[distance > self.threshold[node] - radius]))


def join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets of a[i] and b[i]; parent holds each row's root, the smallest row of its set."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (above := parent[parent]) is not parent and (above != parent).any():
            parent = above


def shard_links(fps: np.ndarray, home: np.ndarray, half: int) -> np.ndarray:
    """For each fingerprint of a shard, the smallest row it is linked to by pairs with a home row.

    fps are distinct and ascending; rows that only visit are compared with home rows, not with each other.
    """
    whole = fps.view(np.uint64)
    points = halves(fps)[half]
    homes = np.flatnonzero(home)
    parent = np.arange(len(fps))
    tree = VantageTree(points[homes], LEAF)
    for leaf, rows in tree.visits(points, HALF_RADIUS):
        members = homes[tree.leaves[leaf]]
        for start in range(0, len(rows), 1_024):
            asked = rows[start : start + 1_024]
            for first in range(0, len(members), 2_048):
                part = members[first : first + 2_048]
                near = np.bitwise_count(whole[asked][:, None] ^ whole[part][None, :]) <= RADIUS
                i, j = np.nonzero(near)
                parent = join_sets(parent, asked[i], part[j])
    return parent


def deal(fps: np.ndarray, trees: list[VantageTree], blocks: int) -> pd.DataFrame:
    """half, shard, home_block, visit_block, fp, home: the groups that each fingerprint takes part in.

    A fingerprint is at home in one shard of each tree and visits all that may hold a neighbour. With more than one
    block a shard's home rows lie in one home block each, and its visitors in one visitor block each: every home
    block meets every visitor block, so that a group keeps its size whatever the shard holds.
    """
    block = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % blocks
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]

    def add(half: int, leaf: int, home_block: np.ndarray | int, visit_block: np.ndarray | int, rows: np.ndarray, home: bool) -> None:
        for column, value in zip(columns, (half, leaf, home_block, visit_block, fps[rows], home), strict=True):
            column.append(np.broadcast_to(value, len(rows)))

    for half, points in enumerate(halves(fps)):
        at_home = np.zeros(len(fps), dtype=np.int64)
        for leaf, rows in trees[half].visits(points, 0):
            at_home[rows] = leaf
        for leaf, rows in trees[half].visits(points, HALF_RADIUS):
            home = at_home[rows] == leaf
            for other in range(blocks):
                # as a home row, against every visitor block; as a visitor, in every home block but where it is at home
                add(half, leaf, block[rows[home]], other, rows[home], True)
                visits = rows[~(home & (block[rows] == other))]
                add(half, leaf, other, block[visits], visits, False)
    names = ("half", "shard", "home_block", "visit_block", "fp", "home")
    out = pd.DataFrame({name: np.concatenate(column) if column else [] for name, column in zip(names, columns, strict=True)})
    return out.astype({"half": "int32", "shard": "int32", "home_block": "int32", "visit_block": "int32", "fp": "int64", "home": "bool"})


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints of distinct(fp); their closure is that of all pairs in the radius."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).collect()], dtype=np.int64)
    shards = int(min(MAX_SHARDS, max(1, 1 << int(np.ceil(np.log2(max(1, n / SHARD_ROWS)))))))
    blocks = max(1, -(-n // (MAX_SHARDS * SHARD_ROWS)))
    trees = [VantageTree(points, max(1, len(sample) // (2 * shards)), shards) for points in halves(sample)]
    held = spark.sparkContext.broadcast(trees)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield deal(batch["fp"].to_numpy(), held.value, blocks)

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("fp")
        fps = shard["fp"].to_numpy()
        roots = shard_links(fps, shard["home"].to_numpy(), int(shard["half"].iloc[0]))
        linked = roots != np.arange(len(fps))
        return pd.DataFrame({"a": fps[roots[linked]], "b": fps[linked]})

    rows = distinct.mapInPandas(dealt, "half int, shard int, home_block int, visit_block int, fp long, home boolean")
    return rows.groupBy("half", "shard", "home_block", "visit_block").applyInPandas(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of the nodes of edges(a, b); min-label propagation with shortcuts."""
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("offer"))
        stepped = labels.join(offered, F.col("node") == F.col("a")).select("node", "label", F.least("label", "offer").alias("near"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = stash(stepped.join(ahead, F.col("near") == F.col("at"), "left").select("node", F.least("near", "beyond").alias("label"), "label").toDF("node", "label", "was"), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("label <> was").limit(1).count():
            return labels


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, label, component_id for every row of docs(doc_id, text, ...).

    label names the component and is never null; component_id is its smallest doc_id, null if it has none.
    """
    rows = stash(with_fingerprint(docs), "fingerprints")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    labels = components(linked_fingerprints(distinct.select("fp")))
    # the smallest id of each component; fingerprints without links are their own component
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = stash(named.join(smallest, "label").select("fp", "label", "component_id"), "components")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    # copies make hot fingerprints
    found = join_spread(rows, by_fp, distinct.select("fp", "n"), ["fp"], F.col("row"), total)
    return found.select("doc_id", "text_hash", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id reachable over links of at most 3 differing bits, itself included. Null and
    empty texts have fingerprint zero and link like any other; repeated rows share a component; a null doc_id gets
    its component's smallest id (null if the component has none); other columns are ignored; no rows give no rows.
    """
    return labelled(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
