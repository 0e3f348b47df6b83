"""URL filter: rules on hosts and paths, looked up in cascades of Bloom filters instead of a join.

The keys of a URL are its host suffixes with its path prefixes, of the lengths that rules have. Level 0 of a cascade
encodes the listed keys. Level 1 encodes the keys of the corpus that level 0 takes for listed, level 2 the listed
ones that level 1 takes for such errors, and so on in turn until no key is taken wrongly. As the levels are built over
every key of the corpus, the first level that does not hold a key tells exactly whether it is listed. Two cascades
serve a table: one for the listed keys, one that tells the blocked of them from the allowed ones.

Each level is some bits for each key that it encodes; a table of rules that is too large for one broadcast is cut into
shards by key hash, and the URLs pass one shard after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, mix, prepare_python, stash

BLOCK, ALLOW = "block", "allow"
#: The rules of the query.
RULES = [("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK)]
#: Bits for each key of a level, and the bits that a key sets: about one wrong key in 45.
BITS_A_KEY, PROBES = 8, 4
#: Rules of one shard: its level 0 has 8 MB, the bound of what is gathered and broadcast for a level.
SHARD_RULES = 8_000_000


@dataclass
class Level:
    words: np.ndarray  # the bit set, 64 bits a word
    size: int  # number of bits


@dataclass
class Cascade:
    """Levels in turn: the even ones encode the chosen keys, the odd ones the others that they were taken for."""

    levels: list[Level] = field(default_factory=list)

    def chosen(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each key is a chosen one; hashes[k, level] is its hash for a level."""
        found = np.zeros(len(hashes), dtype=bool)
        open_ = np.arange(len(hashes))
        for k, level in enumerate(self.levels):
            held = holds(level, hashes[open_, k])
            if k % 2:
                found[open_[~held]] = True
            open_ = open_[held]
        if len(self.levels) % 2:
            found[open_] = True
        return found


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits that a hash sets, one row for each probe."""
    a = mix(hashes.astype(np.int64).view(np.uint64))
    b = mix(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(PROBES)]).astype(np.int64)


def holds(level: Level, hashes: np.ndarray) -> np.ndarray:
    at = places(hashes, level.size)
    return (level.words[at >> 6] >> (at & 63) & 1).astype(bool).all(axis=0)


def level_hash(key: Column, level: int) -> Column:
    """A hash of a key that differs from level to level: keys that agree in one differ in the next."""
    return F.xxhash64(F.lit(level), key)


def encode(keys: DataFrame, level: int, n: int) -> Level:
    """A level over the n keys(key): every task sets the bits of its keys, words are merged by OR."""
    size = max(64, BITS_A_KEY * n)

    def own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(places(batch["h"].to_numpy(), size))
            starts = np.flatnonzero(np.diff(at >> 6, prepend=-1))
            bits = np.bitwise_or.reduceat(np.int64(1) << (at & 63), starts) if len(at) else at
            yield pd.DataFrame({"word": at[starts] >> 6, "bits": bits})

    found = keys.select(level_hash(F.col("key"), level).alias("h")).mapInPandas(own_words, "word long, bits long")
    words = np.zeros(size // 64 + 1, dtype=np.int64)
    merged = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words[merged["word"].to_numpy()] = merged["bits"].to_numpy()
    return Level(words, size)


def held_by(keys: DataFrame, level: Level, k: int) -> DataFrame:
    """Those of keys(key) that a level holds."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        return pd.Series(holds(sent.value, hashes.to_numpy()))

    return keys.filter(held(level_hash(F.col("key"), k)))


def build(chosen: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade that tells chosen(key) from all other keys of universe(key), which may hold chosen ones too.

    What level 0 takes for chosen is set against the chosen keys by grouping both; only these keys are kept.
    """
    chosen = stash(chosen.distinct(), "url-chosen")
    first = encode(chosen, 0, chosen.count())
    both = held_by(universe.distinct(), first, 0).select("key", F.lit(False).alias("chosen")).unionByName(chosen.select("key", F.lit(True).alias("chosen")))
    both = stash(both.groupBy("key").agg(F.max("chosen").alias("chosen")), "url-universe")
    sides, levels = [both.filter("chosen").select("key"), both.filter("not chosen").select("key")], [first]
    while n := (wrong := sides[len(levels) % 2]).count():
        level = encode(wrong, len(levels), n)
        sides[1 - len(levels) % 2] = stash(held_by(sides[1 - len(levels) % 2], level, len(levels)), "url-level")
        levels.append(level)
    return Cascade(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_keys(rules: DataFrame) -> DataFrame:
    """key, blocked, labels (of the host) and length (of the path) of rules(rule, verdict); nulls are no rules."""
    host, path = F.regexp_extract("rule", "^[^/]*", 0), F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    known = rules.filter("rule is not null and verdict is not null").select(ascii_lower(host).alias("host"), path.alias("path"), (F.col("verdict") == BLOCK).alias("blocked"))
    keyed = known.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), "blocked")
    return keyed.groupBy("key", "labels", "length").agg(F.max("blocked").alias("blocked"))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys of a URL that a rule could have, longest first: struct(size, host_size, key), both sizes negative."""
    pairs = F.lit([list(x) for x in shapes]) if shapes else F.array().cast("array<array<int>>")
    fitting = F.filter(pairs, lambda x: x[1] <= F.length(path))
    hosts = F.transform(fitting, lambda x: F.struct(_suffix(host, x[0]).alias("h"), F.substring(path, F.lit(1), x[1]).alias("p")))
    keys = F.transform(hosts, lambda x: F.struct((-F.length(x["h"]) - F.length(x["p"])).alias("size"), (-F.length(x["h"])).alias("host_size"), F.concat(x["h"], x["p"]).alias("key")))
    return F.array_sort(F.array_distinct(keys))


def _suffix(host: Column, labels: Column) -> Column:
    """The last `labels` labels of a host; a shorter host whole."""
    parts = F.split(host, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages(page_id, url, ...).

    rules(rule, verdict): host and path of a rule in one string, like `net/es/`; it fits URLs of the host and its
    subdomains whose path starts with its path. The longest fitting rule decides, of equally long ones that with the
    longer host; a rule listed as both allowed and blocked blocks. URLs without a rule are not listed: null rule,
    `allow`. Null URLs and URLs without `://` have an empty host and path. Repeated pages give repeated rows, other
    columns are ignored, no pages give no rows; without rules all is allowed.
    """
    spark = pages.sparkSession
    prepare_python(spark, 20_000)
    keys = stash(rule_keys(rules), "url-rules")
    shapes = sorted(tuple(r) for r in keys.select("labels", "length").distinct().collect())
    shards = -(-keys.count() // SHARD_RULES)
    shard = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(max(1, shards)))
    host, path = url_parts(F.coalesce("url", F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__keys", candidates(F.col("host"), F.col("path"), shapes)).withColumn("__best", F.lit(None).cast("struct<size: int, host_size: int, key: string, blocked: boolean>"))
    for k in range(shards):
        own = keys.filter(shard(F.col("key")) == k)
        universe = rows.select(F.explode("__keys.key").alias("key")).filter(shard(F.col("key")) == k)
        listed = build(own.select("key"), universe)
        blocked = build(own.filter("blocked").select("key"), own.select("key"))
        if k:
            rows = stash(rows, "url-pass")
        here = F.filter("__keys", lambda x: shard(x["key"]) == k)  # noqa: B023
        rows = rows.withColumn("__here", here).withColumn("__found", first_listed(spark, listed, blocked)(*(hash_lists(F.col("__here.key"), c) for c in (listed, blocked))))
        found = F.when(F.col("__found.at") >= 0, F.get("__here", F.col("__found.at")).withField("blocked", F.col("__found.blocked")))
        rows = rows.withColumn("__best", F.least("__best", found)).drop("__here", "__found")
    verdict = F.when(F.col("__best.blocked"), BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", F.col("__best.key").alias("rule"), verdict.alias("verdict"))


def hash_lists(keys: Column, cascade: Cascade) -> Column:
    """The hashes of each key for each level, one flat list."""
    return F.flatten(F.transform(keys, lambda key: F.array(*(level_hash(key, k) for k in range(len(cascade.levels))))))


def first_listed(spark: SparkSession, listed: Cascade, blocked: Cascade):
    """Column function over two hash lists: the first listed key of a row (-1: none), and whether it is blocked."""
    sent = spark.sparkContext.broadcast((listed, blocked))

    def table(lists: pd.Series, cascade: Cascade) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.int64), *lists]).astype(np.int64).reshape(-1, len(cascade.levels))

    @F.pandas_udf("at int, blocked boolean")
    def found(lists: pd.Series, block_lists: pd.Series) -> pd.DataFrame:
        listed, blocked = sent.value
        hits, blocks = listed.chosen(table(lists, listed)), blocked.chosen(table(block_lists, blocked))
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // len(listed.levels)
        owners = np.repeat(np.arange(len(lists)), sizes)
        starts = np.cumsum(sizes) - sizes
        rows, at = np.unique(owners[hits], return_index=True)
        at = np.flatnonzero(hits)[at]
        out = pd.DataFrame({"at": np.full(len(lists), -1, dtype=np.int32), "blocked": np.zeros(len(lists), dtype=bool)})
        out.loc[rows, "at"] = (at - starts[rows]).astype(np.int32)
        out.loc[rows, "blocked"] = blocks[at]
        return out

    return found


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "rule string, verdict string")
