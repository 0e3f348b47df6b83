"""Language ID, quality and sharding against plain Python that shares no code with them but the statistics of a text."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lineweave.llm import language_id, quality, sharding

SMALL = "/root/testdata/sf0.001"
MASK = 2**32 - 1


def fold(key, modulus, remainder):
    return key is not None and zlib.crc32(str(key).encode()) % modulus == remainder


def buckets(text):
    """Buckets of a text's 2- and 3-grams, a line break at both ends."""
    points = [ord(c) for c in f"\n{text.lower()}\n"]
    out = []
    for order in (2, 3):
        for i in range(len(points) - order + 1):
            h = points[i] * 0x9E3779B1 & MASK
            for k in range(1, order):
                h = (h ^ h >> 15) + points[i + k] & MASK
                h = h * 0x85EBCA6B & MASK
            out.append(h >> 17)
    return Counter(out)


def test_language_id_is_naive_bayes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) between 20 and 1500").limit(90)
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12 34!", "en", "s", 0)], docs.schema))
    rows = docs.collect()
    held = {i: buckets(r["text"]) for i, r in enumerate(rows) if r["text"]}
    totals = {}
    for i, r in enumerate(rows):
        if r["lang"] is not None and r["text"] and not fold(r["doc_id"], 4, 2):
            totals.setdefault(r["lang"], Counter()).update(held[i])
    sums = {x: sum(c.values()) + 0.5 * 2**15 for x, c in totals.items()}
    want = Counter()
    for i, r in enumerate(rows):
        if r["text"] and any(map(str.isalpha, r["text"])):
            scores = {x: sum(n * math.log((totals[x][b] + 0.5) / sums[x]) for b, n in held[i].items()) for x in sorted(totals)}
            best = max(scores, key=scores.get)
            want[r["doc_id"], fold(r["doc_id"], 4, 2), best, round(1 / sum(math.exp(max(-700, v - scores[best])) for v in scores.values()), 2)] += 1
        else:
            want[r["doc_id"], fold(r["doc_id"], 4, 2), "und", 0.0] += 1
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 2)) for r in language_id.identify_languages(docs).collect())
    assert got == want and len(totals) > 1


def test_quality_is_a_shrunk_quadratic_discriminant(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows, marks = docs.select("doc_id", "text").collect(), [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] in (0, 1) and not fold(r["doc_id"], 5, 0)]
    stats = {r["doc_id"]: quality.statistics(r["text"]) for r in rows}
    x, y = np.array([stats[i] for i, _ in marks if i in stats]), np.array([q for i, q in marks if i in stats])
    centre, scale, d = x.mean(0), x.std(0) + 1e-6, x.shape[1]
    z = (x - centre) / scale
    around = lambda rows: sum(np.outer(r, r) for r in rows - rows.mean(0)) / len(rows)
    density = {}
    for label in (0, 1):
        own = z[y == label]
        weight = 0.1 + 0.9 * d / (d + len(own))
        cov = (1 - weight) * around(own) + weight * around(z)
        cov = 0.9 * cov + 0.1 * (np.trace(cov) / d + 1e-3) * np.eye(d)
        inverse, log_det, prior, mean = np.linalg.inv(cov), np.linalg.slogdet(cov)[1], math.log((len(own) + 1) / (len(z) + 2)), own.mean(0)
        density[label] = {i: -0.5 * ((v := (np.array(s) - centre) / scale - mean) @ inverse @ v + log_det) + prior for i, s in stats.items()}
    got = {r["doc_id"]: r for r in quality.classify_quality(docs, labels).collect()}
    assert got.keys() == stats.keys()
    for i, r in got.items():
        want = 1 / (1 + math.exp(-max(-500, min(500, density[1][i] - density[0][i]))))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == fold(i, 5, 0)


def test_shards_take_turns_along_their_permutations(spark):
    names, size = ["b", "a", "zz", "c"], 101
    orders = {}
    for name in names:
        digest = hashlib.sha256(name.encode()).hexdigest()
        offset, stride = int(digest[:16], 16) % size, int(digest[16:32], 16) % (size - 1) + 1
        orders[name] = [(offset + k * stride) % size for k in range(size)]
        assert sorted(orders[name]) == list(range(size))
    table = {}
    while len(table) < size:
        for name in sorted(names):
            if len(table) < size:
                table[next(s for s in orders[name] if s not in table)] = name
    keys = [*range(300), None, 7, 7]
    long = "k" * 200_000
    for kind, values in (("long", keys), ("string", ["", "é", long, None])):
        docs = spark.createDataFrame([(k, "x") for k in values], f"doc_id {kind}, slot string")
        slot = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % size
        got = Counter(tuple(r) for r in sharding.assign_shards(docs, names, size=size).select(F.col("doc_id"), "slot", "shard").collect())
        assert got == Counter((k, slot(k), table[slot(k)]) for k in values)
