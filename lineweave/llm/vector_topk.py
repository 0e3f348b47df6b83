"""Exact top-k search by inner product with a vector-approximation file.

1. Equal vectors are one class, which keeps its k + 1 first rows: more of them are in no answer.
2. The approximation file holds one byte for each component of a class: its cell in a uniform grid. It is stored
   beside the exact vectors.
3. Scan: blocks of cells meet blocks of queries. From the cells follow an upper and a lower bound of each inner
   product; what cannot reach the block's kth lower bound goes. No exact candidate vector takes part.
4. Exact vectors are read in the order of the upper bounds: first each query's best k + 1, then those whose bound
   reaches the kth score found, and no more: nothing unread can enter the answer.
5. Where the bounds leave a query more than DENSE candidates of one block (vectors closer to each other than a
   cell), that block is compared with the query exactly, and again only its best k + 1 are handed on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_spread, prepare_python, stash

#: Classes of a block of cells and of a block of queries: what one task holds.
BLOCK_ROWS = 4_096
#: Blocks of cells at least, so that small tables use more than one task.
LEAST_BLOCKS = 8
CELLS = 256
DENSE = 512
#: Queries whose bounds are held at once.
QUERY_STEP = 256


def bounds(cells: np.ndarray, queries: np.ndarray, low: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower bound of the inner product of each query with each row of cells (signed bytes), and each query's gap to the upper one.

    Integers: the largest value of a cell is width - 1 above its floor. The product of the cells is taken in single
    precision, and the gap has room for its rounding.
    """
    product = queries.astype(np.float32) @ (cells.astype(np.float32) + np.float32(CELLS // 2)).T
    size = np.abs(queries).sum(axis=1)
    rounding = width * size * CELLS * (queries.shape[1] + 2) * 2.0**-22
    at_floor = width * product.astype(np.float64) + (low * queries.sum(axis=1))[:, None]
    down = np.where(queries < 0, queries, 0.0).sum(axis=1) * (width - 1.0) - rounding
    return at_floor + down[:, None], size * (width - 1.0) + 2 * rounding


def _matrix(rows: pd.Series, dtype: type) -> np.ndarray:
    return np.array(rows.tolist(), dtype=dtype).reshape(len(rows), -1)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v array<double> of floor(1024 * x), dims; rows with null or non-finite components go."""
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = embeddings.select("vec_id", "embedding").filter(good & F.col("vec_id").isNotNull())
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024.0).cast("double"))
    return rows.select("vec_id", scaled.alias("v"), F.size("embedding").alias("dims"))


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("klass"), F.lit(n)).cast("int")


def _scan(classes: DataFrame, asked: DataFrame, k: int, blocks: int, query_blocks: int) -> DataFrame:
    """q, c, upper of what the bounds leave; q, block alone where they leave a block dense."""
    low, high = classes.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, high = low or 0.0, high or 0.0
    width = float((high - low) // CELLS + 1)
    cell = F.transform("v", lambda x: (F.floor((x - low) / width) - CELLS // 2).cast("tinyint"))
    cells = stash(classes.select("klass", "dims", cell.alias("cells"), _block(blocks).alias("block")), "cells")
    left = cells.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.select("klass", "dims", "v", _block(query_blocks).alias("query_block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scan(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            ids, own = candidates["klass"].to_numpy(), _matrix(candidates["cells"], np.int8)
            wanted = min(k + 1, len(ids))
            for at in range(0, len(queries), QUERY_STEP):
                part = queries.iloc[at : at + QUERY_STEP]
                lower, gap = bounds(own, _matrix(part["v"], np.float64), low, width)
                kth = np.partition(lower, len(ids) - wanted, axis=1)[:, len(ids) - wanted]
                near = lower >= (kth - gap)[:, None]
                dense = near.sum(axis=1) > DENSE
                q = part["klass"].to_numpy()
                i, j = np.nonzero(near & ~dense[:, None])
                out.append(pd.DataFrame({"q": q[i], "c": ids[j], "upper": lower[i, j] + gap[i]}))
                out.append(pd.DataFrame({"q": q[dense]}))
        found = pd.concat(out) if out else pd.DataFrame({"q": []})
        found = found.reindex(columns=["q", "c", "upper"]).astype({"q": "int64", "c": "Int64", "upper": "float64"})
        return found.assign(block=np.int32(key[1]))

    keys = ["dims", "block", "query_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "q long, c long, upper double, block int")


def _exact_blocks(dense: DataFrame, classes: DataFrame, asked: DataFrame, k: int, blocks: int, query_blocks: int) -> DataFrame:
    """q, c, score: the best k + 1 classes of a block for each row of dense(q, block)."""
    right = stash(dense.join(asked.select(F.col("klass").alias("q"), "dims", "v", _block(query_blocks).alias("query_block")), "q"), "asked-exactly")
    met = right.select("dims", "block", "query_block").distinct()
    left = classes.select("klass", "dims", "v", "first", _block(blocks).alias("block")).join(met.toDF(*[f"met_{c}" for c in met.columns]), (F.col("dims") == F.col("met_dims")) & (F.col("block") == F.col("met_block")))
    left = left.select("dims", "block", F.col("met_query_block").alias("query_block"), "klass", "v", "first")

    def compare(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            candidates = candidates.iloc[np.lexsort([[x[f] for x in candidates["first"]] for f in ("row", "vec_id")])]
            ids, own = candidates["klass"].to_numpy(), _matrix(candidates["v"], np.float64)
            for at in range(0, len(queries), QUERY_STEP):
                part = queries.iloc[at : at + QUERY_STEP]
                score = _matrix(part["v"], np.float64) @ own.T
                for q, scores in zip(part["q"], score, strict=True):
                    best = np.argsort(-scores, kind="stable")[: k + 1]
                    out.append(pd.DataFrame({"q": q, "c": ids[best], "score": scores[best].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "c": [], "score": []}, dtype="int64")

    keys = ["dims", "block", "query_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda _, a, b: compare(a, b), "q long, c long, score long")


def _read_exact(pairs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """q, c, score of pairs(q, c): only now are the candidates' exact vectors read."""
    met = pairs.select("q", "c").join(classes.select(F.col("klass").alias("c"), F.col("v").alias("cv")), "c")
    met = met.join(asked.select(F.col("klass").alias("q"), F.col("v").alias("qv")), "q")
    product = F.aggregate(F.zip_with("cv", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return met.select("q", "c", product.cast("long").alias("score"))


def nearest_classes(classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, c, score: for each class of asked(klass, dims, v), k + 1 classes that hold its k + 1 best rows.

    classes(klass, dims, v, first) with first(vec_id, row), the class's first row, which decides ties.
    """
    blocks = max(LEAST_BLOCKS, -(-classes.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    found = stash(_scan(classes, asked, k, blocks, query_blocks), "bounds")
    by_bound = Window.partitionBy("q").orderBy(F.desc("upper"), "c")
    left = found.filter("c is not null")
    first = stash(_read_exact(left.withColumn("place", F.row_number().over(by_bound)).filter(F.col("place") <= k + 1), classes, asked), "read")
    dense = found.filter("c is null").select("q", "block")
    known = first
    if dense.limit(1).count():
        known = first.unionByName(stash(_exact_blocks(dense, classes, asked, k, blocks, query_blocks), "dense"))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    certain = known.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") == k + 1).select("q", F.col("score").alias("kth"))
    # a query with k known classes or fewer has read all there are
    rest = left.join(certain, "q").filter(F.col("upper") >= F.col("kth")).join(first.select("q", "c"), ["q", "c"], "left_anti")
    every = known.unionByName(_read_exact(rest, classes, asked)).join(classes.select(F.col("klass").alias("c"), "first"), "c")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    return every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).select("q", "c", "score")


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k best other rows.

    Null vectors, vectors with null or non-finite components and null ids take no part; vectors of another length
    are never compared; repeated rows of one vec_id are queries and candidates each for itself: each gets its own k
    rows, the other among them; fewer than k others give all; ties go to the smaller vec_id; empty vectors score 0;
    other columns are ignored; no rows give no rows. Scores must stay below 2**53.
    """
    prepare_python(embeddings.sparkSession)
    # row tells repeated rows apart; it is read from the stored table ever after
    rows = stash(integer_vectors(embeddings).withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("v")), "vectors")
    first_rows = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id", "row"))
    members = F.array_sort(F.collect_list(F.struct("vec_id", "row")))  # k + 1 at most
    classes = rows.withColumn("place", first_rows).filter(F.col("place") <= k + 1).groupBy("h", "v").agg(members.alias("members"), F.first("dims").alias("dims"))
    classes = stash(classes.select(F.monotonically_increasing_id().alias("klass"), "h", "v", "dims", "members", F.col("members")[0].alias("first")), "classes")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "row", "h", "v")
    sizes = stash(queries.groupBy("h", "v").agg(F.count("*").alias("n")), "sizes")
    asked = stash(sizes.join(classes, ["h", "v"]).select("klass", "h", "v", "dims"), "asked")
    near = nearest_classes(classes, asked, k).join(classes.select(F.col("klass").alias("c"), "members"), "c")
    hits = near.select("q", "score", F.explode("members").alias("m")).select("q", F.struct((-F.col("score")).alias("down"), "m.vec_id", "m.row").alias("hit"))
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("hit"))).filter(F.col("place") <= k + 1)
    answers = best.groupBy("q").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    answers = answers.join(asked.select(F.col("klass").alias("q"), "h", "v"), "q").select("h", "v", "hits")
    answered = join_spread(queries.withColumnRenamed("vec_id", "query_id"), answers, sizes, ["h", "v"], F.col("row"), queries.count())
    own = F.slice(F.filter("hits", lambda x: x["row"] != F.col("row")), 1, k)
    out = answered.select("query_id", F.posexplode(own).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.down")).alias("score"))
