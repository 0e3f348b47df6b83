"""Filter interaction audit: what five filters remove in every order in which they can be applied.

A document's failures are a mask of five bits, so documents are first counted by part and mask. Each such cell then
folds across the array of all orders (a constant, the same for every row): `aggregate` walks an order's filters and
carries whether the cell was removed before, `transform` does so for each order. This gives a cell 600 structs of
0/1 flags and counts, weighted by its documents; the cells of a part, at most 32, are merged by elementwise sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER

FILTERS = "ABCDE"
#: White space of the filters' words, and the marks of filter D.
BLANK, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: Documents without an id are dealt over so many keys where they meet the labels.
SALTS = 256


def text_mask(text: Column, words: Column) -> Column:
    """Bits of filters A to D (A is bit 0) for a text and its words."""
    n_words = F.size(words)
    failed = [
        n_words < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n_words,
        100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > CAPITALS_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]
    return sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(failed)), F.lit(0))


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and its mask of filters A to D, one short row for each of docs."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", F.array_remove(F.split("__text", BLANK), ""))
    return rows.select("doc_id", "part", F.unhex(F.sha2("__text", 256)).alias("digest"), text_mask(F.col("__text"), F.col("__words")).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five bits), n, n_good, n_toxic: the documents of each part by the filters that they fail.

    Rows are counted by (id, text, part) first, so copies and repeated rows travel as counts. Copies of a text then
    become one row for each part and pair of labels: their number, and how many of them carry the smallest id.
    """
    rows = masked(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).otherwise(-1)
    rows, marks = rows.withColumn("__salt", salt), marks.withColumn("__label_salt", F.lit(-1))
    rows = rows.join(marks, (F.col("doc_id") == F.col("__id")) & (F.col("__salt") == F.col("__label_salt")), "left")
    rows = rows.select("doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_free"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first")
    )
    smallest = F.min("first").over(Window.partitionBy("digest"))
    kept = F.col("n_free") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    counted = copies.withColumn("smallest", smallest).select("part", "mask", "good", "toxic", kept.alias("first_of"), (F.col("n") - kept).alias("later"))
    both = F.array(F.struct(F.col("mask").alias("m"), F.col("first_of").alias("k")), F.struct((F.col("mask") + 16).alias("m"), F.col("later").alias("k")))
    each = counted.select("part", "good", "toxic", F.explode(both).alias("c")).filter("c.k > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("c.k")).otherwise(0))
    return each.groupBy("part", F.col("c.m").alias("mask")).agg(F.sum("c.k").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


def order_steps(cell: Column, orders: Column) -> Column:
    """The measures of one cell(mask, n, n_good, n_toxic) after each step of each order, one array of structs."""

    def step(state: Column, f: Column) -> Column:
        fails = F.getbit(cell["mask"], f) == 1
        removed, redundant = fails & ~state["gone"], fails & state["gone"]
        count = lambda flag, n: F.when(flag, cell[n]).otherwise(F.lit(0).cast("long"))
        measures = [
            count(~(state["gone"] | fails), "n"), count(removed, "n"), count(redundant, "n"),
            count(fails & (F.bit_count(cell["mask"]) == 1), "n"), count(removed, "n_good"), count(removed, "n_toxic"),
        ]
        found = F.struct(*(m.alias(name) for m, name in zip(measures, MEASURES, strict=True)))
        return F.struct((state["gone"] | fails).alias("gone"), F.array_append(state["steps"], found).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(_STEPS).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


_STEPS = f"array<struct<{', '.join(f'{m}: bigint' for m in MEASURES)}>>"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every order of the five filters, 600 rows for each part of docs.

    docs(doc_id, text, source, ...) and labels(doc_id, quality, toxic, ...); other columns are ignored. A null text is
    the empty one, a null source the part ''. E compares whole texts by SHA-256; a row without an id has no smaller
    id beside it, never fails E and has no labels. Rows that repeat an id and text count each, as copies do not of
    themselves. Of several labels for an id any that says so marks it. No documents give no rows.
    """
    names = ["".join(p) for p in permutations(FILTERS)]
    orders = F.lit([[FILTERS.index(f) for f in name] for name in names])
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))
    zero = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(m) for m in MEASURES)), len(names) * len(FILTERS))
    plus = lambda a, b: F.struct(*((a[m] + b[m]).alias(m) for m in MEASURES))
    merged = parts.select("part", F.aggregate("cells", zero, lambda total, cell: F.zip_with(total, order_steps(cell, orders), plus)).alias("steps"))
    rows = merged.select("part", F.posexplode("steps").alias("at", "m"))
    at_step = F.col("at") % len(FILTERS)
    order = F.element_at(F.lit(names), (F.floor(F.col("at") / len(FILTERS)) + 1).cast("int"))
    rows = rows.select("part", order.alias("filter_order"), (at_step + 1).cast("int").alias("step"), "m.*").withColumn("__filter", F.expr("substring(filter_order, step, 1)"))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "__filter"))).drop("__filter")
