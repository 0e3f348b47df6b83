"""Result tables: pages, annotated baselines, entries of filled tables, and publishing through a staging folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: Rows of a spreadsheet page, its header included.
PAGE_ROWS = 1_048_576
#: Sheets whose counts are summed in one task.
SHARD = 4096


def numbered(rows: DataFrame, sheet: str, order: str) -> DataFrame:
    """number: place of each row in the order of (sheet, order), from 1; sheet is a whole number.

    Rows are numbered within their sheet, sheets within a shard of 4,096, shards among each other, so that no task
    gets more than one sheet or one shard's counts.
    """
    counts = rows.groupBy(sheet).agg(F.count("*").alias("__n")).withColumn("__shard", F.floor(F.col(sheet) / SHARD))
    inner = Window.partitionBy("__shard").orderBy(sheet).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("__before", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    shards = counts.groupBy("__shard").agg(F.sum("__n").alias("__m"))
    outer = Window.partitionBy(F.lit(0)).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("__shard", F.coalesce(F.sum("__m").over(outer), F.lit(0)).alias("__start"))
    offsets = within.join(starts, "__shard").select(sheet, (F.col("__before") + F.col("__start")).alias("__offset"))
    placed = rows.join(offsets, sheet).withColumn("number", F.row_number().over(Window.partitionBy(sheet).orderBy(order)) + F.col("__offset"))
    return placed.drop("__offset")


def with_page(rows: DataFrame, sheet: str, order: str, row_limit: int = PAGE_ROWS) -> DataFrame:
    """number, page, page_row: pages of at most row_limit rows, one of which is the header."""
    body = row_limit - 1
    at = numbered(rows, sheet, order)
    return at.withColumn("page", F.floor((F.col("number") - 1) / body)).withColumn("page_row", (F.col("number") - 1) % body + 2)


def write_pages(rows: DataFrame, path: str, row_limit: int = PAGE_ROWS) -> None:
    """Rows with `page` as CSV, a folder for each page; the header is there for an empty table too."""
    if rows.limit(1).count():
        rows.write.partitionBy("page").option("header", True).option("maxRecordsPerFile", row_limit - 1).csv(path)
    else:
        rows.drop("page").coalesce(1).write.option("header", True).csv(path)


def annotated_baseline(baseline: DataFrame, source: DataFrame, decisions: DataFrame, shown: int = 3) -> DataFrame:
    """Each baseline row with up to `shown` candidates (only if it has no more), counts, conflict and recommendation.

    Texts with more candidates than shown are left out before the join, so that no frequent line is expanded.
    """
    few = source.filter("text <> ''").groupBy("text").agg(F.count("*").alias("hits")).filter(F.col("hits") <= shown)
    ranked = source.join(few, "text").withColumn("rn", F.row_number().over(Window.partitionBy("text").orderBy("source_id")))
    wide = ranked.groupBy("text").agg(*[F.max(F.when(F.col("rn") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, shown + 1) for c in ("korean_key", "source_id")])
    picked = source.select("source_id", F.col("korean_key").alias("recommended"))
    rows = baseline.select("baseline_id", "text").join(wide, "text", "left").join(decisions.select("baseline_id", "n", "missing", "variants", "source_id", "status"), "baseline_id").join(picked, "source_id", "left")
    conflict = F.when(F.col("n") == 0, "unmatched").when(F.col("variants") > 1, "yes").otherwise("no")
    return rows.withColumn("conflict", conflict).drop("text", "variants")


def fill_entries(cells: DataFrame, headers: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Entries side, path, sheet, row, key, text, translation, is_formula of long cells; and the sheets without a text header.

    headers(path, sheet, header_row, name, col, rank): columns by name; of several columns for one name the smallest
    rank counts, so a result column goes before the older translation.
    """
    best = headers.groupBy("path", "sheet", "header_row", "name").agg(F.min_by("col", "rank").alias("col"))
    met = cells.join(best, ["path", "sheet", "col"]).filter("row > header_row")
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    entries = met.groupBy("path", "sheet", "row").agg(
        X.match_key(value("key")).alias("key"), X.match_key(value("text")).alias("text"), X.match_key(value("translation")).alias("translation"),
        F.max(F.coalesce((F.col("name") == "translation") & (F.col("data_type") == "f"), F.lit(False))).alias("is_formula"),
    )
    known = best.filter("name = 'text'").select("path", "sheet")
    skipped = cells.select("path", "sheet").distinct().join(known, ["path", "sheet"], "left_anti")
    return entries.join(known, ["path", "sheet"], "left_semi").withColumn("side", F.lit(side)), skipped


def _inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")


def publish(tables: dict[str, DataFrame], out: str, inputs: list[str]) -> None:
    """Write named tables to a staging folder, see that no input changed meanwhile, then expose them by one rename.

    Nothing is left at `out` after a failure; an existing `out` is refused.
    """
    spark = next(iter(tables.values())).sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staging = paths(f"{out.rstrip('/')}-staging-{uuid.uuid4().hex}")
    files = staging.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(paths(out)):
        raise ValueError(f"{out} exists")
    before = f"{staging}/_inputs"
    try:
        _inputs(spark, inputs).write.parquet(before)
        for name, table in tables.items():
            table.write.mode("errorifexists").parquet(f"{staging}/{name}")
        seen, now = spark.read.parquet(before), _inputs(spark, inputs)
        if seen.exceptAll(now).limit(1).count() or now.exceptAll(seen).limit(1).count():
            raise ValueError("an input changed during the run")
        files.delete(paths(before), True)
        if not files.rename(staging, paths(out)):
            raise OSError(f"could not rename to {out}")
    except BaseException:
        files.delete(staging, True)
        raise
