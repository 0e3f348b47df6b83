"""Two sides of a lookup derived from a documents table: even documents are scripts, odd ones string tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import spread
from ..functions import text as X

#: No array, so no document, has as many lines; ids keep the read order. Document ids are below 2**32.
LINES = 2**31


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _side(lines: DataFrame, path: str, id_name: str) -> DataFrame:
    return lines.select(
        (F.col("doc_id") * LINES + F.col("pos") + 1).alias(id_name), F.lit(path).alias("path"), F.col("doc_id").cast("string").alias("sheet"), (F.col("pos") + 1).alias("row"),
        X.match_key(F.col("line")).alias("text"), F.col("line").alias("original"), F.col("lang").alias("speaker"), "doc_id",
    ).filter("text <> ''")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, path, sheet, row, text, original, speaker, korean (null where missing), korean_key, plain_text."""
    rows = _side(document_lines(spark, sf_dir).filter("doc_id % 2 = 0"), "source", "source_id")
    korean = F.when(F.col("doc_id") % 7 != 0, F.concat_ws("|", "speaker", (F.col("doc_id") % 3).cast("string")))
    rows = rows.withColumn("korean", korean)
    return rows.withColumn("korean_key", X.match_key(F.col("korean"))).withColumn("plain_text", X.plain_key(F.col("original"))).drop("doc_id")


def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """baseline_id, path, sheet, row, text, original, speaker, plain_text."""
    rows = _side(document_lines(spark, sf_dir).filter("doc_id % 2 = 1"), "baseline", "baseline_id")
    return rows.withColumn("plain_text", X.plain_key(F.col("original"))).drop("doc_id")


def with_read_order(rows: DataFrame, name: str) -> DataFrame:
    """A number for each row in the order files (case-folded path), sheets and rows are read in, from 1.

    rows(path, sheet_index, row). Rows are numbered within their sheet, sheets within their file and files among each
    other, by sums of counts, so that no task gets more than one sheet or one row for each file.
    """
    sheets = rows.groupBy(F.lower("path").alias("__file"), "sheet_index").agg(F.count("*").alias("__n"))
    in_file = Window.partitionBy("__file").orderBy("sheet_index").rowsBetween(Window.unboundedPreceding, -1)
    files = sheets.groupBy("__file").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("__file", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    offsets = sheets.withColumn("__before", F.coalesce(F.sum("__n").over(in_file), F.lit(0))).join(starts, "__file").select("__file", "sheet_index", (F.col("__before") + F.col("__start")).alias("__offset"))
    own = Window.partitionBy("__file", "sheet_index").orderBy("row")
    placed = rows.withColumn("__file", F.lower("path")).join(offsets, ["__file", "sheet_index"])
    return placed.withColumn(name, F.row_number().over(own) + F.col("__offset")).drop("__file", "__offset")
