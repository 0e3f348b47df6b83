"""What a job needs of the cluster: this package on the executors, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_sent: set[str] = set()
#: Rows of one key that one task joins, at least; and how many keys may have more than their share.
HOT_ROWS = 1_000
HOT_KEYS = 5_000
#: A key with more pairs than this part of all pairs is split; fewer pairs than PAIRS are one task's work.
PAIR_SHARES, PAIRS = 64, 1_000_000


def send_package(spark: SparkSession) -> None:
    """Once for each application; the executors get the file from the driver, not from a shared folder."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that later rounds do not repeat earlier ones."""
    path = f"{shared_dir(df.sparkSession)}/lineweave-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt out anew if its rows lie in fewer partitions than there are cores (a file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.select(F.spark_partition_id()).distinct().count() < cores else df


def join_spread(rows: DataFrame, table: DataFrame, sizes: DataFrame, keys: list[str], spread: Column, total: int, how: str = "inner") -> DataFrame:
    """rows, many for each key, joined with table, few for each key; no task gets a hot key's rows alone.

    sizes(keys, n) counts the rows of each key and total those of all; `spread` differs among rows of a key. Keys
    with more than total / HOT_KEYS rows (HOT_ROWS at least) are split, and only those entries of table repeated:
    there are fewer than HOT_KEYS of them, a proven bound for the broadcast.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(sizes.filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__salts")
    right = table.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def all_pairs(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Every row of rows with every row of table of the same keys, which is a list of pairs: many of both for a key.

    Pairs are counted before: a key with more than a 64th of them (PAIRS at least) is dealt to several tasks by
    `spread`, and its entries of table are repeated for each; fewer than 64 keys are so, a proven bound for the broadcast.
    """
    held = table.groupBy(*keys).agg(F.count("*").alias("__m"))
    sizes = settle(rows.groupBy(*keys).agg(F.count("*").alias("__n")).join(held, keys).select(*keys, (F.col("__n") * F.col("__m")).alias("n")).filter(F.col("n") > PAIRS), "pairs")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(PAIRS, total // PAIR_SHARES)
    hot = F.broadcast(sizes.filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__salts")
    right = table.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")
