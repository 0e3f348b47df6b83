"""Pipeline over documents: toxicity, language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and fits its models on them.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import decontaminate, language_id, packing, simhash_dedup, toxicity
from lineweave.llm.common import prepare_python, read_table, stash
from lineweave.llm.queries import word_vocabulary

#: Documents that score this or more are toxic.
TOXIC = 0.7
#: Documents whose language is undetermined, or less sure than this, go.
LANGUAGE_SURE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_python(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(spark, model, F.col("text")) < TOXIC)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare_python(spark)
    model = language_id.train(docs)
    found = language_id.language_column(spark, model, F.col("text"))
    kept = docs.withColumn("__language", found).filter((F.col("__language.lang_pred") != language_id.UNDETERMINED) & (F.col("__language.score") >= LANGUAGE_SURE))
    return kept.drop("__language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component stays, null ids last; of repeated rows, the smallest
    by their other columns.

    Rows are known by doc_id and text, so that rows which share an id, or have none, are decided each for itself.
    """
    found = simhash_dedup.labelled(docs)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("__first"), F.col("first.text_hash").alias("__first_hash"))
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("__hash") == F.col("__first_hash")), "left_semi")
    # repeated rows may differ in other columns: the smallest by all of them stays, whatever task sees it first
    others = [c for c in docs.columns if c != "doc_id"]
    one = kept.groupBy("doc_id", "__hash").agg(F.min(F.struct(*others)).alias("__row"))
    return one.select(*[F.col(c) if c == "doc_id" else F.col(f"__row.{c}") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text is contaminated go, whatever other rows share their doc_id or have none either."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_key.doc_id").alias("__bad"), F.col("doc_key.text_hash").alias("__bad_hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")) & (F.xxhash64("text") == F.col("__bad_hash")), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained models and fingerprints are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
