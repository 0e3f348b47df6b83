import pytest
from pyspark.sql import functions as F

from lineweave.llm import decontaminate, simhash_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "simhash_dedup", "decontamination", "packing"]
    extra = spark.createDataFrame([(9001, None), (9002, "12 34")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    kept = stages["language_id"](spark, docs.unionByName(extra), SMALL)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    single = stages["simhash_dedup"](spark, docs.unionByName(docs), SMALL)
    firsts = {r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(firsts)
    clean = stages["toxicity"](spark, docs, SMALL).join(labels, "doc_id")
    assert clean.filter("toxic = 0").count() >= 0.95 * labels.filter("toxic = 0").count()


def test_stages_decide_by_row(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("text is not null").orderBy("item_id").first()["text"]
    # null ids, and an id with several texts; one text twice under each
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (7, words[2]), (7, words[3]), (7, words[3]), (8, words[3]), (None, words[2]), (None, benchmark), (7, benchmark)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    single = stages["simhash_dedup"](spark, docs, SMALL)
    assert single.columns == docs.columns
    wanted = [(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (7, benchmark)]
    assert sorted(((r["doc_id"], r["text"]) for r in single.collect()), key=order) == sorted(wanted, key=order)
    clean = stages["decontamination"](spark, docs, SMALL)
    assert clean.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=order) == sorted(rows[:-2], key=order)


def test_run_keeps_what_every_stage_keeps(spark):
    """run() against the operators one by one: what each finds in its input decides who goes on."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), docs
    for name, stage in list(stages.items())[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, SMALL).collect(), docs.schema)
        gone = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()}
        if name == "simhash_dedup":
            assert gone == {r["doc_id"] for r in simhash_dedup.near_duplicates(before).collect() if r["component_id"] != r["doc_id"]}
        if name == "decontamination":
            benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            assert gone == {r["doc_id"] for r in decontaminate.decontaminate(before, benchmark).filter("contaminated").collect()}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in kept.select("doc_id").collect()}
    assert sum(r["start"] == 0 for r in pieces) == kept.count()


def test_stages_on_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        odd = docs.withColumns({c: F.lit("clash") for c in ("label", "fp", "row", "words", "pos", "score", "language", "n")})
        got = stage(spark, odd, SMALL)
        assert name == "packing" or got.columns == odd.columns
        assert got.count() > 0


def test_copies_that_differ_in_other_columns_have_one_answer(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "fr", "b", 1), (5, text, "en", "z", 2), (5, text, "en", "a", 3), (5, text, None, "c", 4), (6, text, None, None, 5), (None, "", "en", "s", 6), (None, "", "de", "s", 7), (None, "", "de", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    for order in (docs, docs.orderBy(F.desc("n_chars")), docs.repartition(7)):
        assert sorted((tuple(r) for r in stage(spark, order, SMALL).collect()), key=repr) == sorted([rows[3], rows[7]], key=repr)
