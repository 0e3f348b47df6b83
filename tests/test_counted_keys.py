"""Queries that count, or take rows by keys, make no pairs for it; lists of pairs move digests, not texts."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from lineweave import cluster
from lineweave.operators import rounds, segments, structure
from lineweave.plans import lookup


@pytest.fixture(scope="module")
def frequent(spark, tmp_path_factory):
    at, pick = str(tmp_path_factory.mktemp("keys")), random.Random(8)
    lines = ["a", "a", "a (b)", "(c) a", "b", "<i>a</i>", "<b>d</b>", "d", "e (f)", "(e) e", "e", "", " ", "one "]
    texts = ["\n".join(pick.choice(lines) + str(n) * (n % 5 == 0) for _ in range(pick.randint(1, 9))) for n in range(40)]
    docs = [(n, text, pick.choice(["xx", "yy"])) for n, text in enumerate(texts + texts[1::4] + texts[:12])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


def agree(spark, at, name):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{at}/documents.parquet/*.parquet'")
    wanted = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    found = entry.queries()[name](spark, at).select(*columns)
    got, rows = sorted(map(tuple, found.collect()), key=key), sorted(wanted.fetchall(), key=key)
    assert got == rows and rows
    return found


def test_owners_are_counted_by_text(spark, frequent):
    agree(spark, frequent, "w12_owner_counts")
    parts = spark.createDataFrame([(1, 0, "x"), (1, 0, "x"), (1, 1, "x"), (2, 0, "x"), (2, 1, "y")], "source_id long, index int, comparison string")
    rows = spark.createDataFrame([(7, "x"), (8, "x"), (9, "z")], "baseline_id long, comparison string")
    found = segments.owner_counts(parts, rows)
    assert sorted(map(tuple, found.collect())) == [(7, 3), (8, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # nothing is counted after the join, so that it makes no pairs


def test_methods_are_told_by_keys(spark, frequent):
    found = agree(spark, frequent, "a9_methods")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("source_id") == 0  # pairs would hold it
    rows = spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "c", "q"), (4, "", "")], "baseline_id long, text string, plain string")
    source = spark.createDataFrame([(5, "a", "p"), (6, "a", "p"), (7, "x", "")], "source_id long, text string, plain string")
    assert sorted(map(tuple, segments.whole_line_methods(rows, source, ["text", "plain"]).collect())) == [(1, "text"), (2, "plain")]


def test_used_sources_are_told_by_keys(spark, frequent, monkeypatch):
    monkeypatch.setattr(cluster, "PAIRS", 5)
    stored = []
    settle = lookup.settle
    monkeypatch.setattr(lookup, "settle", lambda df, label: stored.append(settle(df, label)) or stored[-1])
    agree(spark, frequent, "j4_tail_round")
    assert all("original" not in x.columns and "form" not in x.columns for x in stored) and stored


@pytest.mark.parametrize("name", ["j1_exact_round", "j3_plain_round"])
def test_candidates_meet_by_digests(spark, frequent, monkeypatch, name):
    monkeypatch.setattr(cluster, "PAIRS", 5)
    found = agree(spark, frequent, name)
    assert "md5(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_walks_store_rows_not_pairs(spark, frequent, monkeypatch):
    monkeypatch.setattr(cluster, "PAIRS", 5)
    stored = []
    settle = rounds.settle
    monkeypatch.setattr(rounds, "settle", lambda df, label: stored.append(settle(df, label)) or stored[-1])
    found = agree(spark, frequent, "w4_walk_over_skips")
    assert found.count() > 500 > max(x.count() for x in stored)
    assert all(x.filter("previous_equal > 0").count() for x in (found,))
    assert "hashpartitioning(baseline_id, source_id" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "module", "step"), [("j28_pair_details", rounds, "scored_pairs"), ("j11_neighbour_evidence", structure, "with_blocks"), ("j10_segment_targets", segments, "segment_targets")])
def test_lines_are_not_shuffled_for_pairs(spark, frequent, monkeypatch, name, module, step):
    """What is sorted, joined and stored by place or id holds digests of 32 characters, no lines."""
    monkeypatch.setattr(cluster, "PAIRS", 5)
    seen, whole = [], getattr(module, step)
    monkeypatch.setattr(module, step, lambda *given: seen.extend(x for x in given if hasattr(x, "columns")) or whole(*given))
    agree(spark, frequent, name)
    for rows in seen:
        assert "original" not in rows.columns
        keys = [c for c in ("text", "comparison") if c in rows.columns]
        assert keys and {len(v) for r in rows.select(*keys).collect() for v in r} <= {0, 32}
