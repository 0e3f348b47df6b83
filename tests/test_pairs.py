import random

import duckdb
import pytest

import __spark_entry__ as entry
from lineweave import cluster
from lineweave.operators import proposals
from lineweave.plans import lookup

LISTS = ["j7_whole_line_pairs", "j10_segment_targets", "j11_neighbour_evidence", "j28_pair_details", "w4_context_score"]


@pytest.fixture(scope="module")
def frequent(spark, tmp_path_factory):
    """Documents of few different lines, some of them empty, tagged or in blocks that occur once."""
    at, pick = str(tmp_path_factory.mktemp("frequent")), random.Random(5)
    texts = ["\n".join(pick.choice(["a", "a", "a", "b", "c", "<i>a</i>", "", f"one {n}"]) for _ in range(pick.randint(1, 9))) for n in range(40)]
    docs = [(n, text, pick.choice(["xx", "yy"])) for n, text in enumerate(texts + texts[1::4] + texts[:12])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", LISTS)
def test_lists_of_pairs_split_frequent_lines(spark, frequent, monkeypatch, name):
    monkeypatch.setattr(cluster, "PAIRS", 5)
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{frequent}/documents.parquet/*.parquet'")
    wanted = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    found = entry.queries()[name](spark, frequent).select(*columns)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted.fetchall(), key=key)
    # the pairs are neither counted nor shuffled by the ids of their rows after they are made
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_id" not in plan and "functions=[partial_count(distinct baseline_id" not in plan


def test_propagated_rows_are_made_once(spark):
    """Rows of one case take its proposals by one join; no distinct runs over the result, and none is lost or doubled."""
    rows = [(i, "b", "s", 2 * i, f"item_{i}", "a long line" if i % 3 else "short", ["x"] if i % 2 else []) for i in range(60)]
    baseline = spark.createDataFrame(rows, "baseline_id long, path string, sheet string, row int, key string, loose string, roles array<string>")
    made = spark.createDataFrame([(i % 3, i, "t") for i in range(0, 60, 5)], "source_id long, baseline_id long, korean string")
    found = proposals.propagate(made, baseline)
    placed = {(s, b) for s, b, _ in map(tuple, made.collect())}
    taken = {b for _, b in placed}
    fits = lambda x, y: not rows[x][6] or not rows[y][6] or rows[x][6] == rows[y][6]
    wanted = {(s, y, "t") for s, x in placed for y in range(60) if y not in taken and rows[x][5] == rows[y][5] != "short" and fits(x, y)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted
    assert "keys=[source_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_breath_pairs_need_no_distinct(spark):
    texts = ["(x) go", "go", "go (y)", "(x)", "stay", "(z) stay"]
    rows = lambda name: spark.createDataFrame([(i, t, t) for i, t in enumerate(texts * 2)], f"{name} long, text string, plain_text string")
    found = lookup.breath_pairs(rows("baseline_id"), rows("source_id"))
    keys = {r["baseline_id"]: (r["text"], r["breath"]) for r in lookup.with_keys(rows("baseline_id")).collect()}
    wanted = [(i, j) for i, (t, n) in keys.items() for j, (u, m) in keys.items() if t == u or (n == m and n != "")]
    assert sorted(map(tuple, found.select("baseline_id", "source_id").collect())) == sorted(wanted) and len(wanted) > 2 * len(keys)
    assert "Aggregate [baseline_id" not in found._jdf.queryExecution().optimizedPlan().toString()
