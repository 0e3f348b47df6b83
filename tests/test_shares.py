"""Steps that must not cost a call, a row or a pair for each small group."""

import hashlib
import json
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.operators import merges, proposals, segments, structure
from lineweave.plans import key_pass
from lineweave.source_queries import _book
from lineweave.sources import workbook


def test_a_call_walks_a_share_of_the_sheets(spark):
    rows = spark.range(300).select(F.col("id").alias("source_id"), F.lit("a").alias("path"), (F.col("id") % 100).cast("string").alias("sheet"), (-F.col("id")).alias("row"))
    other = rows.filter("source_id < 100").select("path", "sheet", F.col("source_id").alias("x"))

    def walk(rows, other):
        return [(r.source_id, other[0]["x"], ",".join(str(q.source_id) for q in rows)) for r in rows]

    walked = key_pass._by_sheet(rows, other, 300, walk, {"source_id": "long", "x": "long", "seen": "string"})
    got = {r["source_id"]: (r["x"], r["seen"]) for r in walked.collect()}
    assert got == {i: (i % 100, f"{i % 100 + 200},{i % 100 + 100},{i % 100}") for i in range(300)}
    # fewer groups than sheets
    assert "share#" in walked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["1. a 2. b", "A：x B：y", "1_x000D_. a 2\r. b", "１. a 2. b", "no labels", "", None, "1. a", "K. a", "x 1. a 2. b", "1.5 2.5", "1. a\n2. b\\n3. c", "1,a 2,b"])
def test_option_parts_of_texts_that_are_not_asked(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(X.option_parts(F.col("t")).alias("p")).first()["p"]
    assert got == X.option_list(text)


def test_overlaps_equal_brute_force_and_pair_no_owners(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for baseline in range(60):
        for _ in range(rng.choice([1, 1, 1, 2])):
            start, n = rng.randrange(40), n + 1
            rows.append((baseline, n, list(range(start, start + rng.randint(2, 5)))))
    held = Counter(r[0] for r in rows)
    nested = lambda a, b: len(a) < len(b) and a in (b[: len(a)], b[len(b) - len(a) :])
    want = {}
    for baseline, candidate, ids in rows:
        met = [o for o in rows if o[0] != baseline and set(o[2]) & set(ids)]
        shared = any(held[o[0]] > 1 or not (nested(ids, o[2]) or nested(o[2], ids)) for o in met)
        want[candidate] = (shared, not shared and any(len(ids) < len(o[2]) for o in met))
    # many baselines of one list: their pairs would be 9 million
    rows += [(1_000 + k, 1_000 + k, [900, 901]) for k in range(3_000)] + [(5_000, 5_000, [950, 951]), (5_001, 5_001, [950, 951, 952])]
    want |= {1_000 + k: (True, False) for k in range(3_000)} | {5_000: (False, True), 5_001: (False, False)}
    frame = spark.createDataFrame(rows, "baseline_id long, candidate long, ids array<long>")
    out = segments.overlaps(frame)
    assert {r["candidate"]: (r["shared"], r["excerpt"]) for r in out.collect()} == want
    assert len({v for v in want.values()}) == 3
    joins = re.findall(r"Join .*o_candidate", out._jdf.queryExecution().optimizedPlan().toString())
    assert not joins


def test_small_workbooks_share_a_batch(spark):
    books = [(f"{k}.xlsx", True, bytearray(_book([f"line {k}", "", "a<b"]) if k % 5 else b"bad")) for k in range(50)]
    cells = workbook.read_cells(spark.createDataFrame(books, "path string, supported boolean, content binary").coalesce(1))
    got = {(r["path"], r["row"]): (r["value"], r["error"] is None) for r in cells.collect()}
    assert got == {(f"{k}.xlsx", row): (v, True) for k in range(50) if k % 5 for row, v in ((1, f"line {k}"), (2, ""), (3, "a<b"))} | {(f"{k}.xlsx", None): (None, False) for k in range(0, 50, 5)}
    assert "MapInArrow" in cells._jdf.queryExecution().executedPlan().toString()


def test_runs_of_a_frequent_line_carry_no_text(spark):
    rows = spark.range(400).select((F.col("id") % 3 + 1).alias("row"), F.col("id").alias("baseline_id"), F.lit("b").alias("path"), (F.col("id") / 3).cast("int").cast("string").alias("sheet"), F.lit(0).alias("block"), F.lit("x" * 50).alias("comparison"))
    wholes = spark.createDataFrame([(1, "x" * 100), (2, "x" * 100), (3, "x" * 150), (4, "y" * 100), (5, "")], "source_id long, comparison string")
    links = structure.linked_runs(rows, "baseline_id", wholes, "source_id")
    got = Counter((r["source_id"], len(r["ids"])) for r in links.collect())
    assert got == {(1, 2): 266, (2, 2): 266, (3, 3): 133}
    assert "comparison" not in links._jdf.queryExecution().optimizedPlan().toString()


def test_context_overlap_equals_brute_force_without_rows_for_places(spark):
    rng = random.Random(2)
    make = lambda n: [(i, "p", str(i % 7), (i // 7) + (i // 7 > 9) * 2, rng.choice(["a", "b", "c", "d", ""])) for i in range(n)]
    source, baseline = make(150), make(140)
    pairs = [(rng.randrange(155), rng.randrange(145)) for _ in range(300)]
    s, b = {r[0]: r for r in source}, {r[0]: r for r in baseline}
    want = {}
    for x, y in set(pairs):
        near = [0, 0]
        if x in s and y in b:
            for d in (-3, -2, -1, 1, 2, 3):
                texts = {r[4] for r in source if r[2] == s[x][2] and r[3] == s[x][3] + d and r[4]}
                near[d > 0] += any(r[4] in texts for r in baseline if r[2] == b[y][2] and 1 <= (r[3] - b[y][3]) * (1 if d > 0 else -1) <= 5)
        want[x, y] = tuple(near)
    kinds = "path string, sheet string, row int, loose string"
    found = proposals.context_overlap(spark.createDataFrame(pairs, "source_id long, baseline_id long"), spark.createDataFrame(source, f"source_id long, {kinds}"), spark.createDataFrame(baseline, f"baseline_id long, {kinds}"))
    assert {(r["source_id"], r["baseline_id"]): (r["before"], r["after"]) for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_frequent_run_and_line_are_shown_once_each(spark):
    rows = "path string, sheet string, row long, original string, korean string, metadata map<string,string>"
    script = [(10 * n + k, "a", f"s{n}", k, t, t * 2, {"role": "r"}) for n in range(20) for k, t in enumerate(["甲", "乙", "丙"], 1)]
    table = [(10 * n + k, "b", f"t{n}", k, t, "", {"role": "r"}) for n in range(30) for k, t in enumerate(["前", "甲乙"], 1)]
    s, b = (structure.with_blocks(structure.with_comparison(spark.createDataFrame(x, f"{name} long, {rows}"))) for x, name in ((script, "source_id"), (table, "baseline_id")))
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    seen = set(shared.iterdir())
    found = merges.merge_candidates(structure.linked_runs(s, "source_id", b, "baseline_id"), s, b).collect()
    new = {p.name.rsplit("-", 1)[0].removeprefix("lineweave-"): spark.read.parquet(str(p)).count() for p in shared.iterdir() if p not in seen and p.name.startswith("lineweave-merge-")}
    assert (len(found), new["merge-links"], new["merge-lists"], new["merge-targets"]) == (600, 600, 20, 30)
    # the fingerprint is that of the whole JSON
    content = lambda kind, r: {"kind": kind, "path": r[1], "sheet": r[2], "row": r[3], "original": r[4], "korean": r[5], "scene": "", "metadata": [{"key": "role", "value": "r"}]}
    for r in found:
        of = lambda rows, i: next(x for x in rows if x[0] == i)
        n, m = r["ids"][0] // 10, r["baseline_id"] // 10
        everyone = [content("source", of(script, i)) for i in r["ids"]] + [content("baseline", of(table, 10 * m + 2)), content("baseline", of(table, 10 * m + 1)), content("source", of(script, 10 * n + 3))]
        text = json.dumps({"v0": 1, "v1": everyone, "v2": {"before": 0, "after": 0, "anchored_before": False, "anchored_after": False}}, ensure_ascii=False, separators=(",", ":"))
        assert r["fingerprint"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["translation"], r["error"], r["conflict"]) == ("甲甲 乙乙", "", "")
