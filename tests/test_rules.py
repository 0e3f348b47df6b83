import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lineweave.functions import segments as S
from lineweave.functions import text as X
from lineweave.operators import proposals, rows, segments
from lineweave.sources import outputs

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f9_baseline_columns", "w3_context_with_skips", "j10_segment_targets", "d3_merge_assessment", "d4_merge_overlaps", "j23_propagated_proposals", "j30_key_audit", "snk2_paged_details", "src5_fill_entries", "lookup_cascade", "j4_tail_round", "j15_unique_text", "j17_context_choice", "j21_option_choice", "u2_distinct_variants", "a3_structure_counts", "a4_full_statistics", "l2_read_order", "src2_cells", "src4_reviews", "f1_header_hits", "f2_sheet_verdict", "f4_scan_switches", "f10_optional_columns", "snk4_fill_log", "j11_neighbour_evidence", "j9_split_lines", "w4_walk_over_skips", "x30_column_letters", "j27_structure_sources", "f7_rollback_by_kind"])
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "orders", "lineitem", "conversations", "nation", "part"):
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    found, wanted = entry.queries()[name](spark, SMALL), connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, found.select(*columns).collect()), key=key) == sorted(wanted.fetchall(), key=key)


def test_split_patterns():
    (numbered,) = S.pattern_list("1. one 2．two 3.5")
    assert (numbered["rule"], numbered["labels"], numbered["parts"], numbered["issues"]) == ("number", ["1", "2"], [" one ", "two 3.5"], [])
    (lettered,) = S.pattern_list("x (A) one (C)")
    assert (lettered["rule"], lettered["prefix"], lettered["issues"]) == ("letter", "x ", ["text_before", "not_consecutive", "empty_part"])
    assert S.pattern_list("1.a B.b")[0]["issues"] == ["mixed_labels"]
    assert [p["rule"] for p in S.pattern_list("a\nb\\nc")] == ["mixed_break"]
    assert S.pattern_list("abc") == S.pattern_list(None) == []
    text = "a\\nb\r\nc"
    (broken,) = S.pattern_list(text)
    assert [text[s["start"] : s["end"]] for s in broken["spans"]] == broken["parts"] == ["a", "b", "c"]


def test_split_translation(spark):
    cases = [
        ("1.甲{a} 2.乙", "1.가{a} 2.나", (["甲{a} ", "乙"], ["가{a} ", "나"], "")), ("1.甲 2.乙", "1.가 3.나", ([], [], "translation: not_consecutive")),
        ("1.甲{a} 2.乙", "1.가 2.나", ([], [], "placeholders")), ("\n甲\n乙\n", "가\n나", (["甲", "乙"], ["가", "나"], "")), ("甲\n乙", "가\n나\n다", ([], [], "unequal")),
        ("A.甲 B.乙", "A.가 B.나", ([], [], "line: no_cut")), ("甲\n<color=1>乙", "가\n나", ([], [], "tags")), (None, None, ([], [], "line: no_cut")),
        ("1.甲 2.乙", "가\n나", ([], [], "translation: no_cut")), ("甲\n乙", "1.가\n3.나", ([], [], "labels_disagree")), ("\n甲\n", "가\n나", ([], [], "line: one_part")), ("甲\n \n乙", "가\n나", ([], [], "line: empty_part")),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "id int, a string, b string")
    df = df.select("id", S.split_patterns(F.col("a")).alias("a"), S.split_patterns(F.col("b")).alias("b"))
    got = segments.split_translation(df, "a", "b").orderBy("id").collect()
    assert [(r["parts"], r["translations"], r["reason"]) for r in got] == [c[2] for c in cases]


def test_spaces_after_sentences():
    assert S.spaced('하나.둘…셋!"넷 3.5 a.b 다?라') == '하나. 둘… 셋!" 넷 3.5 a.b 다?라'
    assert S.spaced("끝.<b>나</b>.{x}") == "끝.<b> 나</b>. {x}"
    for text in ("a!b.c…d", "가.\n나", None, ""):
        assert S.spaced(S.spaced(text)) == S.spaced(text)


def test_speaker_of_file_name(spark):
    cases = {"a/x_P12_小明(男)_角色文档.xlsx": "小明", "主人公_男_P1_主人公_角色文档.xlsx": "男主角", "x\\주인공_여_P2_주인공_캐릭터.xlsx": "女主角", "小红_角色文档.xlsx": "小红", "x_P12_小明.xlsx": "", "主人公_남_P1_主人公_角色文档.xlsx": "主人公", None: ""}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "id int, name string")
    assert [r[1] for r in df.select("id", S.filename_speaker(F.col("name"))).orderBy("id").collect()] == list(cases.values())


def test_common_subsequence_equals_brute_force():
    def longest(a, b):
        return next(n for n in range(len(a), -1, -1) for c in itertools.combinations(a, n) if n == 0 or _is_subsequence(c, b))

    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in "ab")
        assert X.lcs_similarity(a, b) == 2 * longest(a, b) / (len(a) + len(b))


def _is_subsequence(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_orders_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        a, b = (rng.choices("xyz", k=rng.randint(0, 5)) for _ in "ab")
        whole = [p for p in itertools.combinations(range(len(b)), len(a)) if all(x == b[i] for x, i in zip(a, p, strict=True))]
        assert proposals.only_order(a, b) == (list(enumerate(whole[0])) if len(whole) == 1 and a else [])
        value = lambda pairs: sum(1000 - round(100 * abs((i + 1) / (len(a) + 1) - (j + 1) / (len(b) + 1))) for i, j in pairs)  # noqa: B023, E731
        every = [list(zip(s, t, strict=True)) for n in range(min(len(a), len(b)) + 1) for s in itertools.combinations(range(len(a)), n) for t in itertools.combinations(range(len(b)), n)]
        assert value(proposals.best_order(a, b)) == max(value(p) for p in every if all(a[i] == b[j] for i, j in p))


def test_gaps_are_aligned_one_by_one(spark):
    s = spark.createDataFrame([("g", i, i, x) for i, x in enumerate("abca")] + [("h", 1, 90, "a"), ("wide", 1, 91, "a")], "gap string, row int, source_id long, loose string")
    t = spark.createDataFrame([("g", i, 10 + i, x) for i, x in enumerate("bxa")] + [("h", 1, 80, "b")] + [("wide", i, 1000 + i, "a") for i in range(61)], "gap string, row int, baseline_id long, loose string")
    assert sorted(map(tuple, proposals.between_anchors(s, t).collect())) == [(1, 10), (3, 12)]
    assert proposals.beside_anchor(s, t).count() == 0


def test_similar_unique_equals_brute_force(spark):
    """All allowed rows at .9 or more must be one row of one text, not only the most similar ones."""
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefgh", k=20)) for _ in range(30)]
    base += [t[:6] + "z" + t[7:] for t in base[:8]] + base[8:12]
    src = [t[:5] + rng.choice("abz") + t[6:] for t in base] + [base[0], "abc", ""]
    role = lambda k: [["ann"], ["bob"], []][k % 3]
    s = [(k, t, role(k)) for k, t in enumerate(src)]
    b = [(100 + k, t, role(k // 2)) for k, t in enumerate(base)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, loose string, roles array<string>")
    got = {r["source_id"]: (r["baseline_id"], round(r["score"], 9)) for r in proposals.similar_unique(frame(s, "source_id"), frame(b, "baseline_id")).collect()}
    want = {}
    for i, t, roles in s:
        near = [(j, u, m) for j, u, other in b if len(t) >= 6 and (not roles or not other or set(roles) & set(other)) and (m := X.lcs_similarity(u, t)) >= 0.9]
        if len({u for _, u, _ in near}) == 1 and len(near) == 1:
            want[i] = (near[0][0], round(near[0][2], 9))
    assert got == want and len(want) > 5


def test_similar_unique_needs_one_text(spark):
    s = spark.createDataFrame([(1, "abcdefghijklmnopqrst")], "source_id long, loose string")
    b = spark.createDataFrame([(1, "abcdefghijklmnopqrst"), (2, "abcdefghijklmnopqrsx")], "baseline_id long, loose string")
    assert proposals.similar_unique(s, b).count() == 0
    assert proposals.similar_unique(s, b.limit(1)).count() == 1


def test_trial_merge(spark):
    cases = [
        (["好", "吗{x}"], ["네.", "정말{x}"], "好吗{x}", ("네. 정말{x}", "")), (["好"], ["네"], "坏", (None, "not_covered")), (["…", "1"], ["…", "1"], "…1", (None, "no_letters")),
        (["好", "吗"], ["네", None], "好吗", (None, "missing")), (["好{x}"], ["네"], "好{x}", (None, "placeholders")), (["<color=1>好", "吗</color>"], ["네", "네"], "好吗", (None, "tags")),
    ]
    df = spark.createDataFrame([(i, o, t, b) for i, (o, t, b, _) in enumerate(cases)], "id int, o array<string>, t array<string>, b string")
    got = df.select("id", segments.trial_merge(F.col("o"), F.col("t"), F.col("b")).alias("r")).orderBy("id").collect()
    assert [(r["r"]["translation"], r["r"]["reason"]) for r in got] == [c[3] for c in cases]


def test_two_selected_merges_are_both_pending(spark):
    row = {"conflict": "", "error": "", "stale": False, "shared": False, "excerpt": False, "anchored": False}
    made = [row | {"baseline_id": 1, "candidate": 1, "decision": "yes"}, row | {"baseline_id": 1, "candidate": 2, "decision": "yes"}, row | {"baseline_id": 2, "candidate": 3, "decision": None, "anchored": True}, row | {"baseline_id": 3, "candidate": 4, "decision": "no", "conflict": "x"}]
    df = spark.createDataFrame([tuple(m.values()) for m in made], "conflict string, error string, stale boolean, shared boolean, excerpt boolean, anchored boolean, baseline_id long, candidate long, decision string")
    got = {r["candidate"]: (r["state"], r["reason"]) for r in segments.assess_merges(df).collect()}
    assert got == {1: ("pending", "several_selected"), 2: ("pending", "several_selected"), 3: ("trial", "neighbour"), 4: ("not_applicable", "review")}


def test_publish_leaves_nothing_after_a_failure(spark, tmp_path):
    given, out = tmp_path / "in", tmp_path / "out"
    given.mkdir()
    (given / "a.bin").write_bytes(b"1")
    df = spark.range(3)
    outputs.publish({"t": df}, str(out), [str(given)])
    assert spark.read.parquet(f"{out}/t").count() == 3
    with pytest.raises(ValueError):
        outputs.publish({"t": df}, str(out), [str(given)])
    broken = df.select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        outputs.publish({"t": broken}, str(tmp_path / "other"), [str(given)])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]


def test_existing_results_are_refused(spark):
    cells = spark.createDataFrame([("p", "s", 2, 4, " ", "s"), ("p", "s", 3, 4, "x", "s")], "path string, sheet string, row int, col int, value string, data_type string")
    target = spark.createDataFrame([("p", "s", 4, 1)], "path string, sheet string, col int, header_row int")
    rows.refuse_existing(cells.filter("row = 2"), target)
    with pytest.raises(ValueError):
        rows.refuse_existing(cells, target)


def test_fuzzy_queries_take_long_lines(spark, tmp_path):
    from lineweave import proposal_queries, queries

    line = " ".join(f"word{i}" for i in range(60))
    rows = [(2, "en", f"{line} here"), (3, "en", f"{line} there")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.j6(spark, str(tmp_path)).count() == 1
    assert [r["n"] for r in queries.d5(spark, str(tmp_path)).collect()] == [1]
    assert proposal_queries.j20(spark, str(tmp_path)).count() == 1


def test_rollback_by_kind_of_side(spark):
    cell = "path string, sheet string, row long, col int, value string, data_type string"
    cells = [("s", "a", 1, 1, "台词", "s"), ("s", "a", 3, 1, "=A1", "f"), ("s", "a", 5, 2, "=A1", "f"), ("s", "b", 1, 3, "特殊说明", "s"), ("s", "b", 1, 4, " 特殊说明 ", "s"), ("s", "b", 2, 1, "甲", "s"), ("s", "c", 2, 3, "=A1", "f"), ("s", "d", 2, 1, "=A1", "f"), ("t", "x", 2, 1, "=A1", "f"), ("t", "y", 2, 1, "甲", "s")]
    sheets = [("s", k, "source", 1, 1, 2, 3) for k in "abcd"] + [("t", k, "baseline", 1, 1, None, None) for k in "xy"]
    c = spark.createDataFrame(cells, cell)
    h = spark.createDataFrame(sheets, "path string, sheet string, side string, header_row int, text_column int, korean_column int, scene_column int")
    skipped = spark.createDataFrame([("s", "d", 2)], "path string, sheet string, row long")
    lookup = {tuple(r) for r in rows.rollbacks(c, h, excluded=skipped).collect()}
    assert lookup == {("s", "a", 3, "sheet", "formula"), ("s", "b", 1, "sheet", "several_note_headers"), ("t", "x", 2, "run", "formula")}
    scan = rows.rollbacks(c, h, structure=True, excluded=skipped)
    assert {tuple(r) for r in scan.collect()} == {("s", "a", 3, "sheet", "formula"), ("s", "b", 1, "sheet", "several_note_headers"), ("s", "c", 2, "sheet", "formula"), ("t", "x", 2, "file", "formula")}
    assert {(r["path"], r["sheet"]) for r in rows.keep_readable(h, scan).collect()} == {("s", "d")}
    with pytest.raises(ValueError, match="t, sheet x, row 2"):
        rows.keep_readable(h, rows.rollbacks(c, h))
