import difflib
import io
import random
import zipfile
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lineweave.functions import similarity
from lineweave.functions import text as X
from lineweave.operators import fuzzy, keys, reports, rounds, structure
from lineweave.sources import workbook


def sides(spark, base, source):
    """base: texts; source: (text, translation)."""
    b = spark.createDataFrame([(i, "b", "s", i, t, t, t) for i, t in enumerate(base, 1)], "baseline_id long, path string, sheet string, row int, text string, original string, plain_text string")
    s = spark.createDataFrame([(i, "a", "s", i, t, t, k, k or "", t) for i, (t, k) in enumerate(source, 1)], "source_id long, path string, sheet string, row int, text string, original string, korean string, korean_key string, plain_text string")
    return b, s


def test_decisions(spark):
    base = ["p", "q", "r", "x", "u", "v", "w", "z", "m", "only"]
    source = [("p", "1"), ("q", "2"), ("r", "3"), ("x", "good"), ("u", "4"), ("v", "5"), ("w", "6"), ("x", "bad"), ("m", None), ("only", "7"), ("only", "7")]
    b, s = sides(spark, base, source)
    got = {r["baseline_id"]: (r["n"], r["missing"], r["variants"], r["source_id"], r["status"]) for r in rounds.match_round(b, s).collect()}
    assert got[4] == (2, 0, 2, 4, "context")
    assert got[8] == (0, 0, 0, None, "unmatched")
    assert got[9] == (1, 1, 0, None, "all_missing")
    assert got[10] == (2, 0, 1, 10, "unique")


def test_ties_stay_pending_and_later_rounds_keep_settled_rows(spark):
    b, s = sides(spark, ["x", "y…"], [("x", "1"), ("x", "2"), ("y...", "3")])
    first = rounds.match_round(b, s)
    assert {r["baseline_id"]: r["status"] for r in first.collect()} == {1: "pending", 2: "unmatched"}
    from lineweave.plans import lookup

    done = {r["baseline_id"]: (r["status"], r["match_type"]) for r in lookup.cascade(b, s).collect()}
    assert done == {1: ("pending", "plain"), 2: ("unique", "punctuation")}


def test_fuzzy_join_is_complete(spark):
    texts = ["今天天气很好", "今天天气真好", "今天天气很好吗", "明天见", "明天再见", "abcde", "abcdx", "abxde", "xbcde", "aabbccdd", "ddccbbaa", "!!!!"]
    one = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r[0], r[1]): r[2] for r in fuzzy.similar_texts(one, one).collect()}
    want = {(a, b): m for a in texts for b in texts if a != "!!!!" and b != "!!!!" and (m := difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) * 100 >= 80}
    assert got == want


def long_lines(n, seed=11):
    """Lines of up to 1,200 characters in three alphabets, some of them edited copies of others, down to the threshold."""
    rng = random.Random(seed)
    words = {k: ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(60)] for k, letters in enumerate(("etaoinsrh", "абвгдеж", "今天气很好吗明见再上海山水人大小中国"))}
    out = []
    while len(out) < n:
        if out and rng.random() < 0.5:
            t = list(rng.choice(out))
            for _ in range(int(len(t) * rng.choice([0.02, 0.1, 0.19, 0.2, 0.21, 0.25]))):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 2)] = rng.choices("xyzе天 ", k=rng.randint(0, 2))
            out.append("".join(t))
        else:
            out.append(" ".join(rng.choices(words[rng.randrange(3)], k=rng.choice([1, 3, 5, 10, 20, 150 if len(out) > n - 3 else 8]))))
    return out


@cache
def compared_lines():
    texts = sorted(set(long_lines(90)))
    a, b = texts[::2], texts[1::2]
    near = [(x, y) for x in a for y in b if 2 * len(x) <= 3 * len(y) + 3 and 2 * len(y) <= 3 * len(x) + 3]
    return a, b, {by: {(x, y): m for x, y in near if (m := measure(x, y)) >= 0.8} for by, measure in ((True, X.sequence_ratio), (False, X.lcs_similarity))}


@pytest.mark.parametrize("reach", [1_000, 0])
def test_similar_long_texts_are_all_found(spark, monkeypatch, reach):
    monkeypatch.setattr(fuzzy, "REACH", reach)
    monkeypatch.setattr(fuzzy, "REACH_SHARE", 10**9)
    monkeypatch.setattr(fuzzy, "BLOCK_TEXTS", 40)
    a, b, wanted = compared_lines()
    frame = lambda rows: spark.createDataFrame([(t,) for t in [*rows, None, "", rows[0]]], "text string")
    for by_blocks, want in wanted.items():
        got = {(r[0], r[1]): r[2] for r in fuzzy.similar_pairs(frame(a), frame(b), 80, by_blocks).collect()}
        assert got.keys() == want.keys() and len(want) > 10
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_matching_blocks_and_common_subsequences():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(rng.choice(["ab", "abcd", "abcdefghij"]), k=rng.randint(0, 150)))
    left, right = [word() for _ in range(120)], [word() for _ in range(120)]
    for a, b in zip(left, right, strict=True):
        assert similarity.matched(a, b) == sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    x, y = similarity.Side(left), similarity.Side(right)
    i, j = (k.ravel() for k in np.meshgrid(np.arange(120), np.arange(120)))
    got = similarity.subsequences(x, y, i, j)
    want = [round(X.lcs_similarity(left[p], right[q]) * (len(left[p]) + len(right[q])) / 2) for p, q in zip(i, j, strict=True)]
    assert got.tolist() == want


def test_merge_links(spark):
    parts, wholes = sides(spark, ["ab", "cd", "ef", "gh"], [("cdef", "1"), ("abcdefgh", "2"), ("xx", "3")])
    parts, wholes = (structure.with_blocks(structure.with_comparison(x)) for x in (parts, wholes))
    got = {(r["source_id"], tuple(r["ids"])) for r in structure.linked_runs(parts, "baseline_id", wholes, "source_id").collect()}
    assert got == {(1, (2, 3)), (2, (1, 2, 3, 4))}


def test_blocks_and_neighbours(spark):
    form = "long, row int, comparison string, scene string"
    b = [(1, 1, "a", "x"), (2, 2, "b", " "), (3, 3, "c", None), (4, 4, "d", "y"), (5, 6, "a", None), (6, 7, "", None), (7, 8, "b", None)]
    base = structure.with_blocks(spark.createDataFrame(b, f"baseline_id {form}").selectExpr("*", "'p' as path", "'s' as sheet"), scene="scene")
    assert [r["block"] for r in base.orderBy("row").collect()] == [1, 1, 1, 2, 3, 4, 5]
    s = [(1, 1, "a", None), (2, 2, "b", None), (3, 3, "c", None), (4, 4, "d", None)]
    source = structure.with_blocks(spark.createDataFrame(s, f"source_id {form}").selectExpr("*", "'q' as path", "'s' as sheet"))
    links = source.join(base.drop("path", "sheet", "row", "scene", "block"), "comparison").select("source_id", "baseline_id")
    found = structure.neighbour_evidence(links, source, base).collect()
    got = {tuple(r[:2]): tuple(r[2:5]) for r in found}
    assert {tuple(r[:2]): tuple(r[5:]) for r in found if r["anchored"]} == {(1, 1): (False, True), (2, 2): (False, True)}
    # c and d stand once on either side, but the scene of the string table parts them
    assert got == {(1, 1): (0, 2, True), (2, 2): (1, 1, True), (3, 3): (2, 0, False), (4, 4): (0, 0, False), (1, 5): (0, 0, False), (2, 7): (0, 0, False)}


def test_keys(spark):
    numbers = spark.createDataFrame([(1,), (12,), (123,), (7,)], "n long")
    near = {(r[0], r[1]) for r in keys.within_band(numbers.toDF("a"), numbers.toDF("b"), "a", "b", 5).collect()}
    assert near == {(a, b) for a in (1, 12, 123, 7) for b in (1, 12, 123, 7) if abs(a - b) <= 5}
    heads = {(r[0], r[1]) for r in keys.by_number_prefix(numbers.toDF("a"), numbers.toDF("b"), "a", "b").collect()}
    assert heads == {(1, 12), (12, 123), (1, 123)}


def test_compare(spark):
    form = "id long, rel string, sheet string, row long, key string, text string, translation string, is_formula boolean"
    ours = spark.createDataFrame([(1, "f", "s", 1, "k1", "t", "new", False), (2, "f", "s", 2, "k2", "t", "a b", False), (3, "f", "s", 3, "", "t", "x", False), (4, "f", "s", 4, "k4", "t", "x", False)], form)
    theirs = spark.createDataFrame([(1, "f", "s", 1, "k1", "t", "new", False), (2, "f", "s", 2, "k2", "t", "a-b", False), (3, "f", "s", 9, "", "t", "x", False), (5, "g", "s", 4, "k4", "t", "x", False), (6, "h", "s", 4, "k4", "t", "x", False)], form)
    log = spark.createDataFrame([("f", "s", 1, "k1", "old", "new", "filled")], "rel string, sheet string, row long, key string, old string, new string, action string")
    got = {r["id"]: (r["verdict"], r["difference"]) for r in reports.compare_fills(ours, theirs, log).collect()}
    assert got == {1: ("final", None), 2: ("different", "marks"), 3: ("no_partner", None), 4: ("no_partner", None)}


def book(cells, hidden_rows=()):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = {}
    for ref, row, content in cells:
        rows.setdefault(row, []).append(f'<c r="{ref}{row}" {content}')
    sheet = "".join(f'<row r="{r}"{" hidden=\"1\"" if r in hidden_rows else ""}>{"".join(c)}</row>' for r, c in sorted(rows.items()))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="正文" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def text_cell(value):
    return f't="inlineStr"><is><t>{value}</t></is></c>'


def test_workbooks(spark, tmp_path):
    cells = [("A", 1, text_cell("台词")), ("B", 1, text_cell("한국어")), ("A", 2, text_cell("你好")), ("B", 2, "><f>A1</f><v>1</v></c>")]
    (tmp_path / "a.xlsx").write_bytes(book(cells, hidden_rows=(2,)))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "old.xls").write_bytes(b"x")
    (tmp_path / "~$a.xlsx").write_bytes(b"x")
    found = workbook.find_workbooks(spark, str(tmp_path))
    assert sorted(r["supported"] for r in found.collect()) == [False, True, True]
    read = workbook.read_cells(found)
    rows = {(r["row"], r["col"]): (r["value"], r["data_type"], r["row_hidden"]) for r in read.filter("error is null").collect()}
    assert rows == {(1, 1): ("台词", "s", False), (1, 2): ("한국어", "s", False), (2, 1): ("你好", "s", True), (2, 2): ("=A1", "f", True)}
    assert read.filter("error is not null").count() == 1
    hits = workbook.header_hits(read, workbook.CHINESE_HEADERS, workbook.KOREAN_HEADERS)
    assert [(r["issue"], r["header_row"]) for r in workbook.sheet_verdicts(hits).collect()] == [("", 1)]


def test_reviews_are_all_or_nothing(spark):
    form = "identity string, fingerprint string, decision string"
    old = spark.createDataFrame([("a", "1", "yes")], form)
    candidates = spark.createDataFrame([("a", "1"), ("b", "2")], "identity string, fingerprint string")
    filled = spark.createDataFrame([("a", "1", ""), ("b", "2", "no")], form)
    assert {tuple(r) for r in workbook.apply_reviews(old, filled, candidates).collect()} == {("a", "1", "yes", ""), ("b", "2", "no", "")}
    for bad in [("b", "9", "no"), ("c", "1", "no"), ("b", "2", "maybe")]:
        with pytest.raises(ValueError, match="refused"):
            workbook.apply_reviews(old, spark.createDataFrame([bad], form), candidates)


def walked(spark, base, script):
    """(previous_equal, following_equal, full_sides) of the line '目标'; script: (text, skip mark)."""
    b = spark.createDataFrame([(i, "b", "s", i, t) for i, t in enumerate(base, 1)], "baseline_id long, path string, sheet string, row int, text string")
    s = spark.createDataFrame([(i, "a", "s", i, t, k) for i, (t, k) in enumerate(script, 1)], "source_id long, path string, sheet string, row int, text string, context_skip string")
    s = s.withColumn("text", F.when(F.col("context_skip") == rounds.BREATH_MARK, X.breath_key(F.col("text"))).otherwise(F.col("text")))
    pairs = b.select("baseline_id", "text").join(s.filter("context_skip = ''").select("source_id", "text"), "text").filter("text = '目标'")
    (row,) = rounds.skipping_scores(pairs, rounds.context_with_skips(s, "source_id"), b).collect()
    return tuple(row[2:])


def test_contexts_step_over_skipped_lines(spark):
    stage, breath = "演出", rounds.BREATH_MARK
    script = [("前1", ""), ("前2", ""), ("前3", ""), ("场景说明", stage), ("嗯？（惊讶）", breath), *[("", stage)] * 9, ("目标", ""), ("（半疑惑的气）", breath), ("镜头移动", stage), ("后1", ""), ("哈(喘息)", breath), ("后2", ""), ("后3", "")]
    # one breath also stands in the table, whatever its note says; the other skipped lines do not
    assert walked(spark, ["前1", "前2", "前3", "嗯？（不同说明）", "目标", "后1", "哈", "后2", "后3"], script) == (3, 3, 2)
    # a usable line that differs takes a table line, and the sheet's end is the end
    script = [("目标", ""), ("错误邻句", ""), ("", stage), ("（动作）", breath), ("后2", ""), ("后3", ""), ("后1", "")]
    assert walked(spark, ["前1", "前2", "前3", "目标", "后1", "后2", "后3"], script) == (0, 2, 0)
    assert walked(spark, ["目标"], [("目标", "")]) == (0, 0, 0)


def test_split_links_meet_patterns_with_prefix_and_parts(spark):
    b = [(1, "b", "s", 1, "前"), (2, "b", "s", 2, "甲"), (3, "b", "s", 3, "乙"), (4, "b", "s", 4, "丙"), (5, "b", "s", 5, ""), (6, "b", "s", 6, "甲"), (7, "b", "s", 8, "乙")]
    base = structure.with_blocks(structure.with_comparison(spark.createDataFrame(b, "baseline_id long, path string, sheet string, row int, original string")))
    source = spark.createDataFrame([(1, "前1. 甲\n2. 乙"), (2, "甲乙丙"), (3, "甲\n乙"), (4, "1. 甲 2. 丙"), (5, None), (6, "甲")], "source_id long, original string")
    got = {(r["source_id"], r["variant"], tuple(r["ids"])) for r in structure.split_links(base, source).collect()}
    assert got == {(1, "number", (1, 2, 3)), (2, "whole", (2, 3, 4)), (3, "whole", (2, 3)), (3, "line_break", (2, 3))}
    merges = spark.createDataFrame([(9, [4, 5])], "baseline_id long, ids array<long>")
    covered = {tuple(r) for r in structure.covered_rows(merges, structure.split_links(base, source)).collect()}
    assert covered == {(k, None) for k in (1, 2, 3, 4, 9)} | {(None, k) for k in (1, 2, 3, 4, 5)}


def test_queries_equal_their_sql_on_long_lines_and_notes(spark, tmp_path):
    """Structure items of lines beyond 16,000 characters, and breaths whose bracket notes differ."""
    long = "\n".join([chr(97 + i) * 9_000 for i in range(6)])
    noted = lambda x: "\n".join(["one", "two", f"gasp {x}", "four", "six", "seven"])
    docs = [(2, long, "xx"), (4, noted("(a)"), "xx"), (5, noted("(b)"), "xx"), (8, noted("(c)"), "yy"), (9, noted("(a)"), "yy")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("a3_structure_counts", "u2_distinct_variants", "u3_unresolved_rows", "w4_walk_over_skips"):
        wanted = connection.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()))
        assert got == sorted(wanted.fetchall()), name
