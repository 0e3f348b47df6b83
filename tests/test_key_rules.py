import random

import pytest
from pyspark.sql import functions as F

from lineweave.functions import segments as S
from lineweave.functions import text as X
from lineweave.operators import key_rules, keys, proposals, rounds, segments
from lineweave.plans import lookup
from lineweave.sources import outputs, workbook

STORY = ("story_text", "story_convenient")


def may(a, b):
    return not a or not b or bool(set(a) & set(b))


def best(scored, least):
    """The strictly best (score, id) at `least` or more."""
    scored = sorted(((s, b) for s, b in scored), reverse=True)
    return scored[0] if scored and scored[0][0] >= least and (len(scored) == 1 or scored[0][0] > scored[1][0]) else None


@pytest.fixture(scope="module")
def stories(spark):
    rng = random.Random(11)
    text = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 11)))
    base = [(i, n, rng.choice([*STORY, ""]), "b", str(n % 2), n, text(), [rng.choice("PQ")] * rng.randint(0, 1)) for i, n in enumerate(rng.sample(range(100, 400), 150))]
    source = []
    for i in range(250):
        _, n, *_, loose, _ = rng.choice(base)
        loose = rng.choice([loose, loose, loose[1:] + "z", loose[:-2], text()])
        source.append((i, rng.choice([n, n + rng.randint(-6, 6), n + rng.randint(-10, 10), None]), i, loose, [rng.choice("PQ")] * rng.randint(0, 1)))
    b = spark.createDataFrame(base, "baseline_id long, number long, family string, path string, sheet string, row long, loose string, roles array<string>").withColumn("variants", F.array("loose"))
    s = spark.createDataFrame(source, "source_id long, did long, row long, loose string, roles array<string>")
    return source, base, s, b


def test_id_corrections_equal_brute_force(spark, stories):
    source, base, s, b = stories
    wanted = {}
    for sid, did, _, z, roles in source:
        found = None
        if did is not None:
            direct = [e for e in base if e[1] == did and e[2] in STORY]
            same = sorted(e[0] for e in direct if e[6] == z and may(roles, e[7]))
            near = [e[0] for e in base if abs(e[1] - did) <= 5 and e[6] == z and may(roles, e[7])]
            if same:
                found = (same[0], "same_id")
            elif len(near) == 1:
                found = (near[0], "near_id")
            elif direct:
                own = max(X.lcs_similarity(z, e[6]) for e in direct)
                if own < 0.6 and len(z) >= 4:
                    top = best([(X.lcs_similarity(z, e[6]), e[0]) for e in base if e[2] == min(direct)[2] and abs(e[1] - did) <= 9 and may(roles, e[7])], 0.7)
                    found = (top[1], "similar_near") if top and top[0] >= own + 0.2 else None
                if not found:
                    strong = [e[0] for e in direct if may(roles, e[7]) and X.lcs_similarity(z, e[6]) >= 0.9]
                    found = (strong[0], "other_spelling") if len(strong) == 1 else None
        if not found and len(z) >= 7:
            unique = [e[0] for e in base if e[6] == z and may(roles, e[7])]
            found = (unique[0], "unique_text") if len(unique) == 1 else None
        if found:
            wanted[sid] = found
    got = {r["source_id"]: (r["baseline_id"], r["rule"]) for r in key_rules.id_corrections(s, b).collect()}
    assert got == wanted and len({rule for _, rule in wanted.values()}) >= 4


def test_similar_around_and_voices_equal_brute_force(spark, stories):
    source, base, s, b = stories
    anchors = s.filter("did is not null").withColumns({"family": F.lit(STORY[0]), "path": F.lit("b"), "sheet": F.lit("0")}).withColumnRenamed("did", "number")
    wanted = {}
    for sid, did, _, z, roles in source:
        if did is not None and len(z) >= 4:
            top = best([(X.lcs_similarity(z, e[6]), e[0]) for e in base if e[2] == STORY[0] and e[4] == "0" and abs(e[1] - did) <= 21 and may(roles, e[7])], 0.6)
            if top:
                wanted[sid] = top[1]
    assert {r["source_id"]: r["baseline_id"] for r in key_rules.similar_around(anchors, b).collect()} == wanted and wanted
    voices = b.withColumn("key", F.concat(F.lit("char_voice_"), F.lpad("number", 6, "0"))).withColumn("speaker", F.col("family"))
    asked = s.withColumn("speaker", F.when(F.col("source_id") % 2 == 0, STORY[0]).otherwise(STORY[1]))
    wanted = {}
    for sid, _, _, z, _ in source:
        if len(z) >= 4:
            top = best([(X.lcs_similarity(z, e[6]), e[0]) for e in base if e[2] == STORY[sid % 2]], 0.7)
            if top:
                wanted[sid] = top[1]
    assert {r["source_id"]: r["baseline_id"] for r in key_rules.similar_voices(asked, voices).collect()} == wanted and wanted


def test_id_blocks_are_aligned_in_order(spark):
    b = [(i, 120 + i, "story_text", "p", "s", x, []) for i, x in enumerate(["a", "b", "a", "c"])] + [(9, 455, "story_text", "p", "s", "a", []), (10, 456, "story_text", "p", "t", "a", [])]
    s = [(1, 12, 1, "a", []), (2, 12, 2, "a", ["Q"]), (3, 12, 3, "c", []), (4, 45, 4, "a", []), (5, None, 5, "a", [])]
    b += [(20 + i, 9000 + i, "story_text", "p", "s", x, []) for i, x in enumerate("vwxyz")]
    s += [(100 + i, 900, 100 + i, "vwxyz"[i // 2] if i % 2 and i < 10 else "-", []) for i in range(61)]  # script rows have no limit
    base = spark.createDataFrame(b, "baseline_id long, number long, family string, path string, sheet string, loose string, roles array<string>")
    source = spark.createDataFrame(s, "source_id long, did long, row long, loose string, roles array<string>").withColumns({"path": F.lit("q"), "sheet": F.lit("s")})
    assert sorted(map(tuple, key_rules.id_blocks(source, base).collect())) == [(1, 0), (2, 2), (3, 3)] + [(101 + 2 * i, 20 + i) for i in range(5)]  # 45 heads rows of two sheets


def test_later_rounds_keep_earlier_candidates(spark):
    form = "long, path string, sheet string, row int, text string, original string, plain_text string"
    base = ["喂", "走吧，", "<i>去</i>", "好的", "没有"]
    plain = lambda t: t.replace("<i>", "").replace("</i>", "").replace("<b>", "").replace("</b>", "")
    b = spark.createDataFrame([(i, "b", "s", i, t, t, plain(t)) for i, t in enumerate(base, 1)], f"baseline_id {form}")
    script = [("喂（笑）", "1", True), ("走吧,", "2", False), ("<b>去</b>", "3", False), ("好的 (轻声)", "4", False), ("好的 (大声)", "4", False)]
    s = spark.createDataFrame([(i, "a", "s", i, t, t, plain(t), k, n) for i, (t, k, n) in enumerate(script, 1)], f"source_id {form}, korean_key string, is_breath boolean")
    got = {r["baseline_id"]: (r["n"], r["source_id"], r["match_type"], r["round"]) for r in lookup.cascade(b, s).collect()}
    assert got == {1: (1, 1, "breath", 1), 2: (1, 2, "punctuation", 4), 3: (1, 3, "plain", 2), 4: (2, 4, "tail", 3), 5: (0, None, "punctuation", None)}
    taken = b.filter("baseline_id = 2").select("baseline_id")
    assert {r["baseline_id"]: r["source_id"] for r in lookup.cascade(b, s, taken).collect()}[2] is None


def test_frequent_lines_go_by_agreeing_positions(spark, monkeypatch):
    rng = random.Random(2)
    line = lambda: rng.choice(["x", "x", "p", "q", "r"])
    b = spark.createDataFrame([(i, "b", str(i // 30), i % 30, line()) for i in range(300)], "baseline_id long, path string, sheet string, row int, text string")
    s = spark.createDataFrame([(i, "a", str(i // 30), i % 30, line(), rng.choice(["1", "2", ""])) for i in range(300)], "source_id long, path string, sheet string, row int, text string, korean_key string")
    order = lambda: sorted(map(tuple, rounds.match_round(b, s).collect()))
    paired = order()
    monkeypatch.setattr(rounds, "PAIRED", 1)
    assert order() == paired and {r[-1] for r in paired} >= {"context", "pending"}


def test_bilingual_evidence_and_pattern_summary(spark):
    cases = [("1.甲 2.乙", "", "missing"), ("1.甲 2.乙", "가", "no_separator"), ("1.甲 2.乙", "1.가 2.나", "labels_equal"), ("1.甲 2.乙", "1.가 3.나", "ambiguous"), ("1.甲 2.乙", "가\n나", "only_number_equal"), ("甲\n乙", "가\n나\n다", "number_differs")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "id int, a string, b string")
    rows = df.select("id", "b", S.split_patterns(F.col("a"))[0].alias("p"), S.split_patterns(F.col("b")).alias("q"))
    assert [r[1] for r in rows.select("id", S.bilingual_evidence(F.col("p"), F.col("b"), F.col("q"))).orderBy("id").collect()] == [c[2] for c in cases]
    p = spark.createDataFrame([("en", "number", i, f"f{i % 2}", i % 3 == 0, i % 2) for i in range(1, 9)] + [("de", "number", 20, "f", False, 0)], "language string, rule string, id long, path string, matched boolean, n_issues int")
    assert {tuple(r) for r in segments.pattern_summary(p).collect()} == {("en", "number", 8, 2, 2, 4, "1,2,3,4,5"), ("de", "number", 1, 1, 0, 0, "20")}


def test_workbook_lists_and_outputs(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="no workbook"):
        workbook.find_workbooks(spark, str(tmp_path / "none"))
    workbook.refuse_nested("/a/b", "/a/c", "/a/bc")
    with pytest.raises(ValueError, match="contain"):
        workbook.refuse_nested("/a", "/x", "/a/c/")
    (tmp_path / "list.json").write_text('{"version": 1, "sheets": [{"file": "A\\\\B.xlsx", "sheet": "s"}]}')
    assert [tuple(r) for r in workbook.ignored_sheets(spark, str(tmp_path / "list.json")).collect()] == [("a/b.xlsx", "s")]
    (tmp_path / "old.json").write_text('{"version": 2, "sheets": [{"file": "A", "sheet": "s"}]}')
    with pytest.raises(Exception, match="unknown version"):
        workbook.ignored_sheets(spark, str(tmp_path / "old.json")).collect()
    verdicts = spark.createDataFrame([("p/q.xlsx", "=s", "no_header")], "path string, sheet string, issue string")
    for name, rows in (("some", verdicts), ("none_bad", verdicts.limit(0))):
        workbook.write_exceptions(rows, str(tmp_path / name))
        (part,) = (tmp_path / name).glob("*.csv")
        lines = part.read_text("utf-8").splitlines()
        assert lines[0] == "\ufeff" + ",".join(workbook.EXCEPTIONS) and len(lines) == 1 + (name == "some")
    assert lines and "'=s" in next((tmp_path / "some").glob("*.csv")).read_text("utf-8")
    pages = spark.createDataFrame([(i, i // 2) for i in range(5)], "id int, page int")
    outputs.write_pages(pages, str(tmp_path / "pages"), row_limit=3)
    assert spark.read.option("header", True).csv(str(tmp_path / "pages")).count() == 5
    outputs.write_pages(pages.limit(0), str(tmp_path / "empty"))
    assert spark.read.option("header", True).csv(str(tmp_path / "empty")).columns == ["id"]


def test_normalised_texts_and_paths(spark):
    df = spark.createDataFrame([(" Ａ１　",), (None,)], "v string")
    assert [r[0] for r in df.select(X.normalize(F.col("v"))).collect()] == ["A1", ""]
    assert spark.createDataFrame([("C:\\X\\É.xlsx",)], "v string").select(X.path_identity(F.col("v"))).first()[0] == "c:/x/é.xlsx"


def brute_options(source, groups):
    out = []
    for sid, parts, bases, pb, pp, ps in source:
        for stage in (1, 2, 3):
            if stage == 1:
                held = [g for g in groups if g[2] in bases]
                held = [g for g in held if (g[2], g[0], g[1]) == (pb, pp, ps)] or held
            elif stage == 2:
                held = [g for g in groups if pb and (g[2], g[0], g[1]) == (pb, pp, ps)]
            else:
                held = [g for g in groups if not (g[4] and len(g[3]) == len(parts)) or g[3] == parts]
            held = [g for g in held if set(g[3]) & set(parts)]
            if held:
                one = held[0] if len(held) == 1 and held[0][4] and held[0][3] == parts else None
                out.append((sid, *(one[:3] if one else (None,) * 3), stage, "several" if len(held) > 1 else "placed" if one else "not_whole"))
                break
    return sorted(out, key=repr)


def test_option_groups_of_other_lengths_are_places_too(spark):
    rng = random.Random(4)
    texts = lambda n: [rng.choice("ABCDEFGHIJKLMNOP") for _ in range(n)]
    groups = [(rng.choice("pq"), rng.choice("st"), f"b{k // 2}{rng.choice('xy')}{k}", texts(rng.choice([1, 2, 2, 3])), rng.random() < 0.8) for k in range(14)]
    groups += [("p", "s", "one", ["X", "Y"], True), ("p", "s", "long", ["Q", "X2", "Z"], True), ("p", "s", "short", ["Q", "R"], True), ("p", "s", "half", ["V", "W"], False)]
    source = []
    for i in range(150):
        g = rng.choice(groups)
        base, path, sheet = rng.choice([(g[2], g[0], g[1]), ("", "", ""), ("none", "p", "s")])
        parts = rng.choice([g[3], texts(2), ["X", "Y"], ["Q", "R"], ["V", "W"], ["X", "M"]])
        source.append((i, parts, rng.choice([[], [], [g[2]], [g[2], "one"]]), base, path, sheet))
    s = spark.createDataFrame(source, "source_id long, parts array<string>, bases array<string>, previous_base string, previous_path string, previous_sheet string")
    b = spark.createDataFrame(groups, "path string, sheet string, base string, values array<string>, whole boolean")
    got = [(r["source_id"], r["path"], r["sheet"], r["base"], r["stage"], r["outcome"]) for r in key_rules.option_choice(s, b).collect()]
    want = brute_options(source, groups)
    assert sorted(got, key=repr) == want and len({(r[4], r[5]) for r in want}) >= 6


def test_reviews_with_a_null_fingerprint_are_refused(spark):
    form = "identity string, fingerprint string, decision string"
    old, now = spark.createDataFrame([("a", "1", "no")], form), spark.createDataFrame([("a", "2")], "identity string, fingerprint string")
    with pytest.raises(ValueError, match="refused"):
        workbook.apply_reviews(old, spark.createDataFrame([("a", None, "yes")], form), now)


def test_bands_repeat_no_row_for_each_number(spark):
    rng = random.Random(5)
    left = [(i, rng.randint(-60, 60), rng.choice("xy")) for i in range(80)] + [(80, None, "x")]
    right = [(i, rng.randint(-60, 60), rng.choice("xyz")) for i in range(80)] + [(80, None, "x"), (81, 5, None)]
    a, b = spark.createDataFrame(left, "i long, n long, t string"), spark.createDataFrame(right, "j long, m long, u string")
    met = keys.within_band(a, b, "n", "m", 9, ("t", "u"))
    assert sorted((r["i"], r["j"]) for r in met.collect()) == sorted((i, j) for i, n, t in left for j, m, u in right if None not in (n, m) and abs(n - m) <= 9 and t == u)
    assert "sequence(" not in met._jdf.queryExecution().optimizedPlan().toString()
    plain = keys.within_band(a, b, "n", "m", 9)
    assert plain.count() == sum(None not in (n, m) and abs(n - m) <= 9 for _, n, _ in left for _, m, _ in right)


def test_gaps_are_aligned_across_batches(spark):
    rng = random.Random(8)
    s = [(gap * 100 + i, gap, i, rng.choice("abcd")) for gap in range(40) for i in range(rng.randint(1, 12))]
    b = [(gap * 100 + i, gap, i, rng.choice("abcd")) for gap in range(40) for i in range(rng.randint(1, 12))]
    side = lambda rows, name: spark.createDataFrame(rows, f"{name} long, gap long, row long, loose string")
    of = lambda rows, gap: [r for r in rows if r[1] == gap]
    wanted = [(of(s, gap)[i][0], of(b, gap)[j][0]) for gap in range(40) for i, j in proposals.best_order([r[3] for r in of(s, gap)], [r[3] for r in of(b, gap)])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = proposals.between_anchors(side(s, "source_id"), side(b, "baseline_id"))
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # no call for each gap


def test_similar_voices_compares_texts_once(spark, stories):
    *_, s, b = stories
    voices = b.withColumn("key", F.concat(F.lit("char_voice_"), F.lpad("number", 6, "0"))).withColumn("speaker", F.col("family"))
    found = key_rules.similar_voices(s.withColumn("speaker", F.lit(STORY[0])), voices)
    assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are read from a table, twice
