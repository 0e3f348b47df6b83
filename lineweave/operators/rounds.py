"""Rounds of the lookup: candidates by a key, scored by the three lines before and after, then one decision a row.

All occurrences on both sides take part. Candidates are counted by text; rows that agree in text and context are one
case, and a case finds its best source by pairs or, for frequent lines, by the positions on which contexts agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import all_pairs, join_spread, settle
from ..functions import text as X

SIDE = 3
#: Forms with so many different source contexts are paired with their rows; beyond, they go by agreeing positions.
PAIRED = 256
CASE = ["form", "previous", "following"]
UNMATCHED, ALL_MISSING, UNIQUE, PENDING, CONTEXT, FUZZY = "unmatched", "all_missing", "unique", "pending", "context", "fuzzy"


def with_context(rows: DataFrame, key: str = "text", hashed: bool = False) -> DataFrame:
    """previous and following: up to three lines with a key in the same sheet, nearest first.

    hashed: 64-bit hashes of the lines, which is all that a comparison needs; six lines a row are much to shuffle.
    """
    sheet = Window.partitionBy("path", "sheet").orderBy("row")
    filled = rows.filter(F.col(key) != "").withColumn("__line", F.xxhash64(key) if hashed else F.col(key))
    before = F.reverse(F.collect_list("__line").over(sheet.rowsBetween(-SIDE, -1)))
    return filled.withColumn("previous", before).withColumn("following", F.collect_list("__line").over(sheet.rowsBetween(1, SIDE))).drop("__line")


def with_sequence(rows: DataFrame) -> DataFrame:
    """seq: running number of the usable rows of each sheet."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row")))


def context_with_skips(rows: DataFrame, id_name: str) -> DataFrame:
    """id, side, row, text, context_skip: the lines around each usable row until three usable ones, skipped ones included.

    rows(path, sheet, row, text, context_skip); lines with a skip mark are evidence and do not count. A line is in
    reach if fewer than three usable lines lie between; running counts make that an equi-join.
    """
    sheet = Window.partitionBy("path", "sheet").orderBy("row")
    usable = (F.col("context_skip") == "").cast("int")
    lines = rows.filter("text <> '' or context_skip <> ''").withColumn("upto", F.sum(usable).over(sheet))
    others = lines.select("path", "sheet", "upto", F.col("row").alias("at"), F.col("text").alias("near"), F.col("context_skip").alias("skip"))
    # a line after the row is counted from the line before it
    others_after = others.withColumn("upto", F.col("upto") - (F.col("skip") == "").cast("int"))
    mine = lines.filter("context_skip = ''")
    back, ahead = F.sequence(F.col("upto") - SIDE, F.col("upto") - 1), F.sequence(F.col("upto"), F.col("upto") + SIDE - 1)
    reach = lambda steps: mine.select(F.col(id_name).alias("id"), "path", "sheet", "row", F.explode(steps).alias("upto"))
    before = reach(back).join(others, ["path", "sheet", "upto"]).filter("at < row").withColumn("side", F.lit("before"))
    after = reach(ahead).join(others_after, ["path", "sheet", "upto"]).filter("at > row").withColumn("side", F.lit("after"))
    return before.unionByName(after).select("id", "side", F.col("at").alias("row"), F.col("near").alias("text"), F.col("skip").alias("context_skip"))


# Fixed value: the mark of lines that are a breath; their bracket notes do not count.
BREATH_MARK = "气息"


def walked_equal(source: Column, base: Column) -> Column:
    """Lines of a source side that meet their equal on the baseline side, stepping over skipped lines.

    source: array of struct(text, skip), base: array of struct(text, breath), both nearest first. A usable line takes
    the next baseline line, equal or not; a skipped one takes it only if the texts agree.
    """

    def step(state: Column, line: Column) -> Column:
        other = F.get(base, state["at"])
        same = F.coalesce(line["text"] == F.when(line["skip"] == BREATH_MARK, other["breath"]).otherwise(other["text"]), F.lit(False))
        usable = line["skip"] == ""
        return F.struct((state["at"] + (usable | same).cast("int")).alias("at"), (state["equal"] + (usable & same).cast("int")).alias("equal"))

    return F.aggregate(source, F.struct(F.lit(0).alias("at"), F.lit(0).alias("equal")), step, lambda state: state["equal"])


def skipping_scores(pairs: DataFrame, lines: DataFrame, baseline: DataFrame) -> DataFrame:
    """baseline_id, source_id, previous_equal, following_equal, full_sides of pairs(baseline_id, source_id).

    lines: context_with_skips() of the source (the text of breath lines without bracket notes); baseline(baseline_id,
    path, sheet, row, text), with `breath` where a breath line is compared with another text than the row's without
    notes. A baseline row reads as many lines on a side as the longest source side that it meets: they are joined by their running numbers in the sheet, so that no frame holds more than is asked for.
    """
    nearest = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct((F.col("row") * (1 if side == "after" else -1)).alias("far"), "text", F.col("context_skip").alias("skip"))))), lambda x: F.struct(x["text"].alias("text"), x["skip"].alias("skip")))
    sides = lines.groupBy(F.col("id").alias("source_id")).agg(nearest("before").alias("before"), nearest("after").alias("after"))
    met = settle(pairs.select("baseline_id", "source_id").join(sides, "source_id", "left"), "walks")
    breath = F.col("breath") if "breath" in baseline.columns else X.breath_key(F.col("text"))
    numbered = with_sequence(baseline.filter("text <> ''")).select("baseline_id", "path", "sheet", "seq", "text", breath.alias("breath"))
    numbered = settle(numbered, "lines")
    out = met
    for side, way in (("before", -1), ("after", 1)):
        reach = met.groupBy("baseline_id").agg(F.max(F.size(side)).alias("n")).filter("n > 0")
        asked = numbered.select("baseline_id", "path", "sheet", "seq").join(reach, "baseline_id").withColumn("far", F.explode(F.sequence(F.lit(1), F.col("n"))))
        asked = asked.select("baseline_id", "path", "sheet", "far", (F.col("seq") + way * F.col("far")).alias("seq"))
        near = asked.join(numbered.select("path", "sheet", "seq", "text", "breath"), ["path", "sheet", "seq"])
        held = near.groupBy("baseline_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("far", "text", "breath"))), lambda x: F.struct(x["text"].alias("text"), x["breath"].alias("breath"))).alias(f"b_{side}"))
        out = out.join(held, "baseline_id", "left")
    equal = lambda side: F.coalesce(walked_equal(F.col(side), F.coalesce(f"b_{side}", F.array().cast("array<struct<text: string, breath: string>>"))), F.lit(0))
    out = out.select("baseline_id", "source_id", equal("before").alias("previous_equal"), equal("after").alias("following_equal"))
    return out.withColumn("full_sides", (F.col("previous_equal") == SIDE).cast("int") + (F.col("following_equal") == SIDE).cast("int"))


def skipping_pairs(baseline: DataFrame, source: DataFrame) -> DataFrame:
    """baseline_id, source_id, previous_equal, following_equal, full_sides: skipping_scores() of all rows with equal text.

    source(source_id, path, sheet, row, text, context_skip), baseline(baseline_id, path, sheet, row, text, breath).
    Such pairs are very many, so that rows take hashes of the lines around them along and pairs are joined once, neither
    stored nor shuffled. Only rows that have a partner read lines, and only sides that share a line are walked.
    """
    sheet = Window.partitionBy("path", "sheet")
    numbered = with_sequence(baseline.filter("text <> ''")).select("baseline_id", "path", "sheet", "seq", X.digest(F.col("text")).alias("key"), F.xxhash64("text").alias("text"), F.xxhash64("breath").alias("breath"))
    numbered = settle(numbered, "lines")
    usable = (F.col("skip") == "").cast("int")
    lines = source.filter("text <> '' or context_skip <> ''").select("source_id", "path", "sheet", "row", X.digest(F.col("text")).alias("key"), F.xxhash64("text").alias("text"), F.col("context_skip").alias("skip"))
    lines = lines.withColumn("upto", F.sum(usable).over(sheet.orderBy("row")))
    # a line before the row counts as many usable lines as lie up to it, a line after as many as lie before it
    far = lambda way: F.collect_list(F.struct((way * F.col("row")).alias("far"), "text", "skip"))
    lines = lines.withColumn("before", far(-1).over(sheet.orderBy("upto").rangeBetween(-SIDE, -1)))
    lines = lines.withColumn("upto", F.col("upto") - usable).withColumn("after", far(1).over(sheet.orderBy("upto").rangeBetween(1, SIDE)))
    asking = lines.filter("skip = '' and key <> ''").join(numbered.select("key").distinct(), "key", "left_semi")

    def bits(texts: str) -> Column:
        return F.expr(f"aggregate({texts}, 0L, (a, x) -> a | shiftleft(1L, cast(pmod(x, 64) as int)))")

    for side in ("before", "after"):
        asking = asking.withColumn(side, F.transform(F.array_sort(side), lambda x: F.struct(x["text"].alias("text"), x["skip"].alias("skip"))))
        asking = asking.withColumn(f"{side}_texts", F.transform(F.filter(side, lambda x: x["skip"] == ""), lambda x: x["text"])).withColumn(f"{side}_bits", bits(f"{side}_texts"))
    sides = ["before", "after", *(f"{side}_{kind}" for side in ("before", "after") for kind in ("texts", "bits"))]
    asking = settle(asking.select("source_id", "key", *sides), "walks")
    reach = asking.groupBy("key").agg(F.max(F.size("before")).alias("back"), F.max(F.size("after")).alias("ahead"))
    asked = numbered.join(reach, "key")
    places = asked.select("baseline_id", "path", "sheet", "seq", F.explode(F.sequence(-F.col("back"), F.col("ahead"))).alias("far")).filter("far <> 0")
    near = places.withColumn("seq", F.col("seq") + F.col("far")).join(numbered.select("path", "sheet", "seq", "text", "breath"), ["path", "sheet", "seq"])
    beside = lambda test: F.array_sort(F.collect_list(F.when(test, F.struct(F.abs("far").alias("far"), "text", "breath"))))
    held = near.groupBy("baseline_id").agg(beside(F.col("far") < 0).alias("b_before"), beside(F.col("far") > 0).alias("b_after"))
    b = asked.select("baseline_id", "key").join(held, "baseline_id", "left")
    for side in ("b_before", "b_after"):
        b = b.withColumn(side, F.coalesce(F.transform(side, lambda x: F.struct(x["text"].alias("text"), x["breath"].alias("breath"))), F.array().cast("array<struct<text: bigint, breath: bigint>>")))
        b = b.withColumn(f"{side}_texts", F.transform(side, lambda x: x["text"])).withColumn(f"{side}_bits", bits(f"{side}_texts"))

    def equal(side: str) -> Column:
        shares = (F.col(f"{side}_bits").bitwiseAND(F.col(f"b_{side}_bits")) != 0) & F.arrays_overlap(f"{side}_texts", f"b_{side}_texts")
        return F.when(shares, walked_equal(F.col(side), F.col(f"b_{side}"))).otherwise(0)

    out = all_pairs(settle(b, "sides"), asking, ["key"], F.col("baseline_id"))
    out = out.select("baseline_id", "source_id", equal("before").alias("previous_equal"), equal("after").alias("following_equal"))
    return out.withColumn("full_sides", (F.col("previous_equal") == SIDE).cast("int") + (F.col("following_equal") == SIDE).cast("int"))


def side_equal(a: Column, b: Column) -> Column:
    """Positions at which two sides of a context agree; no higher-order function, as those are not compiled."""
    return reduce(Column.__add__, [F.coalesce(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), F.lit(False)).cast("int") for k in range(SIDE)])


def context_scores(pairs: DataFrame) -> DataFrame:
    """previous_equal, following_equal, full_sides of pairs(previous, following, s_previous, s_following)."""
    scored = pairs.withColumn("previous_equal", side_equal(F.col("previous"), F.col("s_previous"))).withColumn("following_equal", side_equal(F.col("following"), F.col("s_following")))
    return scored.withColumn("full_sides", (F.col("previous_equal") == SIDE).cast("int") + (F.col("following_equal") == SIDE).cast("int"))


def candidate_pairs(baseline: DataFrame, source: DataFrame, key: str = "text") -> DataFrame:
    """key (its digest), baseline_id, source_id, korean_key: one row for each baseline row and source row with the same non-empty key."""
    b = baseline.filter(F.col(key) != "").select("baseline_id", X.digest(F.col(key)).alias("key"))
    s = source.filter(F.col(key) != "").select("source_id", X.digest(F.col(key)).alias("key"), "korean_key")
    return all_pairs(b, s, ["key"], F.col("baseline_id"))


def scored_pairs(baseline: DataFrame, source: DataFrame, key: str = "text", of_baseline: tuple[str, ...] = (), of_source: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of equal keys with their scores; of_baseline and of_source are columns that the pairs take along.

    What a pair shows of its rows comes with the rows, so that the pairs, which are many, are joined once and not shuffled.
    """
    baseline, source = (x.withColumn(key, X.digest(F.col(key))) for x in (baseline, source))
    b = with_context(baseline, key, hashed=True).select("baseline_id", F.col(key).alias("key"), "previous", "following", *of_baseline)
    s = with_context(source, key, hashed=True).select("source_id", F.col(key).alias("key"), "korean_key", F.col("previous").alias("s_previous"), F.col("following").alias("s_following"), *of_source)
    return context_scores(all_pairs(b, s, ["key"], F.col("baseline_id")))


def hit_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """n, missing, variants of the candidates."""
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("korean_key") == "", 1).otherwise(0)).cast("long").alias("missing"),
        F.countDistinct(F.when(F.col("korean_key") != "", F.col("korean_key"))).alias("variants"),
    )


def _best_of_few(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """CASE, score, best_id, lo, hi: cases paired with the source cases of their form."""
    equal = F.col("previous_equal") + F.col("following_equal")
    scored = context_scores(cases.join(sources, "form")).withColumn("score", F.col("full_sides") * 10 + equal)
    return _at_top(scored.withColumns({"best_id": F.col("source_id"), "lo": F.col("korean_key"), "hi": F.col("korean_key")}))


def _at_top(met: DataFrame) -> DataFrame:
    """Of each case: its highest score, and there the smallest best_id and lo and the largest hi."""
    down = F.min(F.struct((-F.col("score")).alias("score"), "best_id"))
    top = met.groupBy(*CASE).agg(down.alias("a"), F.min(F.struct((-F.col("score")).alias("score"), "lo")).alias("b"), F.max(F.struct("score", "hi")).alias("c"))
    return top.select(*CASE, F.col("c.score"), "a.best_id", "b.lo", "c.hi")


def _agreements(rows: DataFrame, previous: str, following: str) -> DataFrame:
    """One row for each set of context positions that a row could agree on: score, mask and a hash of the lines there."""
    places = range(2 * SIDE)
    side = (1 << SIDE) - 1
    scores = F.array(*[F.lit(10 * ((m & side == side) + (m >> SIDE == side)) + m.bit_count()) for m in range(1 << 2 * SIDE)])
    rows = rows.withColumn("__at", F.array(*[F.get(F.col(c), F.lit(k)) for c in (previous, following) for k in range(SIDE)]))
    rows = rows.withColumn("__known", reduce(lambda x, y: x + y, [F.when(F.get("__at", F.lit(i)).isNull(), 0).otherwise(1 << i) for i in places]))
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << 2 * SIDE) - 1)), lambda m: m.bitwiseAND(F.col("__known")) == m)
    rows = rows.withColumn("mask", F.explode(masks))
    lines = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.get("__at", F.lit(i))).otherwise(0) for i in places])
    return rows.withColumn("lines", F.xxhash64(lines)).withColumn("score", F.get(scores, "mask")).drop("__at", "__known")


def _best_of_many(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """As _best_of_few(), without pairs: each side is listed by the sets of positions it may agree on.

    The best source agrees on one of 64 sets of positions and no larger one, so that the best set with any source
    names it; sources are summed up by (form, set, lines there) first, and no case meets more than 64 of the sums.
    """
    sums = _agreements(sources, "s_previous", "s_following").groupBy("form", "mask", "lines").agg(F.min("source_id").alias("best_id"), F.min("korean_key").alias("lo"), F.max("korean_key").alias("hi"))
    met = _agreements(cases, "previous", "following").join(sums, ["form", "mask", "lines"])
    return _at_top(met)


def best_by_context(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """form, previous, following, best_id, tied, full_sides: the translated candidate with the best context of each case.

    cases(form, previous, following) are distinct; candidates(form, source_id, korean_key, s_previous, s_following).
    The smallest source_id wins among equals; tied tells that they have different translations. Forms with up to
    PAIRED source cases are paired, the others go by sets of agreeing positions.
    """
    translated = candidates.filter("korean_key <> ''")
    sources = settle(translated.groupBy("form", "s_previous", "s_following", "korean_key").agg(F.min("source_id").alias("source_id")), "sources")
    many = settle(sources.groupBy("form").agg(F.count("*").alias("held")).filter(F.col("held") > PAIRED).select("form"), "frequent")
    best = _best_of_few(cases, sources.join(many, "form", "left_anti"))
    if many.limit(1).count():
        best = best.unionByName(_best_of_many(cases.join(many, "form", "left_semi"), sources.join(many, "form", "left_semi")))
    return best.select(*CASE, "best_id", (F.col("lo") != F.col("hi")).alias("tied"), F.floor(F.col("score") / 10).cast("int").alias("full_sides"))


def decide(rows: DataFrame, candidates: DataFrame, keep_best: bool = False) -> DataFrame:
    """baseline_id, n, missing, variants, source_id, status of every row of rows(baseline_id, form, previous, following).

    A form is what rows with the same candidates share (their text); candidates(form, source_id, korean_key,
    s_previous, s_following) are counted by form, and rows that agree in form and context are one case, so that a
    frequent line makes neither rows times rows nor cases times cases. Among translated candidates the best context
    wins, the smallest source_id on ties; a tie between different translations, or several translations without any
    full side, stays pending.

    Only forms with several translated candidates look at contexts: the others' answer is that of their form.
    """
    rows, candidates = settle(rows, "rows"), settle(candidates, "candidates")
    told = F.col("korean_key") != ""
    by_text = candidates.groupBy("form", "korean_key").agg(F.count("*").alias("n"), F.min("source_id").alias("source_id"))
    counts = by_text.groupBy("form").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("korean_key") == "", F.col("n")).otherwise(0)).alias("missing"), F.count_if(told).alias("variants"),
        F.sum(F.when(told, F.col("n")).otherwise(0)).alias("told"), F.min(F.when(told, F.col("source_id"))).alias("only"),
    )
    forms = settle(rows.groupBy("form").agg(F.count("*").alias("held")).join(counts, "form"), "forms")
    total, all_told = forms.agg(F.sum("held"), F.sum("told")).first()
    met = settle(join_spread(rows, forms.drop("held"), forms.select("form", F.col("held").alias("n")), ["form"], F.col("baseline_id"), total or 0, "left"), "met")
    several = forms.filter("told > 1")
    mine = met.filter("told > 1")
    sources = join_spread(candidates.filter(told), several.select("form"), several.select("form", F.col("told").alias("n")), ["form"], F.col("source_id"), all_told or 0)
    best = best_by_context(mine.select(*CASE).distinct(), sources)
    sizes = settle(mine.groupBy(*CASE).agg(F.count("*").alias("n")), "cases")
    cases = join_spread(mine, best, sizes, CASE, F.col("baseline_id"), total or 0)
    alone = met.filter("told is null or told <= 1").withColumns({"best_id": F.col("only"), "tied": F.lit(False), "full_sides": F.lit(0)})
    status = F.when(F.col("n").isNull(), UNMATCHED).when(F.col("variants") == 0, ALL_MISSING).when(F.col("variants") == 1, UNIQUE).when((F.col("full_sides") == 0) | F.col("tied"), PENDING).otherwise(CONTEXT)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "missing", "variants")]
    picked = F.when(F.col("status").isin(UNIQUE, CONTEXT), F.col("best_id"))
    names = ["baseline_id", "n", "missing", "variants", "best_id", "tied", "full_sides"]
    every = alone.select(*names).unionByName(cases.select(*names)).withColumn("status", status)
    return every.select("baseline_id", *zero, picked.alias("source_id"), "status", *["best_id"] * keep_best)


def match_round(baseline: DataFrame, source: DataFrame, key: str = "text") -> DataFrame:
    """baseline_id, n, missing, variants, source_id, status of every baseline row with a key."""
    baseline, source = (x.withColumn(key, X.digest(F.col(key))) for x in (baseline, source))
    return decide(with_form(baseline, key), keyed_candidates(source, key))


def with_form(baseline: DataFrame, key: str, form: str | None = None) -> DataFrame:
    """baseline_id, form, previous, following: contexts are read from `key`, candidates belong to `form`."""
    return with_context(baseline, key, hashed=True).select("baseline_id", F.col(form or key).alias("form"), "previous", "following")


def keyed_candidates(source: DataFrame, key: str) -> DataFrame:
    """form, source_id, korean_key, s_previous, s_following of source rows with a key, which is their form."""
    return with_context(source, key, hashed=True).select(F.col(key).alias("form"), "source_id", "korean_key", F.col("previous").alias("s_previous"), F.col("following").alias("s_following"))
