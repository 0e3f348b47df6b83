"""Filling the translation column, comparing two fillings, statistics and lists of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .rounds import hit_counts
from .segments import covered_sources


def fill_action(value: Column, old: Column, is_formula: Column) -> Column:
    return F.when(F.coalesce(X.strip(value), F.lit("")) == "", "kept").when(is_formula, "formula").when(value == old, "equal").otherwise("filled")


def fill_values(baseline: DataFrame, decisions: DataFrame, source: DataFrame) -> DataFrame:
    """baseline_id, old, new, status, action, source_id of every baseline row.

    baseline(baseline_id, original, old, is_formula); the recommended translation gets the line breaks of the
    baseline's edges; rows without one, or with a formula, keep the old value.
    """
    start, end = X.edge_newlines(F.col("original"))
    chosen = source.select("source_id", "korean")
    # the edges go along, not the lines
    baseline = baseline.select("baseline_id", "old", "is_formula", start.alias("start"), end.alias("end"))
    start, end = F.col("start"), F.col("end")
    rows = baseline.join(decisions.select("baseline_id", "source_id", "status"), "baseline_id").join(chosen, "source_id", "left")
    value = X.align_newlines(F.col("korean"), start, end)
    rows = rows.withColumn("value", value).withColumn("action", fill_action(F.col("value"), F.col("old"), F.col("is_formula")))
    new = F.when(F.col("action").isin("kept", "formula"), F.col("old")).otherwise(F.col("value"))
    return rows.select("baseline_id", "old", new.alias("new"), "status", "action", "source_id")


def difference_class(a: Column, b: Column) -> Column:
    return F.when(X.match_key(a) == X.match_key(b), "form").when(X.loose_key(a) == X.loose_key(b), "marks").when(a.contains("|") | b.contains("|"), "variants").otherwise("text")


def compare_fills(ours: DataFrame, theirs: DataFrame, log: DataFrame) -> DataFrame:
    """id, their_id, verdict, difference of every row of ours.

    ours and theirs: id, rel, sheet, row, key, text, translation, is_formula; log: rel, sheet, row, key, old, new,
    action. Rows with a key meet by key, those in the same sheet first; rows without one meet by position. Only a
    single partner counts.
    """
    left = ours.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "rel", "sheet", "row", "key", "text", "translation", "is_formula")])
    right = theirs.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "rel", "sheet", "row", "key", "text", "translation", "is_formula")])
    # partners are counted by key, by key and sheet, and by place, so that a frequent key pairs no rows
    single = lambda *by: right.groupBy(*[F.col(f"b_{c}").alias(f"a_{c}") for c in by]).agg(F.count("*").alias("held"), F.min("b_id").alias("b_id"))
    keyed = left.filter("a_key <> ''").select("a_id", "a_key", "a_rel", "a_sheet")
    local = keyed.join(single("key", "rel", "sheet"), ["a_key", "a_rel", "a_sheet"]).select("a_id", "held", "b_id")
    anywhere = keyed.join(local.select("a_id"), "a_id", "left_anti").join(single("key"), "a_key").select("a_id", "held", "b_id")
    placed = left.filter("a_key = ''").select("a_id", "a_rel", "a_sheet", "a_row").join(single("rel", "sheet", "row"), ["a_rel", "a_sheet", "a_row"]).select("a_id", "held", "b_id")
    one = local.unionByName(anywhere).unionByName(placed)
    partner = one.filter("held = 1").select("a_id", "b_id").join(right.select("b_id", "b_text", "b_translation", "b_is_formula"), "b_id")
    rows = left.join(partner, "a_id", "left").join(log.select(F.col("rel").alias("a_rel"), F.col("sheet").alias("a_sheet"), F.col("row").alias("a_row"), F.col("key").alias("l_key"), "old", "new", "action"), ["a_rel", "a_sheet", "a_row"], "left")
    proven = F.col("new").eqNullSafe(F.col("a_translation")) & F.col("l_key").eqNullSafe(F.col("a_key"))
    verdict = (
        F.when(F.col("b_id").isNull() | (F.col("a_text") != F.col("b_text")), "no_partner").when(F.col("a_is_formula") | F.col("b_is_formula"), "pending")
        .when(F.col("a_translation") != F.col("b_translation"), "different").when(~proven | (X.match_key(F.col("a_translation")) == ""), "pending")
        .when(~F.col("action").isin("filled", "equal") | (F.col("b_translation") == F.col("old")), "pending").otherwise("final")
    )
    rows = rows.withColumn("verdict", verdict)
    return rows.select(F.col("a_id").alias("id"), F.col("b_id").alias("their_id"), "verdict", F.when(F.col("verdict") == "different", difference_class(F.col("a_translation"), F.col("b_translation"))).alias("difference"))


def baseline_statistics(rows: DataFrame) -> DataFrame:
    """Counts and rates by file, by sheet and in total, in one pass; rates come from summed counts.

    rows(path, sheet, n, missing, variants, source_id) are decided baseline rows.
    """
    flag = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    sets = rows.groupingSets([["path", "sheet"], ["path"], []], "path", "sheet").agg(
        F.count("*").alias("total"), flag(F.col("n") > 0).alias("matched"), flag(F.col("n") == 0).alias("unmatched"), flag(F.col("variants") > 1).alias("conflicts"),
        flag((F.col("n") > 0) & (F.col("variants") == 0)).alias("all_missing"), flag(F.col("source_id").isNotNull()).alias("recommended"), F.sum("n").cast("long").alias("pairs"), F.grouping_id().cast("int").alias("level"),
    )
    return sets.withColumn("match_rate", X.rate(F.col("matched"), F.col("total"))).withColumn("recommend_rate", X.rate(F.col("recommended"), F.col("total")))


def source_statistics(source: DataFrame, matched: DataFrame) -> DataFrame:
    """By sheet and in total: rows, matched, missing, distinct conflicting texts. matched(source_id) is distinct."""
    conflicts = conflict_texts(source).select("text", F.lit(1).alias("conflict"))
    rows = source.join(matched.withColumn("hit", F.lit(1)), "source_id", "left").join(conflicts, "text", "left")
    return rows.groupingSets([["path", "sheet"], []], "path", "sheet").agg(
        F.count("*").alias("total"), F.count("hit").alias("matched"), F.sum(F.when(F.col("korean_key") == "", 1).otherwise(0)).cast("long").alias("missing"),
        F.countDistinct(F.when(F.col("conflict") == 1, F.col("text"))).alias("conflicts"), F.grouping_id().cast("int").alias("level"),
    )


def conflict_texts(source: DataFrame) -> DataFrame:
    """text, variants of texts with more than one translation over all sources."""
    return source.filter("korean_key <> ''").groupBy("text").agg(F.countDistinct("korean_key").alias("variants")).filter("variants > 1")


def source_issues(source: DataFrame, matched: DataFrame) -> DataFrame:
    """source_id, unmatched, missing, variants of sources that lack a match or a translation, or whose text conflicts."""
    counts = source.groupBy("text").agg(F.countDistinct(F.when(F.col("korean_key") != "", F.col("korean_key"))).alias("variants"))
    rows = source.join(counts, "text").join(matched.withColumn("hit", F.lit(1)), "source_id", "left")
    rows = rows.select("source_id", F.col("hit").isNull().alias("unmatched"), (F.col("korean_key") == "").alias("missing"), "variants")
    return rows.filter("unmatched or missing or variants > 1")


def unrecommended_sources(source: DataFrame, decisions: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Rows of sources whose (text, translation) no recommendation uses.

    parts(source_id, part, total, complete): what written structure items use; a source that is complete, or whose
    parts are all used, is used as well.
    """
    chosen = decisions.filter("source_id is not null").select("source_id")
    if parts is not None:
        chosen = chosen.unionByName(covered_sources(parts))
    used = chosen.distinct().join(source, "source_id").select("text", "korean_key").distinct()
    return source.join(used, ["text", "korean_key"], "left_anti")


def row_counts(baseline: DataFrame, source: DataFrame, key: str = "text", structure: DataFrame | None = None) -> DataFrame:
    """baseline_id, n, missing, variants of baseline rows with a source; sources are counted by text, not by pair.

    structure(baseline_id, korean_key): items that count as candidates of their row.
    """
    hits = hit_counts(source.filter(F.col(key) != ""), key)
    if structure is None:
        return baseline.select("baseline_id", key).join(hits, key).select("baseline_id", "n", "missing", "variants")
    # variants of both kinds: the translations of a text are one array, met once for each row with an item
    held = source.filter((F.col(key) != "") & (F.col("korean_key") != "")).join(baseline.join(structure.select("baseline_id").distinct(), "baseline_id").select(key).distinct(), key)
    known = held.groupBy(key).agg(F.collect_set("korean_key").alias("known"))
    items = structure.groupBy("baseline_id").agg(F.count("*").alias("more"), F.count_if(F.col("korean_key") == "").alias("blank"), F.collect_set(F.when(F.col("korean_key") != "", F.col("korean_key"))).alias("own"))
    rows = baseline.select("baseline_id", key).join(hits, key, "left").join(items, "baseline_id", "left").join(known, key, "left").filter("n is not null or more is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    empty = F.array().cast("array<string>")
    variants = F.when(F.col("own").isNull(), F.col("variants")).otherwise(F.size(F.array_union(F.coalesce("known", empty), F.col("own"))).cast("long"))
    return rows.select("baseline_id", (zero("n") + zero("more")).alias("n"), (zero("missing") + zero("blank")).alias("missing"), variants.alias("variants"))


def full_statistics(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Nine counts and three rates by sheet (level 0), file (1) and in total (3); sheets without rows are listed too.

    rows(path, sheet, n, variants, source_id) are decided baseline rows, sheets(path, sheet) all that take part.
    """
    listed = sheets.distinct().join(rows.select("path", "sheet", "n", "variants", "source_id", F.lit(1).alias("one")), ["path", "sheet"], "left")
    flag = lambda cond: F.count_if(cond & F.col("one").isNotNull())
    conflict, chosen = F.col("variants") > 1, F.col("source_id").isNotNull()
    sets = listed.groupingSets([["path", "sheet"], ["path"], []], "path", "sheet").agg(
        F.grouping_id().cast("int").alias("level"), F.count("one").alias("total"), flag(F.col("n") > 0).alias("matched"), flag(F.col("variants") > 0).alias("translated"), flag(chosen).alias("recommended"), flag(F.col("n") == 0).alias("unmatched"),
        flag((F.col("n") > 0) & (F.col("variants") == 0)).alias("all_missing"), flag(conflict).alias("conflicts"), flag(conflict & chosen).alias("resolved"), flag(conflict & ~chosen).alias("pending"),
    )
    rates = {"match_rate": "matched", "translate_rate": "translated", "recommend_rate": "recommended"}
    return sets.select("*", *[X.rate(F.col(part), F.col("total")).alias(name) for name, part in rates.items()])


def full_source_statistics(source: DataFrame, matched: DataFrame, skipped: DataFrame) -> DataFrame:
    """By sheet (level 0), file (1) and in total (3): rows, matched, unmatched, missing, conflicting texts, skipped rows, rate, state.

    matched(source_id) and skipped(source_id) are distinct.
    """
    mark = lambda ids, name: ids.select("source_id", F.lit(1).alias(name))
    conflicts = conflict_texts(source).select("text", F.lit(1).alias("conflict"))
    rows = source.join(mark(matched, "hit"), "source_id", "left").join(mark(skipped, "skip"), "source_id", "left").join(conflicts, "text", "left")
    sets = rows.groupingSets([["path", "sheet"], ["path"], []], "path", "sheet").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("total"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"), F.count_if(F.col("korean_key") == "").alias("missing"),
        F.countDistinct(F.when(F.col("conflict") == 1, F.col("text"))).alias("conflicts"), F.count("skip").alias("skipped"),
    )
    return sets.select("*", X.rate(F.col("matched"), F.col("total")).alias("match_rate"), F.when(F.col("skipped") > 0, "partly").otherwise("whole").alias("state"))


def run_totals(decisions: DataFrame, source: DataFrame, baseline: DataFrame, filled: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row with the ten totals of a run."""
    of_rows = decisions.agg(F.count("*").alias("baseline_rows"), F.count_if(F.col("n") > 0).alias("matched"), F.sum("n").alias("pairs"), F.count("source_id").alias("recommended"))
    of_sources = source.agg(F.count("*").alias("source_rows"), F.count_if(F.col("korean_key") == "").alias("missing"))
    counts = {"matched_sources": source.join(baseline.select("text").distinct(), "text", "left_semi"), "conflicts": conflict_texts(source), "filled": filled, "skipped": skipped}
    out = of_rows.join(F.broadcast(of_sources))  # one row each
    for name, table in counts.items():
        out = out.join(F.broadcast(table.agg(F.count("*").alias(name))))
    return out


def top_candidates(baseline: DataFrame, source: DataFrame, shown: int = 3, key: str = "text") -> DataFrame:
    """For rows with at most `shown` candidates: the translations in read order, side by side.

    Texts with more sources go by their count before any row is paired.
    """
    sizes = source.filter(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") <= shown)
    held = source.join(sizes, key).groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("source_id", "korean_key"))).alias("held"))
    columns = [F.get("held", F.lit(i))["korean_key"].alias(f"korean_{i + 1}") for i in range(shown)]
    return baseline.select("baseline_id", key).join(held, key).select("baseline_id", "n", *columns)


def distinct_variants(baseline: DataFrame, source: DataFrame, structure: DataFrame, key: str = "text") -> DataFrame:
    """baseline_id, korean_key: the translations of a row's candidates and of its structure items(baseline_id, korean_key)."""
    by_text = source.filter((F.col("korean_key") != "") & (F.col(key) != "")).select(key, "korean_key").distinct()
    rows = baseline.select("baseline_id", key).join(by_text, key).select("baseline_id", "korean_key")
    return rows.union(structure.filter("korean_key <> ''").select("baseline_id", "korean_key")).distinct()


def unresolved_rows(decisions: DataFrame, structure: DataFrame, pending: DataFrame) -> DataFrame:
    """baseline_id, status of rows without a recommendation, a structure item or a pending structure item."""
    open_rows = decisions.filter("source_id is null").select("baseline_id", "status")
    taken = structure.select("baseline_id").unionByName(pending.select("baseline_id")).distinct()
    return open_rows.join(taken, "baseline_id", "left_anti")


def unmatched_sources(source: DataFrame, baseline: DataFrame, key: str = "text") -> DataFrame:
    """source_id of sources whose text no baseline row has."""
    return source.join(baseline.select(key).distinct(), key, "left_anti").select("source_id")


def unrecommended_reasons(source: DataFrame, baseline: DataFrame, decisions: DataFrame, partial: DataFrame, pending: DataFrame) -> DataFrame:
    """source_id, reason of the sources that no recommendation uses.

    partial(source_id): only some parts of a split are used; pending(source_id, reason): structure items that wait.
    """
    left = unrecommended_sources(source, decisions)
    found = baseline.select("text").distinct().withColumn("found", F.lit(True))
    waits = pending.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("waits"))
    part = partial.select("source_id").distinct().withColumn("part", F.lit(True))
    rows = left.join(found, "text", "left").join(waits, "source_id", "left").join(part, "source_id", "left")
    reason = F.when(F.col("part"), "partly_split").when(F.col("waits").isNotNull(), F.concat(F.lit("structure: "), "waits")).when(F.col("found"), "rules_not_met").otherwise("not_found")
    return rows.select("source_id", reason.alias("reason"))
