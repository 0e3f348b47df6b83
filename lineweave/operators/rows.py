"""Which sheets and rows take part: verdict re-checks, eligibility, rollback of sheets, audits of what is left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# Marks of dropped lines; texts that say a line needs no translation; headers of baselines and results.
DEPRECATED = ["废弃", "폐기"]
DEPRECATED_ANYWHERE = r"^(?:废弃|폐기)$|[（(]废弃[）)]"
ALREADY_INCLUDED = r"^韩[语文](?:已经|已)收录$"
NO_TRANSLATION = r"번역\s*불필요|중복\s*번역|无需翻译"
STAGE_NOTE = "演出"
TEXT_HEADER, OTHER_TEXT_HEADER, OTHER_KEY_HEADER = "Text", "chs", "translationKey"
MERGE_BASELINE = "char.xlsx"


def evidence_sample(cells: DataFrame, candidates: DataFrame, rows: int = 3, cells_a_row: int = 32, characters: int = 80) -> DataFrame:
    """path, sheet, row, sample: the first rows with text and the first candidate rows of each sheet, cut for display."""
    filled = cells.filter(X.match_key(F.col("value")) != "")
    ranked = filled.withColumn("rn", F.row_number().over(Window.partitionBy("path", "sheet", "row").orderBy("col"))).filter(F.col("rn") <= cells_a_row)
    lines = ranked.groupBy("path", "sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.substring(X.match_key(F.col("value")), 1, characters).alias("text")))).alias("cells"))
    hits = candidates.select("path", "sheet", "row").distinct().withColumn("hit", F.lit(True))
    marked = lines.join(hits, ["path", "sheet", "row"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    sheet = Window.partitionBy("path", "sheet")
    placed = marked.withColumn("nth", F.row_number().over(sheet.orderBy("row"))).withColumn("nth_hit", F.sum(F.col("hit").cast("int")).over(sheet.orderBy("row")))
    shown = placed.filter((F.col("nth") <= rows) | (F.col("hit") & (F.col("nth_hit") <= rows)))
    return shown.select("path", "sheet", "row", F.array_join(F.transform("cells", lambda c: c["text"]), " | ").alias("sample"))


def recheck(now: DataFrame, earlier: DataFrame) -> DataFrame:
    """path, sheet, issue: what was abnormal at the first check stays so; a failure of the file (empty sheet) holds for all its sheets."""
    of_sheet = earlier.filter("sheet <> '' and issue <> ''").groupBy("path", "sheet").agg(F.min("issue").alias("sheet_issue"))
    of_file = earlier.filter("sheet = '' and issue <> ''").groupBy("path").agg(F.min("issue").alias("file_issue"))
    joined = now.join(of_sheet, ["path", "sheet"], "left").join(of_file, "path", "left")
    return joined.select("path", "sheet", F.coalesce("file_issue", "sheet_issue", "issue").alias("issue"))


def excluded_reason(note: Column, note_formula: Column, remark: Column, remark_formula: Column, include_deprecated: bool = False) -> Column:
    """'' for eligible source rows. A missing note never excludes; a remark counts only where deprecated rows are excluded."""
    dropped = (~note_formula & X.match_key(note).isin(DEPRECATED)) | (~remark_formula & X.match_key(remark).isin(DEPRECATED))
    if include_deprecated:
        return F.when(note_formula, "formula").otherwise("")
    return F.when(dropped, "deprecated").when(note_formula | remark_formula, "formula").otherwise("")


def customer_reason(others: Column, korean: Column, note: Column, speaker: Column, has_speaker: Column, loose: Column, include_deprecated: bool = False) -> Column:
    """'' or why the key rules leave a row out. others: texts of the row's remaining cells."""
    dropped = F.lit(False) if include_deprecated else F.exists(others, lambda v: X.match_key(v).rlike(DEPRECATED_ANYWHERE))
    needless = X.match_key(korean).rlike(ALREADY_INCLUDED) | F.exists(others, lambda v: F.coalesce(v, F.lit("")).rlike(NO_TRANSLATION))
    staged = (X.match_key(note) == STAGE_NOTE) | (has_speaker & (X.match_key(speaker) == ""))
    return F.when(dropped, "deprecated").when(needless, "no_translation").when(staged, "stage").when(loose == "", "symbols").otherwise("")


def without_bad_sheets(rows: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of the sheets that have no bad row, and path, sheet, bad_rows of the others."""
    skipped = rows.filter(bad).groupBy("path", "sheet").agg(F.count("*").alias("bad_rows"))
    return rows.join(skipped, ["path", "sheet"], "left_anti"), skipped


def exclusions(rows: DataFrame) -> DataFrame:
    """Audit of excluded rows that have text or a note, and of stage rows that do not count as context.

    rows(source_id, text, note, reason, context_skip).
    """
    out = (F.col("reason") != "") & ((F.col("text") != "") | (F.col("note") != ""))
    return rows.filter(out | (F.col("context_skip") != "")).select("source_id", F.when(out, F.col("reason")).otherwise(F.concat(F.lit("no context: "), "context_skip")).alias("reason"))


def baseline_columns(cells: DataFrame, results: list[str], rows: int = 10) -> DataFrame:
    """path, sheet, issue, header_row, text_column: exactly one text header, the second name only beside a key header."""
    named = cells.filter(F.col("row") <= rows).withColumn("name", X.match_key(F.col("value"))).filter(F.col("name").isin(TEXT_HEADER, OTHER_TEXT_HEADER, OTHER_KEY_HEADER, *results))
    keyed = F.max((F.col("name") == OTHER_KEY_HEADER).cast("int")).over(Window.partitionBy("path", "sheet", "row")) == 1
    hit = (F.col("name") == TEXT_HEADER) | ((F.col("name") == OTHER_TEXT_HEADER) & F.col("keyed"))
    by_sheet = named.withColumn("keyed", keyed).withColumn("hit", hit).groupBy("path", "sheet").agg(
        F.sum(F.col("hit").cast("int")).alias("hits"), F.max(F.col("name").isin(results).cast("int")).alias("filled"), F.min(F.when(F.col("hit"), F.struct("row", "col"))).alias("at")
    )
    issue = F.when(F.col("filled") == 1, "has_results").when(F.col("hits") == 0, "no_text").when(F.col("hits") > 1, "several_texts").otherwise("")
    good = F.col("issue") == ""
    return by_sheet.withColumn("issue", issue).select("path", "sheet", "issue", F.when(good, F.col("at.row")).alias("header_row"), F.when(good, F.col("at.col")).alias("text_column"))


def merge_targets(baseline: DataFrame, whole_matches: DataFrame) -> DataFrame:
    """Rows of the merge baselines that have no whole-line match."""
    name = F.lower(F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1))
    return baseline.filter(name == MERGE_BASELINE).join(whole_matches.select("baseline_id").distinct(), "baseline_id", "left_anti")


def existing_content(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells below the header of the target columns (path, sheet, col, header_row) that hold a value or a formula."""
    met = cells.join(targets, ["path", "sheet", "col"]).filter("row > header_row")
    return met.filter((X.match_key(F.col("value")) != "") | (F.col("data_type") == "f")).select("path", "sheet", "row", "col")


def refuse_existing(cells: DataFrame, targets: DataFrame) -> None:
    """Stop a run whose result columns are not empty."""
    found = existing_content(cells, targets).limit(1).count()
    if found:
        raise ValueError("a result column already holds values")


def header_report(verdicts: DataFrame) -> DataFrame:
    """By file and in total: sheets, passed, exceptions, abnormal files; the names of a file's passed sheets."""
    by_file = verdicts.groupBy("path").agg(
        F.count("*").alias("sheets"), F.sum((F.col("issue") == "").cast("long")).alias("passed"), F.sum((F.col("issue") != "").cast("long")).alias("exceptions"),
        F.max((F.col("issue") != "").cast("long")).alias("abnormal_files"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("issue") == "", F.col("sheet")))), ",").alias("passed_sheets"),
    )
    sums = [F.sum(c).alias(c) for c in ("sheets", "passed", "exceptions", "abnormal_files")]
    return by_file.unionByName(by_file.agg(*sums).select(F.lit(None).cast("string").alias("path"), "*", F.lit(None).cast("string").alias("passed_sheets")))


def reasons(*lists: DataFrame) -> DataFrame:
    """source_id, reasons: distinct reasons of all lists(source_id, reason), sorted and joined."""
    both = reduce(DataFrame.unionByName, lists)
    return both.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reasons"))


# Headers that a script sheet may have once.
SINGLE_HEADERS = {"note": "特殊说明", "speaker": "说话角色名"}
SHEET, FILE, RUN = "sheet", "file", "run"


def rollbacks(cells: DataFrame, sheets: DataFrame, structure: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """path, sheet, row, scope, reason of what may not be read: formulas in text columns and headers that stand twice.

    cells(path, sheet, row, col, value, data_type), sheets(path, sheet, side, header_row, text_column, korean_column,
    scene_column; null where there is none). A script sheet is dropped as a whole, whatever its other rows hold;
    excluded(path, sheet, row) are no longer looked at. A formula in a string table stops a lookup (scope 'run'); the
    structure scan only leaves out that file. Of several formulas of a sheet the first row is named.
    """
    at = cells.join(sheets, ["path", "sheet"])
    texts = F.array("text_column", "korean_column", *(["scene_column"] if structure else []))
    formulas = at.filter((F.col("row") > F.col("header_row")) & (F.col("data_type") == "f") & F.array_contains(F.array_compact(texts), F.col("col")))
    if excluded is not None:
        formulas = formulas.join(excluded, ["path", "sheet", "row"], "left_anti")
    scope = F.when(F.col("side") == "source", SHEET).otherwise(FILE if structure else RUN)
    found = formulas.groupBy("path", "sheet", "side").agg(F.min("row").alias("row")).select("path", "sheet", "row", scope.alias("scope"), F.lit("formula").alias("reason"))
    header = at.filter("side = 'source' and row = header_row").withColumn("header", X.normalize(F.col("value")))
    named = reduce(Column.__or__, [F.col("header") == name for name in SINGLE_HEADERS.values()])
    twice = header.filter(named).groupBy("path", "sheet", "row", "header").agg(F.count("*").alias("n")).filter("n > 1")
    kind = reduce(lambda c, x: c.when(F.col("header") == x[1], f"several_{x[0]}_headers"), SINGLE_HEADERS.items(), F)
    return found.unionByName(twice.select("path", "sheet", "row", F.lit(SHEET).alias("scope"), kind.alias("reason")))


def keep_readable(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows(path, sheet, ...) without the sheets and files that verdicts of rollbacks() name; one of a run is an error."""
    stop = verdicts.filter(F.col("scope") == RUN).orderBy("path", "sheet").select("path", "sheet", "row", "reason").first()
    if stop:
        raise ValueError(f"{stop['path']}, sheet {stop['sheet']}, row {stop['row']}: {stop['reason']}")
    out = rows.join(verdicts.filter(F.col("scope") == SHEET).select("path", "sheet").distinct(), ["path", "sheet"], "left_anti")
    return out.join(verdicts.filter(F.col("scope") == FILE).select("path").distinct(), "path", "left_anti").select(*rows.columns)
