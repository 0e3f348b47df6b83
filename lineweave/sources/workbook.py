"""Workbooks as a long table of cells, header checks, and lists kept as JSON.

Spark finds the files and deals them out, one task reads one file at a time; a bad file or sheet becomes an error row.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import send_package
from ..functions import text as X

# Suffixes that are read, suffixes that are reported, default header names.
READ, REPORTED = (".xlsx", ".xlsm"), (".xls", ".xlsb", ".ods")
CHINESE_HEADERS = ["对白文本", "台词", "文本内容（示例）", "语音", "最新(2.18)", "中文原文"]
KOREAN_HEADERS = ["韩文", "한국어", "韩语译文"]
CELLS = "path string, sheet string, sheet_index int, sheet_state string, row int, col int, value string, data_type string, row_hidden boolean, error string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
#: Cells handed on at once, whatever a workbook holds; small workbooks share a batch.
SLICE = 50_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def find_workbooks(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, supported, content of the workbooks under root; lock files are left out, a folder without any is refused."""
    found = choose_workbooks(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root))
    if not found.select("path").limit(1).count():
        raise ValueError(f"no workbook under {root}")
    return found


def choose_workbooks(files: DataFrame) -> DataFrame:
    """path, supported, content of those files(path, content) that are workbooks and no lock files."""
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    name = F.element_at(F.split("path", "/"), -1)
    found = files.filter(~name.startswith("~$") & suffix.isin(*READ, *REPORTED))
    return found.select("path", suffix.isin(*READ).alias("supported"), F.when(suffix.isin(*READ), F.col("content")).alias("content"))


def refuse_nested(*roots: str) -> None:
    """Source, baseline and output folders must not contain each other."""
    plain = [re.sub(r"/+", "/", r.replace("\\", "/")).rstrip("/") + "/" for r in roots]
    for i, a in enumerate(plain):
        for b in plain[i + 1 :]:
            if a.startswith(b) or b.startswith(a):
                raise ValueError(f"{a} and {b} contain each other")


def scan_switches(sheets: DataFrame, ignored: DataFrame, hidden_sheets: bool = True) -> tuple[DataFrame, DataFrame]:
    """The sheets(path, sheet, sheet_state) that take part, and path, sheet, reason of those left out.

    ignored(file, sheet) is the ignore list: file is a normalised path. With hidden_sheets off only visible ones stay.
    """
    marks = ignored.select(F.col("file").alias("__file"), "sheet", F.lit(True).alias("__ignored")).distinct()
    known = sheets.withColumn("__file", X.path_identity(F.col("path"))).join(marks, ["__file", "sheet"], "left")
    reason = F.when(F.col("__ignored"), "ignored").when(F.lit(not hidden_sheets) & (F.col("sheet_state") != "visible"), "hidden_sheet").otherwise("")
    judged = known.withColumn("reason", reason)
    return judged.filter("reason = ''").drop("reason", "__file", "__ignored"), judged.filter("reason <> ''").select("path", "sheet", "reason")


# Headers of the optional columns.
OPTIONAL = {
    "key": ["translationKey", "Key", "TextKey", "ID"], "comment": ["Comment"], "speaker": ["说话角色名", "说话角色", "角色", "角色名", "speaker", "CharacterName", "Character"],
    "dialogue": ["对话ID", "台词ID"], "plot": ["剧情ID"], "target": ["TextTrans", "translate"], "note": ["特殊说明"],
}


def optional_columns(headers: DataFrame, names: dict[str, list[str]] = OPTIONAL) -> DataFrame:
    """path, sheet, one column number for each optional name (null if absent or ambiguous), new_target, issue.

    headers(path, sheet, col, value) are the cells of the header row. Names are compared in NFKC without blanks and
    case. Without a target column a new one comes after the last header; with several the issue is 'several_targets'.
    """
    plain = lambda c: F.lower(F.regexp_replace(X.normalize(c), " ", ""))
    cells = headers.withColumn("__name", plain(F.col("value")))
    is_one = {name: F.col("__name").isin([x.lower().replace(" ", "") for x in of]) for name, of in names.items()}
    hits = {name: F.count_if(test).alias(f"__{name}_n") for name, test in is_one.items()}
    places = {name: F.min(F.when(test, F.col("col"))).alias(f"__{name}") for name, test in is_one.items()}
    sheets = cells.groupBy("path", "sheet").agg(*hits.values(), *places.values(), F.max("col").alias("__last"))
    columns = [F.when(F.col(f"__{name}_n") == 1, F.col(f"__{name}")).alias(name) for name in names]
    several = F.col("__target_n") > 1
    return sheets.select("path", "sheet", *columns, F.when(F.col("__target_n") == 0, F.col("__last") + 1).alias("new_target"), F.when(several, "several_targets").otherwise("").alias("issue"))


def _joined_text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _sheet_cells(path: str, name: str, index: int, state: str, data: bytes, shared: list[str]) -> Iterator[tuple]:
    row, hidden = 0, False
    for event, node in ElementTree.iterparse(io.BytesIO(data), events=("start", "end")):
        if node.tag == f"{_MAIN}row":
            if event == "start":
                row, hidden, col = int(node.get("r", row + 1)), node.get("hidden") in ("1", "true"), 0
            else:
                node.clear()
        elif node.tag == f"{_MAIN}c" and event == "end":
            col = _column(node.get("r")) or col + 1
            kind, raw = node.get("t", "n"), node.find(f"{_MAIN}v")
            if node.find(f"{_MAIN}f") is not None:
                yield path, name, index, state, row, col, f"={node.find(f'{_MAIN}f').text or ''}", "f", hidden, None
            elif kind == "inlineStr":
                yield path, name, index, state, row, col, _joined_text(node), "s", hidden, None
            elif raw is not None and raw.text is not None:
                yield path, name, index, state, row, col, shared[int(raw.text)] if kind == "s" else raw.text, "s" if kind in ("s", "str") else kind, hidden, None


def _column(reference: str | None) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference or "")[0]:
        n = 26 * n + ord(c) - 64
    return n


def _workbook_cells(path: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            parts = set(book.namelist())
            shared = [_joined_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
            targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            sheets = [(x.get("name"), x.get("state", "visible"), targets[x.get(_REL)]) for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
            for index, (name, state, target) in enumerate(sheets):
                try:
                    yield from _sheet_cells(path, name, index, state, book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), shared)
                except (KeyError, ValueError, IndexError, ElementTree.ParseError) as e:
                    yield path, name, index, state, None, None, None, None, None, f"{type(e).__name__}: {e}"
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        yield path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def read_cells(workbooks: DataFrame) -> DataFrame:
    """Cells of find_workbooks(); formula cells have data_type 'f', errors are rows with `error` alone."""
    send_package(workbooks.sparkSession)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, CELLS.split(", "))])
        books = ((path.as_py(), content.as_py()) for batch in batches for path, content in zip(batch.column("path"), batch.column("content"), strict=True))
        found = (cell for path, content in books for cell in _workbook_cells(path, content))
        while rows := list(islice(found, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return workbooks.filter("supported").select("path", "content").mapInArrow(cells, CELLS)


def header_hits(cells: DataFrame, chinese: list[str], korean: list[str], rows: int = 10, hidden: bool = True) -> DataFrame:
    """Cells of the first rows whose normalised text is one of the header names; language tells which.

    A name of both lists gives a row for either language.
    """
    shown = cells if hidden else cells.filter(~F.col("row_hidden"))
    first = shown.filter(F.col("row") <= rows).withColumn("__text", X.normalize(F.col("value")))
    languages = F.array(F.when(F.col("__text").isin(chinese), "chinese"), F.when(F.col("__text").isin(korean), "korean"))
    return first.withColumn("language", F.explode(F.filter(languages, lambda x: x.isNotNull()))).drop("__text")


def sheet_verdicts(hits: DataFrame, sheets: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """path, sheet, issue ('' if passed), header_row, chinese_column, korean_column, note_column of every sheet.

    hits(path, sheet, row, col, language); sheets(path, sheet) adds those without any hit; notes(path, sheet, row, col)
    are the note columns, of which the header row may have one (leave them out where deprecated rows take part).
    """
    of = lambda x: F.col("language") == x
    by_row = hits.groupBy("path", "sheet", "row").agg(
        F.count_if(of("chinese")).alias("chinese"), F.count_if(of("korean")).alias("korean"), F.min(F.when(of("chinese"), F.col("col"))).alias("c_col"), F.min(F.when(of("korean"), F.col("col"))).alias("k_col"),
        F.arrays_overlap(F.collect_set(F.when(of("chinese"), F.col("col"))), F.collect_set(F.when(of("korean"), F.col("col")))).alias("overlap"),
    )
    common = (F.col("chinese") > 0) & (F.col("korean") > 0)
    row = F.when(common, F.struct("row", "chinese", "korean", "c_col", "k_col", "overlap"))
    found = by_row.groupBy("path", "sheet").agg(F.sum("chinese").alias("cn"), F.sum("korean").alias("ko"), F.count(row).alias("common"), F.min(row).alias("first"))
    everyone = found if sheets is None else sheets.select("path", "sheet").distinct().join(found, ["path", "sheet"], "left")
    if notes is None:
        noted = everyone.withColumn("note_n", F.lit(0)).withColumn("note_col", F.lit(None).cast("int"))
    else:
        by_note = notes.groupBy("path", "sheet", F.col("row").alias("note_row")).agg(F.count("*").alias("note_n"), F.min("col").alias("note_col"))
        noted = everyone.withColumn("note_row", F.col("first.row")).join(by_note, ["path", "sheet", "note_row"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    issue = (
        F.when((zero("cn") == 0) & (zero("ko") == 0), "no_header").when(zero("ko") == 0, "chinese_only").when(zero("cn") == 0, "korean_only").when(zero("common") == 0, "other_row")
        .when(F.col("common") > 1, "several_rows").when((F.col("first.chinese") > 1) | (F.col("first.korean") > 1), "several_columns").when(F.col("first.overlap"), "same_column")
        .when(zero("note_n") > 1, "several_notes").otherwise("")
    )
    out = noted.withColumn("issue", issue)
    passed = lambda c: F.when(F.col("issue") == "", F.col(c))
    return out.select("path", "sheet", "issue", passed("first.row").alias("header_row"), passed("first.c_col").alias("chinese_column"), passed("first.k_col").alias("korean_column"), passed("note_col").alias("note_column"))


def ignored_sheets(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet of an ignore list kept as JSON {version, sheets: [{file, sheet}]}; another version is refused."""
    return ignored_entries(spark.read.schema(IGNORED).option("multiLine", True).option("mode", "FAILFAST").json(path))


IGNORED = "version int, sheets array<struct<file: string, sheet: string>>"


def ignored_entries(listed: DataFrame) -> DataFrame:
    """file, sheet of ignore lists(version, sheets); files are normalised paths."""
    checked = listed.select(F.when(F.col("version") == 1, F.col("sheets")).otherwise(F.raise_error(F.lit("unknown version of the ignore list")).cast("array<struct<file: string, sheet: string>>")).alias("sheets"))
    entries = checked.select(F.explode("sheets").alias("x")).select("x.file", "x.sheet").distinct()
    return entries.withColumn("file", X.path_identity(F.col("file")))


def apply_reviews(reviews: DataFrame, filled: DataFrame, candidates: DataFrame, decisions: tuple[str, ...] = ("yes", "no", "pending")) -> DataFrame:
    """identity, fingerprint, decision, comment: old reviews overlaid by a filled table; one bad row refuses the import.

    Bad: an unknown decision, an unknown identity, a changed fingerprint, an identity twice. A blank decision keeps
    the old one.
    """
    known = candidates.select("identity", F.col("fingerprint").alias("now"))
    said = lambda rows: rows if "comment" in rows.columns else rows.withColumn("comment", F.lit(""))
    reviews, filled = said(reviews), said(filled)
    checked = filled.join(known, "identity", "left").groupBy("identity").agg(F.first("comment").alias("new_comment"), F.count("*").alias("times"), F.first("fingerprint").alias("fingerprint"), F.first("now").alias("now"), F.first(X.match_key(F.col("decision"))).alias("decision"))
    bad: Column = (F.col("times") > 1) | F.col("now").isNull() | ~F.col("now").eqNullSafe(F.col("fingerprint")) | ~F.col("decision").isin("", *decisions)
    refused = checked.agg(F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad")).first()["bad"]
    if refused:
        raise ValueError(f"the review table is refused: {refused} bad rows")
    new = checked.select("identity", F.col("fingerprint").alias("new_fingerprint"), F.nullif("decision", F.lit("")).alias("new_decision"), F.nullif("new_comment", F.lit("")).alias("new_comment"))
    merged = reviews.join(new, "identity", "full_outer")
    out = merged.select("identity", F.coalesce("new_fingerprint", "fingerprint").alias("fingerprint"), F.coalesce("new_decision", "decision").alias("decision"), F.coalesce("new_comment", "comment", F.lit("")).alias("comment"))
    return out.filter("decision is not null")


# Columns of the exceptions table; the mark that tells a spreadsheet the encoding.
EXCEPTIONS = ["file", "path", "sheet", "sheet_state", "issue", "chinese", "korean", "header_row", "chinese_column", "korean_column", "details"]
BYTE_ORDER_MARK = "\ufeff"


def exceptions_table(verdicts: DataFrame) -> DataFrame:
    """The 11 columns of the exceptions table as text; what a spreadsheet would run gets a leading quote, what is unknown stays empty."""
    bad = verdicts.filter("issue <> ''").withColumn("file", F.element_at(F.split("path", "/"), -1))
    text = lambda c: F.coalesce(X.spreadsheet_safe(F.col(c).cast("string")), F.lit("")) if c in bad.columns else F.lit("")
    return bad.select(*[text(c).alias(c) for c in EXCEPTIONS])


def write_exceptions(verdicts: DataFrame, path: str) -> None:
    """The exceptions table as one CSV file with a byte order mark, and its header even if empty: a list for people."""
    table = exceptions_table(verdicts).withColumnRenamed("file", f"{BYTE_ORDER_MARK}file")
    table.coalesce(1).write.option("header", True).option("encoding", "UTF-8").csv(path)


def write_log(filled: DataFrame, baseline: DataFrame, root: str, path: str) -> None:
    """The log of fill_values() as CSV: see fill_log()."""
    fill_log(filled, baseline, root).write.option("header", True).csv(path)


def fill_log(filled: DataFrame, baseline: DataFrame, root: str) -> DataFrame:
    """relative, path, sheet, row, key, old, new, status, action, basis, source of every filled row, relative to root."""
    place = baseline.select("baseline_id", "path", "sheet", "row", "key")
    start = F.length(F.lit(root.rstrip("/"))) + 2
    rows = filled.join(place, "baseline_id")
    relative = F.when(F.col("path").startswith(f"{root.rstrip('/')}/"), F.expr("path").substr(start, F.length("path"))).otherwise(F.col("path"))
    basis = F.concat_ws("; ", F.col("status"), F.when(F.col("source_id").isNotNull(), F.concat(F.lit("source "), F.col("source_id").cast("string"))))
    return rows.select(relative.alias("relative"), "path", "sheet", "row", "key", "old", "new", "status", "action", basis.alias("basis"), F.col("source_id").alias("source"))
