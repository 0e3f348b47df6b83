"""Queries of the workbook sources, header checks, switches and logs, on workbooks and tables derived from the given ones."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import reports, rounds
from .queries import SIDES, _base, _pairs, _read, _slim, _src, query
from .sources import tables, workbook

_PRINTABLE = r"[^\x20-\x{D7FF}\x{E000}-\x{FFFD}]"


@query("src1_workbooks", r"""with f as (select page_id, url || case page_id % 6 when 0 then '/a.xlsx' when 1 then '/b.XLSM' when 2 then '/c.xls' when 3 then '/~$d.xlsx' when 4 then '/e.txt' else '/f.ods' end as path from pages) select path, page_id % 6 < 2 as supported from f where page_id % 6 not in (3, 4)""")
def src1(spark, d):
    k = F.col("page_id") % 6
    name = F.when(k == 0, "/a.xlsx").when(k == 1, "/b.XLSM").when(k == 2, "/c.xls").when(k == 3, "/~$d.xlsx").when(k == 4, "/e.txt").otherwise("/f.ods")
    files = _read(spark, d, "pages").select(F.concat("url", name).alias("path"), F.col("html").cast("binary").alias("content"))
    return workbook.choose_workbooks(files).select("path", "supported")


def _book(lines: list[str]) -> bytes:
    """A workbook of one sheet with the lines in its first column."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c></row>' for i, x in enumerate(lines, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="text" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


@query("src2_cells", rf"""select case when doc_id % 50 = 7 then null else 'text' end as sheet, doc_id, cast(case when doc_id % 50 <> 7 then row end as integer) as row, case when doc_id % 50 <> 7 then line end as value, doc_id % 50 = 7 as broken
from (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as row from (select doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_PRINTABLE}', '', 'g')) as l from documents where text is not null)) where (doc_id % 50 <> 7 and line <> '') or row = 1 and doc_id % 50 = 7""")
def src2(spark, d):
    """Each document as a workbook, some of them broken, read back as cells."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            books = [_book(lines.as_py()) if doc_id % 50 != 7 else b"broken" for doc_id, lines in zip(ids, batch.column("lines"), strict=True)]
            yield pa.RecordBatch.from_pydict({"path": [f"{doc_id}.xlsx" for doc_id in ids], "content": pa.array(books, pa.binary())})

    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, _PRINTABLE, ""))
    docs = _read(spark, d, "documents").filter("text is not null").select("doc_id", lines.alias("lines"))
    books = docs.mapInArrow(pack, "path string, content binary")
    cells = workbook.read_cells(workbook.choose_workbooks(books))
    doc_id = F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("long").alias("doc_id")
    return cells.filter("error is not null or value <> ''").select("sheet", doc_id, "row", "value", F.col("error").isNotNull().alias("broken"))


_IGNORED = "select distinct 'in/' || lower(o_orderstatus) || '.xlsx' as file, 's' || (o_custkey % 40) as sheet from orders where o_orderkey % 9 = 0"


def _ignored(spark, d) -> DataFrame:
    """Ignore lists kept as JSON, one for each customer, read back."""
    o = _read(spark, d, "orders").filter("o_orderkey % 9 = 0")
    entry = F.struct(F.concat(F.lit("in\\"), "o_orderstatus", F.lit(".XLSX")).alias("file"), F.concat(F.lit("s"), F.col("o_custkey") % 40).alias("sheet"))
    listed = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_set(entry).alias("sheets"))).alias("json"))
    return workbook.ignored_entries(listed.select(F.from_json("json", workbook.IGNORED, {"mode": "FAILFAST"}).alias("x")).select("x.*"))


@query("src3_ignored_sheets", _IGNORED)
def src3(spark, d):
    return _ignored(spark, d)


@query("src4_reviews", """with c as (select cast(o_orderkey as varchar) as identity, o_orderpriority as fingerprint, o_orderkey as k from orders), old as (select identity, fingerprint, case k % 3 when 0 then 'yes' else 'pending' end as decision, 'old' as comment from c where k % 2 = 0),
new as (select identity, fingerprint, nullif(case k % 4 when 0 then '' when 1 then 'no' else 'yes' end, '') as decision, case when k % 5 = 0 then 'seen' end as comment from c where k % 3 = 0)
select identity, coalesce(n.fingerprint, o.fingerprint) as fingerprint, coalesce(n.decision, o.decision) as decision, coalesce(n.comment, o.comment, '') as comment from old o full join new n using (identity) where coalesce(n.decision, o.decision) is not null""")  # fmt: skip
def src4(spark, d):
    k = F.col("o_orderkey")
    c = _read(spark, d, "orders").select(k.cast("string").alias("identity"), F.col("o_orderpriority").alias("fingerprint"), k)
    old = c.filter(k % 2 == 0).select("identity", "fingerprint", F.when(k % 3 == 0, "yes").otherwise("pending").alias("decision"), F.lit("old").alias("comment"))
    new = c.filter(k % 3 == 0).select("identity", "fingerprint", F.when(k % 4 == 0, " ").when(k % 4 == 1, "no").otherwise("yes").alias("decision"), F.when(k % 5 == 0, "seen").otherwise("").alias("comment"))
    return workbook.apply_reviews(old, new, c)


@query("f1_header_hits", f"with {SIDES}, names as (select distinct text, doc_id % 2 = 0 as cn from cut where doc_id < 40 and row = 1 and text <> '') select sheet, row, case when cn then 'chinese' else 'korean' end as language from cut join names using (text) where row <= 10")
def f1(spark, d):
    lines = tables.document_lines(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("sheet"), (F.col("pos") + 1).alias("row"), F.concat(F.lit("\u3000"), "line", F.lit(" ")).alias("value"))
    first = lines.filter("doc_id < 40 and row = 1").select("doc_id", F.trim(F.regexp_replace("value", "\u3000", "")).alias("v")).filter("v <> ''").collect()  # 40 names at most
    chinese, korean = ([r["v"] for r in first if r["doc_id"] % 2 == k] for k in (0, 1))
    return workbook.header_hits(lines, chinese, korean).select("sheet", "row", "language")


_VERDICTS = """c as (select conv_id, cast(conv_id as varchar) as sheet, turn as row from conversations), h as (select sheet, row, cast(1 + row % 3 as integer) as col, case when row % 3 = 0 then 'chinese' else 'korean' end as language from c where row < 4 and conv_id % 7 > 0 union all select sheet, row, case when conv_id % 4 = 0 then 1 else 5 end, 'korean' from c where row % 3 = 0 and conv_id % 2 = 0 and conv_id % 7 > 0 and row < 3),
n as (select sheet, row, 9 as col from c where conv_id % 3 = 0 union all select sheet, row, 10 from c where conv_id % 6 = 0),
r as (select sheet, row, count(*) filter (language = 'chinese') as cn, count(*) filter (language = 'korean') as ko, min(col) filter (language = 'chinese') as cc, min(col) filter (language = 'korean') as kc, list_has_any(list(col) filter (language = 'chinese'), list(col) filter (language = 'korean')) as same from h group by 1, 2),
s as (select sheet, sum(cn) as cn, sum(ko) as ko, count(*) filter (cn > 0 and ko > 0) as common, min({'row': row, 'cn': cn, 'ko': ko, 'cc': cc, 'kc': kc, 'same': same}) filter (cn > 0 and ko > 0) as f from r group by 1),
m as (select sheet, row, count(*) as n, min(col) as col from n group by 1, 2),
v as (select a.sheet, s.f, m.col as note, case when coalesce(cn, 0) = 0 and coalesce(ko, 0) = 0 then 'no_header' when ko = 0 then 'chinese_only' when cn = 0 then 'korean_only' when common = 0 then 'other_row' when common > 1 then 'several_rows' when f.cn > 1 or f.ko > 1 then 'several_columns' when f.same then 'same_column' when m.n > 1 then 'several_notes' else '' end as issue
from (select distinct sheet from c) a left join s using (sheet) left join m on m.sheet = a.sheet and m.row = s.f.row)"""


@query("f2_sheet_verdict", f"with {_VERDICTS} select sheet, issue, case when issue = '' then f.row end as header_row, case when issue = '' then f.cc end as chinese_column, case when issue = '' then f.kc end as korean_column, case when issue = '' then note end as note_column from v")
def f2(spark, d):
    return _verdicts(spark, d).drop("path")


def _verdicts(spark, d) -> DataFrame:
    k, row = F.col("conv_id"), F.col("row")
    c = _read(spark, d, "conversations").select(F.lit("c").alias("path"), k.cast("string").alias("sheet"), F.col("turn").alias("row"), "conv_id")
    hits = c.filter((row < 4) & (k % 7 > 0)).select("path", "sheet", "row", (1 + row % 3).cast("int").alias("col"), F.when(row % 3 == 0, "chinese").otherwise("korean").alias("language"))
    more = c.filter((row % 3 == 0) & (k % 2 == 0) & (k % 7 > 0) & (row < 3)).select("path", "sheet", "row", F.when(k % 4 == 0, 1).otherwise(5).alias("col"), F.lit("korean").alias("language"))
    note = lambda rows, col: rows.select("path", "sheet", "row", F.lit(col).alias("col"))
    notes = note(c.filter(k % 3 == 0), 9).unionByName(note(c.filter(k % 6 == 0), 10))
    return workbook.sheet_verdicts(hits.unionByName(more), c, notes)


@query("snk1_exceptions", f"with {_VERDICTS} select 'c' as file, 'c' as path, sheet, issue, '' as header_row, '' as details from v where issue <> ''")
def snk1(spark, d):
    return workbook.exceptions_table(_verdicts(spark, d)).select("file", "path", "sheet", "issue", "header_row", "details")


@query("f4_scan_switches", f"with i as ({_IGNORED}), s as (select distinct 'IN/' || o_orderstatus || '.xlsx' as path, 's' || (o_custkey % 60) as sheet, case o_custkey % 6 when 0 then 'hidden' when 1 then 'veryHidden' else 'visible' end as state from orders) select path, s.sheet, case when i.file is not null then 'ignored' when state <> 'visible' then 'hidden_sheet' else '' end as reason from s left join i on i.file = lower(path) and i.sheet = s.sheet")
def f4(spark, d):
    u = F.col("o_custkey")
    state = F.when(u % 6 == 0, "hidden").when(u % 6 == 1, "veryHidden").otherwise("visible")
    sheets = _read(spark, d, "orders").select(F.concat(F.lit("IN/"), "o_orderstatus", F.lit(".xlsx")).alias("path"), F.concat(F.lit("s"), u % 60).alias("sheet"), state.alias("sheet_state")).distinct()
    kept, skipped = workbook.scan_switches(sheets, _ignored(spark, d), hidden_sheets=False)
    return kept.select("path", "sheet", F.lit("").alias("reason")).unionByName(skipped)


@query("f10_optional_columns", """with h as (select cast(l_orderkey as varchar) as sheet, l_linenumber as col, case l_partkey % 9 when 0 then 'Ｋｅｙ' when 1 then 'Text Key' when 2 then 'comment' when 3 then '说话角色' when 4 then '对话ID' when 5 then 'TextTrans' when 6 then 'TRANSLATE' when 7 then '剧情ID' else 'other' end as v, l_partkey % 9 as k from lineitem),
g as (select sheet, count(*) filter (k < 2) as nk, min(col) filter (k < 2) as ck, count(*) filter (k = 2) as nc, min(col) filter (k = 2) as cc, count(*) filter (k = 3) as ns, min(col) filter (k = 3) as cs, count(*) filter (k = 4) as nd, min(col) filter (k = 4) as cd, count(*) filter (k = 7) as np, min(col) filter (k = 7) as cp, count(*) filter (k in (5, 6)) as nt, min(col) filter (k in (5, 6)) as ct, max(col) as last from h group by 1)
select sheet, case when nk = 1 then ck end as key, case when nc = 1 then cc end as comment, case when ns = 1 then cs end as speaker, case when nd = 1 then cd end as dialogue, case when np = 1 then cp end as plot, case when nt = 1 then ct end as target, case when nt = 0 then last + 1 end as new_target, case when nt > 1 then 'several_targets' else '' end as issue from g""")  # fmt: skip
def f10(spark, d):
    names = ["Ｋｅｙ", "Text Key", "comment", "说话角色", "对话ID", "TextTrans", "TRANSLATE", "剧情ID", "other"]
    value = F.get(F.array(*map(F.lit, names)), (F.col("l_partkey") % 9).cast("int"))
    cells = _read(spark, d, "lineitem").select(F.lit("p").alias("path"), F.col("l_orderkey").cast("string").alias("sheet"), F.col("l_linenumber").alias("col"), value.alias("value"))
    return workbook.optional_columns(cells).drop("path", "note")


@query("snk4_fill_log", f"""with {SIDES}, {_pairs('text')}, r as (select b.baseline_id, b.sheet, b.row, case when b.row % 3 = 0 then 'en|0' else '' end as old, x.status, x.source_id, s.korean as value from base b join decision x using (baseline_id) left join src s on s.source_id = x.source_id),
e as (select *, case when coalesce(value, '') = '' then 'kept' when value = old then 'equal' else 'filled' end as action from r)
select 'sub/t.xlsx' as relative, '/in/sub/t.xlsx' as path, sheet, row, 'k' || row as key, old, case when action = 'kept' then old else value end as new, status, action, status || case when source_id is not null then '; source ' || source_id else '' end as basis, source_id as source from e""")  # fmt: skip
def snk4(spark, d):
    base = _base(spark, d)
    src = _slim(_src(spark, d), "source_id", "path", "sheet", "row", "text", "korean", "korean_key")
    rows = base.withColumn("old", F.when(F.col("row") % 3 == 0, "en|0").otherwise("")).withColumn("is_formula", F.lit(False))
    filled = reports.fill_values(rows, rounds.match_round(_slim(_base(spark, d), "baseline_id", "path", "sheet", "row", "text"), src, "text"), src)
    placed = base.withColumn("path", F.lit("/in/sub/t.xlsx")).withColumn("key", F.concat(F.lit("k"), "row"))
    return workbook.fill_log(filled, placed, "/in/")
