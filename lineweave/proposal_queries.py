"""Queries of the key proposals and of the result tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import settle, shared_dir
from .functions import text as X
from .operators import proposals, reports, rounds
from .queries import SIDES, _base, _loose, _pairs, _read, _slim, _src, query
from .sources import outputs

# ---- proposals


@query("j12_direct_ids", """with s as (select l_orderkey * 10 + l_linenumber as source_id, l_orderkey as dialogue, l_returnflag as loose, case when l_linenumber % 3 = 0 then '' else l_linestatus end as role from lineitem),
b as (select o_orderkey as baseline_id, o_orderkey as number, case when o_custkey % 2 = 0 then 'N' else 'R' end as loose, o_orderstatus as role from orders where o_orderkey % 5 <> 0 union all select o_orderkey + 100000000, o_orderkey, 'N', 'F' from orders where o_orderkey % 4 = 0)
select source_id, min(baseline_id) as baseline_id from s join b on s.dialogue = b.number and s.loose = b.loose and (s.role = '' or s.role = b.role) group by source_id""")  # fmt: skip
def j12(spark, d):
    names = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    role = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linestatus"))
    s = _read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"), F.col("l_orderkey").cast("string").alias("dialogue"), F.col("l_returnflag").alias("loose"), names(role).alias("roles"))
    o = _read(spark, d, "orders").withColumn("number", F.col("o_orderkey"))
    key = lambda family: F.concat(F.lit(f"{family}_"), "o_orderkey", F.lit("_Dialog_Detail_v0")).alias("key")
    b = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("baseline_id"), key("story_text"), "number", F.when(F.col("o_custkey") % 2 == 0, "N").otherwise("R").alias("loose"), names(F.col("o_orderstatus")).alias("roles"))
    more = o.filter("o_orderkey % 4 = 0").select((F.col("o_orderkey") + 100000000).alias("baseline_id"), key("story_convenient"), "number", F.lit("N").alias("loose"), names(F.lit("F")).alias("roles"))
    return proposals.direct_ids(s, b.unionByName(more))


@query("j16_voice_scope", """select distinct o_orderpriority as speaker, lpad(cast(o_custkey % 1000 as varchar), 6, '0') as voice from orders where o_orderkey % 3 = 0 union all select * from (values ('男主角', '199002'), ('女主角', '199001'))""")
def j16(spark, d):
    key = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("char_voice_words_ab_"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 6, "0"))).otherwise(F.concat(F.lit("story_text_"), "o_custkey"))
    return proposals.voice_scope(_read(spark, d, "orders").select(F.col("o_orderpriority").alias("speaker"), key.alias("key")))


def _loose_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    return tuple(side.withColumn("loose", X.loose_key(F.col("text"))) for side in (_src(spark, d), _base(spark, d)))


_UNIQUE = f"""{SIDES}, s as (select source_id, sheet, row, {_loose('text')} as k from src), b as (select baseline_id, sheet, row, {_loose('text')} as k from base),
one as (select k, min(baseline_id) as baseline_id from b where length(k) >= 7 group by k having count(*) = 1), c as (select source_id, baseline_id from s join one using (k))"""


@query("j17_context_overlap", f"""with {_UNIQUE}, p as (select c.source_id, c.baseline_id, x.row - s.row as d from c join s using (source_id) join b using (baseline_id) join s x on x.sheet = s.sheet and x.row between s.row - 3 and s.row + 3 and x.row <> s.row and x.k <> ''
join b y on y.sheet = b.sheet and y.k = x.k and ((x.row < s.row and y.row between b.row - 5 and b.row - 1) or (x.row > s.row and y.row between b.row + 1 and b.row + 5)))
select source_id, baseline_id, count(distinct d) filter (d < 0) as before, count(distinct d) filter (d > 0) as after from c left join p using (source_id, baseline_id) group by 1, 2""")  # fmt: skip
def j17(spark, d):
    long = (F.length("loose") >= 7).alias("long")
    s, b = (settle(side.select(side.columns[0], "path", "sheet", "row", X.digest(F.col("loose")).alias("loose"), long), "side") for side in _loose_sides(spark, d))
    one = b.filter("long").groupBy("loose").agg(F.count("*").alias("n"), F.min("baseline_id").alias("baseline_id")).filter("n = 1")
    return proposals.context_overlap(s.join(one, "loose").select("source_id", "baseline_id"), s, b)


def _gaps(spark, d) -> tuple[DataFrame, DataFrame]:
    """Turns of events between anchors (every ninth event of a user): even ones are script rows, odd ones targets."""
    from pyspark.sql.window import Window

    e = _read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("loose"))
    run = F.sum((F.col("event_id") % 9 == 0).cast("int")).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.withColumn("gap", F.concat_ws("/", "user_id", run)).filter("event_id % 9 <> 0").withColumn("row", F.col("event_id"))
    return rows.filter("event_id % 2 = 0").withColumnRenamed("event_id", "source_id"), rows.filter("event_id % 2 = 1").withColumnRenamed("event_id", "baseline_id")


@query("j18_between_anchors")
def j18(spark, d):
    return proposals.between_anchors(*_gaps(spark, d))


@query("j19_beside_anchor")
def j19(spark, d):
    return proposals.beside_anchor(*_gaps(spark, d))


@query("j20_similar_unique")
def j20(spark, d):
    return proposals.similar_unique(*_loose_sides(spark, d))


@query("w11_previous_lines", "with r as (select conv_id * 1000 + turn as id, conv_id, turn, role, turn % 3 = 0 as opt, turn % 5 = 1 as ex from conversations) select id as source_id, p.id as previous_id, p.role as previous_key from (select *, last_value(case when not opt and not ex then {'id': id, 'role': role} end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as p from r) where opt and not ex")
def w11(spark, d):
    c = _read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), F.lit("c").alias("path"), F.col("conv_id").alias("sheet"), F.col("turn").alias("row"), (F.col("turn") % 3 == 0).alias("is_option"), (F.col("turn") % 5 == 1).alias("excluded"), F.col("role").alias("key"))
    return proposals.previous_lines(c)


_KEYED = """b as (select o_orderkey as baseline_id, o_custkey % 2 as sheet, o_orderkey as row, case when o_orderkey % 3 = 0 then 'story_text_' || o_orderkey || '_Dialog_Detail_v0' when o_orderkey % 3 = 1 then 'item_' || o_orderkey else '' end as key, case when o_orderkey % 3 = 0 then 'd' else 'i' end as kind,
case when o_orderkey % 2 = 0 then 'long line ' || (o_orderkey % 300) else 's' || (o_orderkey % 300) end as loose, o_orderstatus as role from orders),
p as (select o_orderkey % 97 as source_id, o_orderkey as baseline_id, o_orderpriority as korean from orders where o_orderkey % 11 = 0)"""


def _keyed(spark, d) -> tuple[DataFrame, DataFrame]:
    o, k = _read(spark, d, "orders"), F.col("o_orderkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("story_text_"), k, F.lit("_Dialog_Detail_v0"))).when(k % 3 == 1, F.concat(F.lit("item_"), k)).otherwise("")
    loose = F.when(k % 2 == 0, F.concat(F.lit("long line "), k % 300)).otherwise(F.concat(F.lit("s"), k % 300))
    b = o.select(k.alias("baseline_id"), F.lit("b").alias("path"), (F.col("o_custkey") % 2).alias("sheet"), k.alias("row"), key.alias("key"), loose.alias("loose"), F.array("o_orderstatus").alias("roles"))
    return b, o.filter("o_orderkey % 11 = 0").select((k % 97).alias("source_id"), k.alias("baseline_id"), F.col("o_orderpriority").alias("korean"))


@query("j23_propagated_proposals", f"""with {_KEYED}, n as (select b.*, case when length(u.loose) > 6 then u.loose end as above, case when length(v.loose) > 6 then v.loose end as below from b left join b u on u.sheet = b.sheet and u.row = b.row - 1 left join b v on v.sheet = b.sheet and v.row = b.row + 1 where b.key <> '')
select distinct p.source_id, y.baseline_id, p.korean from p join n x using (baseline_id) join n y on y.loose = x.loose and y.kind = x.kind and y.role = x.role where y.baseline_id not in (select baseline_id from p) and (length(x.loose) > 6 or x.above = y.above or x.below = y.below)""")  # fmt: skip
def j23(spark, d):
    b, p = _keyed(spark, d)
    return proposals.propagate(p, b)


@query("j24_claim_guard", f"with {_KEYED} select o_orderkey as baseline_id, o_orderkey in (select baseline_id from p) as refused from orders where o_custkey % 4 = 0")
def j24(spark, d):
    _, p = _keyed(spark, d)
    kept, refused = proposals.guard_claims(p, _read(spark, d, "orders").filter("o_custkey % 4 = 0").select(F.col("o_orderkey").alias("baseline_id")))
    return kept.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


_SETTLED = """q as (select l_orderkey as baseline_id, l_orderkey * 10 + l_linenumber as source_id, case when l_linenumber % 3 = 0 then '' else l_returnflag end as korean, l_suppkey % 2 as part from lineitem where l_partkey % 3 = 0),
g as (select baseline_id, count(distinct nullif(korean, '')) as v, min((source_id, part)) filter (korean <> '') as f from q group by 1),
z as (select q.*, f, case when baseline_id % 7 = 0 then 'locked' when baseline_id % 5 = 0 then 'structure_conflict' when v > 1 then 'several' when v = 0 then 'missing' else 'added' end as outcome from q join g using (baseline_id)),
w as (select baseline_id, source_id, cast(part as bigint) as part, outcome, case when outcome = 'added' and f = (source_id, part) then case when part > 0 then 'option' else 'line' end else '' end as applied from z)"""


def _settled(spark, d) -> DataFrame:
    korean = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag"))
    li, k = _read(spark, d, "lineitem").filter("l_partkey % 3 = 0"), F.col("l_orderkey").alias("baseline_id")
    made = li.select(k, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"), korean.alias("korean"), (F.col("l_suppkey") % 2).cast("long").alias("part"))
    return proposals.settle_proposals(made, li.filter("l_orderkey % 7 = 0").select(k), li.filter("l_orderkey % 5 = 0").select(k))


@query("d6_settled_proposals", f"with {_SETTLED} select * from w")
def d6(spark, d):
    return _settled(spark, d)


@query("j30_key_audit", f"""with {_SETTLED}, s as (select l_orderkey * 10 + l_linenumber as source_id, case when l_partkey % 3 <> 0 and l_suppkey % 4 = 0 then 'deprecated' else '' end as ex, l_orderkey as o, l_partkey % 3 = 1 and l_suppkey % 4 <> 0 and l_quantity < 10 as edge from lineitem),
m as (select source_id, baseline_id, outcome from w union all select source_id, o, 'claimed' from s where edge) select * from m union all select source_id, null, case when ex <> '' then ex else 'not_found' end from s where ex <> '' or source_id not in (select source_id from m)""")  # fmt: skip
def j30(spark, d):
    source_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id")
    li = _read(spark, d, "lineitem")
    s = li.select(source_id, F.when((F.col("l_partkey") % 3 != 0) & (F.col("l_suppkey") % 4 == 0), "deprecated").otherwise("").alias("excluded"))
    refused = li.filter("l_partkey % 3 = 1 and l_suppkey % 4 <> 0 and l_quantity < 10").select(source_id, F.col("l_orderkey").alias("baseline_id"))
    return proposals.audit(s, _settled(spark, d), refused)


# ---- result tables


@query("snk2_paged_details", f"with {SIDES}, n as (select baseline_id, row_number() over (order by cast(sheet as bigint), row) as number from base) select baseline_id, number, (number - 1) // 999 as page, (number - 1) % 999 + 2 as page_row from n")
def snk2(spark, d):
    rows = _base(spark, d).select("baseline_id", F.col("sheet").cast("long").alias("sheet"), "row")
    return outputs.with_page(rows, "sheet", "row", row_limit=1000).select("baseline_id", "number", "page", "page_row")


@query("snk3_annotated_baseline", f"""with {SIDES}, {_pairs('text')}, r as (select *, row_number() over (partition by text order by source_id) as rn, count(*) over (partition by text) as hits from src), w as (select text, {', '.join(f'max(case when rn = {i} then {c} end) as {c}_{i}' for i in (1, 2, 3) for c in ('korean_key', 'source_id'))} from r where hits <= 3 group by text)
select b.baseline_id, x.n, x.missing, x.source_id, x.status, s.korean_key as recommended, case when x.n = 0 then 'unmatched' when x.variants > 1 then 'yes' else 'no' end as conflict, w.* exclude (text) from base b join decision x using (baseline_id) left join w on w.text = b.text left join src s on s.source_id = x.source_id""")  # fmt: skip
def snk3(spark, d):
    base = _slim(_base(spark, d), "baseline_id", "path", "sheet", "row", "text")
    src = _slim(_src(spark, d), "source_id", "path", "sheet", "row", "text", "korean_key")
    return outputs.annotated_baseline(base, src, rounds.match_round(base, src, "text"))


@query("snk5_published_details", f"with {SIDES}, {_pairs('text')} select baseline_id, status, source_id from decision")
def snk5(spark, d):
    out = f"{shared_dir(spark)}/lineweave-published-{uuid.uuid4().hex}"
    base, src = _base(spark, d), _src(spark, d)
    details = rounds.match_round(base, src, "text").select("baseline_id", "status", "source_id")
    outputs.publish({"details": details, "conflicts": reports.conflict_texts(src)}, out, [f"{d}/documents.parquet"])
    return spark.read.parquet(f"{out}/details")


def structure_tables(spark, d) -> dict[str, DataFrame]:
    """The structure report's tables by name, for publish(): merges, splits, segments, unmatched and pending rows."""
    from . import rule_queries as R

    segments = R.j10(spark, d)
    return {
        "merge_candidates": R.d4(spark, d), "merge_assessment": R.d3(spark, d), "whole_lines": R.j7(spark, d), "segments": segments,
        "segments_pending": segments.filter("not usable"), "unexplained": R.d10(spark, d), "items": R.d2(spark, d), "patterns": R.a8(spark, d),
    }


@query("snk6_structure_report", "with k as (select o_custkey % 7 = 0 as more from orders) select 'merge_candidates' as name, count(*) + count(*) filter (more) as n from k union all select 'merge_assessment', count(*) + count(*) filter (more) from k")
def snk6(spark, d):
    from . import rule_queries as R

    out = f"{shared_dir(spark)}/lineweave-report-{uuid.uuid4().hex}"
    outputs.publish({"merge_candidates": R.d4(spark, d), "merge_assessment": R.d3(spark, d)}, out, [f"{d}/orders.parquet"])
    parts = [spark.read.parquet(f"{out}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("merge_candidates", "merge_assessment")]
    return parts[0].unionByName(parts[1])


@query("src5_fill_entries", """with c as (select cast(o_custkey as varchar) as sheet, o_orderkey + 11 as row, 'k' || o_orderkey as key, o_orderstatus as text, case when o_custkey % 2 = 0 then o_orderpriority || '!' else o_orderpriority end as translation, o_orderkey % 13 = 0 as is_formula from orders) select 1 as side, * from c where cast(sheet as bigint) % 5 <> 0""")
def src5(spark, d):
    sheet = F.col("o_custkey").cast("string").alias("sheet")
    o = _read(spark, d, "orders")
    cell = lambda col, value, kind="s": F.struct(F.lit(col).alias("col"), value.alias("value"), (F.lit(kind) if isinstance(kind, str) else kind).alias("data_type"))
    formula = F.when(F.col("o_orderkey") % 13 == 0, "f").otherwise("s")
    every = F.array(cell(1, F.concat(F.lit("k"), "o_orderkey")), cell(2, F.concat(F.lit(" "), "o_orderstatus")), cell(3, F.col("o_orderpriority"), formula), cell(4, F.concat("o_orderpriority", F.lit("!")), formula))
    cells = o.select(F.lit("f").alias("path"), sheet, (F.col("o_orderkey") + 11).alias("row"), F.explode(every).alias("x")).select("path", "sheet", "row", "x.*")
    named = [("key", 1, 1, "true"), ("text", 2, 1, "sheet % 5 <> 0"), ("translation", 3, 2, "true"), ("translation", 4, 1, "sheet % 2 = 0")]
    sheets = cells.select("path", "sheet").distinct().withColumn("header_row", F.lit(10))
    headers = sheets.select("*", F.explode(F.array(*[F.when(F.expr(test), F.struct(F.lit(name).alias("name"), F.lit(col).alias("col"), F.lit(rank).alias("rank"))) for name, col, rank, test in named])).alias("h")).filter("h is not null")
    return outputs.fill_entries(cells, headers.select("path", "sheet", "header_row", "h.*"), 1)[0].drop("path")
