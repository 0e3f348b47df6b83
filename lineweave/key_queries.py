"""Queries of the key rules' acceptance and of operators that only parts of other queries showed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import settle
from .functions import text as X
from .operators import fuzzy, key_rules, reports, rounds
from .queries import SIDES, _base, _loose, _merged, _pairs, _read, _slim, _src, _twins, _TWINS, _MERGED, query
from .sources import tables

_FAMILY = "case o_orderkey % 3 when 0 then 'story_text' when 1 then 'story_convenient' else '' end"


def _stories(spark, d) -> tuple[DataFrame, DataFrame]:
    """Script rows from line items and keyed rows from orders: ids that are off by a few, texts that differ a little."""
    k = F.col("o_orderkey")
    o = _read(spark, d, "orders")
    family = F.when(k % 3 == 0, "story_text").when(k % 3 == 1, "story_convenient").otherwise("")
    words = lambda n: F.concat_ws("", F.substring(F.md5(n.cast("string").cast("binary")), 1, 12), F.lit("line"), (n % 7).cast("string"))
    role = lambda c: F.when(c == "P", F.array().cast("array<string>")).otherwise(F.array(c))
    b = o.select(k.alias("baseline_id"), k.alias("number"), family.alias("family"), F.lit("b").alias("path"), (k % 2).cast("string").alias("sheet"), k.alias("row"), words(k).alias("loose"), F.array(words(k)).alias("variants"), role(F.col("o_orderstatus")).alias("roles"))
    li = _read(spark, d, "lineitem")
    at, nth = F.col("l_orderkey"), F.col("l_linenumber")
    text = F.when(nth == 1, words(at)).when(nth == 2, words(at + 2)).when(nth == 3, F.concat(F.lit("x"), words(at))).when(nth == 4, F.concat(F.lit("ab"), F.substring(words(at + 3), 3, 20))).otherwise(words(at + 1000))
    s = li.select((at * 10 + nth).alias("source_id"), at.alias("did"), (at * 10 + nth).alias("row"), text.alias("loose"), role(F.when(nth % 2 == 0, F.lit("P")).otherwise(F.col("l_linestatus"))).alias("roles"))
    return settle(s.dropDuplicates(["source_id"]), "script-rows"), b


@query("j13_id_corrections")
def j13(spark, d):
    return key_rules.id_corrections(*_stories(spark, d))


@query("j14_id_blocks")
def j14(spark, d):
    s, b = _stories(spark, d)
    s = s.withColumn("path", F.lit("s")).withColumn("sheet", (F.col("row") % 3).cast("string"))
    one_table = b.withColumn("family", F.lit("story_text")).withColumn("sheet", F.lit("0"))
    return key_rules.id_blocks(s.withColumn("did", F.floor(F.col("did") / 10)).filter("did >= 100"), one_table)


@query("j15_unique_text", f"with {SIDES}, s as (select source_id, {_loose('text')} as k, speaker from src), b as (select baseline_id, {_loose('text')} as k, speaker from base union select baseline_id, {_loose('speaker')}, speaker from base), m as (select source_id, count(*) as n, min(baseline_id) as baseline_id from s join b using (k) where length(k) >= 7 and (s.speaker is null or b.speaker is null or s.speaker = b.speaker) group by 1) select source_id, baseline_id from m where n = 1")
def j15(spark, d):
    roles = F.when(F.col("speaker").isNull(), F.array().cast("array<string>")).otherwise(F.array("speaker"))
    b = _base(spark, d).select("baseline_id", roles.alias("roles"), X.key_variants(F.concat_ws("|", F.replace("text", F.lit("|"), F.lit(" ")), "speaker")).alias("variants"))
    s = _src(spark, d).select("source_id", X.loose_key(F.col("text")).alias("loose"), roles.alias("roles"))
    return key_rules.unique_texts(s, b).select("source_id", "baseline_id")


_CHOICE = """c as (select l_orderkey % 5000 as source_id, l_orderkey * 10 + l_linenumber as baseline_id, max(cast(l_quantity as bigint) % 4) as overlap, max(case l_linestatus when 'F' then 1 else 0 end) as role, min(case when l_partkey % 3 > 0 then l_partkey % 40 end) as distance, bool_or(l_suppkey % 5 = 0) as between_ from lineitem group by 1, 2)"""


@query("j17_context_choice", f"""with {_CHOICE}, r as (select *, coalesce(distance, 1000000000000000000) as far from c), w as (select *, row_number() over q as place, lead(overlap) over q as o2, lead(role) over q as r2, lead(far) over q as f2 from r window q as (partition by source_id order by overlap desc, role desc, far, baseline_id)),
t as (select *, case when overlap > 0 and (o2 is null or overlap > o2 or (overlap = o2 and role > r2)) then 'context' when far <= 30 and (o2 is null or f2 - far >= 5) then 'near_number' end as rule from w where place = 1), i as (select source_id, min(baseline_id) as only_ from c where between_ group by 1 having count(*) = 1)
select source_id, case when rule is not null then baseline_id else only_ end as baseline_id, coalesce(rule, 'between') as rule from t left join i using (source_id) where rule is not null or only_ is not null""")  # fmt: skip
def j17(spark, d):
    li = _read(spark, d, "lineitem")
    rows = li.groupBy((F.col("l_orderkey") % 5000).alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("baseline_id")).agg(
        F.max(F.col("l_quantity").cast("long") % 4).alias("overlap"), F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("role"),
        F.min(F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 40)).alias("distance"), F.max(F.col("l_suppkey") % 5 == 0).alias("between"),
    )
    return key_rules.context_choice(rows)


@query("j20_similar_around")
def j20_around(spark, d):
    s, b = _stories(spark, d)
    anchors = s.withColumn("family", F.when(F.col("did") % 3 == 0, "story_text").otherwise("story_convenient")).withColumn("path", F.lit("b")).withColumn("sheet", (F.col("did") % 2).cast("string"))
    return key_rules.similar_around(anchors.withColumnRenamed("did", "number"), b)


@query("j20_similar_voices")
def j20_voices(spark, d):
    s, b = _stories(spark, d)
    key = F.concat(F.lit("char_voice_words_ab_"), F.lpad((F.col("baseline_id") % 1_000_000).cast("string"), 6, "0"))
    lines = b.withColumn("key", key).withColumn("speaker", F.concat(F.lit("v"), F.col("baseline_id") % 500))
    return key_rules.similar_voices(s.withColumn("speaker", F.concat(F.lit("v"), F.col("did") % 500)), lines)


_OPTIONS = """o as (select l_orderkey as k, l_linenumber as n, min(l_partkey) as v from lineitem group by 1, 2), g as (select 'p' as path, cast(k % 3 as varchar) as sheet, 'b' || (k // 2) as base, list(cast(v as varchar) order by n) as vals, list(n order by n) as ns from o group by k % 3, k // 2, k),
h as (select path, sheet, base, vals, ns = range(ns[1], ns[1] + len(ns)) and ns[1] in (0, 1) as whole from g where len(ns) = len(list_distinct(ns))),
s as (select k as source_id, vals as parts, case when k % 4 = 0 then ['b' || (k // 2)] when k % 4 = 1 then ['b' || (k // 2), 'b' || (k // 2 + 1)] else [] end as bases, case when k % 5 < 2 then 'b' || (k // 2) else '' end as pb, 'p' as pp, cast(k % 3 as varchar) as ps from (select k, list(cast(v as varchar) order by n) as vals from o where n < 4 group by k)),
own as (select s.*, h.path, h.sheet, h.base, vals, whole, h.base = pb and h.path = pp and h.sheet = ps as loc from (select *, unnest(bases) as ub from s) s join h on h.base = s.ub), own2 as (select * from (select *, bool_or(loc) over (partition by source_id) as al from own) where loc or not al),
met as (select source_id, 1 as stage, parts, path, sheet, base, vals, whole from own2 union all select source_id, 2, parts, path, sheet, base, vals, whole from s join h on h.base = pb and h.path = pp and h.sheet = ps where pb <> ''
union all select distinct source_id, 3, parts, path, sheet, base, vals, whole from (select *, unnest(parts) as part from s) s join (select *, unnest(vals) as part from h) h using (part) where not whole or len(vals) <> len(parts) or vals = parts),
r as (select source_id, stage, count(distinct (path, sheet, base)) as n, min((path, sheet, base)) as g, bool_or(whole and vals = parts) as fits from met where list_has_any(parts, vals) group by 1, 2), f as (select *, row_number() over (partition by source_id order by stage) as rn from r)
select source_id, case when n = 1 and fits then g[1] end as path, case when n = 1 and fits then g[2] end as sheet, case when n = 1 and fits then g[3] end as base, stage, case when n > 1 then 'several' when fits then 'placed' else 'not_whole' end as outcome from f where rn = 1"""


@query("j21_option_choice", f"with {_OPTIONS}")
def j21(spark, d):
    k, n = F.col("k"), F.col("n")
    o = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("v"))
    listed = lambda rows: rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", F.col("v").cast("string").alias("v")))).alias("x"))
    values = F.transform("x", lambda e: e["v"])
    ns = F.transform("x", lambda e: e["n"])
    first = F.get(ns, F.lit(0))
    whole = first.isin(0, 1) & (ns == F.sequence(first, first + F.size("x") - 1))
    base = lambda shift=0: F.concat(F.lit("b"), (F.floor(k / 2) + shift).cast("string"))
    groups = listed(o).select(F.lit("p").alias("path"), (k % 3).cast("string").alias("sheet"), base().alias("base"), values.alias("values"), whole.alias("whole"))
    bases = F.when(k % 4 == 0, F.array(base())).when(k % 4 == 1, F.array(base(), base(1))).otherwise(F.array().cast("array<string>"))
    s = listed(o.filter(n < 4)).select(k.alias("source_id"), values.alias("parts"), bases.alias("bases"), F.when(k % 5 < 2, base()).otherwise("").alias("previous_base"), F.lit("p").alias("previous_path"), (k % 3).cast("string").alias("previous_sheet"))
    return key_rules.option_choice(s, groups)


# ---- operators that other queries only used


@query("x11_common_subsequence")
def x11(spark, d):
    return _read(spark, d, "part").select("p_partkey", X.lcs_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query("x20_speakers", """with n as (select o_orderkey as id, case o_orderkey % 6 when 0 then '旁白' when 1 then 'Player' when 2 then '主角' when 3 then o_orderpriority || ' (' || o_orderstatus || ')' when 4 then '？？' else o_orderstatus end as a, case when o_orderkey % 2 = 0 then o_orderstatus else lower(o_orderpriority) end as b from orders),
v as (select id, case when id % 6 in (0, 4) then [] when id % 6 = 2 then ['@player'] when id % 6 = 1 then ['player'] when id % 6 = 3 then list_sort([replace(lower(o_orderpriority), ' ', ''), replace(lower(o_orderpriority), ' ', '') || '(' || lower(o_orderstatus) || ')', lower(o_orderstatus)]) else [lower(o_orderstatus)] end as names, replace(lower(b), ' ', '') as other from n join orders on o_orderkey = id)
select id, array_to_string(names, ',') as names, case when len(names) = 0 then 0 when list_contains(names, other) then 1 else -1 end as compared from v""")  # fmt: skip
def x20(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 6 == 0, "旁白").when(k % 6 == 1, "Player").when(k % 6 == 2, "主角").when(k % 6 == 3, F.concat("o_orderpriority", F.lit(" ("), "o_orderstatus", F.lit(")"))).when(k % 6 == 4, "？？").otherwise(F.col("o_orderstatus"))
    other = F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(F.lower("o_orderpriority"))
    rows = _read(spark, d, "orders").select(k.alias("id"), X.speaker_variants(name).alias("names"), X.speaker_variants(other).alias("other"))
    return rows.select("id", F.array_join("names", ",").alias("names"), X.speaker_compare(F.col("names"), F.col("other")).alias("compared"))


@query("x31_rates", "select c_nationkey, count(*) as total, count(*) filter (c_acctbal > 0) as part, count(*) filter (c_acctbal > 0) / nullif(count(*) filter (c_mktsegment = 'BUILDING'), 0)::double as rate from customer group by 1")
def x31(spark, d):
    rows = _read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("part"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("whole"))
    return rows.select("c_nationkey", "total", "part", X.rate(F.col("part"), F.col("whole")).alias("rate"))


@query("w8_best_similar", """with p as (select l_orderkey as baseline_id, l_partkey as source_id, case when l_linenumber % 3 = 0 then '' else l_returnflag end as korean_key, case when l_linenumber % 4 > 0 then 0.8 + (l_suppkey % 10) / 50.0 end as similarity from lineitem),
q as (select *, coalesce(similarity, 1.0) as v from p), t as (select baseline_id, max(v) as top from q where korean_key <> '' group by 1), b as (select baseline_id, min(source_id) as best, count(distinct korean_key) as tied from q join t using (baseline_id) where korean_key <> '' and v = top group by 1),
c as (select baseline_id, count(*) as n, count(*) filter (korean_key = '') as missing, count(distinct nullif(korean_key, '')) as variants from p group by 1) select baseline_id, n, missing, variants, case when tied = 1 then best end as source_id, case when best is null then 'all_missing' when tied > 1 then 'pending' else 'fuzzy' end as status from c left join b using (baseline_id)""")  # fmt: skip
def w8(spark, d):
    similarity = F.when(F.col("l_linenumber") % 4 > 0, F.lit(0.8) + (F.col("l_suppkey") % 10) / F.lit(50.0))
    p = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("baseline_id"), F.col("l_partkey").alias("source_id"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("korean_key"), similarity.alias("similarity"))
    return fuzzy.decide_fuzzy(p)


@query("d7_fill_action", "select l_orderkey, l_linenumber, case when l_linenumber % 4 = 0 then 'kept' when l_partkey % 5 = 0 then 'formula' when l_returnflag = l_linestatus or l_linenumber = 1 then 'equal' else 'filled' end as action from lineitem")
def d7(spark, d):
    value = F.when(F.col("l_linenumber") % 4 == 0, " ").otherwise(F.col("l_returnflag"))
    old = F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reports.fill_action(value, old, F.col("l_partkey") % 5 == 0).alias("action"))


@query("u1_candidate_union", """with a as (select l_orderkey % 3000 as form, l_partkey as source_id, 'plain' as match_type, 2 as place from lineitem where l_linenumber <= 3), b as (select l_orderkey % 3000, l_partkey, 'tail', 3 from lineitem where l_linenumber in (2, 3, 4)), c as (select l_orderkey % 3000, l_partkey, 'punctuation', 4 from lineitem where l_linenumber >= 4),
u as (select * from a union all select * from b union all select * from c) select cast(form as varchar) as form, source_id, arg_min(match_type, place) as match_type from u group by form, source_id""")  # fmt: skip
def u1(spark, d):
    from .plans import lookup

    li = _read(spark, d, "lineitem")
    link = lambda test, kind, place: li.filter(test).select((F.col("l_orderkey") % 3000).cast("string").alias("form"), F.col("l_partkey").alias("source_id"), F.lit(kind).alias("match_type"), F.lit(place).alias("place"))
    parts = [link("l_linenumber <= 3", lookup.PLAIN, 2), link("l_linenumber in (2, 3, 4)", lookup.TAIL, 3), link("l_linenumber >= 4", lookup.MARK, 4)]
    return lookup.first_types(parts).drop("place")


@query("w1_running_sequence", f"with {SIDES} select baseline_id, cast(row_number() over (partition by path, sheet order by row) as bigint) as seq from base")
def w1(spark, d):
    return rounds.with_sequence(_base(spark, d)).select("baseline_id", F.col("seq").cast("long").alias("seq"))


@query("a3_structure_counts", f"with {SIDES}, {_TWINS}, {_MERGED}, x as (select baseline_id, korean_key from twins join src using (text) union all select baseline_id, korean_key from merged) select baseline_id, count(*) as n, count(*) filter (korean_key = '') as missing, count(distinct nullif(korean_key, '')) as variants from x group by 1")
def a3(spark, d):
    return reports.row_counts(_twins(spark, d), _src(spark, d), structure=_merged(spark, d))


@query("a4_full_statistics", f"""with {SIDES}, {_pairs('text')}, r as (select b.path, b.sheet, x.* from decision x join base b using (baseline_id)), a as (select path, sheet from r union all select 'baseline', 'empty ' || n_nationkey from nation),
g as (select path, sheet, cast(grouping(path, sheet) as integer) as level, count(*) as rows_, count(*) filter (n > 0) as matched, count(*) filter (variants > 0) as translated, count(source_id) as recommended, count(*) filter (n = 0) as unmatched, count(*) filter (n > 0 and variants = 0) as all_missing, count(*) filter (variants > 1) as conflicts, count(*) filter (variants > 1 and source_id is not null) as resolved from r group by grouping sets ((path, sheet), (path), ())),
e as (select * from g union all select 'baseline', 'empty ' || n_nationkey, 0, 0, 0, 0, 0, 0, 0, 0, 0 from nation)
select path, sheet, level, rows_ as total, matched, translated, recommended, unmatched, all_missing, conflicts, resolved, conflicts - resolved as pending, matched / nullif(rows_, 0)::double as match_rate, translated / nullif(rows_, 0)::double as translate_rate, recommended / nullif(rows_, 0)::double as recommend_rate from e""")  # fmt: skip
def a4(spark, d):
    base = _slim(_base(spark, d), "baseline_id", "path", "sheet", "row", "text")
    decided = base.select("baseline_id", "path", "sheet").join(rounds.match_round(base, _slim(_src(spark, d), "source_id", "path", "sheet", "row", "text", "korean_key"), "text"), "baseline_id")
    empty = _read(spark, d, "nation").select(F.lit("baseline").alias("path"), F.concat(F.lit("empty "), F.col("n_nationkey").cast("string")).alias("sheet"))
    return reports.full_statistics(decided, base.select("path", "sheet").distinct().unionByName(empty))


@query("a5_full_source_statistics", f"""with {SIDES}, c as (select text from src where korean_key <> '' group by text having count(distinct korean_key) > 1), r as (select s.*, s.text in (select text from base) as hit, s.text in (select text from c) as conflict from src s),
k as (select sheet, count(*) as skipped from src where row % 9 = 0 group by 1), g as (select path, sheet, cast(grouping(path, sheet) as integer) as level, count(*) as total, count(*) filter (hit) as matched, count(*) filter (not hit) as unmatched, count(*) filter (korean_key = '') as missing, count(distinct case when conflict then text end) as conflicts, count(*) filter (row % 9 = 0) as skipped from r group by grouping sets ((path, sheet), (path), ()))
select *, matched / nullif(total, 0)::double as match_rate, case when skipped > 0 then 'partly' else 'whole' end as state from g""")  # fmt: skip
def a5(spark, d):
    src = _src(spark, d)
    hits = src.join(_base(spark, d).select("text").distinct(), "text", "left_semi").select("source_id")
    return reports.full_source_statistics(src, hits, src.filter("row % 9 = 0").select("source_id"))


@query("a12_full_totals", f"""with {SIDES}, {_pairs('text')}, c as (select text from src where korean_key <> '' group by text having count(distinct korean_key) > 1)
select (select count(*) from base) as baseline_rows, (select count(*) from decision where n > 0) as matched, (select count(*) from src) as source_rows, (select count(*) from src where text in (select text from base)) as matched_sources, (select count(*) from src where korean_key = '') as missing, (select count(*) from c) as conflicts,
(select cast(sum(n) as bigint) from decision) as pairs, (select count(source_id) from decision) as recommended, (select count(*) from decision x join base using (baseline_id) where source_id is not null and row % 5 <> 0) as filled, (select count(*) from src where row % 9 = 0) as skipped""")  # fmt: skip
def a12(spark, d):
    base = _slim(_base(spark, d), "baseline_id", "path", "sheet", "row", "text")
    src = _slim(_src(spark, d), "source_id", "path", "sheet", "row", "text", "korean_key")
    decided = rounds.match_round(base, src, "text")
    filled = decided.join(base.select("baseline_id", "row"), "baseline_id").filter("source_id is not null and row % 5 <> 0")
    return reports.run_totals(decided, src, base, filled, src.filter("row % 9 = 0"))


@query("l2_read_order", f"with {SIDES}, o as (select baseline_id, row_number() over (order by lower('f' || (doc_id % 7)), doc_id, b.row) as source_id from base b join (select distinct doc_id, cast(doc_id as varchar) as sheet from cut) using (sheet)) select * from o")
def l2(spark, d):
    rows = _base(spark, d).withColumn("sheet_index", F.col("sheet").cast("long")).withColumn("path", F.concat(F.when(F.col("sheet").cast("long") % 2 == 0, "F").otherwise("f"), (F.col("sheet").cast("long") % 7).cast("string")))
    return tables.with_read_order(rows, "source_id").select("baseline_id", "source_id")


@query("l3_report_order", f"with {SIDES}, {_pairs('text')}, x as (select b.sheet, b.row, d.status, d.baseline_id from decision d join base b using (baseline_id)) select baseline_id, row_number() over (order by cast(sheet as bigint), row) as place from x where status = 'pending'")
def l3(spark, d):
    from .sources import outputs

    base = _base(spark, d)
    rows = rounds.match_round(base, _src(spark, d), "text").filter("status = 'pending'").join(base.select("baseline_id", F.col("sheet").cast("long").alias("sheet"), "row"), "baseline_id")
    return outputs.numbered(rows, "sheet", "row").select("baseline_id", F.col("number").alias("place"))
