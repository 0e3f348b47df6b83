"""The operators as queries over the given tables; thin layers that keep the contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filter_audit, html_diff, importance, language_id, license_scan, packing, quality, sharding, simhash_dedup, toxicity, url_filter, vector_topk
from .common import read_table

SHARDS = [f"shard-{i:04d}" for i in range(256)]


def word_vocabulary() -> str:
    """Default vocabulary file of the packing query; operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract_main_text(read_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), word_vocabulary())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), SHARDS)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_html_extraction, op2_license_scan, op3_decontamination, op4_packing, op5_language_id, op6_quality, op7_exact_topk, op8_sharding, op9_simhash_dedup, op10_toxicity, op11_importance_resampling, op12_filter_audit, op13_url_filter]
    return {f.__name__: f for f in ops}


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP3_SQL = rf"""
with items as (select distinct coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark),
wins as (select distinct item, least(len(w), 13) as n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') as g
         from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as s from items where len(w) > 0)),
docs as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
sizes as (select distinct n from wins),
grams as (select r, s, n, array_to_string(w[s : s + n - 1], ' ') as g
          from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from docs, sizes)),
hits as (select r, item, s, wins.n as n from grams join wins on grams.g = wins.g and grams.n = wins.n),
places as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from (select distinct r, s, n from hits)) group by r),
names as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join places using (r) left join names using (r)
"""

OP7_SQL = """
with good as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as double)) as v from embeddings
              where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.r as q, a.vec_id as query_id, b.vec_id as vec_id, b.r as r, cast(list_inner_product(a.v, b.v) as bigint) as score
           from good a join good b on a.r <> b.r and len(a.v) = len(b.v) where a.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by q order by score desc, vec_id, r) as rank from scored) where rank <= 10
"""


OP11_SQL = rf"""
with recursive table_steps as (select range as b, 0 as k, range as c from range(256) union all
                               select b, k + 1, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) from table_steps where k < 8),
lookup as (select list(c order by b) as t from table_steps where k = 8),
docs as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
items as (select {_WORDS} as w from benchmark),
runs as (select r, array_to_string(w[s : s + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from docs, (values (1), (2), (3)) as x(n))),
wanted as (select array_to_string(w[s : s + n - 1], ' ') as g from (select w, n, unnest(range(1, len(w) - n + 2)) as s from items, (values (1), (2), (3)) as x(n))),
bytes as (select g, hex(encode(g)) as x from (select g from runs union select g from wanted)),
crcs as (select g, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i : i + 1])::bigint)),
                                   lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)])), 4294967295::bigint) % 10000 as bucket from bytes, lookup),
doc_buckets as (select r, bucket, count(*) as n from runs join crcs using (g) group by all),
s_counts as (select bucket, sum(n) as s from doc_buckets group by bucket),
t_counts as (select bucket, count(*) as t from wanted join crcs using (g) group by bucket),
sums as (select (select coalesce(sum(s), 0) from s_counts) as s_all, (select coalesce(sum(t), 0) from t_counts) as t_all),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double))) as gain from s_counts left join t_counts using (bucket), sums),
weights as (select r, sum(n) as n_features, sum(n * gain) as weight from doc_buckets join gain using (bucket) group by r),
scored as (select doc_id, r, len(w) >= 20 as able, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
                  cast(coalesce(weight, 0) as bigint) + cast(floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(cast(doc_id as varchar), ''))[1:8])::bigint + 0.5::double) / 4294967296))) as bigint) as score
           from docs left join weights using (r)),
places as (select *, row_number() over (partition by able order by score desc, doc_id nulls first, r) as place, count(*) over (partition by able) as n_able from scored)
select doc_id, n_features, weight, score, case when able and place <= 5 * n_able // 100 then place end as rank from places
"""

_CUT_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP12_SQL = rf"""
with recursive orders as (select '' as o union all select o || f from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) as x(f) where not contains(o, f)),
marked as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_CUT_WORDS} as w, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
failing as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                   case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
                   || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' else '' end
                   || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when doc_id > first then 'E' else '' end as fails
            from texts left join marked using (doc_id)),
cells as (select part, fails, count(*) as n, count(*) filter (where good) as n_good, count(*) filter (where toxic) as n_toxic from failing group by part, fails),
steps as (select part, o as filter_order, step, o[step:step] as f, contains(fails, o[step:step]) as bad, regexp_matches(o[1 : step - 1], '[' || fails || 'x]') as gone, len(fails) as n_fails, n, n_good, n_toxic
          from cells, (select o from orders where length(o) = 5), (select unnest(range(1, 6)) as step)),
counts as (select part, filter_order, step, f, sum(case when gone or bad then 0 else n end) as kept, sum(case when bad and not gone then n else 0 end) as removed, sum(case when bad and gone then n else 0 end) as redundant,
                  sum(case when bad and n_fails = 1 then n else 0 end) as unique_fails, sum(case when bad and not gone then n_good else 0 end) as good_lost, sum(case when bad and not gone then n_toxic else 0 end) as toxic_lost
           from steps group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from counts
"""

OP13_SQL = r"""
with rules(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut as (select page_id, row_number() over () as r, case when contains(url, '://') then url[strpos(url, '://') + 3 :] else '' end as rest from pages),
parts as (select page_id, r, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as p from cut),
best as (select r, arg_max(host || path, length(host || path)) as rule, arg_max(verdict, length(host || path)) as verdict
         from parts join rules on (h = host or ends_with(h, '.' || host)) and starts_with(p, path) group by r)
select page_id, h as host, p as path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op7_exact_topk": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_url_filter": OP13_SQL}
