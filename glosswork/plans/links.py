"""Queries of the link and term operators with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.operators import links as L
from glosswork.plans.fixtures import spark_view as fx, sql_views as sql
from glosswork.plans.registry import query
from glosswork.plans.spans import WINDOWED, ranges, window_steps

BUCKETS = {"NO": "first", "AF": "second", "RF": "third"}
BUCKET_SQL = "case title when 'NO' then 'first' when 'AF' then 'second' when 'RF' then 'third' else 'other' end"
STEPS = "steps as (select unit_id, span_no as step_no, start_line as first_line, end_line as last_line from fx_spans)"
PREFIXES = ["ref ", "see ", "cf. "]


def comments(spark, d):
    return fx(spark, d, "fx_links").withColumn("bucket", L.bucket_of(F.col("title"), BUCKETS))


@query("s9_filter_links", sql("select *, case pos % 3 when 0 then 1000 + pos % 900 when 1 then 1500 end as year from fx_links where category = 'Commentary' and title in ('NO', 'AF')"))
def s9(spark, d):
    dates = F.expr("case pos % 3 when 0 then array(1000 + pos % 900, 1990L) when 1 then array(1500L) else cast(array() as array<bigint>) end")
    return L.filter_links(fx(spark, d, "fx_links").withColumn("comp_date", dates), ["NO", "AF"], ["Commentary"])


@query("s10_bucket_links", sql(f"select unit_id, {BUCKET_SQL} as bucket, count(*) as links from fx_links group by 1, 2"))
def s10(spark, d):
    return comments(spark, d).groupBy("unit_id", "bucket").agg(F.count(F.lit(1)).alias("links"))


@query("s11_group_by_anchor", sql("select unit_id, line_no, count(*) as links, string_agg(source_ref, '|' order by pos, source_ref) as refs from fx_links group by 1, 2"))
def s11(spark, d):
    return L.group_by_anchor(fx(spark, d, "fx_links"))


@query("l1_links_for_step", sql(f"""with {STEPS}, j as (select l.*, s.step_no, row_number() over (partition by l.unit_id, s.step_no, l.source_ref order by l.line_no, l.pos, l.title, l.category) k
from fx_links l join steps s on s.unit_id = l.unit_id and l.line_no between s.first_line and s.last_line) select unit_id, step_no, line_no, source_ref, title, category from j where k = 1"""))
def l1(spark, d):
    steps = fx(spark, d, "fx_spans").selectExpr("unit_id", "span_no as step_no", "start_line as first_line", "end_line as last_line")
    return L.links_for_steps(steps, fx(spark, d, "fx_links"))


@query("l2_reanchor", sql(f"""with {WINDOWED}, a as (select r.unit_id, s.step_no, cast(s.first_line - r.unit_start + 1 as int) as first_line, cast(greatest(least(s.last_line, r.unit_end), s.first_line) - r.unit_start + 1 as int) as last_line
from wsteps s join ranges r on r.collection = s.collection and r.window_no = s.window_no and s.first_line between r.unit_start and r.unit_end) select * from a"""))
def l2(spark, d):
    return L.reanchor(window_steps(spark, d), ranges(spark, d))


LOOKUP = """a as (select distinct unit_id, line_no, pos as ask_pos, asked_ref from fx_refs), c as (select distinct unit_id, line_no, pos as cand_pos, full_ref from fx_refs),
bare as (select a.*, c.cand_pos, c.full_ref, case when starts_with(asked_ref, 'ref ') or starts_with(asked_ref, 'see ') or starts_with(asked_ref, 'cf. ') then substr(asked_ref, 5) else asked_ref end as ba,
  case when starts_with(full_ref, 'ref ') or starts_with(full_ref, 'see ') or starts_with(full_ref, 'cf. ') then substr(full_ref, 5) else full_ref end as bc from a join c using (unit_id, line_no)),
t as (select *, case when asked_ref = full_ref then 1 when ba = bc then 2 when ends_with(full_ref, asked_ref) or ends_with(asked_ref, full_ref) then 3 end as tier from bare),
k as (select *, row_number() over (partition by unit_id, line_no, ask_pos, asked_ref order by tier, cand_pos, full_ref) as k from t where tier is not null)"""


@query("l3_fuzzy_ref_lookup", sql(f"with {LOOKUP} select unit_id, line_no, ask_pos, asked_ref, full_ref, tier from k where k = 1"))
def l3(spark, d):
    refs = fx(spark, d, "fx_refs")
    return L.fuzzy_ref_lookup(refs.withColumnRenamed("pos", "ask_pos"), refs.withColumnRenamed("pos", "cand_pos"), PREFIXES)


@query("l4_dedupe_by_ref", sql(f"with c as (select *, {BUCKET_SQL} as bucket from fx_links), k as (select *, row_number() over (partition by unit_id, bucket, source_ref order by line_no, pos) k from c) select unit_id, bucket, source_ref, line_no, pos from k where k = 1"))
def l4(spark, d):
    return L.dedupe_by_ref(comments(spark, d)).select("unit_id", "bucket", "source_ref", "line_no", "pos")


@query("l5_pivot_buckets", sql(f"""with c as (select unit_id, {BUCKET_SQL} as bucket from fx_links), g as (select unit_id, count(*) filter (bucket = 'first') as first, count(*) filter (bucket = 'second') as second, count(*) filter (bucket = 'third') as third, count(*) filter (bucket = 'other') as other from c group by 1)
select *, cast((first > 0)::int + (second > 0)::int + (third > 0)::int + (other > 0)::int as int) as full_buckets from g"""))
def l5(spark, d):
    return L.pivot_buckets(comments(spark, d), ["first", "second", "third", "other"])


@query("l5_bucket_arrays", sql(f"""with c as (select *, {BUCKET_SQL} as bucket from fx_links), g as (select unit_id, line_no, {', '.join(f"coalesce(string_agg(source_ref, '|' order by pos, source_ref) filter (bucket = '{b}'), '') as {b}" for b in ('first', 'second', 'third', 'other'))} from c group by 1, 2)
select *, cast((first <> '')::int + (second <> '')::int + (third <> '')::int + (other <> '')::int as int) as full_buckets from g"""))
def l5b(spark, d):
    arrays = L.bucket_arrays(comments(spark, d), ["first", "second", "third", "other"])
    return arrays.select("unit_id", "line_no", *[F.array_join(b, "|").alias(b) for b in ("first", "second", "third", "other")], "full_buckets")


@query("l6_term_redundancy", sql("select unit_id, count(*) as total, count(distinct lower(term)) as distinct_terms, count(*) - count(distinct lower(term)) as redundant from fx_terms group by 1"))
def l6(spark, d):
    return L.term_redundancy(fx(spark, d, "fx_terms"), F.lower("term"))


@query("l7_prior_terms_context", sql("""with b as (select *, cast(floor((step_no - 1) / 2) as int) as batch, row_number() over (partition by unit_id order by step_no, term_pos) as r from fx_terms),
e as (select unit_id, batch, min(r) as first from b group by 1, 2), c as (select e.unit_id, e.batch, coalesce(string_agg(b.term, ' ' order by b.r), '') as context from e left join b on b.unit_id = e.unit_id and b.r < e.first and b.r >= e.first - 40 group by 1, 2)
select distinct b.unit_id, b.step_no, c.context from b join c using (unit_id, batch)"""))
def l7(spark, d):
    return L.prior_terms_context(fx(spark, d, "fx_terms"), batch=2)


@query("l8_merge_partial_updates", sql("""with u as (select unit_id, step_no, case step_no % 3 when 0 then '  ' else concat('new ', role) end as text from fx_steps where (unit_id + step_no) % 4 > 0)
select s.unit_id, s.step_no, s.label, s.branch_role, s.role, coalesce(case when trim(u.text) <> '' then u.text end, s.text) as text from fx_steps s left join u on u.unit_id = s.unit_id and u.step_no = s.step_no"""))
def l8(spark, d):
    steps = fx(spark, d, "fx_steps")
    updates = steps.where("(unit_id + step_no) % 4 > 0").selectExpr("unit_id", "step_no", "case step_no % 3 when 0 then '  ' else concat('new ', role) end as text")
    return L.merge_partial_updates(steps, updates, "text")
