"""Queries of the spine, catalogue, usage and run operators with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.operators import spine as S
from glosswork.plans.fixtures import spark_view as fx, sql_views as sql
from glosswork.plans.registry import query

PRICES = [("model-0", 1.0, 2.0), ("model-1", 3.0, 4.0), ("model-1-2024", 5.0, 6.0)]
REF = "case o_orderkey % 5 when 0 then concat('Big Part ', o_custkey % 90, 'a') when 1 then concat(o_custkey % 90, 'b') when 2 then concat('Part', o_custkey, 'a') when 3 then concat('Small ', o_custkey % 70, 'c') else concat('Other Name ', o_custkey % 80, 'b') end"
UNITS_SQL = "units as (select source as collection, cast(doc_id // 40 + 2 as int) as unit_no, case when doc_id % 2 = 0 then 'a' else 'b' end as side, doc_id from documents)"


def units(spark, d):
    return fx(spark, d, "documents").selectExpr("source as collection", "cast(doc_id div 40 + 2 as int) as unit_no", "case when doc_id % 2 = 0 then 'a' else 'b' end as side", "doc_id")


@query("s12_parse_unit_ref", sql(f"select o_orderkey, coalesce(regexp_extract(ref, '^(?:(.*\\S)\\s+)?(\\d+)([ab])$', 1), '') as collection, cast(regexp_extract(ref, '^(?:(.*\\S)\\s+)?(\\d+)([ab])$', 2) as int) as unit_no, regexp_extract(ref, '^(?:(.*\\S)\\s+)?(\\d+)([ab])$', 3) as side from (select o_orderkey, {REF} as ref from orders) where regexp_matches(ref, '^(?:(.*\\S)\\s+)?(\\d+)([ab])$')"))
def s12(spark, d):
    refs = fx(spark, d, "orders").select("o_orderkey", S.parse_unit_ref(F.expr(REF)).alias("u")).where("u is not null")
    return refs.select("o_orderkey", "u.*")


@query("c1_enumerate_units", sql("""with c as (select source as collection, count(*) as n from documents group by 1), k as (select collection, unnest(range(1, n + 1)) as k from c), u as (select collection, cast((k + 1) // 2 + 1 as int) as unit_no, case when k % 2 = 1 then 'a' else 'b' end as side from k)
select * from u where (unit_no > 3 or (unit_no = 3 and side >= 'b')) and (unit_no < 20 or (unit_no = 20 and side <= 'a'))"""))
def c1(spark, d):
    counts = fx(spark, d, "documents").groupBy(F.col("source").alias("collection")).agg(F.count(F.lit(1)).alias("n"))
    return S.enumerate_units(counts, (3, "b"), (20, "a"))


SPINE_SQL = "spine as (select collection, cast(unnest(range(2, m + 1)) as int) as unit_no from (select p_brand as collection, max(p_size) as m from part group by 1))"


@query("c2_expected_spine", sql(f"with {SPINE_SQL} select collection, unit_no, unnest(['a', 'b']) as side from spine"))
def c2(spark, d):
    last = fx(spark, d, "part").groupBy(F.col("p_brand").alias("collection")).agg(F.max("p_size").alias("last_unit"))
    return S.expected_spine(last)


@query("c3_missing_units", sql(f"with {UNITS_SQL}, sp as (select collection, unnest(range(2, m + 1)) as unit_no from (select collection, max(unit_no) as m from units group by 1)), s2 as (select collection, cast(unit_no as int) as unit_no, unnest(['a', 'b']) as side from sp) select * from s2 where (collection, unit_no, side) not in (select (collection, unit_no, side) from units where doc_id % 3 > 0)"))
def c3(spark, d):
    u = units(spark, d)
    return S.missing_units(S.expected_spine(u.groupBy("collection").agg(F.max("unit_no").alias("last_unit"))), u.where("doc_id % 3 > 0"))


@query("c4_windows_of", sql("select collection, window_no, unit_id, concat(min(unit_id) over w, '-', max(unit_id) over w) as label from fx_windows window w as (partition by collection, window_no)"))
def c4(spark, d):
    return S.windows_of(fx(spark, d, "documents").selectExpr("source as collection", "doc_id as unit_id"))


@query("c5_windows_pending", sql("with g as (select collection, window_no, count(*) as units, count(*) filter (unit_id % 11 > 2 or window_no % 3 = 0) as done from fx_windows group by 1, 2) select * from g where done < units"))
def c5(spark, d):
    w = fx(spark, d, "fx_windows")
    return S.windows_pending(w, w.where("unit_id % 11 > 2 or window_no % 3 = 0"))


CATALOGUE = "cat as (select doc_id, coalesce(source, 'Other') as collection, case when trim(string_split(text, chr(10))[1]) <> '' then string_split(text, chr(10))[1] else '(no topic)' end as main_topic, concat(source, '_', doc_id, '.json') as file from documents)"


@query("c6_build_catalogue", sql(f"with {CATALOGUE} select * from cat"))
def c6(spark, d):
    return S.build_catalogue(fx(spark, d, "documents"))


@query("c6_catalogue_of_analyses", sql("select concat('Unit ', conv_id) as ref, coalesce(case when conv_id % 4 > 0 then concat('c', conv_id % 3) end, '') as collection, cast(case when conv_id % 5 = 0 then 0 else conv_id end as int) as \"unitNo\", case when conv_id % 2 = 0 then 'b' else 'a' end as side, coalesce(case when conv_id % 6 > 0 then min_by(text, turn) end, '') as \"mainTopic\", '' as \"generatedAt\", concat('u_', conv_id, '.json') as file from conversations group by conv_id"))
def c6b(spark, d):
    c = fx(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    units = c.selectExpr("concat('Unit ', conv_id) as ref", "case when conv_id % 4 > 0 then concat('c', conv_id % 3) end as collection", "case when conv_id % 5 > 0 then cast(conv_id as int) end as unitNo", "case when conv_id % 2 = 0 then 'b' end as side", "case when conv_id % 6 > 0 then first end as mainTopic", "cast(null as string) as generatedAt", "concat('u_', conv_id, '.json') as file")
    return S.catalogue_of_analyses(units)


@query("c7_filter_catalogue", sql("with g as (select coalesce(p_brand, 'Other') as collection, count(*) filter (contains(lower(p_name), 're') or contains(lower(p_type), 're')) as shown, count(*) as total from part group by 1) select * from g where shown > 0"))
def c7(spark, d):
    return S.filter_catalogue(fx(spark, d, "part"), "RE", ["p_name", "p_type"], "p_brand")


@query("c8_availability", sql(f"with {UNITS_SQL}, s as (select distinct collection, unit_no, side from units) select collection, unit_no, string_agg(side, '' order by side) as sides from s group by 1, 2"))
def c8(spark, d):
    return S.availability(units(spark, d))


@query("c10_neighbours", sql(f"with {CATALOGUE}, r as (select *, case when doc_id % 10 = 3 then replace(file, '.json', '.demo.json') else file end as f from cat) select collection, doc_id, lag(f) over w as previous, lead(f) over w as following from r where not contains(f, '.demo.') window w as (partition by collection order by doc_id)"))
def c10(spark, d):
    entries = S.build_catalogue(fx(spark, d, "documents"))
    return S.neighbours(entries.withColumn("file", F.expr("case when doc_id % 10 = 3 then replace(file, '.json', '.demo.json') else file end")))


PRICED = f"""prices(price_model, input, output) as (values {', '.join(str(p) for p in PRICES)}), priced as (select * from (select u.*, case when seq % 7 = 0 then 0 else coalesce((input_tokens * input + output_tokens * output) / 1e6, 0) end as usd, row_number() over (partition by u.seq order by length(price_model) desc nulls last) k from fx_usage u left join prices p on starts_with(u.model, p.price_model)) where k = 1)"""


def priced(spark, d):
    """Usage with dollars; every seventh call is one of a local provider."""
    usage = fx(spark, d, "fx_usage").withColumn("provider", F.expr("case when seq % 7 = 0 then 'local' when seq % 7 < 5 then 'hosted' end"))
    return S.price_usage(usage, spark.createDataFrame(PRICES, "price_model string, input double, output double"))


@query("u1_usage_by_pass", sql(f"with {PRICED}, p as (select *, coalesce(nullif(pass, 'view'), 'unknown') as named from priced) select named as pass, round(sum(seconds), 4) as seconds, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, count(*) as calls, round(sum(usd), 6)::double as usd from p group by rollup (named)"))
def u1(spark, d):
    return S.usage_by_pass(priced(spark, d).withColumn("pass", F.expr("nullif(pass, 'view')")))


@query("u2_price_usage", sql(f"with {PRICED} select seq, model, round(usd, 9)::double as usd from priced"))
def u2(spark, d):
    return priced(spark, d).select("seq", "model", F.round("usd", 9).alias("usd"))


@query("u3_last_model_per_pass", sql("select pass, max_by(model, seq) as model from fx_usage group by 1"))
def u3(spark, d):
    return S.last_model_per_pass(fx(spark, d, "fx_usage"))


COLLECTED = "runs as (select *, split_part(run_key, '/', 1) as collection, cast(round(minutes * 100) as bigint) as hundredths from fx_runs)"


def runs(spark, d):
    return fx(spark, d, "fx_runs").withColumn("collection", F.split("run_key", "/")[0])


@query("u4_run_eta", sql(f"""with {COLLECTED}, e as (select collection, seq, row_number() over w as i, cast(sum(hundredths) over w as bigint) as elapsed, cast(sum(case when not skipped then hundredths end) over w as bigint) as worked, count(case when not skipped then 1 end) over w as rl from runs window w as (partition by collection order by "at", seq rows between unbounded preceding and current row))
select collection, seq, elapsed, elapsed::double / i as mean_all, worked::double / nullif(rl, 0) as mean_built, cast(floor(elapsed::double / i * (3000 - i)) as bigint) as eta_all from e"""))
def u4(spark, d):
    hundredths = F.round(F.col("minutes") * 100).cast("bigint")  # whole numbers add up alike in any order
    return S.run_eta(runs(spark, d).withColumn("minutes", hundredths), 3000)


@query("u5_latest_status", sql("""select run_key, status, skipped, round(minutes, 4) as minutes from (select *, row_number() over (partition by run_key order by "at" desc, seq desc) k from fx_runs) where k = 1"""))
def u5(spark, d):
    return S.latest_status(fx(spark, d, "fx_runs"))


@query("u6_retry_rounds", sql("""with t as (select *, row_number() over (partition by run_key order by "at", seq) k from fx_runs) select run_key, count(*) as attempts, bool_or(status = 'ok') as succeeded, cast(min(case when status = 'ok' then k end) as int) as first_ok from t where k <= 3 group by 1"""))
def u6(spark, d):
    return S.retry_rounds(fx(spark, d, "fx_runs"))


@query("u7_run_totals", sql(f"with {COLLECTED} select collection, count(*) filter (status = 'ok' and not skipped) as ok, count(*) filter (skipped) as skipped, count(*) filter (status <> 'ok') as failed from runs group by 1"))
def u7(spark, d):
    return S.run_totals(runs(spark, d))


@query("u9_effort_correlation", sql("select round(corr(steps, minutes), 6) as r, count(*) as n from (select run_id, count(*)::double as steps, sum(seconds) as minutes from fx_usage group by 1)"))
def u9(spark, d):
    effort = fx(spark, d, "fx_usage").groupBy("run_id").agg(F.count(F.lit(1)).cast("double").alias("steps"), F.sum("seconds").alias("minutes"))
    return S.effort_correlation(effort, "steps", "minutes")


@query("s5_explode_manifest", sql("""select run_key, split_part(run_key, '/', 1) as collection, split_part(run_key, '/', 3) as first, split_part(run_key, '/', 3) as last, status, skipped, concat('took ', cast(round(minutes, 0) as int)) as message
from (select *, row_number() over (partition by run_key order by seq desc) k from fx_runs) where k = 1"""))
def s5(spark, d):
    last = fx(spark, d, "fx_runs").groupBy("run_key").agg(F.max_by(F.struct("status", "skipped", F.concat(F.lit("took "), F.round("minutes", 0).cast("int")).alias("message")), "seq").alias("r"))
    # a manifest of some 500 windows each
    bags = last.groupBy(F.pmod(F.hash("run_key"), F.lit(1 + last.count() // 500)).alias("bag")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("run_key", "r")))).alias("json"))
    manifests = bags.select(F.from_json("json", "map<string, struct<status: string, skipped: boolean, message: string>>").alias("results"))
    return S.explode_manifest(manifests)


@query("s15_parse_pass_progress", sql(r"""with p as (select run_id, ts, seq, cast(nullif(regexp_extract(msg, '^Pass (\d+)/(\d+): (.*)$', 1), '') as int) as n, cast(nullif(regexp_extract(msg, '^Pass (\d+)/(\d+): (.*)$', 2), '') as int) as tot, regexp_extract(msg, '^Pass (\d+)/(\d+): (.*)$', 3) as said from fx_progress), q as (select * from p where n is not null),
l as (select * from (select *, row_number() over (partition by run_id order by ts desc, seq desc) k from q) where k = 1), g as (select run_id, max(tot) as passes, count(distinct n) as passes_seen from q group by 1)
select run_id, n as last_pass, said as last_message, passes, passes_seen, array_to_string(list_transform(range(1, passes + 1), lambda i: case when i < n then 'x' else '.' end), '') as done from g join l using (run_id)"""))
def s15(spark, d):
    progress = S.parse_pass_progress(fx(spark, d, "fx_progress"))
    return progress.withColumn("done", F.array_join(F.transform("done", lambda x: F.when(x, "x").otherwise(".")), ""))


@query("r4_progress_tail", sql("select run_id, seq, msg, cast(k as int) as k from (select *, row_number() over (partition by run_id order by ts desc, seq desc) k from fx_progress) where k <= 200"))
def r4(spark, d):
    return S.progress_tail(fx(spark, d, "fx_progress"), 200)


@query("r5_stale_runs", sql("""with g as (select run_id, max(ts) as last_ts, max_by(msg, seq) as m0 from fx_progress group by 1), l as (select p.run_id, p.msg as last_msg, p.ts from (select *, row_number() over (partition by run_id order by ts desc, seq desc) k from fx_progress) p where k = 1),
n as (select max(ts) as now from fx_progress) select run_id, last_msg, cast(floor(epoch(now)) as bigint) - cast(floor(epoch(ts)) as bigint) as idle_seconds from l, n where last_msg = 'purchase' and cast(floor(epoch(now)) as bigint) - cast(floor(epoch(ts)) as bigint) > 30"""))
def r5(spark, d):
    log = fx(spark, d, "fx_progress")
    now = log.agg(F.max("ts").alias("now")).scalar()
    return S.stale_runs(log, now)
