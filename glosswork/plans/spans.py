"""Queries of the interval operators with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.operators import spans as S
from glosswork.plans.fixtures import spark_view as fx, sql_views as sql
from glosswork.plans.registry import query

# The literal recurrence of the span repair, as views for the oracles that build on it.
REPAIRED = """
s0 as (select f.unit_id, f.start_line s, f.end_line e, f.topic, u.n_lines t,
         row_number() over (partition by f.unit_id order by f.start_line, f.span_no) rn,
         count(*) over (partition by f.unit_id) n
       from fx_spans f join fx_units u using (unit_id)),
chain as (
  select unit_id, rn, n, topic, s as start_line, greatest(case when rn = n then t else least(t, e) end, s) as end_line
  from (select unit_id, rn, n, topic, greatest(1, s) as s, e, t from s0 where rn = 1)
  union all
  select x.unit_id, x.rn, x.n, x.topic, greatest(c.end_line + 1, x.s),
         greatest(case when x.rn = x.n then x.t else least(x.t, x.e) end, greatest(c.end_line + 1, x.s))
  from chain c join s0 x on x.unit_id = c.unit_id and x.rn = c.rn + 1),
repaired as (select unit_id, cast(rn as int) as span_no, cast(start_line as int) as start_line, cast(end_line as int) as end_line, topic from chain)
"""
STEP_RANGES = "steps as (select unit_id, span_no as step_no, start_line as first_line, least(end_line, start_line + 2) as last_line from repaired where span_no % 5 <> 2)"
GISTED = "gisted as (select unit_id, span_no, start_line, end_line, topic, concat('gist of ', topic) as gist from repaired)"
WINDOWED = """
ranges as (select collection, window_no, unit_id,
    cast(coalesce(sum(n_lines) over (partition by collection, window_no order by unit_id rows between unbounded preceding and 1 preceding), 0) + 1 as int) as unit_start,
    cast(sum(n_lines) over (partition by collection, window_no order by unit_id) as int) as unit_end from fx_windows),
wspans as (select r.collection, r.window_no, cast(row_number() over (partition by r.collection, r.window_no order by r.unit_id, p.span_no) as int) as span_no,
    cast(r.unit_start + p.start_line - 1 as int) as start_line, cast(r.unit_start + p.end_line + 1 as int) as end_line, p.topic, concat('gist of ', p.topic) as gist
    from ranges r join fx_spans p on p.unit_id = r.unit_id),
wsteps as (select collection, window_no, span_no as step_no, start_line as first_line, end_line as last_line from wspans)
"""


def recursive(views: str, body: str) -> str:
    return sql(f"with recursive {views} {body}")


def repaired(spark, d):
    return S.repair_spans(fx(spark, d, "fx_spans"), fx(spark, d, "fx_units"))


def steps_of(spans):
    return spans.where("span_no % 5 <> 2").select("unit_id", F.col("span_no").alias("step_no"), F.col("start_line").alias("first_line"), F.expr("least(end_line, start_line + 2)").alias("last_line"))


def ranges(spark, d):
    return S.concat_window(fx(spark, d, "fx_windows"))


def window_spans(spark, d):
    r = ranges(spark, d).select("collection", "window_no", "unit_id", "unit_start")
    j = r.join(fx(spark, d, "fx_spans"), "unit_id")
    w = S.Window.partitionBy("collection", "window_no").orderBy("unit_id", "span_no")
    return j.select("collection", "window_no", F.row_number().over(w).cast("int").alias("n"), (F.col("unit_start") + F.col("start_line") - 1).cast("int").alias("start_line"), (F.col("unit_start") + F.col("end_line") + 1).cast("int").alias("end_line"), "topic", F.concat(F.lit("gist of "), "topic").alias("gist")).withColumnRenamed("n", "span_no")


def window_steps(spark, d):
    return window_spans(spark, d).select("collection", "window_no", F.col("span_no").alias("step_no"), F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line"))


@query("i1_repair_spans", recursive(REPAIRED, "select * from repaired"))
def i1(spark, d):
    return repaired(spark, d)


@query("i2_repair_step_ranges", recursive("""
s0 as (select f.unit_id, f.span_no, f.start_line s, f.end_line e, u.n_lines t, row_number() over (partition by f.unit_id order by f.span_no) rn, count(*) over (partition by f.unit_id) n
       from fx_spans f join fx_units u using (unit_id)),
chain as (select unit_id, rn, greatest(e, s, 1) u from s0 where rn = 1
  union all select x.unit_id, x.rn, greatest(x.e, x.s, 1, c.u + 1) from chain c join s0 x on x.unit_id = c.unit_id and x.rn = c.rn + 1),
ends as (select s0.*, case when s0.rn = n then t else least(t, u) end as fin from s0 join chain using (unit_id, rn))
""", """select unit_id, span_no, cast(least(greatest(lag(fin, 1, 0) over (partition by unit_id order by rn) + 1, s, 1), fin) as int) as start_line, cast(fin as int) as end_line from ends"""))
def i2(spark, d):
    return S.repair_step_ranges(fx(spark, d, "fx_spans"), fx(spark, d, "fx_units"))


@query("i3_localise", recursive(REPAIRED + ", l as (select unit_id, span_no, k as step_no, k * 2 - 3 as ls, k * 2 + (unit_id % 3) - 3 as le from repaired, (select 1 k union all select 2 union all select 3))", """
select l.unit_id, l.span_no, cast(step_no as int) as step_no,
  cast(least(start_line - 1 + greatest(1, ls), least(start_line - 1 + greatest(ls, le), end_line)) as int) as first_line, cast(least(start_line - 1 + greatest(ls, le), end_line) as int) as last_line
from l join repaired r on r.unit_id = l.unit_id and r.span_no = l.span_no"""))
def i3(spark, d):
    spans = repaired(spark, d)
    local = spans.select("unit_id", "span_no", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step_no"))
    local = local.withColumns({"local_start": F.col("step_no") * 2 - 3, "local_end": F.col("step_no") * 2 + F.col("unit_id") % 3 - 3})
    return S.localise_to_global(local, spans)


@query("i4_drop_consecutive_duplicates", sql("""
with r as (select unit_id, span_no as step_no, cast(span_no // 2 as int) as first_line, cast(span_no // 2 + unit_id % 2 * (span_no % 3) as int) as last_line from fx_spans),
m as (select *, coalesce(lag(first_line) over w = first_line and lag(last_line) over w = last_line, false) as dup from r window w as (partition by unit_id order by step_no)),
k as (select *, bool_or(dup) over (partition by unit_id) as any_dup from m)
select unit_id, cast(case when any_dup then row_number() over (partition by unit_id order by step_no) else step_no end as int) as step_no, first_line, last_line from k where not dup"""))
def i4(spark, d):
    r = fx(spark, d, "fx_spans").selectExpr("unit_id", "span_no as step_no", "cast(span_no div 2 as int) as first_line", "cast(span_no div 2 + unit_id % 2 * (span_no % 3) as int) as last_line")
    return S.drop_consecutive_duplicates(r)


@query("i5_split_large_spans", recursive(REPAIRED + """, c as (select *, greatest(cast(ceil((end_line - start_line + 1) / 5.0) as int), 1) as chunks from repaired),
z as (select *, cast(ceil((end_line - start_line + 1) / chunks::double) as int) as size, unnest(range(0, chunks)) as part from c)""", """
select unit_id, span_no, cast(part + 1 as int) as part, cast(start_line + part * size as int) as start_line, cast(least(start_line + part * size + size - 1, end_line) as int) as end_line,
  case when chunks > 1 then concat(topic, ' (part ', part + 1, '/', chunks, ')') else topic end as topic from z where start_line + part * size <= end_line"""))
def i5(spark, d):
    return S.split_large_spans(repaired(spark, d), most_lines=5)


@query("i6_concat_window", sql(f"with {WINDOWED} select r.collection, r.window_no, r.unit_id, unit_start, unit_end, concat(min(unit_id) over w, '-', max(unit_id) over w) as window_ref from ranges r window w as (partition by collection, window_no)"))
def i6(spark, d):
    return ranges(spark, d)


@query("i7_owner_of_line", sql(f"""with {WINDOWED} select s.collection, s.window_no, s.line, (select min_by(r.unit_id, r.unit_start) from ranges r where r.collection = s.collection and r.window_no = s.window_no and s.line between r.unit_start and r.unit_end) as owner
from (select distinct collection, window_no, end_line as line from wspans) s where exists (select 1 from ranges r where r.collection = s.collection and r.window_no = s.window_no and s.line between r.unit_start and r.unit_end)"""))
def i7(spark, d):
    lines = window_spans(spark, d).select("collection", "window_no", F.col("end_line").alias("line")).distinct()
    return S.owner_of_line(lines, ranges(spark, d))


@query("i8_split_spans_to_units", sql(f"""with {WINDOWED} select s.collection, s.window_no, r.unit_id, s.span_no, cast(greatest(s.start_line, r.unit_start) - r.unit_start + 1 as int) as start_line,
  cast(least(s.end_line, r.unit_end) - r.unit_start + 1 as int) as end_line, concat(case when s.start_line < r.unit_start then '(continues) ' else '' end, s.topic) as topic,
  concat(s.gist, case when s.end_line > r.unit_end then ' (continues on the next unit)' else '' end) as gist
from wspans s join ranges r on s.collection = r.collection and s.window_no = r.window_no and not (s.end_line < r.unit_start or s.start_line > r.unit_end)"""))
def i8(spark, d):
    return S.split_spans_to_units(window_spans(spark, d), ranges(spark, d))


NUMBERED = """numbered as (select s.collection, s.window_no, r.unit_id, s.step_no as window_step, cast(row_number() over (partition by s.collection, s.window_no, r.unit_id order by s.step_no) as int) as step_no,
  cast(s.first_line - r.unit_start + 1 as int) as first_line, cast(least(s.last_line, r.unit_end) - r.unit_start + 1 as int) as last_line
from wsteps s join ranges r on s.collection = r.collection and s.window_no = r.window_no and s.first_line between r.unit_start and r.unit_end)"""


@query("i9_assign_steps_to_units", sql(f"with {WINDOWED}, {NUMBERED} select * from numbered"))
def i9(spark, d):
    return S.assign_steps_to_units(window_steps(spark, d), ranges(spark, d))


@query("i10_remap_dependencies", sql(f"""with {WINDOWED}, {NUMBERED}, deps as (select collection, window_no, step_no as step, step_no - 1 - step_no % 4 as dep_step from wsteps)
select d.collection, d.window_no, a.unit_id as from_unit, a.step_no as from_step, b.unit_id as to_unit, b.step_no as to_step
from deps d join numbered a on a.collection = d.collection and a.window_no = d.window_no and a.window_step = d.step join numbered b on b.collection = d.collection and b.window_no = d.window_no and b.window_step = d.dep_step"""))
def i10(spark, d):
    steps = window_steps(spark, d)
    deps = steps.selectExpr("collection", "window_no", "step_no as step", "step_no - 1 - step_no % 4 as dep_step")
    return S.remap_dependencies(deps, S.assign_steps_to_units(steps, ranges(spark, d)))


@query("i11_span_step_bounds_overlap", recursive(REPAIRED + ", " + STEP_RANGES, """select p.unit_id, p.span_no, min(s.step_no) as first_step, max(s.step_no) as last_step
from fx_spans p left join steps s on s.unit_id = p.unit_id and s.first_line <= p.end_line and s.last_line >= p.start_line group by 1, 2"""))
def i11(spark, d):
    return S.span_step_bounds(fx(spark, d, "fx_spans"), steps_of(repaired(spark, d)), overlap=True)


@query("i12_span_step_bounds_start", recursive(REPAIRED + ", " + STEP_RANGES, """select p.unit_id, p.span_no, min(s.step_no) as first_step, max(s.step_no) as last_step
from fx_spans p left join steps s on s.unit_id = p.unit_id and s.first_line between p.start_line and p.end_line group by 1, 2"""))
def i12(spark, d):
    return S.span_step_bounds(fx(spark, d, "fx_spans"), steps_of(repaired(spark, d)))


BOUNDS = "bounds as (select unit_id, span_no, case when unit_id % 4 > 0 then span_no end as first_step, case when unit_id % 4 > 0 then span_no + 1 end as last_step from repaired where span_no % 2 = 1)"


@query("i13_steps_in_span", recursive(REPAIRED + ", " + STEP_RANGES + ", " + BOUNDS + ", g as (select s.unit_id, b.span_no, s.step_no from steps s join bounds b on s.unit_id = b.unit_id and s.step_no between b.first_step and b.last_step)", """
select * from g union all select unit_id, 0, step_no from steps where unit_id not in (select unit_id from g)"""))
def i13(spark, d):
    spans = repaired(spark, d)
    bounds = spans.where("span_no % 2 = 1").selectExpr("unit_id", "span_no", "case when unit_id % 4 > 0 then span_no end as first_step", "case when unit_id % 4 > 0 then span_no + 1 end as last_step")
    return S.steps_in_span(bounds, steps_of(spans))


@query("i14_orphan_steps", recursive(REPAIRED + ", " + STEP_RANGES, "select * from steps s where not exists (select 1 from fx_spans p where p.unit_id = s.unit_id and s.first_line between p.start_line and p.end_line)"))
def i14(spark, d):
    return S.orphan_steps(steps_of(repaired(spark, d)), fx(spark, d, "fx_spans"))


ASKED = "asked as (select unit_id, line_no as step_no, case line_no % 3 when 0 then substr(text, 5) when 1 then concat(substr(text, 1, 40), ' zzz') else concat('zz', text) end as text from fx_lines)"
LOCATED = """
flat as (select unit_id, line_no, regexp_replace(lower(text), '\\s+', '', 'g') as t from fx_lines),
pos as (select unit_id, line_no, cast(coalesce(sum(length(t)) over (partition by unit_id order by line_no rows between unbounded preceding and 1 preceding), 0) + 1 as int) as pos from flat),
whole as (select unit_id, string_agg(t, '' order by line_no) as whole from flat group by unit_id),
needles as (select unit_id, step_no, regexp_replace(lower(text), '\\s+', '', 'g') as n from asked),
at_pos as (select unit_id, step_no, case when length(n) < 10 then null when instr(whole, substr(n, 1, 60)) > 0 then instr(whole, substr(n, 1, 60)) when instr(whole, substr(n, 1, 12)) > 0 then instr(whole, substr(n, 1, 12)) end as at_char from needles join whole using (unit_id)),
located as (select a.unit_id, a.step_no, cast(max(p.line_no) as int) as line_no from at_pos a left join pos p on p.unit_id = a.unit_id and p.pos <= a.at_char group by 1, 2)
"""


def asked_text(line_no, text):
    return F.when(line_no % 3 == 0, F.substr(text, F.lit(5))).when(line_no % 3 == 1, F.concat(F.substring(text, 1, 40), F.lit(" zzz"))).otherwise(F.concat(F.lit("zz"), text))


def asked_steps(spark, d):
    return fx(spark, d, "fx_lines").select("unit_id", F.col("line_no").alias("step_no"), asked_text(F.col("line_no"), F.col("text")).alias("text"))


@query("i15_locate_start_line", sql(f"with {ASKED}, {LOCATED} select * from located"))
def i15(spark, d):
    return S.locate_start_lines(asked_steps(spark, d), fx(spark, d, "fx_lines"))


COUNTS = "counts as (select unit_id, cast(n_lines as int) as n_steps from fx_units)"
PROPORTIONAL = """
sizes as (select unit_id, span_no, end_line - start_line + 1 as size, row_number() over (partition by unit_id order by span_no) rn, count(*) over (partition by unit_id) n, n_steps from fx_spans join counts using (unit_id)),
ideal as (select *, case when rn = n then n_steps else cast(round_even(cast(sum(size) over (partition by unit_id order by rn) as double) / cast(sum(size) over (partition by unit_id) as double) * n_steps, 0) as int) end as x from sizes),
pchain as (select unit_id, rn, greatest(x, 1) as last_step from ideal where rn = 1
  union all select i.unit_id, i.rn, greatest(i.x, c.last_step + 1) from pchain c join ideal i on i.unit_id = c.unit_id and i.rn = c.rn + 1),
prop as (select i.unit_id, i.span_no, cast(lag(c.last_step, 1, 0) over (partition by i.unit_id order by i.rn) + 1 as int) as first_step, cast(c.last_step as int) as last_step from ideal i join pchain c on c.unit_id = i.unit_id and c.rn = i.rn)
"""


def step_counts(spark, d):
    return fx(spark, d, "fx_units").selectExpr("unit_id", "n_lines as n_steps")


@query("i16_rebuild_bounds", recursive(f"{ASKED}, {LOCATED}, {COUNTS}, {PROPORTIONAL}" + """,
own as (select unit_id, span_no, min(step_no) f, max(step_no) l from (select l.unit_id, l.step_no, min(p.span_no) as span_no from located l join fx_spans p on p.unit_id = l.unit_id and l.line_no between p.start_line and p.end_line group by 1, 2) group by 1, 2)""", """
select p.unit_id, p.span_no, cast(coalesce(o.f, case when p.first_step <= c.n_steps then p.first_step end) as int) as first_step, cast(coalesce(o.l, case when p.last_step <= c.n_steps then p.last_step end) as int) as last_step
from prop p join counts c using (unit_id) left join own o on o.unit_id = p.unit_id and o.span_no = p.span_no"""))
def i16(spark, d):
    spans, counts = fx(spark, d, "fx_spans"), step_counts(spark, d)
    located = S.locate_start_lines(asked_steps(spark, d), fx(spark, d, "fx_lines"))
    return S.rebuild_bounds(located, spans, S.proportional_bounds(spans, counts), counts)


@query("i17_proportional_bounds", recursive(f"{COUNTS}, {PROPORTIONAL}", "select * from prop"))
def i17(spark, d):
    return S.proportional_bounds(fx(spark, d, "fx_spans"), step_counts(spark, d))


@query("i18_proportional_steps_floor", sql(f"""with {COUNTS}, sizes as (select unit_id, span_no, end_line - start_line + 1 as size, n_steps, row_number() over w rn, count(*) over (partition by unit_id) n,
  cast(sum(end_line - start_line + 1) over w as double) acc, cast(sum(end_line - start_line + 1) over (partition by unit_id) as double) total from fx_spans join counts using (unit_id) window w as (partition by unit_id order by span_no))
select unit_id, span_no, cast(floor((acc - size) / total * n_steps) as int) as from_step, cast(case when rn = n then n_steps else floor(acc / total * n_steps) end as int) as to_step from sizes"""))
def i18(spark, d):
    return S.proportional_steps_floor(fx(spark, d, "fx_spans"), step_counts(spark, d))


@query("i19_span_sanity", sql("""with f as (select p.*, u.n_lines, lead(start_line) over (partition by unit_id order by start_line, span_no) as nx from fx_spans p join fx_units u using (unit_id))
select unit_id, span_no, 'reversed' as fault from f where start_line > end_line union all select unit_id, span_no, 'before_first_line' from f where start_line < 1 union all select unit_id, span_no, 'past_last_line' from f where end_line > n_lines
union all select unit_id, span_no, 'gap' from f where nx > end_line + 1 union all select unit_id, span_no, 'overlap' from f where nx <= end_line"""))
def i19(spark, d):
    return S.span_sanity(fx(spark, d, "fx_spans"), fx(spark, d, "fx_units"))


@query("i19_uncovered_lines", sql("select unit_id, line_no from fx_lines l where not exists (select 1 from fx_spans p where p.unit_id = l.unit_id and l.line_no between p.start_line and p.end_line)"))
def i19b(spark, d):
    return S.uncovered_lines(fx(spark, d, "fx_lines"), fx(spark, d, "fx_spans"))


SUMMARY = """summary as (select unit_id, case when count(*) > 1 then array_to_string(list_slice(list(topic order by span_no), 1, 3), ' · ') else min(topic) end as topic,
  case when count(*) > 1 then string_agg(concat('(', span_no, ') ', gist), ' ' order by span_no) else min(gist) end as overview from gisted group by unit_id)"""


def _summary(spark, d):
    gisted = repaired(spark, d).withColumn("gist", F.concat(F.lit("gist of "), "topic"))
    return S.unit_summary(gisted, fx(spark, d, "fx_units"))


@query("i20_unit_summary", recursive(f"{REPAIRED}, {GISTED}, {SUMMARY}", "select * from summary"))
def i20(spark, d):
    return _summary(spark, d)


@query("i21_changed_only", recursive(f"{REPAIRED}, {GISTED}, {SUMMARY}", "select unit_id, topic, overview from summary where not (unit_id % 3 = 0)"))
def i21(spark, d):
    now = _summary(spark, d)
    stored = now.withColumn("overview", F.expr("case unit_id % 3 when 0 then overview when 1 then null else concat(overview, '!') end"))
    return S.changed_only(now, stored, ["unit_id"], "overview")
