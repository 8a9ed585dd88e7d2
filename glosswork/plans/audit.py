"""Queries of the audit, review, flow and search operators with their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from glosswork.functions.rules import AUDIT_RULES, CHALLENGE, RESOLUTION, SOURCE_RULES, STATEMENT
from glosswork.operators import audit as A
from glosswork.operators.gram_index import GramIndex
from glosswork.plans.fixtures import LABELS, spark_view as fx, sql_views as sql
from glosswork.plans.ingest import tables as analysis_tables
from glosswork.plans.registry import query
from glosswork.sources.scratch import scratch_folder

POINT = "\u05b8"  # stands after the first letter of the texts of odd units
RULES = [(1, r"^\s*(the|and)(\s|$)", "challenge"), (2, r"^\s*(la|le|les)(\s|$)", "resolution"), (3, r"^\s*(der|die|das)(\s|$)", "statement"), (4, r"^\s*(el|los)(\s|$)", None)]
RULE_ROWS = ", ".join(f"({i}, '{p}', {'null' if e is None else repr(e)})" for i, p, e in RULES)
MATCHES = f"""rules(rule_ix, pattern, expected) as (values {RULE_ROWS}),
texts as (select unit_id, step_no, label, 0 as source_ix, trim(lower(text)) as t from fx_steps union all select unit_id, step_no, label, 1, trim(lower(reverse_words)) from (select *, array_to_string(list_reverse(string_split(text, ' ')), ' ') as reverse_words from fx_steps)),
hits as (select * from texts join rules on regexp_matches(t, pattern))"""


def rules(spark):
    return spark.createDataFrame(RULES, "rule_ix int, pattern string, expected string")


def two_texts(spark, d):
    pointed = lambda c: F.when(F.col("unit_id") % 2 == 1, F.concat(F.substring(c, 1, 1), F.lit(POINT), F.substring(c, F.lit(2), F.length(c)))).otherwise(c)
    backwards = F.array_join(F.reverse(F.split("text", " ")), " ")
    return fx(spark, d, "fx_steps").withColumn("backwards", pointed(backwards)).withColumn("text", pointed(F.col("text")))


@query("a1_source_rule_override", sql(f"""with {MATCHES}, k as (select *, row_number() over (partition by unit_id, step_no order by source_ix, rule_ix) k from hits where expected is not null and expected <> label)
select s.unit_id, s.step_no, s.label as old_label, coalesce(k.expected, s.label) as label, k.rule_ix, cast(null as varchar) as rule_name, substr(k.t, 1, 80) as matched_text from fx_steps s left join k on k.unit_id = s.unit_id and k.step_no = s.step_no and k.k = 1"""))
def a1(spark, d):
    return A.source_rule_override(two_texts(spark, d), rules(spark), ["text", "backwards"])


@query("a2_pattern_audit", sql(f"""with {MATCHES}, k as (select *, row_number() over (partition by unit_id, step_no order by source_ix, rule_ix) k from hits)
select unit_id, step_no, label, expected, cast(null as varchar) as rule_name, case when expected is null then 'REVIEW' else 'MISMATCH' end as finding from k where k = 1 and (expected is null or expected <> label)"""))
def a2(spark, d):
    return A.pattern_audit(two_texts(spark, d), rules(spark), ["text", "backwards"])


OPENINGS = ("לָמָּה לִי {}", "וְאִידָּךְ סָבַר {}", "וצריכא:", "תָּנוּ רַבָּנַן {}", "לָא, בְּ{}", "וְהָא {} קָאָמַר", "{}", "", "וּמִי מָצֵית אָמְרַתְּ {}", "אִי תְּנָא {}")
LABELS_OF = (CHALLENGE, RESOLUTION, STATEMENT)


def _rule_rows(listed) -> str:
    return ", ".join(f"({i}, '{p}', {'null' if e is None else repr(e)}, '{n}')" for i, (p, e, n) in enumerate(listed, 1))


def _opened(text: str) -> list[str]:
    """A step's opening words and label, by its place; the same SQL for both engines."""
    opening = " ".join(f"when {i} then replace('{o}', '{{}}', {text})" for i, o in enumerate(OPENINGS))
    label = " ".join(f"when {i} then '{x}'" for i, x in enumerate(LABELS_OF))
    return [f"case (unit_id + step_no) % {len(OPENINGS)} {opening} end as opening", f"case (unit_id + 2 * step_no) % 3 {label} end as label"]


def _published(listed) -> str:
    return f"""rules(rule_ix, pattern, expected, name) as (values {_rule_rows(listed)}),
opened as (select unit_id, step_no, text, {', '.join(_opened('text'))} from fx_steps),
texts as (select unit_id, step_no, label, k, trim(regexp_replace(lower(t), '[֑-ׇ]', '', 'g')) as t
  from (select *, 0 as k, case when step_no % 4 = 0 then null else opening end as t from opened union all select *, 1, case when step_no % 4 = 0 then opening else text end from opened) where trim(coalesce(t, '')) <> ''),
hits as (select * from texts join rules on regexp_matches(t, pattern))"""


def opened_steps(spark, d):
    opened = fx(spark, d, "fx_steps").selectExpr("unit_id", "step_no", "text", *_opened("text"))
    late = F.col("step_no") % 4 == 0
    return opened.withColumn("trigger", F.when(~late, F.col("opening"))).withColumn("phrase", F.when(late, F.col("opening")).otherwise(F.col("text")))


def _named(spark, listed):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(listed, 1)], "rule_ix int, pattern string, expected string, name string")


@query("a1_published_rules", sql(f"""with {_published(SOURCE_RULES)}, k as (select *, row_number() over (partition by unit_id, step_no order by k, rule_ix) as nth from hits where expected <> label)
select o.unit_id, o.step_no, o.label as old_label, coalesce(k.expected, o.label) as label, k.rule_ix, k.name as rule_name, substr(k.t, 1, 80) as matched_text
from opened o left join k on k.unit_id = o.unit_id and k.step_no = o.step_no and k.nth = 1"""))
def a1b(spark, d):
    return A.source_rule_override(opened_steps(spark, d), _named(spark, SOURCE_RULES), ["trigger", "phrase"])


@query("a2_published_rules", sql(f"""with {_published(AUDIT_RULES)}, f as (select unit_id, step_no, min(k) as k from texts group by all),
h as (select *, row_number() over (partition by unit_id, step_no order by rule_ix) as nth from hits join f using (unit_id, step_no, k))
select unit_id, step_no, label, expected, name as rule_name, case when expected is null then 'REVIEW' else 'MISMATCH' end as finding from h where nth = 1 and (expected is null or expected <> label)"""))
def a2b(spark, d):
    return A.pattern_audit(opened_steps(spark, d), _named(spark, AUDIT_RULES), ["trigger", "phrase"], first_text=True)


SEQUENCE = "seq as (select * from (select unit_id, step_no, label, lag(label) over (partition by unit_id order by step_no) as previous from fx_steps) where previous = 'challenge' and label in ('response', 'question'))"


@query("a3_sequence_audit", sql(f"with {SEQUENCE} select * from seq"))
def a3(spark, d):
    return A.sequence_audit(fx(spark, d, "fx_steps"), "challenge", ["response", "question"])


@query("a4_audit_report", sql(f"""with {SEQUENCE}, g as (select s.unit_id, count(*) as steps, count(q.unit_id) as flagged from fx_steps s left join seq q using (unit_id, step_no) group by 1)
select unit_id, steps, flagged, round(flagged * 100.0 / steps, 6)::double as pct from g where flagged > 0 union all select null, cast(sum(steps) as bigint), cast(sum(flagged) as bigint), round(sum(flagged) * 100.0 / sum(steps), 6)::double from g"""))
def a4(spark, d):
    steps = fx(spark, d, "fx_steps")
    return A.audit_report(steps, A.sequence_audit(steps, "challenge", ["response", "question"]))


@query("a5_neighbour_context", sql("""select unit_id, step_no, substr(text, 1, 300) as excerpt, lag(label) over w as prev_label, lag(substr(text, 1, 300)) over w as prev_text, lead(label) over w as next_label, lead(substr(text, 1, 300)) over w as next_text
from fx_steps window w as (partition by unit_id order by step_no)"""))
def a5(spark, d):
    return A.neighbour_context(fx(spark, d, "fx_steps"))


@query("a6_consensus", sql("""with v1 as (select * from fx_verdicts where vote_no = 1), t as (select * from fx_verdicts where vote_no = 4),
a as (select unit_id, step_no, count(*) filter (correct) as agree from fx_verdicts where vote_no < 4 group by 1, 2),
n as (select unit_id, step_no, suggested, count(*) as n, min(vote_no) as seen from fx_verdicts where vote_no < 4 and not correct group by 1, 2, 3),
top as (select * from (select *, row_number() over (partition by unit_id, step_no order by n desc, seen) k from n) where k = 1),
dec as (select v1.unit_id, v1.step_no, v1.suggested as s1, top.suggested as s2, t.suggested as s3,
  case when not v1.correct and v1.confidence = 'high' then 'first' when not v1.correct and top.n >= 2 and a.agree <= 1 then 'majority' when not v1.correct and not t.correct then 'tie_breaker' else 'keep' end as decision
  from v1 join a using (unit_id, step_no) join t using (unit_id, step_no) left join top using (unit_id, step_no))
select unit_id, step_no, decision, case decision when 'first' then s1 when 'majority' then s2 when 'tie_breaker' then s3 end as new_label from dec"""))
def a6(spark, d):
    return A.consensus(fx(spark, d, "fx_verdicts"))


@query("a7_apply_high_confidence", sql("""select s.unit_id, s.step_no, case when v.suggested is not null then v.suggested else s.label end as label
from fx_steps s left join (select * from fx_verdicts where vote_no = 1 and not correct and confidence = 'high') v using (unit_id, step_no)"""))
def a7(spark, d):
    return A.apply_high_confidence(fx(spark, d, "fx_steps"), fx(spark, d, "fx_verdicts"))


# label values reachable only through known labels; other values are free text
PATCHES = """patches as (select unit_id, step_no, ix, kind, severity, field, case when kind = 'wrong_classification' and ix % 2 = 1 then 'proof' else new_value end as new_value from fx_issues
 union all select unit_id, step_no, ix + 1000, 'phrasing_too_long', 'warning', 'title', concat('again ', step_no) from fx_issues where ix % 3 = 0 union all select unit_id, step_no, ix + 2000, 'other', 'nit', 'unknown', 'x' from fx_issues where ix % 4 = 0)"""
STATUS = f"""status as (select *, case when kind = 'wrong_classification' and new_value in ({', '.join(repr(x) for x in LABELS)}) and severity <> 'nit' then 'label' when field in ('title', 'label') then field end as target from patches)"""


def patches(spark, d):
    issues = fx(spark, d, "fx_issues")
    columns = ["unit_id", "step_no", "ix", "kind", "severity", "field", "new_value"]
    base = issues.withColumn("new_value", F.expr("case when kind = 'wrong_classification' and ix % 2 = 1 then 'proof' else new_value end")).select(columns)
    again = issues.where("ix % 3 = 0").selectExpr("unit_id", "step_no", "ix + 1000", "'phrasing_too_long'", "'warning'", "'title'", "concat('again ', step_no)")
    other = issues.where("ix % 4 = 0").selectExpr("unit_id", "step_no", "ix + 2000", "'other'", "'nit'", "'unknown'", "'x'")
    return A.patch_status(base.union(again).union(other), list(LABELS), ["title", "label"])


@query("a8_patch_status", sql(f"with {PATCHES}, {STATUS} select unit_id, step_no, ix, target, case when target is null then 'skipped' else 'applied' end as status from status"))
def a8(spark, d):
    return patches(spark, d).select("unit_id", "step_no", "ix", "target", "status")


@query("a8_auto_patch", sql(f"""with {PATCHES}, {STATUS}, l as (select unit_id, step_no, target, max_by(new_value, ix) as v from status where target is not null group by 1, 2, 3)
select s.unit_id, s.step_no, coalesce(t.v, s.role) as title, coalesce(b.v, s.label) as label from fx_steps s left join l t on t.unit_id = s.unit_id and t.step_no = s.step_no and t.target = 'title' left join l b on b.unit_id = s.unit_id and b.step_no = s.step_no and b.target = 'label'"""))
def a8b(spark, d):
    return A.auto_patch(fx(spark, d, "fx_steps").withColumnRenamed("role", "title"), patches(spark, d), ["title", "label"])


@query("a9_severity_counts", sql("""with g as (select unit_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'nit') as nit from fx_issues group by 1)
select *, case when critical > 0 then 'needs_work' when warning > 0 then 'good' else 'excellent' end as assessment from g"""))
def a9(spark, d):
    return A.severity_counts(fx(spark, d, "fx_issues"))


@query("a10_schema_check", sql("""select unit_id, step_no, 'label is not listed' as message from fx_steps where label not in ('statement', 'challenge', 'proof', 'question') union all select unit_id, step_no, 'text is too short' from fx_steps where length(text) < 200
union all select unit_id, step_no, 'role is not listed' from fx_steps where role not in ('user', 'assistant')"""))
def a10(spark, d):
    return A.schema_check(fx(spark, d, "fx_steps"), {
        "label is not listed": ~F.col("label").isin("statement", "challenge", "proof", "question"),
        "text is too short": F.length("text") < 200,
        "role is not listed": ~F.col("role").isin("user", "assistant"),
    })


@query("a10_first_messages", sql("""with b as (select unit_id, step_no, 0 as rule, 'label is not listed' as message from fx_steps where label not in ('statement', 'challenge', 'proof', 'question') union all select unit_id, step_no, 1, 'text is too short' from fx_steps where length(text) < 200 union all select unit_id, step_no, 2, 'role is not listed' from fx_steps where role not in ('user', 'assistant')),
k as (select *, row_number() over (partition by unit_id order by step_no, rule) k from b) select unit_id, string_agg(concat(step_no, ': ', message), '; ' order by k) filter (k <= 3) as messages, count(*) as broken from k group by 1"""))
def a10b(spark, d):
    return A.first_messages(fx(spark, d, "fx_steps"), {
        "label is not listed": ~F.col("label").isin("statement", "challenge", "proof", "question"),
        "text is too short": F.length("text") < 200,
        "role is not listed": ~F.col("role").isin("user", "assistant"),
    })


@query("a11_content_checks", sql("""select distinct conv_id as unit_id, 'no_spans' as fault from conversations where conv_id % 6 = 0 union all select distinct unit_id, 'no_phrases' from fx_steps where (unit_id + step_no) % 11 = 0
union all select distinct unit_id, 'terms_without_points' from fx_terms where term_pos <= 2 and not regexp_matches(term, '[éèaeiou]')"""))
def a11b(spark, d):
    steps = fx(spark, d, "fx_steps")
    units = steps.select("unit_id").distinct()
    spans = units.where("unit_id % 6 > 0")
    phrases = steps.where("(unit_id + step_no) % 11 > 0")
    return A.content_checks(units, steps, spans, phrases, fx(spark, d, "fx_terms").where("term_pos <= 2"), "[éèaeiou]")


TITLES = "t as (select conv_id as unit_id, case when conv_id % 5 = 0 and turn = 0 then 'x' else role end as title, turn from conversations)"


@query("a11_structure_checks", sql(f"""with u as (select doc_id as unit_id, string_split(text, ' ')[1] as topic, string_split(text, chr(10))[1] as overview from documents), {TITLES},
g as (select unit_id, count(*) as steps, count(*) filter (length(title) < 3) as short_titles from t group by 1), j as (select u.*, coalesce(steps, 0) as steps, short_titles from u left join g using (unit_id))
select unit_id, 'no_steps' as fault from j where steps = 0 union all select unit_id, 'short_topic' from j where length(topic) < 10 union all select unit_id, 'short_overview' from j where length(overview) < 30 union all select unit_id, 'short_titles' from j where short_titles > 0"""))
def a11(spark, d):
    units = fx(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.split("text", " ")[0].alias("topic"), F.split("text", "\n")[0].alias("overview"))
    steps = fx(spark, d, "conversations").selectExpr("conv_id as unit_id", "case when conv_id % 5 = 0 and turn = 0 then 'x' else role end as title")
    return A.structure_checks(units, steps)


@query("a12_quality_score", sql("""select unit_id, cast(greatest(0, 100 - sum(case severity when 'critical' then 25 when 'warning' then 7 else 2 end)) as bigint) as score, count(*) filter (severity = 'critical') = 0 as passed from fx_issues group by 1"""))
def a12(spark, d):
    return A.quality_score(fx(spark, d, "fx_issues"))


@query("a13_unit_metrics", sql("""with c as (select unit_id, label, count(*) n from fx_steps group by 1, 2), h as (select unit_id, string_agg(concat(label, '=', n), ',' order by concat(label, '=', n)) as labels from c group by 1)
select unit_id, count(*) as steps, round(avg(length(text)), 6) as mean_chars, count(distinct role) as roles, round(sum(len(string_split(text, ' ')))::double / count(*), 6) as words_per_step, any_value(labels) as labels from fx_steps join h using (unit_id) group by 1"""))
def a13(spark, d):
    return A.unit_metrics(fx(spark, d, "fx_steps"))


METRIC_SQL = "select source, 'docs' as metric, count(*)::double as value from documents group by 1 union all select source, 'chars', sum(length(text))::double from documents group by 1 union all select source, concat('lang_', lang), count(*)::double from documents group by 1, lang"


@query("a14_compare_runs", sql(f"""with m as ({METRIC_SQL}), a as (select metric, sum(value) v from m where cast(substr(source, 4) as int) % 2 = 0 and metric <> 'lang_de' group by 1), b as (select metric, sum(value) v from m where cast(substr(source, 4) as int) % 2 = 1 and metric <> 'lang_fr' group by 1)
select metric, round(coalesce(a.v, 0), 6) as value_a, round(coalesce(b.v, 0), 6) as value_b, round(coalesce(b.v, 0) - coalesce(a.v, 0), 6) as delta, case when metric in ('docs', 'chars') then coalesce(b.v, 0) > coalesce(a.v, 0) else coalesce(b.v, 0) < coalesce(a.v, 0) end as improved from a full join b using (metric)"""))
def a14(spark, d):
    docs = fx(spark, d, "documents").withColumn("odd", F.expr("cast(substr(source, 4) as int) % 2"))
    metrics = docs.groupBy("odd").agg(F.count(F.lit(1)).cast("double").alias("docs"), F.sum(F.length("text")).cast("double").alias("chars"), *[F.count(F.when(F.col("lang") == x, 1)).cast("double").alias(f"lang_{x}") for x in ("en", "fr", "de", "es")])
    long = metrics.unpivot("odd", [c for c in metrics.columns if c != "odd"], "metric", "value")
    side = lambda n, gone: long.where((F.col("odd") == n) & (F.col("metric") != gone)).select("metric", "value")
    return A.compare_runs(side(0, "lang_de"), side(1, "lang_fr"), ["docs", "chars"])


@query("a15_dependency_edges", sql("""select d.unit_id, d.step_no, d.dep_step, s.label, p.label as dep_label, case when p.label is null then 'dangling' when d.dep_step >= d.step_no then 'not_earlier' when s.label = 'resolution' and p.label <> 'challenge' then 'wrong_label' when s.label = 'response' and p.label <> 'question' then 'wrong_label' else 'ok' end as finding
from fx_deps d join fx_steps s on s.unit_id = d.unit_id and s.step_no = d.step_no left join fx_steps p on p.unit_id = d.unit_id and p.step_no = d.dep_step"""))
def a15(spark, d):
    return A.dependency_edges(fx(spark, d, "fx_deps"), fx(spark, d, "fx_steps"), {"resolution": "challenge", "response": "question"})


@query("f2_branch_depth", sql("""with recursive o as (select unit_id, step_no, branch_role, row_number() over (partition by unit_id order by step_no) rn from fx_steps),
c as (select unit_id, step_no, rn, case branch_role when 'opens_new_branch' then 1 else 0 end as depth from o where rn = 1
 union all select o.unit_id, o.step_no, o.rn, case o.branch_role when 'opens_new_branch' then c.depth + 1 when 'returns_to_previous_branch' then greatest(0, c.depth - 1) when 'conclusion_of_branch' then 0 else c.depth end from c join o on o.unit_id = c.unit_id and o.rn = c.rn + 1)
select unit_id, step_no, cast(depth as int) as depth from c"""))
def f2(spark, d):
    return A.branch_depth(fx(spark, d, "fx_steps"))


FIELDS = """f as (select doc_id, 'text' as field, 0 as ordinal, 5 as weight, text from documents union all select doc_id, 'source', 1, 10, source from documents union all select doc_id, 'first_line', 2, 8, string_split(text, chr(10))[1] from documents)"""


@query("f3_search", sql(f"""with {FIELDS}, h as (select *, instr(lower(text), 'ation') as a from f where instr(lower(text), 'ation') > 0 order by weight desc, doc_id, ordinal limit 50), s as (select *, greatest(a - 50, 1) as st, least(a + 5 + 50, length(text) + 1) as en from h)
select doc_id, field, cast(ordinal as int) as ordinal, cast(weight as int) as weight, concat(case when st > 1 then '…' else '' end, substr(text, st, en - st), case when en <= length(text) then '…' else '' end) as snippet from s"""))
def f3(spark, d):
    docs = fx(spark, d, "documents")
    fields = docs.selectExpr("doc_id", "stack(3, 'text', 0, 5, text, 'source', 1, 10, source, 'first_line', 2, 8, split(text, '\\n')[0]) as (field, ordinal, weight, text)")
    return A.search(fields, "ation")


@query("f5_logic_facets", sql("""select unit_id, step_no, 'scope' as facet, 'whole unit' as value from fx_steps where label = 'statement' union all select unit_id, step_no, 'branch', branch_role from fx_steps union all select unit_id, step_no, 'length', cast(length(text) as varchar) from fx_steps where role = 'user'"""))
def f5(spark, d):
    return A.logic_facets(fx(spark, d, "fx_steps"), {
        "scope": F.when(F.col("label") == "statement", "whole unit"),
        "branch": F.col("branch_role"),
        "length": F.when(F.col("role") == "user", F.length("text")),
    })


NAMES = [(x, x.capitalize()) for x in LABELS if x != "proof"]


@query("f6_step_labels", sql(f"select unit_id, step_no, label, coalesce(n.name, s.label) as name from fx_steps s left join (values {', '.join(str(x) for x in NAMES)}) n(l, name) on n.l = s.label"))
def f6(spark, d):
    names = spark.createDataFrame(NAMES, "label string, name string")
    return fx(spark, d, "fx_steps").join(F.broadcast(names), "label", "left").select("unit_id", "step_no", "label", F.coalesce("name", "label").alias("name"))  # one row a label


def parts_of(spark, d):
    """Exploded analyses of the conversations, as the flat tables that they are made of."""
    tables = analysis_tables(spark, d)
    blank = {"summary": F.concat(F.lit("In short: "), "title"), "deeper": F.concat_ws(" ", "label", "branchRole", "what")}
    return tables | {"steps": tables["steps"].withColumns(blank).where("stepNumber % 13 > 0")}


STEPS = "st as (select *, concat('Unit ', unit_id) as ref, substr(text, 1, 40) as what, case when step_no % 3 = 0 then 'Low' else 'High' end as confidence from fx_steps where step_no % 13 > 0)"
WHOLE = "ph as (select unit_id, step_no, cast(generate_subscripts(a, 1) as int) as phrase_no, unnest(a) as source from (select unit_id, step_no, string_split(text, chr(10)) as a from fx_steps))"
CLEAN = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda z: z <> '')"


@query("a13_analysis_metrics", sql(f"""with {STEPS}, {WHOLE}, u as (select unit_id, string_agg(text, ' ' order by step_no desc) as text from fx_steps group by 1),
s as (select unit_id, count(*) as steps, sum(length(what)) as wc, sum(length(concat_ws(' ', label, branch_role, what))) as dc, count(*) filter (confidence <> 'High') as unsure from st group by 1),
h as (select unit_id, string_agg(concat(label, '=', n), ',' order by label) as labels from (select unit_id, label, count(*) as n from st group by 1, 2) group by 1),
p as (select unit_id, count(*) as phrases, sum(length(source) + 1) as pc, string_agg(source, ' ' order by step_no, phrase_no) as said from ph group by 1),
t as (select unit_id, count(*) as terms, count(distinct trim(replace(term, 'é', ''))) as uniq, count(*) filter (contains(term, 'é')) as pointed from fx_terms where term_pos <= 3 group by 1),
c as (select unit_id, sum(1 + unit_id % 2) as comments, count(*) as commented from fx_steps group by 1),
cov as (select unit_id, list_reduce(list_prepend({{'gi': 0, 'm': 0, 't': ''}}, list_transform(src, lambda x: {{'gi': 0, 'm': 0, 't': x}})),
  lambda a, b: case when list_position(list_slice(gen, a.gi + 1, a.gi + 20), b.t) > 0 then {{'gi': cast(a.gi + list_position(list_slice(gen, a.gi + 1, a.gi + 20), b.t) as int), 'm': a.m + 1, 't': ''}} else {{'gi': a.gi, 'm': a.m, 't': ''}} end).m as m, len(src) as n
  from (select unit_id, {CLEAN.format("regexp_replace(text, 'é', '', 'g')")} as src, {CLEAN.format("regexp_replace(said, 'é', '', 'g')")} as gen from u join p using (unit_id)))
select concat('Unit ', unit_id) as ref, steps, labels, phrases, round(phrases::double / steps, 6) as phrases_per_step, terms, t.uniq as unique_terms, terms - t.uniq as redundant_terms, pointed as terms_with_points, terms - pointed as terms_without_points,
  round(wc::double / steps, 6) as what_chars_per_step, round(dc::double / steps, 6) as deeper_chars_per_step, cast(pc as bigint) as phrase_chars, round(case when n = 0 then 1 else m::double / n end, 9) as coverage, commented as steps_with_comments, cast(comments as bigint) as comments, true as has_spans, unsure as unsure_steps
from s join h using (unit_id) join p using (unit_id) join t using (unit_id) join c using (unit_id) join cov using (unit_id)"""))
def a13b(spark, d):
    text = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("step_no", "text")))), lambda x: x["text"]), " ")
    sources = fx(spark, d, "fx_steps").groupBy(F.concat(F.lit("Unit "), F.col("unit_id").cast("string")).alias("ref")).agg(text.alias("text"))
    metrics = A.analysis_metrics(parts_of(spark, d), sources, points="[é]")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return metrics.withColumn("labels", listed)


@query("a14_compare_labels", sql("""with a as (select label, count(*) n from fx_steps where unit_id % 2 = 0 and label <> 'proof' group by 1), b as (select label, count(*) n from fx_steps where unit_id % 2 = 1 and label <> 'question' group by 1)
select label, coalesce(a.n, 0) as count_a, coalesce(b.n, 0) as count_b, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b using (label)"""))
def a14b(spark, d):
    steps = fx(spark, d, "fx_steps")
    return A.compare_labels(steps.where("unit_id % 2 = 0 and label <> 'proof'"), steps.where("unit_id % 2 = 1 and label <> 'question'"))


SEARCHED = f"""with {STEPS}, {WHOLE}, k as (select *, list_extract([1, 2, 3, 4], cast(step_no % 4 + 1 as int)) as bucket, unnest(range(0, cast(unit_id % 2 as int) + 1)) as pos from fx_steps),
f as (select concat('Unit ', unit_id) as ref, 0 as step_no, 0 as kind, 0 as pos, 'mainTopic' as field, 10 as weight, min_by(text, step_no) as loose, null::varchar as exact, '' as lead, false as whole from fx_steps group by unit_id
 union all select ref, step_no, 1, 0, 'title', 8, role, null, '', false from st union all select ref, step_no, 2, 0, 'summary', 5, concat('In short: ', role), null, '', false from st
 union all select ref, step_no, 3, 0, 'what', 5, what, null, '', false from st union all select ref, step_no, 4, 0, 'deeper', 5, concat_ws(' ', label, branch_role, what), null, '', false from st
 union all select concat('Unit ', unit_id), step_no, 5, term_pos - 1, 'term', 7, concat('of ', reverse(term)), term, '', true from fx_terms where term_pos <= 3
 union all select concat('Unit ', unit_id), step_no, 6, 2 * phrase_no, 'source phrase', 6, null, source, '', false from ph union all select concat('Unit ', unit_id), step_no, 6, 2 * phrase_no + 1, 'translated phrase', 4, reverse(source), null, '', false from ph
 union all select concat('Unit ', unit_id), step_no, 7, bucket * 1000000 + pos, 'takeaway', 6, role, null, concat('source ', pos, ': '), false from k),"""


def _hits(needle: str, k: int, name: str = "h") -> str:
    """The k best hits of a needle in the searched fields, as common table expressions that end in ``name``."""
    n = len(needle)
    return f"""{name}_h as (select *, coalesce(loose, exact) as t from f where contains(lower(loose), '{needle.lower()}') or contains(exact, '{needle}') order by weight desc, ref, step_no, kind, pos limit {k}),
{name}_s as (select *, instr(lower(t), '{needle.lower()}') as a from {name}_h), {name}_w as (select *, greatest(a - 50, 1) as b, least(a + 50 + {n}, length(t) + 1) as e from {name}_s),
{name} as (select ref, cast(step_no as int) as step_no, kind, cast(pos as int) as pos, field, weight, case when whole then concat_ws(' — ', exact, loose) when a > 0 then concat(lead, case when b > 1 then '…' else '' end, substr(t, b, e - b), case when e <= length(t) then '…' else '' end) else concat(lead, substr(t, 1, 120)) end as snippet from {name}_w)"""


@query("f3_search_analyses", sql(f"{SEARCHED}\n{_hits('ER', 4000)} select * from h"))
def f3b(spark, d):
    return A.search_analyses(A.search_fields(parts_of(spark, d)), " ER ", 4000)

NEEDLES = ("e", "TI", "the", "ation", "continues_current_li", "in short: user", "qqq")  # of 1 to 20 characters


@query("f3_indexed_search", sql(f"{SEARCHED}\n" + ", ".join(_hits(x, 300, f"h{i}") for i, x in enumerate(NEEDLES)) + " " + " union all ".join(f"select '{x}' as needle, * from h{i}" for i, x in enumerate(NEEDLES))))
def f3c(spark, d):
    """The search over analyses, each needle through the posting lists of its trigrams."""
    index = GramIndex(spark, scratch_folder(spark, "gram-index"))
    index.build(A.search_fields(parts_of(spark, d)), ["loose", "exact"], tier="weight")
    found = [index.best(x, 300, lambda rows, x=x: A.search_analyses(rows, x, 300)).withColumn("needle", F.lit(x)) for x in NEEDLES]
    return reduce(DataFrame.union, found)
