"""Queries of the text and alignment operators with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import alignment as A
from glosswork.plans.fixtures import spark_view as fx, sql_views as sql
from glosswork.plans.registry import query

ACCENTS = "[éèêëàâçîïôöùûüäßñáíóú]"
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"


def words(c: str) -> str:
    return WORDS.format(c)


@query("s6_strip_markup", sql(r"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', ' ', 'gi'), '<[^>]*>', '', 'g'), '[\s\x{00A0}]+', ' ', 'g')) as text from pages"))
def s6(spark, d):
    return fx(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query("s7_flatten_segments", sql("""with l as (select doc_id, text, string_split(text, chr(10)) as a from documents)
select doc_id, cast(unnest(range(0, len(a))) as int) as pos, unnest(a) as segment from l where doc_id % 3 > 0 union all select doc_id, 0, text from l where doc_id % 3 = 0"""))
def s7(spark, d):
    lines = F.split("text", "\n")
    nested = F.transform(lines, lambda x: F.array(x))
    raw = F.expr("doc_id % 3")
    json = F.when(raw == 0, F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)")).when(raw == 1, F.to_json(lines)).otherwise(F.to_json(nested))
    docs = fx(spark, d, "documents").select("doc_id", json.alias("raw"))
    return docs.select("doc_id", F.posexplode(T.flatten_segments(F.col("raw"))).alias("pos", "segment"))


@query("s8_merge_versions", sql("""with m as (select unit_id, line_no, coalesce(nullif(trim(v1), ''), nullif(trim(v2), ''), nullif(trim(v3), '')) as t, v1, v2, v3 from fx_versions)
select unit_id, line_no, case when count(t) over (partition by unit_id) > 0 then coalesce(t, '') else coalesce(v1, v2, v3) end as text from m"""))
def s8(spark, d):
    return A.merge_versions(fx(spark, d, "fx_versions"))


@query("t1_proportional_translation", sql(f"""with n as (select *, len({words('text')}) as w from fx_lines),
b as (select *, coalesce(sum(w) over (partition by unit_id order by line_no rows between unbounded preceding and 1 preceding), 0) as before, sum(w) over (partition by unit_id) as total, count(*) over (partition by unit_id) as n_lines from n),
t as (select doc_id as unit_id, case when doc_id % 2 = 0 then string_split(text, chr(10)) else list_slice(string_split(text, chr(10)), 1, greatest(1, len(string_split(text, chr(10))) - 1)) end as tr from documents),
j as (select b.*, tr, {words("array_to_string(tr, ' ')")} as al from b join t using (unit_id)),
k as (select *, cast(floor(before::double / greatest(total, 1)::double * len(al)) as int) as i0, cast(floor((before + w)::double / greatest(total, 1)::double * len(al)) as int) as i1 from j)
select unit_id, line_no, case when len(tr) = n_lines then tr[line_no] else array_to_string(list_slice(al, i0 + 1, i1), ' ') end as translation from k"""))
def t1(spark, d):
    lines = F.split("text", "\n")
    tr = fx(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.when(F.col("doc_id") % 2 == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.size(lines) - 1))).alias("tr_lines"))
    return A.proportional_slice(fx(spark, d, "fx_lines"), tr)


@query("t2_padded_slice", sql(f"""with u as (select doc_id as unit_id, regexp_replace(lower(text), '\\s+', '', 'g') as u, {words('reverse(text)')} as tr from documents),
s as (select unit_id, line_no as step_no, regexp_replace(lower(case when line_no % 5 = 4 then concat('zz', text) else text end), '\\s+', '', 'g') as s from fx_lines),
j as (select unit_id, step_no, s, u, tr, instr(u, substr(s, 1, 80)) as p from s join u using (unit_id)),
k as (select *, cast(floor((p - 1)::double / length(u) * len(tr)) as int) as i0, cast(floor(least((p - 1 + length(s))::double / length(u), 1.0) * len(tr)) as int) as i1 from j),
m as (select *, greatest(0, i0 - greatest(20, i1 - i0)) as lo, least(len(tr), i1 + greatest(20, i1 - i0)) as hi from k)
select unit_id, cast(step_no as int) as step_no, case when p > 0 and length(s) > 0 then array_to_string(list_slice(tr, lo + 1, hi), ' ') else array_to_string(tr, ' ') end as translation from m"""))
def t2(spark, d):
    units = fx(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("src"), F.reverse("text").alias("translation"))
    steps = fx(spark, d, "fx_lines").selectExpr("unit_id", "line_no as step_no", "case when line_no % 5 = 4 then concat('zz', text) else text end as text")
    return A.padded_slice(steps, units)


def split_after(text: str, marks: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '([{marks}])', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '')"


def count_words(text: str) -> str:
    return f"len({words(text).replace('lambda x: x', 'lambda z: z')})"


@query("t3_split_phrases", sql(f"""with recursive hard as (select unit_id, line_no, {split_after('text', A.HARD)} as a from fx_lines),
soft as (select unit_id, line_no, flatten(list_transform(a, lambda x: case when {count_words('x')} > {A.MOST_WORDS} then {split_after('x', A.SOFT)} else [x] end)) as a from hard),
cut as (select unit_id, line_no, flatten(list_transform(a, lambda x: case when {count_words('x')} > {A.MOST_WORDS} then
  list_transform(range(0, ({count_words('x')} + {A.CHUNK_WORDS} - 1) // {A.CHUNK_WORDS}), lambda k: array_to_string(list_slice({words('x').replace('lambda x: x', 'lambda z: z')}, k * {A.CHUNK_WORDS} + 1, (k + 1) * {A.CHUNK_WORDS}), ' ')) else [x] end)) as p from soft),
rounds as (select unit_id, line_no, p, list_transform(p, lambda x: {count_words('x')}) as s, false as done from cut
  union all
  (with f as (select *, list_filter(range(1, len(p) + 1), lambda i: s[i] < {A.LEAST_WORDS} and ((i > 1 and s[i - 1] + s[i] <= {A.MOST_WORDS}) or (i < len(p) and s[i + 1] + s[i] <= {A.MOST_WORDS})))[1] as i from rounds where not done),
   g as (select *, case when i > 1 and s[i - 1] + s[i] <= {A.MOST_WORDS} and not (i < len(p) and s[i + 1] + s[i] <= {A.MOST_WORDS} and s[i + 1] < s[i - 1]) then i - 1 else i end as lo from f)
   select unit_id, line_no, case when i is null then p else list_concat(list_concat(list_slice(p, 1, lo - 1), [concat(p[lo], ' ', p[lo + 1])]), list_slice(p, lo + 2, len(p))) end,
     case when i is null then s else list_concat(list_concat(list_slice(s, 1, lo - 1), [s[lo] + s[lo + 1]]), list_slice(s, lo + 2, len(s))) end, i is null from g))
select unit_id, line_no, cast(generate_subscripts(p, 1) as int) as phrase_no, unnest(p) as phrase from rounds where done"""))
def t3(spark, d):
    return A.split_phrases(fx(spark, d, "fx_lines"))


@query("t4_align_translation", sql(f"""with p as (select unit_id, line_no, cast(k as int) as phrase_no, n, w from (select unit_id, line_no, least(len(ws), 1 + unit_id % 3) as n, unnest(range(1, least(len(ws), 1 + unit_id % 3) + 1)) as k, 1 + unnest(range(1, least(len(ws), 1 + unit_id % 3) + 1)) as w from (select unit_id, line_no, {words('text')} as ws from fx_lines) where len(ws) > 0)),
q as (select p.*, sum(w) over (partition by unit_id, line_no) as total_w, l.text as translation, {words('l.text')} as tr, regexp_split_to_array(regexp_replace(trim(l.text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as sentences from p join fx_lines l using (unit_id, line_no)),
r as (select *, greatest(1, cast(round_even((len(tr) * w)::double / total_w, 0) as int)) as quota from q),
s as (select *, coalesce(sum(quota) over (partition by unit_id, line_no order by phrase_no rows between unbounded preceding and 1 preceding), 0) as before from r),
t as (select *, case when trim(translation) = '' then '{A.UNAVAILABLE}' when n = 1 then trim(translation) when len(sentences) = n then sentences[phrase_no] else array_to_string(list_slice(tr, before + 1, case when phrase_no = n then len(tr) else before + quota end), ' ') end as x from s)
select unit_id, line_no, phrase_no, case when x = '' then '{A.UNAVAILABLE}' else x end as translation from t"""))
def t4(spark, d):
    lines = fx(spark, d, "fx_lines")
    n = F.least(F.size(T.words("text")), (F.col("unit_id") % 3 + 1).cast("int"))
    phrases = lines.where(F.size(T.words("text")) > 0).select("unit_id", "line_no", F.explode(F.sequence(F.lit(1), n)).alias("phrase_no"))
    phrases = phrases.withColumn("phrase", F.array_join(F.array_repeat(F.lit("w"), F.col("phrase_no") + 1), " "))
    return A.align_translation(phrases, lines.select("unit_id", "line_no", F.col("text").alias("translation")))


TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[aeiou]', '', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


@query("t5_normalise_tokens", sql(f"select doc_id, array_to_string({TOKENS.format('text')}, ' ') as tokens from documents"))
def t5(spark, d):
    return fx(spark, d, "documents").select("doc_id", F.array_join(T.normalise_tokens(F.col("text"), dropped="[aeiou]"), " ").alias("tokens"))


COVER = """cov as (select doc_id, list_reduce(list_prepend({{'gi': 0, 'm': 0, 't': ''}}, list_transform(src, lambda x: {{'gi': 0, 'm': 0, 't': x}})),
  lambda a, b: case when list_position(list_slice(gen, a.gi + 1, a.gi + {k}), b.t) > 0 then {{'gi': cast(a.gi + list_position(list_slice(gen, a.gi + 1, a.gi + {k}), b.t) as int), 'm': a.m + 1, 't': ''}} else {{'gi': a.gi, 'm': a.m, 't': ''}} end).m as m, len(src) as n
  from (select doc_id, string_split(text, ' ') as src, list_filter(string_split(text, ' '), lambda x, i: i % (2 + doc_id % 9) > 0) as gen from documents))"""


def _coverage(spark, d, k):
    docs = fx(spark, d, "documents").select("doc_id", F.split("text", " ").alias("src"))
    docs = docs.withColumn("gen", F.expr("filter(src, (x, i) -> (i + 1) % (2 + doc_id % 9) > 0)"))
    return docs.select("doc_id", F.round(T.coverage_ratio(F.col("src"), F.col("gen"), k), 9).alias("ratio"))


@query("t6_coverage_ratio", sql(f"with {COVER.format(k=20)} select doc_id, round(m::double / n, 9) as ratio from cov"))
def t6(spark, d):
    return _coverage(spark, d, 20)


@query("t7_coverage_gate", sql(f"with {COVER.format(k=12)} select doc_id, case when m::double / n < 0.85 then 'critical' when m::double / n < 0.95 then 'warning' else 'ok' end as gate from cov"))
def t7(spark, d):
    return _coverage(spark, d, 12).select("doc_id", T.coverage_gate(F.col("ratio")).alias("gate"))


@query("t8_points", sql(f"select doc_id, regexp_replace(text, '{ACCENTS}', '', 'g') as bare, regexp_matches(text, '{ACCENTS}') as has_points, regexp_matches(text, '[a-z]') as has_script from documents"))
def t8(spark, d):
    c = F.col("text")
    return fx(spark, d, "documents").select("doc_id", T.strip_points(c, ACCENTS).alias("bare"), T.has_class(c, ACCENTS).alias("has_points"), T.has_class(c, "[a-z]").alias("has_script"))


VARIANT = "case p_partkey % 7 when 0 then ' N/A ' when 1 then 'none' when 2 then '' when 3 then 'Skip' when 4 then 'null' else p_type end"


@query("t9_blank_placeholders", sql(f"select p_partkey, case when lower(trim(v)) in ('', 'n/a', 'na', 'none', 'skip', 'null') then null else v end as value from (select p_partkey, {VARIANT} as v from part)"))
def t9(spark, d):
    return fx(spark, d, "part").select("p_partkey", T.blank_placeholders(F.expr(VARIANT)).alias("value"))


@query("t10_length_guard", sql(f"""with x as (select unit_id, line_no, text as new, array_to_string(list_filter({words('text')}, lambda x, i: i % (2 + unit_id % 9) = 0), ' ') as src from fx_lines),
c as (select *, greatest(15, cast(floor(len({words('src')}) * 2.5) as int)) as cap, regexp_split_to_array(regexp_replace(trim(new), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1] as sent from x)
select unit_id, line_no, case when trim(new) = '' then src when len({words('new')}) <= cap then new when len({words('sent')}) <= cap then sent else concat(array_to_string(list_slice({words('new')}, 1, cap), ' '), '…') end as text from c"""))
def t10(spark, d):
    lines = fx(spark, d, "fx_lines").withColumn("src", F.array_join(F.filter(T.words("text"), lambda x, i: (i + 1) % (F.col("unit_id") % 9 + 2) == 0), " "))
    return lines.select("unit_id", "line_no", T.length_guard(F.col("text"), F.col("src"), F.col("src")).alias("text"))


@query("t11_pad_or_trim", sql("select conv_id, turn, array_to_string(list_resize(list_slice(string_split(text, ' '), 1, 40 + turn), 40 + turn, ''), '|') as padded from conversations"))
def t11(spark, d):
    n = (F.col("turn") + 40).cast("int")
    return fx(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.pad_or_trim(F.split("text", " "), n), "|").alias("padded"))


@query("t12_contamination", sql(f"""with p as (select unit_id, len(list_filter({words('text')}, lambda x, i: i % (2 + line_no % 6) = 0)) as sw, len({words('text')}) as tw from fx_lines), g as (select unit_id, count(*) as phrases, cast(sum(case when tw > greatest(20, 3 * sw) then 1 else 0 end) as bigint) as bad from p group by 1)
select unit_id, phrases, bad, bad::double / phrases < 0.05 as clean from g"""))
def t12(spark, d):
    phrase = F.array_join(F.filter(T.words("text"), lambda x, i: (i + 1) % (F.col("line_no") % 6 + 2) == 0), " ")
    return A.contamination(fx(spark, d, "fx_lines").select("unit_id", phrase.alias("phrase"), F.col("text").alias("translation")))


@query("t13_already_aligned", sql("""select unit_id, line_no, len(list_filter(t, lambda x: list_contains(p, x)))::double / len(t) > 0.7 as aligned from (select unit_id, line_no, string_split(text, ' ') as t, list_filter(string_split(text, ' '), lambda x, i: i % (2 + unit_id % 3) > 0) as p from fx_lines)"""))
def t13(spark, d):
    lines = fx(spark, d, "fx_lines").withColumn("t", F.split("text", " "))
    lines = lines.withColumn("p", F.filter("t", lambda x, i: (i + 1) % (F.col("unit_id") % 3 + 2) > 0))
    return lines.select("unit_id", "line_no", T.already_aligned(F.col("t"), F.col("p")).alias("aligned"))


@query("t14_truncate_ellipsis", sql("select doc_id, case when length(text) > 300 then concat(substr(text, 1, 300), '…') else text end as excerpt from documents"))
def t14(spark, d):
    return fx(spark, d, "documents").select("doc_id", T.truncate_ellipsis(F.col("text"), 300).alias("excerpt"))


@query("t15_snippet", sql("""with p as (select doc_id, text, instr(lower(text), 'tion th') as a from documents), s as (select *, greatest(a - 50, 1) as st, least(a + 7 + 50, length(text) + 1) as en from p)
select doc_id, case when a > 0 then concat(case when st > 1 then '…' else '' end, substr(text, st, en - st), case when en <= length(text) then '…' else '' end) else substr(text, 1, 120) end as snippet from s"""))
def t15(spark, d):
    return fx(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), "tion th").alias("snippet"))


@query("t16_flag_words", sql(r"select doc_id, regexp_matches(text, '(?i)\b(idiot|worthless|pathetic|clown)\b') as flagged from documents"))
def t16(spark, d):
    return fx(spark, d, "documents").select("doc_id", T.flag_words(F.col("text"), ["idiot", "worthless", "pathetic", "clown"]).alias("flagged"))


@query("t17_missing_points", sql(f"""with m as (select * from fx_terms where regexp_matches(term, '[a-z]') and not regexp_matches(term, '{ACCENTS}'))
select t.unit_id, t.step_no, t.term_pos, case when m.term is not null and t.term_pos % 2 = 0 then concat(m.term, 'é') else t.term end as term from fx_terms t left join m using (unit_id, step_no, term_pos)"""))
def t17(spark, d):
    terms = fx(spark, d, "fx_terms")
    queue = A.missing_points(terms, "[a-z]", ACCENTS)
    new = queue.withColumn("term", F.when(F.col("term_pos") % 2 == 0, F.concat("term", F.lit("é"))).otherwise(" "))
    return A.apply_replacements(terms, new)


@query("t18_normalise_enum", sql("""select o_orderkey, case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'high' when '3-MEDIUM' then '3_medium' when '5-LOW' then '5_low' else 'unknown' end as priority from orders"""))
def t18(spark, d):
    value = A.normalise_enum(F.col("o_orderpriority"), ["3_medium", "5_low"], {"1_urgent": "high", "2_high": "high"}, "unknown")
    return fx(spark, d, "orders").select("o_orderkey", value.alias("priority"))


SEVERITIES = ("critical", "warning", "nit")
RAW_SEVERITY = "case {n} % 6 when 0 then 'Critically bad' when 1 then ' NIT-pick ' when 2 then 'low' when 3 then 'warning' when 4 then null else 'odd' end"


@query("t18_severity", sql(f"select o_orderkey, case o_orderkey % 6 when 0 then 'critical' when 1 then 'nit' when 2 then 'nit' else 'warning' end as severity from orders"))
def t18b(spark, d):
    raw = F.expr(RAW_SEVERITY.format(n="o_orderkey"))
    value = A.normalise_enum(raw, list(SEVERITIES), {"low": "nit", "minor": "nit"}, "warning", {"crit": "critical", "nit": "nit"})
    return fx(spark, d, "orders").select("o_orderkey", value.alias("severity"))
