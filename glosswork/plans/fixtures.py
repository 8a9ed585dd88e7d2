"""Derived views over the test tables that give every operator an input, in Spark and in the oracles' SQL.

``spark_view`` builds a view as a DataFrame; ``sql_views`` gives the same views as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from glosswork.operators.ordering import numbered

TABLES = ("documents", "conversations", "events", "lineitem", "orders", "part", "customer", "pages", "benchmark", "labels")

LABELS = ("statement", "challenge", "resolution", "proof", "rejection", "question", "response", "conclusion")
_LABEL_LIST = ",".join(f"'{x}'" for x in LABELS)

# name: (Spark SQL, DuckDB SQL or None where both are the same)
_VIEWS: dict[str, tuple[str, str | None]] = {
    "fx_lines": (
        "select doc_id as unit_id, pos+1 as line_no, trim(line) as text from (select doc_id, posexplode(split(text,'\\n')) as (pos,line) from documents)",
        "select doc_id as unit_id, cast(generate_subscripts(l,1) as int) as line_no, trim(unnest(l)) as text from (select doc_id, string_split(text,chr(10)) as l from documents)",
    ),
    "fx_units": ("select unit_id, cast(count(*) as int) as n_lines from fx_lines group by unit_id", None),
    "fx_spans": (
        "select unit_id, cast(k+1 as int) as span_no, cast(4*k + (unit_id+k)%3 as int) as start_line, cast(4*k + (unit_id+k)%3 + 2 + (unit_id*3+k)%5 as int) as end_line, concat('topic ',cast(unit_id%7 as string),'-',cast(k as string)) as topic from (select unit_id, explode(sequence(0,cast(floor((n_lines-1)/4) as int))) as k from fx_units)",
        "select unit_id, cast(k+1 as int) as span_no, cast(4*k + (unit_id+k)%3 as int) as start_line, cast(4*k + (unit_id+k)%3 + 2 + (unit_id*3+k)%5 as int) as end_line, concat('topic ',cast(unit_id%7 as varchar),'-',cast(k as varchar)) as topic from (select unit_id, unnest(range(0,cast(floor((n_lines-1)/4) as int)+1)) as k from fx_units)",
    ),
    "fx_steps": (
        f"select conv_id as unit_id, cast(turn+1 as int) as step_no, element_at(array({_LABEL_LIST}), cast((conv_id*7+floor(turn*(turn+1)/2))%8+1 as int)) as label, case (conv_id+turn*2)%6 when 0 then 'opens_new_branch' when 1 then 'opens_new_branch' when 2 then 'returns_to_previous_branch' when 3 then 'conclusion_of_branch' else 'continues_current_line' end as branch_role, role, text from conversations",
        f"select conv_id as unit_id, cast(turn+1 as int) as step_no, list_extract([{_LABEL_LIST}], cast((conv_id*7+floor(turn*(turn+1)/2))%8+1 as int)) as label, case (conv_id+turn*2)%6 when 0 then 'opens_new_branch' when 1 then 'opens_new_branch' when 2 then 'returns_to_previous_branch' when 3 then 'conclusion_of_branch' else 'continues_current_line' end as branch_role, role, text from conversations",
    ),
    "fx_deps": ("select unit_id, step_no, cast(step_no-1-(unit_id%3) as int) as dep_step from fx_steps where label in ('resolution','response','rejection')", None),
    "fx_windows": (
        "select source as collection, cast(substr(source,4) as int) as coll_no, unit_id, n_lines, cast(floor((rn-1)/5) as int) as window_no from (select d.source, u.unit_id, u.n_lines, row_number() over (partition by d.source order by u.unit_id) rn from fx_units u join documents d on d.doc_id=u.unit_id)",
        None,
    ),
    "fx_versions": ("select unit_id, line_no, text as src, case when (unit_id+line_no)%3=0 then concat('A ',text) else '' end as v1, case when (unit_id+line_no)%3=1 then concat(' B ',text) else '  ' end as v2, case when unit_id%11=0 then '' else text end as v3 from fx_lines", None),
    "fx_links": (
        "select cast(l_orderkey % n as bigint) as unit_id, l_linenumber as line_no, concat(l_returnflag,l_linestatus) as title, case when l_suppkey%4=0 then 'Quotation' else 'Commentary' end as category, concat('ref ',cast(l_orderkey as string),':',cast(l_partkey as string)) as source_ref, l_partkey as pos from lineitem cross join (select count(*) n from documents)",
        "select cast(l_orderkey % n as bigint) as unit_id, l_linenumber as line_no, concat(l_returnflag,l_linestatus) as title, case when l_suppkey%4=0 then 'Quotation' else 'Commentary' end as category, concat('ref ',cast(l_orderkey as varchar),':',cast(l_partkey as varchar)) as source_ref, l_partkey as pos from lineitem cross join (select count(*) n from documents)",
    ),
    "fx_terms": (
        "select unit_id, step_no, pos+1 as term_pos, term from (select unit_id, step_no, posexplode(split(trim(text),' ')) as (pos,term) from fx_steps)",
        "select unit_id, step_no, cast(generate_subscripts(l,1) as int) as term_pos, unnest(l) as term from (select unit_id, step_no, string_split(trim(text),' ') as l from fx_steps)",
    ),
    "fx_usage": (
        "select event_id as seq, user_id as run_id, event_type as pass, concat('model-',cast(user_id%3 as string),case when event_id%2=0 then '-2024' else '' end) as model, value as seconds, cast(event_id%900 as bigint) as input_tokens, cast(event_id%300 as bigint) as output_tokens, ts from events",
        "select event_id as seq, user_id as run_id, event_type as pass, concat('model-',cast(user_id%3 as varchar),case when event_id%2=0 then '-2024' else '' end) as model, value as seconds, cast(event_id%900 as bigint) as input_tokens, cast(event_id%300 as bigint) as output_tokens, ts from events",
    ),
    "fx_runs": (
        "select event_id as seq, concat('c',cast(user_id%5 as string),'/window/',cast(user_id as string)) as run_key, case when event_type='error' then 'failed' else 'ok' end as status, event_type='view' as skipped, value as minutes, ts as at from events",
        "select event_id as seq, concat('c',cast(user_id%5 as varchar),'/window/',cast(user_id as varchar)) as run_key, case when event_type='error' then 'failed' else 'ok' end as status, event_type='view' as skipped, value as minutes, ts as at from events",
    ),
    "fx_progress": (
        "select event_id as seq, user_id as run_id, ts, case when event_type in ('click','view') then concat('Pass ',cast(event_id%6+1 as string),'/6: ',event_type) else event_type end as msg from events",
        "select event_id as seq, user_id as run_id, ts, case when event_type in ('click','view') then concat('Pass ',cast(event_id%6+1 as varchar),'/6: ',event_type) else event_type end as msg from events",
    ),
    "fx_verdicts": (
        f"select s.unit_id, s.step_no, v.vote_no, (s.unit_id*3+s.step_no*v.vote_no+v.vote_no*v.vote_no)%5<2 as correct, element_at(array({_LABEL_LIST}), cast((s.unit_id+s.step_no+floor(v.vote_no/3))%8+1 as int)) as suggested, case (s.unit_id*s.step_no)%4 when 0 then 'high' when 1 then 'low' else 'medium' end as confidence from fx_steps s cross join (select 1 vote_no union all select 2 union all select 3 union all select 4) v",
        f"select s.unit_id, s.step_no, v.vote_no, (s.unit_id*3+s.step_no*v.vote_no+v.vote_no*v.vote_no)%5<2 as correct, list_extract([{_LABEL_LIST}], cast((s.unit_id+s.step_no+floor(v.vote_no/3))%8+1 as int)) as suggested, case (s.unit_id*s.step_no)%4 when 0 then 'high' when 1 then 'low' else 'medium' end as confidence from fx_steps s cross join (select 1 vote_no union all select 2 union all select 3 union all select 4) v",
    ),
    "fx_issues": ("select unit_id, step_no, cast(row_number() over (partition by unit_id order by step_no) as int) as ix, case when (unit_id+step_no)%3=0 then 'wrong_classification' else 'phrasing_too_long' end as kind, case (unit_id*5+step_no)%3 when 0 then 'critical' when 1 then 'warning' else 'nit' end as severity, case when step_no%2=0 then 'title' else 'label' end as field, concat('fix ',role) as new_value from fx_steps where (unit_id+step_no)%2=0", None),
    "fx_refs": ("select unit_id, line_no, pos, source_ref as full_ref, case pos%4 when 0 then source_ref when 1 then substr(source_ref,5) when 2 then substr(source_ref,6) else concat('x',substr(source_ref,1,5)) end as asked_ref from fx_links", None),
}


def _used(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "fx_windows":  # as its SQL, but a collection's units are numbered by many tasks
        docs = table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("unit_id"))
        units = numbered(docs.join(spark_view(spark, sf_dir, "fx_units"), "unit_id"), ["collection"], ["unit_id"], "rn")
        return units.selectExpr("collection", "cast(substr(collection, 4) as int) as coll_no", "unit_id", "n_lines", "cast(floor((rn - 1) / 5) as int) as window_no")
    sql = _VIEWS[name][0]
    inputs = {n: spark_view(spark, sf_dir, n) for n in _used(sql, (*TABLES, *_VIEWS)) if n != name}
    for n in inputs:
        sql = re.sub(rf"(from|join) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **inputs)


def sql_views(sql: str) -> str:
    """``sql`` with the derived views that it uses in front, as DuckDB common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _used(text, _VIEWS):
            if n not in needed:
                need(_VIEWS[n][1] or _VIEWS[n][0])
                needed.append(n)

    need(sql)
    views = ", ".join(f"{n} as ({_VIEWS[n][1] or _VIEWS[n][0]})" for n in needed)
    body = sql.strip()
    if not views:
        return body
    if re.match(r"with recursive\b", body, re.I):
        return f"with recursive {views}, {body[len('with recursive'):]}"
    if re.match(r"with\b", body, re.I):
        return f"with {views}, {body[len('with'):]}"
    return f"with {views} {body}"
