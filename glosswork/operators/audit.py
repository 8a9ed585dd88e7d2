"""Audits of labelled steps: rules, sequences, verdicts, issues, quality scores, comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glosswork.functions.text import HEBREW_POINTS, bind, coverage_ratio, normalise_tokens, snippet, strip_points

KEYS = ["unit_id", "step_no"]


def rule_text(source: Column, points: str = HEBREW_POINTS) -> Column:
    """A text as rules see it: lower-cased, without points, trimmed; blank is null."""
    bare = F.regexp_replace(strip_points(F.lower(source), points), r"^\s+|\s+$", "")
    return F.when(bare != "", bare)


def _first_match(rules: DataFrame, sources: list[Column], wanted) -> Column:
    """struct(expected, rule_ix, rule_name, matched_text) of the first rule, by text then rule, that matches a text and is ``wanted``; else null.

    Rules (rule_ix, pattern, expected, and name if they have one) are tens of rows written by people. One alternation of
    all patterns sends most texts away; for the others each rule is one branch with a literal pattern, which is compiled
    once, and a step's texts are searched only as far as the first hit. Each text is made ready once.
    """
    listed = rules.orderBy("rule_ix").collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 rules")
    named = "name" in rules.columns
    any_of = "|".join(f"(?:{r['pattern']})" for r in listed) or "(?!)"

    def found(text: Column) -> Column:
        chain = F.when(F.lit(False), None)
        for r in listed:
            values = (("expected", r["expected"]), ("rule_ix", r["rule_ix"]), ("rule_name", r["name"] if named else None))
            hit = F.struct(*[F.lit(v).cast("int" if n == "rule_ix" else "string").alias(n) for n, v in values], F.substring(text, 1, 80).alias("matched_text"))
            chain = chain.when(wanted(r["expected"]) & text.rlike(r["pattern"]), hit)
        return F.when(text.rlike(any_of), chain)

    return F.coalesce(*[bind(found, s) for s in sources])


def source_rule_override(steps: DataFrame, rules: DataFrame, sources: list[str], points: str = HEBREW_POINTS) -> DataFrame:
    """New labels by rules (rule_ix, pattern, expected, name): the first rule, by text then rule, that matches and disagrees
    wins. Texts are searched without points; the log has the rule and the first 80 characters of the text it matched.
    """
    disagrees = lambda expected: F.lit(False) if expected is None else ~F.col("label").eqNullSafe(F.lit(expected))
    hit = steps.select(*KEYS, "label", _first_match(rules, [rule_text(F.col(c), points) for c in sources], disagrees).alias("hit"))
    return hit.select(*KEYS, F.col("label").alias("old_label"), F.coalesce("hit.expected", "label").alias("label"), "hit.rule_ix", "hit.rule_name", "hit.matched_text")


def pattern_audit(steps: DataFrame, rules: DataFrame, sources: list[str], points: str = HEBREW_POINTS, first_text: bool = False) -> DataFrame:
    """Findings by the first rule that matches at all: REVIEW if it expects no label, MISMATCH if it expects another.

    With ``first_text`` only the first text that is not blank is searched. Texts are searched without points.
    """
    texts = [rule_text(F.col(c), points) for c in sources]
    hit = _first_match(rules, [F.coalesce(*texts)] if first_text else texts, lambda _: F.lit(True))
    first = steps.select(*KEYS, "label", hit.alias("hit")).where("hit is not null").select(*KEYS, "label", "hit.expected", "hit.rule_name")
    finding = F.when(F.col("expected").isNull(), "REVIEW").when(~F.col("expected").eqNullSafe(F.col("label")), "MISMATCH")
    return first.select(*KEYS, "label", "expected", "rule_name", finding.alias("finding")).where("finding is not null")


def sequence_audit(steps: DataFrame, after: str, unexpected: list[str]) -> DataFrame:
    """Steps whose label should not follow a step of the label ``after``."""
    w = Window.partitionBy("unit_id").orderBy("step_no")
    return steps.select(*KEYS, "label", F.lag("label").over(w).alias("previous")).where((F.col("previous") == after) & F.col("label").isin(unexpected))


def audit_report(steps: DataFrame, flagged: DataFrame) -> DataFrame:
    """Steps, flagged steps and their percentage per unit with any, and over all (unit_id null)."""
    f = flagged.select(*KEYS).distinct().withColumn("flag", F.lit(1))
    g = steps.select(*KEYS).join(f, KEYS, "left").rollup("unit_id").agg(F.count(F.lit(1)).alias("steps"), F.count("flag").alias("flagged"), F.grouping_id().alias("level"))
    return g.where("level = 1 or flagged > 0").select("unit_id", "steps", "flagged", F.round(F.col("flagged") * 100 / F.col("steps"), 6).alias("pct"))


def neighbour_context(steps: DataFrame, chars: int = 300) -> DataFrame:
    """Each step's excerpt with the labels and excerpts of its neighbours."""
    w = Window.partitionBy("unit_id").orderBy("step_no")
    cut = F.substring("text", 1, chars)
    return steps.select(*KEYS, cut.alias("excerpt"), F.lag("label").over(w).alias("prev_label"), F.lag(cut).over(w).alias("prev_text"), F.lead("label").over(w).alias("next_label"), F.lead(cut).over(w).alias("next_text"))


def consensus(verdicts: DataFrame, tie_vote: int = 4) -> DataFrame:
    """Decide each step by its verdicts (vote_no, correct, suggested, confidence); adds decision and new_label.

    The first verdict's disagreement applies at once if it is highly confident. Else, if it disagrees, the first three
    votes decide: the top suggestion of those that disagree applies with two votes, if at most one vote says correct (of
    equals the one seen first). Else the tie-breaker's disagreement applies. Without a first verdict all stays.
    """
    vote = F.struct("correct", "suggested", "confidence")
    first = F.max(F.when(F.col("vote_no") == 1, vote)).alias("v1")
    tie = F.max(F.when(F.col("vote_no") == tie_vote, vote)).alias("tie")
    agree = F.count(F.when((F.col("vote_no") < tie_vote) & F.col("correct"), 1)).alias("agree")
    g = verdicts.groupBy(*KEYS).agg(first, tie, agree)
    said = verdicts.where((F.col("vote_no") < tie_vote) & ~F.col("correct")).groupBy(*KEYS, "suggested").agg(F.count(F.lit(1)).alias("n"), F.min("vote_no").alias("seen"))
    top = said.groupBy(*KEYS).agg(F.max(F.struct("n", (-F.col("seen")).alias("order"), "suggested")).alias("top"))
    j = g.join(top, KEYS, "left")
    disagrees = F.col("v1").isNotNull() & ~F.col("v1.correct")
    decision = (
        F.when(disagrees & (F.col("v1.confidence") == "high"), "first")
        .when(disagrees & (F.col("top.n") >= 2) & (F.col("agree") <= 1), "majority")
        .when(disagrees & F.col("tie").isNotNull() & ~F.col("tie.correct"), "tie_breaker")
        .otherwise("keep")
    )
    j = j.withColumn("decision", decision)
    label = F.when(F.col("decision") == "first", F.col("v1.suggested")).when(F.col("decision") == "majority", F.col("top.suggested")).when(F.col("decision") == "tie_breaker", F.col("tie.suggested"))
    return j.select(*KEYS, "decision", label.alias("new_label"))


def apply_high_confidence(steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Labels after one sweep: a highly confident first verdict that disagrees replaces the label."""
    v = verdicts.where("vote_no = 1 and not correct and confidence = 'high'").select(*KEYS, "suggested")
    return steps.select(*KEYS, "label").join(v, KEYS, "left").select(*KEYS, F.coalesce("suggested", "label").alias("label"))


def patch_status(issues: DataFrame, labels: list[str], fields: list[str]) -> DataFrame:
    """What each issue would change: the label, for wrong classifications of a severity above nit with a known label, else a
    listed field; the rest is skipped.
    """
    to_label = (F.col("kind") == "wrong_classification") & F.col("new_value").isin(labels) & (F.col("severity") != "nit")
    target = F.when(to_label, F.lit("label")).when(F.col("field").isin(fields), F.col("field"))
    return issues.withColumn("target", target).withColumn("status", F.when(target.isNull(), "skipped").otherwise("applied"))


def auto_patch(steps: DataFrame, issues: DataFrame, fields: list[str]) -> DataFrame:
    """Apply the issues of status applied in order; the last write to a field wins."""
    keys = KEYS
    last = issues.where("status = 'applied'").groupBy(*keys, "target").agg(F.max_by("new_value", "ix").alias("value"))
    wide = last.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    j = steps.join(wide, keys, "left")
    return j.select(*keys, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues by severity and the unit's assessment."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    g = issues.groupBy("unit_id").agg(n("critical"), n("warning"), n("nit"))
    return g.withColumn("assessment", F.when(F.col("critical") > 0, "needs_work").when(F.col("warning") > 0, "good").otherwise("excellent"))


def schema_check(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each broken rule: (unit_id, step_no, message)."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), message) for message, bad in rules.items()]))
    return rows.select(*KEYS, F.explode(broken).alias("message"))


def first_messages(rows: DataFrame, rules: dict[str, Column], most: int = 3) -> DataFrame:
    """Per unit the first messages of its broken rules, by step and then in the order of the rules, and how many there are."""
    broken = F.array(*[F.when(F.coalesce(bad, F.lit(True)), message) for message, bad in rules.items()])
    long = rows.select(*KEYS, F.posexplode(broken).alias("rule", "message")).where("message is not null")
    w = Window.partitionBy("unit_id").orderBy("step_no", "rule")
    first = long.withColumn("k", F.row_number().over(w))
    listed = F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", F.concat_ws(": ", "step_no", "message").alias("m")))))
    return first.groupBy("unit_id").agg(F.array_join(F.transform(listed, lambda x: x["m"]), "; ").alias("messages"), F.count(F.lit(1)).alias("broken"))


def _units_without(units: DataFrame, parts: DataFrame, fault: str) -> DataFrame:
    return units.select("unit_id").join(parts.select("unit_id"), "unit_id", "left_anti").select("unit_id", F.lit(fault).alias("fault"))


def content_checks(units: DataFrame, steps: DataFrame, spans: DataFrame, phrases: DataFrame, terms: DataFrame, points: str) -> DataFrame:
    """Faults of a unit's content: no spans, steps without phrases, terms without any of the points."""
    bare_steps = steps.select(*KEYS).join(phrases.select(*KEYS), KEYS, "left_anti").select("unit_id", F.lit("no_phrases").alias("fault"))
    bare_terms = terms.where(~F.col("term").rlike(points)).select("unit_id", F.lit("terms_without_points").alias("fault"))
    return _units_without(units, spans, "no_spans").union(bare_steps.union(bare_terms).distinct())


def structure_checks(units: DataFrame, steps: DataFrame) -> DataFrame:
    """Faults of a unit's structure: no steps, a short topic, a short overview, steps with short titles."""
    g = steps.groupBy("unit_id").agg(F.count(F.lit(1)).alias("steps"), F.count(F.when(F.length("title") < 3, 1)).alias("short_titles"))
    j = units.join(g, "unit_id", "left")
    faults = [
        F.when(F.coalesce("steps", F.lit(0)) == 0, "no_steps"),
        F.when(F.length("topic") < 10, "short_topic"),
        F.when(F.length("overview") < 30, "short_overview"),
        F.when(F.col("short_titles") > 0, "short_titles"),
    ]
    return j.select("unit_id", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


PENALTIES = {"critical": 25, "warning": 7, "nit": 2}


def quality_score(issues: DataFrame) -> DataFrame:
    """100 less the penalties, not below 0; a unit passes without critical issues."""
    penalty = reduce(lambda c, kv: c.when(F.col("severity") == kv[0], kv[1]), PENALTIES.items(), F.when(F.lit(False), 0)).otherwise(0)
    return issues.groupBy("unit_id").agg(F.greatest(F.lit(0).cast("bigint"), 100 - F.sum(penalty)).alias("score"), (F.count(F.when(F.col("severity") == "critical", 1)) == 0).alias("passed"))


def unit_metrics(steps: DataFrame) -> DataFrame:
    """Per unit: steps, label histogram (label=count, by label), mean text length, roles, words a step."""
    counts = steps.groupBy("unit_id", "label").agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", "n"))), ",").alias("labels"))
    g = steps.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
        F.count_distinct("role").alias("roles"),
        F.round(F.sum(F.size(F.split("text", " "))) / F.count(F.lit(1)), 6).alias("words_per_step"),
    )
    return g.join(histogram, "unit_id")


def analysis_metrics(tables: dict[str, DataFrame], sources: DataFrame, points: str = HEBREW_POINTS, sure: str = "High", lookahead: int = 20) -> DataFrame:
    """The seventeen metrics of every unit (ref) of exploded analyses, and its label histogram as a map.

    ``sources`` (ref, text) are the units' whole texts, for the share of their tokens that the phrases cover in order. A
    unit without steps has zeros; means are over the steps, one at least. Null confidences count as sure.
    """
    keys = ["ref", "stepNumber"]
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    chars = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(f"{c}_chars")
    steps = tables["steps"].groupBy("ref").agg(F.count(F.lit(1)).alias("steps"), chars("what"), chars("deeper"), n(F.col("confidence") != sure, "unsure_steps"))
    labels = tables["steps"].groupBy("ref", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("ref").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    phrases = tables["phrases"].groupBy("ref").agg(F.count(F.lit(1)).alias("phrases"), F.sum(F.length("source") + 1).alias("phrase_chars"), F.array_sort(F.collect_list(F.struct(*keys[1:], "phraseNumber", "source"))).alias("said"))
    bare = F.trim(F.regexp_replace("term", points, ""))
    terms = tables["terms"].groupBy("ref").agg(F.count(F.lit(1)).alias("terms"), F.count_distinct(bare).alias("unique_terms"), n(F.col("term").rlike(points), "terms_with_points"))
    comments = tables["comments"].groupBy("ref").agg(F.count(F.lit(1)).alias("comments"), F.count_distinct("stepNumber").alias("steps_with_comments"))
    spans = tables["spans"].select("ref").distinct().withColumn("has_spans", F.lit(True))
    j = sources.select("ref", "text")
    for part in (steps, labels, phrases, terms, comments, spans):
        j = j.join(part, "ref", "left")
    counted = ["steps", "what_chars", "deeper_chars", "unsure_steps", "phrases", "phrase_chars", "terms", "unique_terms", "terms_with_points", "comments", "steps_with_comments"]
    j = j.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counted})
    j = j.withColumn("_source", normalise_tokens(F.col("text"), dropped="^$", points=points))
    said = F.array_join(F.transform("said", lambda x: x["source"]), " ")
    j = j.withColumn("_generated", F.coalesce(normalise_tokens(said, dropped="^$", points=points), F.array().cast("array<string>")))
    a_step = lambda c: F.round(F.col(c) / F.greatest("steps", F.lit(1)), 6)
    return j.select(
        "ref", "steps", "labels", "phrases", a_step("phrases").alias("phrases_per_step"), "terms", "unique_terms", (F.col("terms") - F.col("unique_terms")).alias("redundant_terms"),
        "terms_with_points", (F.col("terms") - F.col("terms_with_points")).alias("terms_without_points"), a_step("what_chars").alias("what_chars_per_step"),
        a_step("deeper_chars").alias("deeper_chars_per_step"), "phrase_chars", F.round(coverage_ratio(F.col("_source"), F.col("_generated"), lookahead), 9).alias("coverage"),
        "steps_with_comments", "comments", F.coalesce("has_spans", F.lit(False)).alias("has_spans"), "unsure_steps",
    )


def compare_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, count_a, count_b, delta) over the union of the labels of two step tables; a missing label counts 0."""
    count = lambda df, name: df.groupBy("label").agg(F.count(F.lit(1)).alias(name))
    j = count(a, "count_a").join(count(b, "count_b"), "label", "full").na.fill(0, ["count_a", "count_b"])
    return j.withColumn("delta", F.col("count_b") - F.col("count_a"))


def compare_runs(a: DataFrame, b: DataFrame, higher_is_better: list[str]) -> DataFrame:
    """(metric, value_a, value_b, delta, improved) of two metric tables (metric, value); a missing metric counts 0."""
    j = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), "metric", "full")
    j = j.select("metric", F.coalesce("value_a", F.lit(0.0)).alias("value_a"), F.coalesce("value_b", F.lit(0.0)).alias("value_b"))
    delta = F.round(F.col("value_b") - F.col("value_a"), 6)
    better = F.when(F.col("metric").isin(higher_is_better), delta > 0).otherwise(delta < 0)
    return j.select("metric", F.round("value_a", 6).alias("value_a"), F.round("value_b", 6).alias("value_b"), delta.alias("delta"), better.alias("improved"))


def dependency_edges(deps: DataFrame, steps: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Every dependency with its finding: dangling, not earlier, or of a label that the step's label may not depend on."""
    s = steps.select(*KEYS, "label")
    j = deps.join(s, KEYS).join(s.select("unit_id", F.col("step_no").alias("dep_step"), F.col("label").alias("dep_label")), ["unit_id", "dep_step"], "left")
    want = F.element_at(F.create_map(*[F.lit(x) for pair in needed.items() for x in pair]), F.col("label"))
    finding = F.when(F.col("dep_label").isNull(), "dangling").when(F.col("dep_step") >= F.col("step_no"), "not_earlier").when(want.isNotNull() & (want != F.col("dep_label")), "wrong_label").otherwise("ok")
    return j.select(*KEYS, "dep_step", "label", "dep_label", finding.alias("finding"))


def branch_depth(steps: DataFrame) -> DataFrame:
    """Depth of the argument after each step: one more when a branch opens, one less, not below 0, when it returns, 0 at its
    conclusion. The clipping is a running minimum of the prefix sums since the last conclusion.
    """
    w = Window.partitionBy("unit_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    role = F.col("branch_role")
    move = F.when(role == "opens_new_branch", 1).when(role == "returns_to_previous_branch", -1).otherwise(0)
    seg = steps.withColumn("seg", F.sum((role == "conclusion_of_branch").cast("int")).over(w)).withColumn("move", move)
    ws = Window.partitionBy("unit_id", "seg").orderBy("step_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = seg.withColumn("p", F.sum("move").over(ws))
    return p.select(*KEYS, (F.col("p") - F.least(F.lit(0), F.min("p").over(ws))).cast("int").alias("depth"))


def search(fields: DataFrame, needle: str, k: int = 50, context: int = 50) -> DataFrame:
    """The k best hits of (doc_id, field, ordinal, weight, text), case-insensitive: by weight, then document and ordinal."""
    hits = fields.where(F.contains(F.lower("text"), F.lit(needle.lower())))
    top = hits.orderBy(F.desc("weight"), "doc_id", "ordinal").limit(k)
    return top.select("doc_id", "field", "ordinal", "weight", snippet(F.col("text"), needle, context).alias("snippet"))


# The weights of the fields that a search looks through.
FIELD_WEIGHTS = {"mainTopic": 10, "title": 8, "summary": 5, "what": 5, "deeper": 5, "term": 7, "source phrase": 6, "translated phrase": 4, "takeaway": 6}


def search_fields(tables: dict[str, DataFrame]) -> DataFrame:
    """The nine searched fields of exploded analyses, one row each: (ref, step_no, kind, pos, field, weight, loose, exact,
    lead, whole).

    ``loose`` is searched whatever the case, ``exact`` as it is; a snippet has ``lead`` in front or, if ``whole``, is all of
    exact and loose. step_no, kind and pos give the order within a document.
    """
    rows = []

    def add(name: str, kind: int, df: DataFrame, loose: str | None, exact: str | None = None, lead: Column | None = None, whole: bool = False, pos: str = "0", step: str = "stepNumber") -> None:
        text = lambda c: F.lit(None).cast("string") if c is None else F.col(c)
        front = F.lit("") if lead is None else lead
        head = [F.col("ref"), F.expr(step).cast("int").alias("step_no"), F.lit(kind).alias("kind"), F.expr(pos).cast("int").alias("pos")]
        rows.append(df.select(*head, F.lit(name).alias("field"), F.lit(FIELD_WEIGHTS[name]).alias("weight"), text(loose).alias("loose"), text(exact).alias("exact"), front.alias("lead"), F.lit(whole).alias("whole")))

    add("mainTopic", 0, tables["units"], "mainTopic", step="0")
    for kind, name in enumerate(("title", "summary", "what", "deeper"), 1):
        add(name, kind, tables["steps"], name)
    add("term", 5, tables["terms"], "meaning", "term", whole=True, pos="pos")
    add("source phrase", 6, tables["phrases"], None, "source", pos="2 * phraseNumber")
    add("translated phrase", 6, tables["phrases"], "translation", pos="2 * phraseNumber + 1")
    buckets = F.array_position(F.array(*[F.lit(b) for b in ("first", "second", "third", "other")]), F.col("bucket"))
    placed = tables["comments"].withColumn("_pos", buckets * 1_000_000 + F.col("pos"))
    add("takeaway", 7, placed, "takeaway", lead=F.concat("source", F.lit(": ")), pos="_pos")
    return reduce(DataFrame.union, rows)


def search_analyses(fields: DataFrame, needle: str, k: int = 50, context: int = 50) -> DataFrame:
    """The k best hits of ``search_fields``: by weight, then document, step and place in it. A blank needle has none."""
    needle = needle.strip()
    found = F.contains(F.lower("loose"), F.lit(needle.lower()))
    hit = F.coalesce(found, F.lit(False)) | F.coalesce(F.contains("exact", F.lit(needle)), F.lit(False))
    top = fields.where(hit & F.lit(bool(needle))).orderBy(F.desc("weight"), "ref", "step_no", "kind", "pos").limit(k)
    around = F.concat("lead", snippet(F.coalesce("loose", "exact"), needle or " ", context))
    shown = F.when(F.col("whole"), F.concat_ws(" — ", "exact", "loose")).otherwise(around)
    return top.select("ref", "step_no", "kind", "pos", "field", "weight", shown.alias("snippet"))


def logic_facets(steps: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(unit_id, step_no, facet, value) of the facets that are not null."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value")) for name, value in facets.items()])
    long = steps.select(*KEYS, F.explode(pairs).alias("p"))
    return long.select(*KEYS, "p.facet", "p.value").where("value is not null")
