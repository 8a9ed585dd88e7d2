"""Interval operators over the lines of a unit: repair, split, move between windows and units, audit.

Lines are numbered from 1 and ranges include both ends. Every window is over one unit or one window of units.
Sequential repairs are written as running maxima, so they are one sort and one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glosswork.functions.text import bind


def by_unit():
    return Window.partitionBy("unit_id")


def running_end(order, reach: Column, rn: str = "rn") -> Column:
    """Ends of a chain in which each takes at least one line: end(i) = max(reach(i), end(i-1) + 1), from end(0) = 0."""
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.col(rn) + F.greatest(F.lit(0), F.max(reach - F.col(rn)).over(so_far))).cast("int")


def _numbered(df: DataFrame, *order: str):
    w = by_unit().orderBy(*order)
    return w, df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(by_unit()))


def repair_spans(spans: DataFrame, units: DataFrame, default_topic: str = "whole unit") -> DataFrame:
    """Order by start, push each start past the end before it, clip to the unit, end the last at the last line, renumber.

    A unit without spans gets one span over all its lines.
    """
    joined = units.select("unit_id", "n_lines").join(spans, "unit_id", "left")
    filled = joined.select(
        "unit_id", "n_lines",
        F.coalesce("span_no", F.lit(1)).alias("span_no"),
        F.coalesce("start_line", F.lit(1)).alias("s"),
        F.coalesce("end_line", "n_lines").alias("e"),
        F.coalesce("topic", F.lit(default_topic)).alias("topic"),
    )
    w, rows = _numbered(filled, "s", "span_no")
    reach = F.greatest("s", F.when(F.col("rn") == F.col("n"), F.col("n_lines")).otherwise(F.least("n_lines", "e")))
    ends = rows.withColumn("end_line", running_end(w, reach))
    start = F.greatest(F.lag("end_line", 1, 0).over(w) + 1, F.col("s"))
    return ends.select("unit_id", F.col("rn").cast("int").alias("span_no"), start.cast("int").alias("start_line"), "end_line", "topic")


def repair_step_ranges(steps: DataFrame, units: DataFrame) -> DataFrame:
    """Make ranges follow one another without gaps in the given order, clipped to the unit, the last ending with it."""
    w, rows = _numbered(steps.join(units.select("unit_id", "n_lines"), "unit_id"), "span_no")
    reach = F.greatest("end_line", "start_line", F.lit(1))
    u = rows.withColumn("u", running_end(w, reach))
    ends = u.withColumn("e", F.when(F.col("rn") == F.col("n"), F.col("n_lines")).otherwise(F.least("n_lines", "u")))
    start = F.least(F.greatest(F.lag("e", 1, 0).over(w) + 1, F.col("start_line"), F.lit(1)), F.col("e"))
    return ends.select("unit_id", "span_no", start.cast("int").alias("start_line"), F.col("e").cast("int").alias("end_line"))


def localise_to_global(local: DataFrame, spans: DataFrame) -> DataFrame:
    """Ranges (local_start, local_end) inside a span become lines of the unit, clipped to the span."""
    j = local.join(spans.select("unit_id", "span_no", "start_line", "end_line"), ["unit_id", "span_no"])
    off = F.col("start_line") - 1
    end = F.least(off + F.greatest("local_start", "local_end"), F.col("end_line"))
    start = F.least(off + F.greatest(F.lit(1), F.col("local_start")), end)
    return j.select("unit_id", "span_no", "step_no", start.cast("int").alias("first_line"), end.cast("int").alias("last_line"))


def drop_consecutive_duplicates(ranges: DataFrame) -> DataFrame:
    """Drop rows whose range equals that of the row before; number again only the units where a row was dropped."""
    w = by_unit().orderBy("step_no")
    before = F.lag(F.struct("first_line", "last_line")).over(w)
    marked = ranges.withColumn("dup", F.coalesce(before == F.struct("first_line", "last_line"), F.lit(False)))
    kept = marked.withColumn("dropped", F.max("dup").over(by_unit())).where("not dup")
    number = F.when(F.col("dropped"), F.row_number().over(w)).otherwise(F.col("step_no"))
    return kept.select("unit_id", number.cast("int").alias("step_no"), "first_line", "last_line")


def split_large_spans(spans: DataFrame, most_lines: int = 25) -> DataFrame:
    """Cut spans longer than ``most_lines`` into equal chunks; chunks keep the span's number and say which part they are."""
    size = F.col("end_line") - F.col("start_line") + 1
    cut = spans.withColumn("chunks", F.greatest(F.ceil(size / most_lines), F.lit(1)).cast("int"))
    cut = cut.withColumn("size", F.ceil(size / F.col("chunks")).cast("int"))
    parts = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    start = F.col("start_line") + F.col("part") * F.col("size")
    suffix = F.concat(F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("chunks").cast("string"), F.lit(")"))
    topic = F.when(F.col("chunks") > 1, F.concat("topic", suffix)).otherwise(F.col("topic"))
    end = F.least(start + F.col("size") - 1, F.col("end_line"))
    return parts.select("unit_id", "span_no", (F.col("part") + 1).alias("part"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), topic.alias("topic")).where("start_line <= end_line")


WINDOW = ["collection", "window_no"]


def concat_window(windows: DataFrame) -> DataFrame:
    """Give the units of a window one common line space: each unit's first and last line in it, and the window's name."""
    w = Window.partitionBy(*WINDOW).orderBy("unit_id")
    before = F.coalesce(F.sum("n_lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(*WINDOW)
    name = F.concat_ws("-", F.min("unit_id").over(whole), F.max("unit_id").over(whole))
    return windows.select(*WINDOW, "unit_id", (before + 1).cast("int").alias("unit_start"), (before + F.col("n_lines")).cast("int").alias("unit_end"), name.alias("window_ref"))


def owner_of_line(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """The unit of a window that holds a line of the window's line space; of several the first."""
    r = ranges.select(*WINDOW, F.col("unit_id").alias("owner"), "unit_start", "unit_end")
    j = lines.join(r, WINDOW).where("line between unit_start and unit_end")
    return j.groupBy(*WINDOW, "line").agg(F.min_by("owner", "unit_start").alias("owner"))


def split_spans_to_units(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Deal the spans of a window to the units they overlap, in the units' own lines; continuations say so."""
    r = ranges.select(*WINDOW, "unit_id", "unit_start", "unit_end")
    j = spans.join(r, WINDOW).where("not (end_line < unit_start or start_line > unit_end)")
    start = F.greatest("start_line", "unit_start") - F.col("unit_start") + 1
    end = F.least("end_line", "unit_end") - F.col("unit_start") + 1
    topic = F.concat(F.when(F.col("start_line") < F.col("unit_start"), "(continues) ").otherwise(""), "topic")
    gist = F.concat("gist", F.when(F.col("end_line") > F.col("unit_end"), " (continues on the next unit)").otherwise(""))
    return j.select(*WINDOW, "unit_id", "span_no", start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), topic.alias("topic"), gist.alias("gist"))


def assign_steps_to_units(steps: DataFrame, ranges: DataFrame) -> DataFrame:
    """A step belongs to the unit that holds its first line; steps are numbered again in each unit."""
    r = ranges.select(*WINDOW, "unit_id", "unit_start", "unit_end")
    j = steps.join(r, WINDOW).where("first_line between unit_start and unit_end")
    w = Window.partitionBy(*WINDOW, "unit_id").orderBy("step_no")
    end = F.least("last_line", "unit_end") - F.col("unit_start") + 1
    return j.select(*WINDOW, "unit_id", F.col("step_no").alias("window_step"), F.row_number().over(w).cast("int").alias("step_no"), (F.col("first_line") - F.col("unit_start") + 1).cast("int").alias("first_line"), end.cast("int").alias("last_line"))


def remap_dependencies(deps: DataFrame, numbering: DataFrame) -> DataFrame:
    """Dependencies in old step numbers become (unit, step) pairs in new numbers; those on missing steps are dropped."""
    keys = [c for c in WINDOW if c in deps.columns]
    new = numbering.select(*keys, "window_step", "unit_id", "step_no")
    of = new.select(*keys, F.col("window_step").alias("step"), F.col("unit_id").alias("from_unit"), F.col("step_no").alias("from_step"))
    on = new.select(*keys, F.col("window_step").alias("dep_step"), F.col("unit_id").alias("to_unit"), F.col("step_no").alias("to_step"))
    return deps.join(of, [*keys, "step"]).join(on, [*keys, "dep_step"]).select(*keys, "from_unit", "from_step", "to_unit", "to_step")


def span_step_bounds(spans: DataFrame, steps: DataFrame, overlap: bool = False) -> DataFrame:
    """First and last step of every span, null without one: those that start in it, or with ``overlap`` those that meet it."""
    s = steps.select("unit_id", "step_no", "first_line", "last_line")
    near = "first_line <= end_line and last_line >= start_line" if overlap else "first_line between start_line and end_line"
    j = spans.alias("p").join(s.alias("s"), (F.col("p.unit_id") == F.col("s.unit_id")) & F.expr(near), "left")
    return j.groupBy(F.col("p.unit_id").alias("unit_id"), "span_no").agg(F.min("step_no").alias("first_step"), F.max("step_no").alias("last_step"))


def steps_in_span(bounds: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps by group of the bounds; a unit none of whose groups has a step gets one group 0 of all steps."""
    s = steps.select("unit_id", "step_no")
    grouped = s.join(bounds.where("first_step is not null"), "unit_id").where("step_no between first_step and last_step").select("unit_id", "span_no", "step_no")
    rest = s.join(grouped.select("unit_id").distinct(), "unit_id", "left_anti").select("unit_id", F.lit(0).alias("span_no"), "step_no")
    return grouped.union(rest)


def orphan_steps(steps: DataFrame, spans: DataFrame) -> DataFrame:
    """Steps whose first line lies in no span."""
    p = spans.select(F.col("unit_id").alias("u"), "start_line", "end_line")
    return steps.join(p, (F.col("unit_id") == F.col("u")) & F.expr("first_line between start_line and end_line"), "left_anti")


def locate_start_lines(steps: DataFrame, lines: DataFrame, head: int = 60, short_head: int = 12, least: int = 10) -> DataFrame:
    """The line in which a step's text begins: its first ``head`` characters without white space, else its first
    ``short_head``, are searched in the unit's joined text; a needle shorter than ``least`` gives null.
    """
    flat = lines.select("unit_id", "line_no", _squeezed("text").alias("t"))
    sizes = lines.select("unit_id", "line_no", F.length(_squeezed("text")).alias("size"))  # before the shuffle, which leaves the texts behind
    whole = flat.groupBy("unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), "").alias("whole"))
    needles = steps.select("unit_id", "step_no", _squeezed("text").alias("n")).groupBy("unit_id").agg(F.collect_list(_needle(F.col("step_no"), F.col("n"), head, short_head)).alias("needles"))
    # one row a unit, so that its text is not copied to each of its steps
    asked = needles.join(whole, "unit_id", "left").select("unit_id", F.inline(F.transform("needles", lambda x: _placed(x, F.col("whole"), head, short_head, least))))
    none = lambda kind: F.lit(None).cast(kind)
    marks = sizes.select("unit_id", _before().alias("at"), F.lit(0).alias("asks"), F.col("line_no").cast("int").alias("line_no"), none(dict(steps.dtypes)["step_no"]).alias("step_no"))
    questions = asked.select("unit_id", F.col("at").cast("long").alias("at"), F.lit(1).alias("asks"), none("int").alias("line_no"), "step_no")
    return _lines_at(marks.union(questions))


def locate_in_units(units: DataFrame, head: int = 60, short_head: int = 12, least: int = 10) -> DataFrame:
    """As ``locate_start_lines``, for units whose ``steps`` and ``lines`` are arrays: a unit is searched in its own row, so no
    text is shuffled.
    """
    none = lambda kind: F.lit(None).cast(kind)
    flat = F.transform(F.array_sort("lines"), lambda x: F.struct(x["line_no"].alias("line_no"), _squeezed(x["text"]).alias("t")))
    needles = F.transform("steps", lambda x: bind(lambda n: _needle(x["step_no"], n, head, short_head), _squeezed(x["text"])))
    step_no = units.select(F.inline("steps")).schema["step_no"].dataType

    def marks(flat: Column, whole: Column, needles: Column) -> Column:
        lines = F.transform(flat, lambda x: F.struct(F.lit(0).alias("asks"), none("long").alias("at"), F.length(x["t"]).alias("size"), x["line_no"].cast("int").alias("line_no"), none(step_no).alias("step_no")))
        asked = F.transform(needles, lambda x: bind(lambda y: F.struct(F.lit(1).alias("asks"), y["at"].cast("long").alias("at"), none("int").alias("size"), none("int").alias("line_no"), y["step_no"].alias("step_no")), _placed(x, whole, head, short_head, least)))
        return F.when(needles.isNotNull(), F.concat(F.coalesce(lines, F.filter(asked, lambda x: F.lit(False))), asked))

    joined = bind(lambda flat, needles: bind(marks, flat, F.array_join(F.transform(flat, lambda x: x["t"]), ""), needles), flat, needles)
    rows = units.select("unit_id", F.inline(joined))
    return _lines_at(rows.withColumn("at", F.coalesce("at", F.when(F.col("asks") == 0, _before()))))


def _squeezed(text) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def _needle(step_no: Column, n: Column, head: int, short_head: int) -> Column:
    return F.struct(step_no.alias("step_no"), F.length(n).alias("size"), F.substring(n, 1, head).alias("long"), F.substring(n, 1, short_head).alias("short"))


def _placed(x: Column, whole: Column, head: int, short_head: int, least: int) -> Column:
    """Where a needle lies. The longer one begins with the shorter, so it is nowhere before it: both take one pass through the
    text. ``contains`` tells first, as it reads a text faster than ``instr`` and ``locate``.
    """
    there = lambda n, at: F.when(F.contains(whole, n), at)
    longer = lambda p: F.when(p > 0, there(x["long"], F.call_function("locate", x["long"], whole, p)))
    after = lambda p: bind(lambda p, q: F.when(q > 0, q).when(p > 0, p), p, longer(p))
    at = bind(after, there(x["short"], F.instr(whole, x["short"]))) if short_head < head else bind(lambda q: F.when(q > 0, q), there(x["long"], F.instr(whole, x["long"])))
    return F.struct(x["step_no"].alias("step_no"), F.when(x["size"] >= least, at).alias("at"))


def _before() -> Column:
    """The character at which a line begins in its unit's joined text, by the sizes of the lines before it."""
    before = by_unit().orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return (F.coalesce(F.sum("size").over(before), F.lit(0)) + 1).cast("long")


def _lines_at(marks: DataFrame) -> DataFrame:
    """For each row that ``asks`` (1, not 0) the last line that begins no later than ``at``; null where that is null."""
    order = by_unit().orderBy("at", "asks", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.when(F.col("at").isNotNull(), F.max("line_no").over(order))
    return marks.withColumn("found", last).where("asks = 1").select("unit_id", "step_no", F.col("found").alias("line_no"))


def proportional_bounds(spans: DataFrame, step_counts: DataFrame) -> DataFrame:
    """Deal n steps to spans in proportion to their lines: half-even rounded ends, each at least one step after the last."""
    size = spans.select("unit_id", "span_no", (F.col("end_line") - F.col("start_line") + 1).alias("size"))
    w, rows = _numbered(size.join(step_counts, "unit_id"), "span_no")
    acc = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("double")
    total = F.sum("size").over(by_unit()).cast("double")
    share = F.bround(acc / total * F.col("n_steps")).cast("int")
    rows = rows.withColumn("x", F.when(F.col("rn") == F.col("n"), F.col("n_steps")).otherwise(share))
    rows = rows.withColumn("last_step", running_end(w, F.col("x")))
    return rows.select("unit_id", "span_no", (F.lag("last_step", 1, 0).over(w) + 1).cast("int").alias("first_step"), "last_step")


def proportional_steps_floor(spans: DataFrame, step_counts: DataFrame) -> DataFrame:
    """Slices of the steps in proportion to the spans' lines, rounded down at both ends; the last span takes the rest."""
    size = spans.select("unit_id", "span_no", (F.col("end_line") - F.col("start_line") + 1).alias("size"))
    w, rows = _numbered(size.join(step_counts, "unit_id"), "span_no")
    acc = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("double")
    total = F.sum("size").over(by_unit()).cast("double")
    start = F.floor((acc - F.col("size")) / total * F.col("n_steps"))
    end = F.when(F.col("rn") == F.col("n"), F.col("n_steps")).otherwise(F.floor(acc / total * F.col("n_steps")))
    return rows.select("unit_id", "span_no", start.cast("int").alias("from_step"), end.cast("int").alias("to_step"))


def rebuild_bounds(located: DataFrame, spans: DataFrame, fallback: DataFrame, step_counts: DataFrame) -> DataFrame:
    """Bounds from located lines (first span that holds the line); spans without any take the proportional ones, whose
    steps past the last one become null.
    """
    p = spans.select(F.col("unit_id").alias("u"), "span_no", "start_line", "end_line")
    j = located.where("line_no is not null").join(p, (F.col("unit_id") == F.col("u")) & F.expr("line_no between start_line and end_line"))
    owner = j.groupBy("unit_id", "step_no").agg(F.min("span_no").alias("span_no"))
    own = owner.groupBy("unit_id", "span_no").agg(F.min("step_no").alias("f"), F.max("step_no").alias("l"))
    fb = fallback.join(step_counts, "unit_id").select("unit_id", "span_no", F.when(F.col("first_step") <= F.col("n_steps"), F.col("first_step")).alias("ff"), F.when(F.col("last_step") <= F.col("n_steps"), F.col("last_step")).alias("fl"))
    keys = ["unit_id", "span_no"]
    all_spans = spans.select(*keys).join(own, keys, "left").join(fb, keys, "left")
    return all_spans.select(*keys, F.coalesce("f", "ff").alias("first_step"), F.coalesce("l", "fl").alias("last_step"))


def span_sanity(spans: DataFrame, units: DataFrame) -> DataFrame:
    """One row for every fault of a span: starts after its end, starts before line 1, ends past the unit, and a gap or an
    overlap to the span after it.
    """
    w = by_unit().orderBy("start_line", "span_no")
    follow = spans.join(units.select("unit_id", "n_lines"), "unit_id").withColumn("next", F.lead("start_line").over(w))
    faults = [
        F.when(F.col("start_line") > F.col("end_line"), "reversed"),
        F.when(F.col("start_line") < 1, "before_first_line"),
        F.when(F.col("end_line") > F.col("n_lines"), "past_last_line"),
        F.when(F.col("next") > F.col("end_line") + 1, "gap"),
        F.when(F.col("next") <= F.col("end_line"), "overlap"),
    ]
    return follow.select("unit_id", "span_no", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def uncovered_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines that no span covers."""
    p = spans.select(F.col("unit_id").alias("u"), "start_line", "end_line")
    return lines.select("unit_id", "line_no").join(p, (F.col("unit_id") == F.col("u")) & F.expr("line_no between start_line and end_line"), "left_anti")


def unit_summary(spans: DataFrame, units: DataFrame, inherited: str = "no spans") -> DataFrame:
    """Topic and overview of a unit: one span's own; of several the first three topics and all gists, numbered."""
    parts = spans.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("span_no", "topic", "gist"))).alias("a"))
    many = F.size("a") > 1
    topics = F.array_join(F.transform(F.slice("a", 1, 3), lambda x: x["topic"]), " · ")
    gists = F.array_join(F.transform("a", lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x["gist"])), " ")
    j = units.select("unit_id").join(parts, "unit_id", "left")
    return j.select("unit_id", F.when(many, topics).otherwise(F.coalesce(F.col("a")[0]["topic"], F.lit(inherited))).alias("topic"), F.when(many, gists).otherwise(F.coalesce(F.col("a")[0]["gist"], F.lit(inherited))).alias("overview"))


def changed_only(recomputed: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the stored one, null-safely; rows without a stored one count as changed."""
    old = stored.select(*keys, F.col(value).alias("_old"))
    return recomputed.join(old, keys, "left").where(~F.col(value).eqNullSafe(F.col("_old"))).drop("_old")
