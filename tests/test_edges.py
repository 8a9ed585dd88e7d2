"""Nulls, blanks, pointed script, empty tables and restarts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import alignment, audit, links, spans, spine
from glosswork.sources import analyses
from glosswork.streaming import corrections


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_pointed_script(spark):
    t = F.col("t")
    assert one(spark, "בְּרֵאשִׁית", T.strip_points(t)) == "בראשית"
    assert one(spark, "בְּרֵאשִׁית", T.has_class(t, T.HEBREW_POINTS)) is True
    assert one(spark, "a<br/>b <i>c</i>  d", T.strip_markup(t)) == "a b c d"
    assert one(spark, None, T.strip_markup(t)) is None
    assert one(spark, "<b>שָׁלוֹם</b> abc, עוֹלָם", T.normalise_tokens(t)) == ["שלום", "עולם"]


def test_segments_of_every_shape(spark):
    t = F.col("t")
    assert one(spark, '"a"', T.flatten_segments(t)) == ["a"]
    assert one(spark, '["a", "b"]', T.flatten_segments(t)) == ["a", "b"]
    assert one(spark, '[["a"], ["b", "c"]]', T.flatten_segments(t)) == ["a", "b", "c"]
    assert one(spark, None, T.flatten_segments(t)) == []


def test_guards(spark):
    t = F.col("t")
    assert one(spark, " N/A ", T.blank_placeholders(t)) is None
    assert one(spark, "x" * 5, T.truncate_ellipsis(t, 3)) == "xxx…"
    long = " ".join(["w"] * 30)
    assert one(spark, long, T.length_guard(t, F.lit("old"), F.lit("a b"))) == " ".join(["w"] * 15) + "…"
    assert one(spark, " ", T.length_guard(t, F.lit("old"), F.lit("a b"))) == "old"
    assert one(spark, "Short one. " + long, T.length_guard(t, F.lit("old"), F.lit("a b"))) == "Short one."


def test_versions_fall_back_as_a_whole(spark):
    rows = [(1, 1, " ", "b", "c"), (1, 2, None, "", "c"), (2, 1, "", " ", ""), (2, 2, "", "", "")]
    df = spark.createDataFrame(rows, "unit_id long, line_no int, v1 string, v2 string, v3 string")
    got = [tuple(r) for r in alignment.merge_versions(df).orderBy("unit_id", "line_no").collect()]
    assert got == [(1, 1, "b"), (1, 2, "c"), (2, 1, ""), (2, 2, "")]


def test_empty_tables(spark):
    no_spans = spark.createDataFrame([], "unit_id long, span_no int, start_line int, end_line int, topic string")
    units = spark.createDataFrame([(7, 3)], "unit_id long, n_lines int")
    assert [tuple(r) for r in spans.repair_spans(no_spans, units).collect()] == [(7, 1, 1, 3, "whole unit")]
    assert spans.repair_step_ranges(no_spans, units).count() == 0
    assert audit.consensus(spark.createDataFrame([], "unit_id long, step_no int, vote_no int, correct boolean, suggested string, confidence string")).count() == 0
    assert spine.enumerate_units(spark.createDataFrame([("c", 0)], "collection string, n int")).count() == 0


def test_references_by_tier(spark):
    asked = spark.createDataFrame([(1, 1, 1, "ref A 1"), (1, 1, 2, "A 2"), (1, 1, 3, "2"), (1, 1, 4, "zzz")], "unit_id long, line_no int, ask_pos int, asked_ref string")
    full = spark.createDataFrame([(1, 1, 1, "ref A 1"), (1, 1, 2, "ref A 2")], "unit_id long, line_no int, cand_pos int, full_ref string")
    got = {r["ask_pos"]: (r["full_ref"], r["tier"]) for r in links.fuzzy_ref_lookup(asked, full, ["ref "]).collect()}
    assert got == {1: ("ref A 1", 1), 2: ("ref A 2", 2), 3: ("ref A 2", 3)}


def test_only_well_named_files_are_read(spark, tmp_path):
    own = '{"ref": "Some Name 12a", "spans": [], "steps": [{"stepNumber": 1, "keyTerms": [{"term": "t"}], "dependsOn": [2], "comments": {"first": [{"ref": "r", "phrases": [{"phraseNumber": 1}]}]}}]}'
    (tmp_path / "Some_Name_12a.json").write_text(own)
    (tmp_path / "Some_Name_12b.json").write_text('{"ref": ')
    (tmp_path / "Some_Name_13a.json").write_text('{"ref": "Some Name 13a", "steps": []}')
    (tmp_path / "_index.json").write_text('{"ref": "index"}')
    good, bad = analyses.read_analyses(spark, str(tmp_path) + "/[A-Z]*.json", keys={})
    assert [r["ref"] for r in good.collect()] == ["Some Name 12a"]
    assert {(r["file"], r["reason"]) for r in bad.collect()} == {("Some_Name_12b.json", "malformed"), ("Some_Name_13a.json", "no spans")}
    tables = {n: t.count() for n, t in analyses.explode_analyses(good).items()}
    assert tables == {"units": 1, "spans": 0, "steps": 1, "phrases": 0, "terms": 1, "comments": 1, "comment_phrases": 1, "dependencies": 1}


# a document in the published shape, with every kind of part
PUBLISHED_DOCUMENT = {
    "ref": "Some Name 12b", "masechet": "Some_Name", "daf": 12, "amud": "b", "mainTopic": "topic", "overview": "about",
    "sugyaBoundaries": [{"sugyaNumber": 1, "startLine": 1, "endLine": 3, "topic": "t", "gist": "g", "openingFormula": "o", "firstStepNumber": 1, "lastStepNumber": 2}],
    "steps": [
        {
            "stepNumber": 1, "hebrewStepName": "קושיא", "title": "first", "stepSummary": "s", "whatsHappening": "w", "deeperAnalysis": "d",
            "keyTerms": [{"term": "a", "meaning": "b"}, {"term": "c", "meaning": "d"}], "whatToRemember": "r", "whyThisMatters": "m",
            "phrases": [{"phraseNumber": 1, "aramaic": "x", "english": "y"}, {"phraseNumber": 2, "aramaic": "z", "english": "q", "notes": "n"}],
            "classificationConfidence": "High", "branchRole": "opens_new_branch", "dependsOnStepNumbers": [], "kashyaTarget": "k",
            "meforshim": {
                "rashi": [{"source": "R", "ref": "R 1", "hebrew": "h", "takeaway": "t", "phrases": [{"phraseNumber": 1, "aramaic": "x", "english": "y"}]}],
                "tosafot": [], "rishonim": [{"source": "Q", "ref": "Q 1", "hebrew": "h", "english": "e", "takeaway": "u"}], "acharonim": [], "interplaySummary": "both",
            },
        },
        {"stepNumber": 2, "hebrewStepName": "תירוץ", "title": "second", "stepSummary": "s", "whatsHappening": "w", "deeperAnalysis": "d", "keyTerms": [], "phrases": [{"phraseNumber": 1, "aramaic": "x", "english": "y"}], "dependsOnStepNumbers": [1]},
    ],
    "pipelineVersion": "1", "generatedAt": "2026-01-01", "modelsUsed": {"structure": "m"}, "cost": {"totalUSD": 0.5, "totalInputTokens": 5, "totalOutputTokens": 6, "byPass": {"structure": 0.5}},
}


def without_empty(value):
    if isinstance(value, dict):
        return {k: v for k, v in ((k, without_empty(v)) for k, v in value.items()) if v not in (None, [], {})}
    return [without_empty(v) for v in value] if isinstance(value, list) else value


def test_published_documents_come_back_whole(spark, tmp_path):
    (tmp_path / "Some_Name_12b.json").write_text(json.dumps(PUBLISHED_DOCUMENT, ensure_ascii=False, indent=2))
    good, bad = analyses.read_analyses(spark, str(tmp_path))
    assert bad.count() == 0
    tables = analyses.explode_analyses(good)
    assert tables["steps"].where("stepNumber = 1").first()["what"] == "w"
    assert [(r["bucket"], r["commentRef"]) for r in tables["comments"].orderBy("bucket").collect()] == [("first", "R 1"), ("third", "Q 1")]
    again = json.loads(analyses.as_documents(analyses.assemble_analyses(tables)).first()["value"])
    assert without_empty(again) == without_empty(PUBLISHED_DOCUMENT)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    steps = spark.createDataFrame([(1, 1, "t", "l")], "unit_id long, step_no int, title string, label string")
    args = (spark, str(tmp_path / "in"), steps, str(tmp_path / "log"), str(tmp_path / "cp"))
    record = lambda seq, value: spark.createDataFrame([(seq, f"2024-01-0{seq}", 1, 1, "title", value)], corrections.RECORD)
    record(1, "a").write.mode("append").json(args[1])
    assert corrections.correction_stream(*args).count() == 1
    record(2, "b").write.mode("append").json(args[1])
    log = corrections.correction_stream(*args)
    assert log.count() == 2
    assert corrections.snapshot(steps, log).first()["title"] == "b"
    assert corrections.correction_stream(*args).count() == 2
