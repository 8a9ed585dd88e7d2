"""Views that follow changed keys, files of units, the trigram index, streams of progress, and the ingestion of answers."""

from __future__ import annotations

import json
import os
import random
import re
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import alignment, audit as A, gram_index, links as L, spans as S
from glosswork.operators.gram_index import GramIndex
from glosswork.sources import analyses as R
from glosswork.sources.scratch import fixed
from glosswork.sources.unit_files import UnitFilesReader, read_unit_files, write_unit_files
from glosswork.streaming import progress as P
from glosswork.streaming.corrections import run_available
from glosswork.streaming.stages import StagedRun
from glosswork.streaming.views import INPUT, Stage, Views

ROW = "k long, id long, sent int, v long"


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def two_stages(spark, root, seen):
    def sums(tables):
        made = tables[INPUT].groupBy("k").agg(F.sum("v").alias("total"))
        seen.append(("sums", sorted(r[0] for r in made.select("k").collect())))
        return made

    def signs(tables):
        made = tables["sums"].select("k", F.signum("total").cast("int").alias("sign"))
        seen.append(("signs", sorted(r[0] for r in made.select("k").collect())))
        return made

    return Views(spark, root, "k", [Stage("sums", (INPUT,), sums), Stage("signs", ("sums",), signs)], identity=("k", "id"), version="sent", buckets=5)


def test_only_changed_keys_pass_from_stage_to_stage(spark, tmp_path):
    seen, rng, known = [], random.Random(3), {}
    views = two_stages(spark, str(tmp_path / "v"), seen)
    for number in range(5):
        batch = [(rng.randrange(9), rng.randrange(4), rng.randrange(6), rng.randrange(-5, 6)) for _ in range(8)] if number != 3 else []
        batch = list({(k, i, s): (k, i, s, v) for k, i, s, v in batch}.values()) + ([(None, 1, 1, 1)] if number == 1 else [])
        for k, i, s, v in batch:
            if k is not None and s > known.get((k, i), (-1,))[0]:
                known[k, i] = (s, v)
        batch = [r for r in batch if r[0] is None or known[r[0], r[1]][0] > r[2] or known[r[0], r[1]] == (r[2], r[3])]
        views.apply(spark.createDataFrame(batch, ROW), number)
        sums = {}
        for (k, _), (_, v) in known.items():
            sums[k] = sums.get(k, 0) + v
        assert rows_of(views.table("sums"), "k", "total") == sorted(sums.items(), key=repr)
        assert rows_of(views.table("signs"), "k", "sign") == sorted(((k, (v > 0) - (v < 0)) for k, v in sums.items()), key=repr)
    before, calls = rows_of(views.table("sums"), "k", "total"), len(seen)
    views.apply(spark.createDataFrame([(1, 1, 99, 1000)], ROW), 2)  # a batch that is replayed
    assert rows_of(views.table("sums"), "k", "total") == before and len(seen) == calls
    one = known[next(iter(known))]
    key = next(iter(known))
    views.apply(spark.createDataFrame([(*key, 98, one[1])], ROW), 10)  # the same value in a newer row: its sum does not change
    assert seen[calls:] == [("sums", [key[0]])]
    assert sorted(os.listdir(tmp_path / "v" / "pointers"))[-1].startswith(".") or len([n for n in os.listdir(tmp_path / "v" / "pointers") if n.endswith(".json") and n[0] != "."]) == 2


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    views = two_stages(spark, str(tmp_path / "v"), [])
    views.apply(spark.createDataFrame([(k, 0, 0, 1) for k in range(40)], ROW), 0)
    bucket = spark.createDataFrame([(7,)], "k long").select(F.pmod(F.xxhash64("k"), F.lit(5))).first()[0]
    for table in (INPUT, "sums", "signs"):
        for other in range(5):
            if other != bucket:
                for name in os.listdir(tmp_path / "v" / "data" / table / "batch=0" / f"bucket={other}"):
                    os.remove(tmp_path / "v" / "data" / table / "batch=0" / f"bucket={other}" / name)
    views.apply(spark.createDataFrame([(7, 1, 0, 4)], ROW), 1)
    assert (7, 5) in rows_of(views.table("sums").where("k = 7"), "k", "total")


def units(spark, n=6, extra=()):
    rows = [(f"Unit {i}", "Col", i, "a" if i % 2 else None, [], []) for i in range(n)]
    kind = f"ref string, collection string, unitNo int, side string, spans array<{R.SPAN}>, steps array<{R.STEP}>"
    return spark.createDataFrame([*rows, *extra], kind)


def test_a_unit_is_one_file_that_is_opened_alone(spark, tmp_path):
    folder = str(tmp_path / "units")
    write_unit_files(units(spark).repartition(3), folder)
    assert sorted(os.listdir(folder)) == [f"Col_{i}a.json" for i in range(6)]
    good, bad = read_unit_files(spark, folder)
    assert rows_of(good, "ref", "unitNo") == sorted(((f"Unit {i}", i) for i in range(6)), key=repr) and bad.count() == 0
    (tmp_path / "units" / "Col_1a.json").write_text("{")
    (tmp_path / "units" / "Col_2a.review.json").write_text("{}")
    good, bad = read_unit_files(spark, folder)
    assert good.count() == 5 and [r.reason for r in bad.collect()] == ["malformed"]
    for i in (0, 1, 2, 3, 5):
        os.chmod(tmp_path / "units" / f"Col_{i}a.json", 0)
    assert [p.names for p in UnitFilesReader({"path": folder, "names": "Col_4a.json"}).partitions()] == [("Col_4a.json",)]
    assert rows_of(read_unit_files(spark, folder, ["Col_4a.json", "Col_99a.json"])[0], "ref") == [("Unit 4",)]
    assert read_unit_files(spark, folder, [])[0].count() == 0


def test_no_file_stays_of_a_write_that_fails(spark, tmp_path):
    folder = str(tmp_path / "units")
    failing = units(spark, 40).repartition(4).withColumn("ref", F.when(F.col("unitNo") == 17, F.raise_error(F.lit("lost"))).otherwise(F.col("ref")))
    with pytest.raises(Exception, match="lost"):
        write_unit_files(failing, folder)
    files = lambda: [n for n in os.listdir(folder) if not n.startswith("_job-")] if os.path.exists(folder) else []  # noqa: E731  # a task may outlive its job
    assert files() == []
    with pytest.raises(Exception, match="several documents"):
        write_unit_files(units(spark, 3, [("again", "Col", 1, "a", [], [])]), folder)
    assert files() == []


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(11)
    letters = "abΣσςİé😀 -xX"
    texts = [None, "", "a", "ab", "😀", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(150))]
    fields = spark.createDataFrame([(f"r{i}", 0, 0, 0, "title", 1, t, (t or "")[::-1] if i % 3 else None, "", False) for i, t in enumerate(texts)],
                                   "ref string, step_no int, kind int, pos int, field string, weight int, loose string, exact string, lead string, whole boolean")
    index = GramIndex(spark, str(tmp_path / "index"), folders=7)
    index.build(fields.repartition(3), ["loose", "exact"])
    for needle in ["a", "ab", "😀", "X", "qq", "abx", "zzzz", texts[20][2:9], texts[30][:20], texts[40].upper()]:
        if needle.strip() == needle and needle:
            want = rows_of(A.search_analyses(fields, needle, 500), "ref", "snippet")
            assert rows_of(A.search_analyses(index.candidates(needle), needle, 500), "ref", "snippet") == want, needle
    assert index.candidates("").count() == 0
    plan = index.postings("abx")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_folder" in plan.replace("isnotnull(_folder", "[_folder") or "_folder" in plan.split("PartitionFilters")[1][:200]


def test_best_hits_come_from_the_highest_tiers_that_have_enough(spark, tmp_path):
    rng = random.Random(12)
    rows = [(f"r{i:03}", 0, 0, 0, "title", 3 - i % 3, "".join(rng.choice("abc") for _ in range(12)), "XY" if i % 3 == 1 else "xy" if i % 3 == 0 else None, "", False) for i in range(240)]
    fields = spark.createDataFrame(rows, "ref string, step_no int, kind int, pos int, field string, weight int, loose string, exact string, lead string, whole boolean")
    index = GramIndex(spark, str(tmp_path / "index"), folders=7)
    index.build(fields.repartition(3), ["loose", "exact"], tier="weight")
    for needle, k, searched in [("a", 40, [80]), ("XY", 30, [80, 160]), ("abc", 1000, None), ("qqq", 5, [0]), ("", 5, [0])]:
        seen = []

        def search(rows, needle=needle, k=k, seen=seen):
            seen.append(rows.count())
            return A.search_analyses(rows, needle, k)

        got = rows_of(index.best(needle, k, search), "ref", "snippet")
        assert got == rows_of(A.search_analyses(fields, needle, k), "ref", "snippet"), needle
        if searched is not None:  # "a" is in nearly all texts of the highest tier; "XY" in 80 rows there in the wrong case, so all are searched
            assert len(seen) == len(searched) and all(n <= most for n, most in zip(seen, searched, strict=True)), (needle, seen)


def test_gram_lists_hold_every_gram_once_a_slice(monkeypatch):
    monkeypatch.setattr(gram_index, "_SLICE", 400)
    rng = random.Random(13)
    rare = [chr(c) for c in range(0x100, 0x20000) if not 0xD800 <= c < 0xE000]  # too many for a gram and a place in 63 bits
    few = [(i * 90 + (i // 300 << 33), i // 50 % 2, *["".join(rng.choice("abΣé😀 \0") for _ in range(rng.randrange(9))) or None for _ in "xy"]) for i in range(900)]
    for rows in (few, [(7, 0, "".join(rare), "ab")], []):
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["_row", "_tier", "x", "y"])
        found, keys = [], []
        for out in gram_index._lists([batch]):
            for r in out.to_pylist():
                keys.append((r["gram"], r["chunk"]))
                found += [(r["gram"], r["tier"], (r["chunk"] >> 15 << 15) + place) for place in r["rows"]]
        assert len(set(keys)) == len(keys) and len(set(found)) == len(found)
        assert set(found) == {(t[i : i + 3], r[1], r[0]) for r in rows for t in r[2:] if t for i in range(len(t))}


def test_tails_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 4, i, (start + timedelta(seconds=(i * 37) % 500)).isoformat(), "purchase" if i % 5 == 0 else f"m{i}") for i in range(120)]
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1]), reverse=True):
        want.setdefault(r[0], []).append(r[1])
    for turn in (0, 1):
        random.Random(turn).shuffle(rows)
        for part in range(4):
            path = tmp_path / f"in{turn}"
            path.mkdir(exist_ok=True)
            (path / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "seq", "ts", "msg"), r, strict=True))) for r in rows[part::4]))
        stream = spark.readStream.schema(P.LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / f"in{turn}"))
        got = P.follow_tails(P.live_tails(stream, keep=7, lateness="1 day"), str(tmp_path / f"view{turn}"), str(tmp_path / f"check{turn}"))
        assert {r.run_id: r.seqs for r in got.collect()} == {k: v[:7] for k, v in want.items()}


def test_a_finished_run_goes_after_its_silence(spark, tmp_path):
    def message(run, second, msg):
        return json.dumps({"run_id": run, "seq": second, "ts": (datetime(2024, 1, 1) + timedelta(seconds=second)).isoformat(), "msg": msg})

    folder, view = tmp_path / "in", None
    folder.mkdir()
    for part, lines in enumerate(([message(1, 0, "purchase"), message(2, 5, "click")], [message(3, 30, "click")], [message(3, 31, "click")], [message(1, 60, "click")])):
        (folder / f"{part}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema(P.LOG).json(str(folder))
        view = P.follow_tails(P.live_tails(stream, lateness="0 seconds"), str(tmp_path / "view"), str(tmp_path / "check"))
        live = {r.run_id: (r.live, r.seqs) for r in view.collect()}
        assert live[1] == [(True, [0]), (True, [0]), (False, [0]), (True, [60])][part]
        assert live[2] == (True, [5])  # not finished: stays


ANSWERS = {
    1: ('{"a": "he said “x” twice"}', ["he said “x” twice"]), 2: ('{"a": "list ,] end"}', ["list ,] end"]), 3: ('[{"a":"1"},{"a":"2"}]', ["1", "2"]),
    4: ('text {"a": "}{"} after', ["}{"]), 5: ('```json\n{"a": "x",}\n```', ["x"]), 6: ('{“a”: “list ,] "q" end”,}', ['list ,] "q" end']), 7: ("nothing", None), 8: (None, None),
    9: ("5", None), 10: ('{"a": "x"} garbage }', ["x"]), 11: ('{"a": "x"}], "b": [{"a":"2"}', ["x"]), 12: ('{"a": "unterminated', None), 13: ('{"a": "esc \\" } x"} t', ['esc " } x']),
    14: ('so: ["a", "b"]', None), 15: ("[]", []), 16: ('{"a":"x","a":"y"}', ["y"]), 17: ("{'a': 'x'}", None), 18: ('I think [1] then {"a": "z"}', ["z"]), 19: ("", None), 20: ('{"a": "x\\', None),
    21: ('{"b": 1}', [None]), 22: ('[{"a":"p"}, null]', None), 23: ('```\n[{"a":"1"},]\n``` ', ["1"]), 24: ("{" * 5000, None), 25: ("[" * 5000 + "]" * 5000, None),
}


def test_answers_are_parsed_strictly_first_and_repaired_outside_strings(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in ANSWERS.items()], "id int, raw string")
    parsed, quarantined = R.ingest_model_output(df, "raw", "a string")
    got = {}
    for r in parsed.collect():
        got.setdefault(r.id, []).append(r.a)
    assert got == {i: want for i, (_, want) in ANSWERS.items() if want}
    assert rows_of(quarantined, "id", "raw") == sorted(((i, raw) for i, (raw, want) in ANSWERS.items() if want is None), key=repr)


def test_coverage_binds_its_tokens(spark):
    df = spark.createDataFrame([("a b c d", "a x c y"), ("", "a"), (None, "a")], "s string, g string")
    arrays = df.select(T.words(F.col("s")).alias("s"), T.words(F.col("g")).alias("g"))
    ratios = arrays.select(T.coverage_ratio(F.col("s"), F.col("g"), 20).alias("r"))
    assert [r[0] for r in ratios.collect()] == [0.5, 1.0, None]
    plan = ratios._jdf.queryExecution().optimizedPlan().toString()
    inside = plan[plan.index("aggregate(") :].split("lambdafunction")[1]
    assert "split(" not in inside and "filter(" not in inside


def test_points_do_not_hide_a_text_from_its_rule(spark):
    steps = spark.createDataFrame([(1, 1, "x", "לָמָּה לִי " + "ק" * 100), (1, 2, "x", "Other"), (1, 3, None, "למה לי"), (1, 4, "y", None)], "unit_id long, step_no int, label string, text string")
    rules = spark.createDataFrame([(1, r"^\s*למה\s*לי", "y", "why")], "rule_ix int, pattern string, expected string, name string")
    got = rows_of(A.source_rule_override(steps, rules, ["text"]), "step_no", "label", "rule_name", "matched_text")
    assert got[0] == (1, "y", "why", ("למה לי " + "ק" * 100)[:80]) and got[1] == (2, "x", None, None) and got[2][:3] == (3, "y", "why") and got[3][:2] == (4, "y")


def test_files_that_come_later_are_not_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    views = two_stages(spark, str(tmp_path / "v"), [])
    for part in range(2):
        (tmp_path / "in" / f"{part}.json").write_text(json.dumps({"k": 1, "id": part, "sent": 1, "v": 10}))
        run_available(spark.readStream.schema(ROW).json(str(tmp_path / "in")), views.apply, str(tmp_path / "c"))
        os.remove(tmp_path / "in" / f"{part}.json")
    assert rows_of(views.table("sums"), "k", "total") == [(1, 20)]


def test_a_reference_meets_its_candidates_by_texts(spark):
    rng = random.Random(6)
    some = ["", "a", "ba", "cba", "x cba", "ref cba", "b", "ab", "xab", None]
    asked = [(u, 1, i, rng.choice(some)) for u in range(6) for i in range(7)]
    cands = [(u, 1, i, rng.choice(some)) for u in range(6) for i in range(5)]
    prefixes = ["ref ", "x "]

    def bare(t):
        return next((t[len(p) :] for p in prefixes if t.startswith(p)), t)

    want = set()
    for u, line, i, a in asked:
        hits = []
        for v, _, j, c in cands:
            if u == v and a is not None and c is not None:
                tier = 1 if a == c else 2 if bare(a) == bare(c) else 3 if a.endswith(c) or c.endswith(a) else None
                hits += [(tier, j, c)] if tier else []
        if hits:
            want.add((u, line, i, a, min(hits)[2], min(hits)[0]))
    got = L.fuzzy_ref_lookup(
        spark.createDataFrame(asked, "unit_id long, line_no int, ask_pos int, asked_ref string"),
        spark.createDataFrame(cands, "unit_id long, line_no int, cand_pos int, full_ref string"),
        prefixes,
    )
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)


def test_references_meet_at_their_ends_in_one_shuffle(spark):
    rng = random.Random(41)
    prefixes, refs = ["ref ", "see "], ["", "1:1", "12:1", "ef 1:1", "ref 1:1", "ref 12:12", "see 12:12", "112:12", "xref 112:12", "2:12", "ref ref 112:12", "ef 12:12"]
    rows = [(1, line, rng.randrange(40), rng.choice(refs)) for line in (1, 2) for _ in range(30)]
    a = spark.createDataFrame(rows[::2], "unit_id long, line_no int, ask_pos int, asked_ref string")
    c = spark.createDataFrame(rows[1::2], "unit_id long, line_no int, cand_pos int, full_ref string")
    bare = lambda r: r[4:] if r.startswith(tuple(prefixes)) else r
    want = set()
    for u, line, i, x in rows[::2]:
        tiers = [(1 if x == y else 2 if bare(x) == bare(y) else 3, j, y) for _, other, j, y in rows[1::2] if other == line and (bare(x) == bare(y) or x.endswith(y) or y.endswith(x))]
        if tiers:
            want.add((u, line, i, x, min(tiers)[2], min(tiers)[0]))
    assert set(map(tuple, L.fuzzy_ref_lookup(a, c, prefixes).collect())) == want
    by_tail = L._hits_by_tail(a, c, ["unit_id", "line_no"], prefixes)
    assert by_tail._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1 and by_tail._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_wrappers_are_read_by_whole_paths(spark):
    inner = {"mapValue": {"fields": {"n": {"integerValue": "3"}, "x": {"nullValue": None}, "l": {"arrayValue": {"values": [{"stringValue": "a"}]}}}}}
    docs = [{"o": {"mapValue": {"fields": {"p": inner}}}}, {"o": {"mapValue": {"fields": {"p": {"stringValue": "no map"}}}}}, {"o": {"mapValue": {}}}, {"o": {"stringValue": "a"}}, {}]
    rows = spark.createDataFrame([(json.dumps({"fields": x}),) for x in docs], "raw string")
    found = R.ingest_typed_export(rows, "raw", {"o": "struct<p: struct<n: bigint, x: double, l: array<string>>>"})
    assert [r["o"] and r["o"].asDict(True) for r in found.collect()] == [{"p": {"n": 3, "x": None, "l": ["a"]}}, {"p": None}, {"p": None}, None, None]
    assert "try_variant_get(try_variant_get" not in found._jdf.queryExecution().analyzed().toString()


def test_answers_are_cut_into_slices_of_a_batch(spark):
    texts = [None if i % 50 == 7 else "no answer" if i % 50 == 8 else f'Well: {{"a": "x{i}",}} so' for i in range(3 * R._SLICE + 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, raw string").coalesce(1)
    parsed, quarantined = R.ingest_model_output(df, "raw", "a string")
    assert {(r["id"], r["a"]) for r in parsed.collect()} == {(i, f"x{i}") for i, t in enumerate(texts) if t and t != "no answer"}
    assert {r["id"] for r in quarantined.collect()} == {i for i in range(len(texts)) if i % 50 in (7, 8)}


def test_tails_are_merged_without_python_state(spark, tmp_path):
    """Micro-batches of one call: a run ended at the watermark of a batch starts anew in a later one, a late message counts."""
    start = datetime(2024, 1, 1)
    parts = ([(1, 0, "purchase"), (2, 2, "purchase")], [(3, 40, "click"), (2, 20, "purchase")], [(1, 39, "purchase"), (3, 10, "late")], [(3, 75, "end")])
    (tmp_path / "in").mkdir()
    for part, lines in enumerate(parts):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"run_id": r, "seq": s, "ts": (start + timedelta(seconds=s)).isoformat(), "msg": m}) for r, s, m in lines))
        os.utime(tmp_path / "in" / f"{part}.json", (1_700_000_000 + part,) * 2)
    stream = spark.readStream.schema(P.LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = P.follow_tails(P.live_tails(stream, lateness="0 seconds"), str(tmp_path / "view"), str(tmp_path / "check"))
    assert {r.run_id: (r.live, r.last_msg, r.seqs) for r in got.collect()} == {1: (False, "purchase", [39]), 2: (False, "purchase", [20, 2]), 3: (True, "end", [75, 40, 10])}
    assert not (tmp_path / "check" / "state").exists()  # the view is the only state


def test_a_write_makes_one_file_a_bucket(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id as k", "id % 3 as id", "cast(1 as bigint) as sent", "id as v").repartition(7)
    views = Views(spark, str(tmp_path / "v"), "k", [Stage("twice", (INPUT,), lambda t: t[INPUT].selectExpr("k", "2 * v as w"))], identity=("k", "id"), version="sent", buckets=5)
    for number in range(2):
        views.apply(rows.withColumn("sent", F.lit(number).cast("bigint")), number)
    for table in (INPUT, "twice"):
        assert [len(list(b.glob("*.parquet"))) for b in (tmp_path / "v" / "data" / table / "batch=0").glob("bucket=*")] == [1] * 5
    assert views.table("twice").agg(F.sum("w"), F.count("k")).first()[:] == (4000 * 3999, 4000)


def test_staged_runs_read_the_documents_once(spark, tmp_path, monkeypatch):
    from glosswork.plans import ingest

    seen, run = [], StagedRun.run
    monkeypatch.setattr(StagedRun, "run", lambda self, pending, stop_after=None: (seen.append(pending.inputFiles()), run(self, pending, stop_after))[1])
    got = ingest.r6b(spark, "/root/testdata/sf0.001")
    assert len(seen) == 7 and not any("documents" in f for files in seen for f in files)
    assert got.count() == got.select("unit_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").count()


def test_a_padded_slice_measures_its_unit_once(spark):
    steps = spark.createDataFrame([(1, 1, "a b"), (1, 2, "zz"), (2, 1, ""), (3, 1, None)], "unit_id long, step_no int, text string")
    units = spark.createDataFrame([(1, "x a b c", "p q r s t"), (2, "", ""), (3, "k", None)], "unit_id long, src string, translation string")
    got = alignment.padded_slice(steps, units, least_pad=1)
    assert rows_of(got, "unit_id", "step_no", "translation") == [(1, 1, "p q r s t"), (1, 2, "p q r s t"), (2, 1, ""), (3, 1, None)]
    assert len(re.findall(r"length\(u#", got._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_both_needles_take_one_pass(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    lines = [(u, i, text(rng.randrange(0, 9))) for u in range(25) for i in range(1, 9)]
    steps = [(u, i, text(rng.randrange(2, 9))) for u in range(25) for i in range(1, 13)]
    flat = lambda t: t.replace(" ", "")
    args = [spark.createDataFrame(x, f"unit_id long, {n} int, text string") for x, n in ((steps, "step_no"), (lines, "line_no"))]
    for head, short in ((6, 3), (3, 3), (2, 4)):
        want = []
        for u, k, t in steps:
            own = [flat(x) for v, _, x in sorted(lines) if v == u]
            at = next((p for p in ("".join(own).find(flat(t)[:n]) for n in (head, short)) if p >= 0), None) if len(flat(t)) >= 2 else None
            want.append((u, k, None if at is None else max(i + 1 for i in range(len(own)) if len("".join(own[:i])) <= at)))
        got = S.locate_start_lines(*args, head=head, short_head=short, least=2)
        assert rows_of(got, "unit_id", "step_no", "line_no") == sorted(want, key=repr)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("instr(whole") == 1 and plan.count("locate(") == (short < head)


def test_rows_that_are_only_added_are_not_compared(spark, tmp_path, monkeypatch):
    views, compare = Views(spark, str(tmp_path / "v"), "k", [Stage("sums", (INPUT,), lambda t: t[INPUT].groupBy("k").agg(F.sum("v").alias("total")))], buckets=3), []
    changed = Views._changed
    monkeypatch.setattr(Views, "_changed", lambda self, new, *rest: (compare.append(new.columns), changed(self, new, *rest))[1])
    views.apply(spark.createDataFrame([(1, 1), (2, 5)], "k long, v long"), 0)
    views.apply(spark.createDataFrame([(1, 7), (1, 1), (None, 3)], "k long, v long"), 1)
    assert rows_of(views.table("sums"), "k", "total") == [(1, 9), (2, 5)] and rows_of(views.table(INPUT), "k", "v") == [(1, 1), (1, 1), (1, 7), (2, 5)]
    assert compare == [["k", "total"]] * 2  # the stage's rows alone


def test_changed_rows_are_told_by_digests(spark, tmp_path):
    kind = "k long, a string, b string, at timestamp, l array<string>"
    moment = datetime(2024, 1, 1, 0, 0, 0, 1)
    old = [(1, "x", None, None, []), (2, "x", "y", moment, [None, "a"]), (3, "x", "y", moment, None), (4, "same", None, moment, ["a"]), (5, "gone", None, None, None), (9, "unasked", None, None, None)]
    new = [(1, None, "x", None, []), (2, "x", "y", moment + timedelta(microseconds=1), [None, "a"]), (3, "x", "y", moment, []), (4, "same", None, moment, ["a"]), (6, None, None, None, None)]
    views = Views(spark, str(tmp_path / "v"), "k", [])
    keys = spark.range(1, 8).withColumnRenamed("id", "k")
    changed = views._changed(spark.createDataFrame(new, kind), spark.createDataFrame(old, kind), keys)
    assert sorted({r.k for r in changed.collect()}) == [1, 2, 3, 5, 6]


def test_an_input_in_parts_is_not_written_again(spark, tmp_path):
    seen, rng, known, folder = [], random.Random(5), {}, tmp_path / "v"

    def sums(tables):
        made = tables[INPUT].groupBy("k").agg(F.sum("v").alias("total"))
        seen.append(sorted(r[0] for r in made.select("k").collect()))
        return made

    views = Views(spark, str(folder), "k", [Stage("sums", (INPUT,), sums)], identity=("k", "id"), version="sent", buckets=3, in_parts=True)
    files = lambda: {f.relative_to(folder): f.stat().st_mtime_ns for f in folder.glob("data/input/batch=*/bucket=*/*.parquet")}
    for number in range(12):  # rows that are new, newer, stale, sent twice in a batch, or as new as one before with other values
        batch = [(rng.randrange(7), rng.choice([None, 1, 2]), rng.choice([None, *range(4 * number)]), rng.randrange(99)) for _ in range(6)] if number != 3 else []
        order = lambda s: -1 if s is None else s
        for at, (k, i, s, _) in enumerate(batch):
            batch = [r for j, r in enumerate(batch) if j <= at or (r[0], r[1]) != (k, i) or order(r[2]) != order(s)]  # no ties within a batch
        before, changed = files(), set()
        for k, i, s, v in batch:
            if (k, i) not in known or order(s) > order(known[k, i][0]):
                known[k, i], changed = (s, v), changed | {k}
        seen.clear()
        views.apply(spark.createDataFrame([*batch, (None, 1, 1, 1)], ROW).repartition(2), number)
        assert seen == ([sorted(changed)] if changed else [])
        assert rows_of(views.table(INPUT), "k", "id", "sent", "v") == sorted(((*x, *y) for x, y in known.items()), key=repr) and views.table(INPUT).columns == ["k", "id", "sent", "v"]
        assert rows_of(views.table("sums"), "k", "total") == sorted(((k, sum(v for (x, _), (_, v) in known.items() if x == k)) for k in {k for k, _ in known}), key=repr)
        after = files()
        assert all(after[f] == at for f, at in before.items() if f in after)
        new = [f for f in after if f not in before and f.parts[2] == f"batch={number}"]
        assert (spark.read.parquet(*(str(folder / f) for f in new)).count() if new else 0) == len(batch)  # what came, and no more
    assert any("-whole" in f.parts[2] for f in files())  # buckets with more replaced rows than others


def test_a_bucket_of_many_parts_becomes_one(spark, tmp_path):
    views = Views(spark, str(tmp_path / "v"), "k", [Stage("sums", (INPUT,), lambda t: t[INPUT].groupBy("k").agg(F.sum("v").alias("total")))], buckets=1)
    for number in range(13):
        views.apply(spark.createDataFrame([(1, number)], "k long, v long"), number)
    assert rows_of(views.table(INPUT), "v") == sorted(((n,) for n in range(13)), key=repr) and rows_of(views.table("sums"), "k", "total") == [(1, 78)]
    held = lambda: sorted(p.parent.name for p in (tmp_path / "v" / "data" / INPUT).glob("batch=*/bucket=0"))
    assert held() == ["batch=10", "batch=11", "batch=12", "batch=9", "batch=9-whole"]


def test_units_are_searched_in_their_own_rows(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("aB \t") for _ in range(n)) if rng.random() < 0.95 else None
    units = [(u, [(i, text(rng.randrange(0, 9))) for i in rng.sample(range(1, 9), 8)], [(i, text(rng.randrange(2, 9))) for i in range(1, rng.randrange(2, 9))]) for u in range(30)]
    units += [(90, [(1, "")], []), (91, None, [(1, "aaaa")]), (92, [(1, "ab")], None)]
    df = spark.createDataFrame(units, "unit_id long, lines array<struct<line_no: int, text: string>>, steps array<struct<step_no: int, text: string>>")
    flat = [df.select("unit_id", F.inline(n)) for n in ("steps", "lines")]
    for head, short in ((6, 3), (3, 3), (2, 4)):
        got = S.locate_in_units(df, head=head, short_head=short, least=2)
        assert rows_of(got, "unit_id", "step_no", "line_no") == rows_of(S.locate_start_lines(*flat, head=head, short_head=short, least=2), "unit_id", "step_no", "line_no")


def test_the_chain_keeps_no_arrivals_and_moves_no_texts(spark, tmp_path, monkeypatch):
    from glosswork.plans import ingest
    from glosswork.plans.fixtures import spark_view
    from glosswork.plans.spans import asked_steps

    monkeypatch.setattr(ingest, "scratch_folder", lambda *_: str(tmp_path / "chain"))
    d = "/root/testdata/sf0.001"
    made = ingest.unit_documents(spark, d)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    for name, want in (("lines", spark_view(spark, d, "fx_lines")), ("steps", asked_steps(spark, d)), ("spans", spark_view(spark, d, "fx_spans"))):
        got = made.select("unit_id", F.inline(name))
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got, *want.columns) == rows_of(want, *want.columns)
    ingest.r3_chain(spark, d).count()
    arrived = [len(list((tmp_path / "chain" / "in").glob(p))) for p in ("*.json", "*.json.gz")]
    sent = spark.read.parquet(str(tmp_path / "chain" / "views" / "data" / "input")).groupBy("batch").agg(F.max("sent")).collect()
    assert arrived[0] == 0 and sorted(map(tuple, sent)) == [(0, 1), (1, 2), (2, 3)]
    assert arrived[1] == len(list((tmp_path / "chain" / "in").glob("*.gz"))) <= 2 * spark.sparkContext.defaultParallelism


def test_stages_that_read_the_input_compare_nothing(spark, tmp_path, monkeypatch):
    from glosswork.streaming import views as V

    written = []
    monkeypatch.setattr(V, "fixed", lambda rows, name: (written.append(name), fixed(rows, name))[1])
    views = Views(spark, str(tmp_path / "v"), "k", [Stage("sums", (INPUT,), lambda t: t[INPUT].groupBy("k").agg(F.sum("v").alias("total"))),
                  Stage("twice", ("sums", INPUT), lambda t: t["sums"].join(t[INPUT], "k").selectExpr("k", "total + v as w"))], identity=("k",), version="sent", buckets=3, in_parts=True)
    for number, rows in enumerate(([(1, 0, 1, 5), (2, 0, 1, 6)], [(2, 0, 2, 6), (1, 0, 0, 9)])):
        views.apply(spark.createDataFrame(rows, ROW), number)
    assert rows_of(views.table("twice"), "k", "w") == [(1, 10), (2, 12)]
    assert written == ["row-marks", "changed-keys"] * 2  # none of them for a comparison of a stage's rows
