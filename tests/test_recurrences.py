"""The closed forms equal the step-by-step rules they stand for, on random input."""

from __future__ import annotations

import random
import re

from glosswork.operators import alignment, audit, spans


def test_repairs_follow_the_recurrence(spark):
    rng = random.Random(1)
    rows, units = [], []
    for unit in range(300):
        units.append((unit, rng.randrange(1, 40)))
        rows += [(unit, k + 1, rng.randrange(-3, 45), rng.randrange(-3, 45), f"t{k}") for k in range(rng.randrange(0, 7))]
    df = spark.createDataFrame(rows, "unit_id long, span_no int, start_line int, end_line int, topic string")
    u = spark.createDataFrame(units, "unit_id long, n_lines int")
    repaired, stepped = {}, {}
    for r in spans.repair_spans(df, u).orderBy("unit_id", "span_no").collect():
        repaired.setdefault(r["unit_id"], []).append((r["start_line"], r["end_line"], r["topic"]))
    for r in spans.repair_step_ranges(df, u).orderBy("unit_id", "span_no").collect():
        stepped.setdefault(r["unit_id"], []).append((r["start_line"], r["end_line"]))
    for unit, total in units:
        mine = sorted([r for r in rows if r[0] == unit], key=lambda r: (r[2], r[1])) or [(unit, 1, 1, total, "whole unit")]
        prev, want = 0, []
        for i, (_, _, s, e, topic) in enumerate(mine):
            start = max(prev + 1, s)
            end = max(total if i == len(mine) - 1 else min(total, e), start)
            want.append((start, end, topic))
            prev = end
        assert repaired[unit] == want
        given, reach, want = [r for r in rows if r[0] == unit], 0, []
        for i, (_, _, s, e, _) in enumerate(given):
            reach = max(reach + 1, e, s, 1)
            end = total if i == len(given) - 1 else min(total, reach)
            start = min(max((want[-1][1] if want else 0) + 1, s, 1), end)
            want.append((start, end))
        assert stepped.get(unit, []) == want


def test_branch_depth_never_falls_below_zero(spark):
    rng = random.Random(2)
    roles = ["opens_new_branch", "returns_to_previous_branch", "conclusion_of_branch", "continues_current_line", None]
    rows = [(unit, k, rng.choice(roles)) for unit in range(200) for k in range(1, rng.randrange(2, 15))]
    df = spark.createDataFrame(rows, "unit_id long, step_no int, branch_role string")
    got = {(r["unit_id"], r["step_no"]): r["depth"] for r in audit.branch_depth(df.na.fill("none", ["branch_role"])).collect()}
    depth = {}
    for unit, k, role in rows:
        d = depth.get(unit, 0)
        d = d + 1 if role == roles[0] else max(0, d - 1) if role == roles[1] else 0 if role == roles[2] else d
        depth[unit] = d
        assert got[unit, k] == d


def test_short_phrases_join_the_shorter_neighbour():
    assert alignment.merge_runts(["a b c d", "e", "f g h"]) == ["a b c d", "e f g h"]
    assert alignment.merge_runts(["a b c", "e", "f g h"]) == ["a b c e", "f g h"]
    assert alignment.merge_runts(["a b c d e f g", "x y", "k l m n o p q"]) == ["a b c d e f g", "x y", "k l m n o p q"]
    assert alignment.merge_runts(["a", "b"]) == ["a b"]
    assert alignment.merge_runts([]) == []


def test_phrases_keep_every_word(spark):
    texts = ["", None, "one two. three four five, six seven eight nine ten; eleven", "׃ a b׃", " ".join(map(str, range(50)))]
    df = spark.createDataFrame(list(enumerate(texts)), "unit_id long, text string").selectExpr("unit_id", "1 as line_no", "text")
    got = {}
    for r in alignment.split_phrases(df).orderBy("unit_id", "phrase_no").collect():
        got.setdefault(r["unit_id"], []).append(r["phrase"])
        assert len(r["phrase"].split()) <= 8
    for unit, text in enumerate(texts):
        assert " ".join(got.get(unit, [])).split() == (text or "").split()


def test_short_phrases_join_as_by_the_restarting_rule(spark):
    """One way through with a stack gives what the literal rule gives, which starts again after each join."""

    def literal(pieces):
        count = lambda x: len(re.findall(r"(?u)\S+", x))
        at = 0
        while at < len(pieces):
            sizes = [count(p) for p in pieces]
            room = [(sizes[k], k) for k in (at - 1, at + 1) if 0 <= k < len(pieces) and sizes[k] + sizes[at] <= 8]
            if sizes[at] >= 3 or not room:
                at += 1
                continue
            lo = min(at, min(room)[1])
            pieces[lo : lo + 2] = [f"{pieces[lo]} {pieces[lo + 1]}"]
            at = 0
        return pieces

    r = random.Random(5)
    marks = [*"abcé😀,;:.!?—–-׃", *"    ", "\t", "\u2003", "\xa0", "\x85", "\u200b"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 90))) for _ in range(800)]
    texts += ["\t a b. c", "ab cd. " * 90, "word " * 90, "", "   ", None]
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate(texts)], "unit_id long, line_no int, text string")
    found = {}
    for row in alignment.split_phrases(df).orderBy("unit_id", "phrase_no").collect():
        found.setdefault(row["unit_id"], []).append(row["phrase"])
    for i, x in enumerate(texts):
        assert found.get(i, []) == literal(alignment.phrase_pieces(x or "")), x
    assert all(len(p.split()) == 6 for p in found[802])
