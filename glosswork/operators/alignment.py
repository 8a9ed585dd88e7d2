"""Alignment of source lines, phrases and translations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from glosswork.functions import text as T

# The marks that end phrases, the limits of their words, and what stands for a missing translation.
HARD, SOFT = "׃.!?", ",;:—–-"
MOST_WORDS, CHUNK_WORDS, LEAST_WORDS = 8, 6, 3
UNAVAILABLE = "[translation unavailable]"
AFTER_HARD, AFTER_SOFT = (re.compile(f"[^{marks}]+[{marks}]?|[{marks}]") for marks in (HARD, SOFT))
WORD = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")  # between white space, as T.words
BATCH_CHARS = 4_000_000


def merge_versions(lines: DataFrame) -> DataFrame:
    """Line by line the first of v1, v2, v3 that is not blank; if that leaves a unit all blank, its first version with text.

    A unit is all blank only where every version is, so the fallback keeps the lines of v1 as they are.
    """
    tidy = lambda c: F.when(F.trim(c) != "", F.trim(c))
    merged = F.coalesce(tidy("v1"), tidy("v2"), tidy("v3"))
    whole = Window.partitionBy("unit_id")
    any_text = F.max(F.when(merged.isNotNull(), 1).otherwise(0)).over(whole)
    text = F.when(any_text == 1, F.coalesce(merged, F.lit(""))).otherwise(F.coalesce("v1", "v2", "v3"))
    return lines.select("unit_id", "line_no", text.alias("text"))


def proportional_slice(lines: DataFrame, translations: DataFrame) -> DataFrame:
    """Each source line's share of its unit's translation: the line of the same place if both have as many lines, else the
    words between the prefix fractions of the source's words, both cut down to integers.
    """
    w = Window.partitionBy("unit_id").orderBy("line_no")
    whole = Window.partitionBy("unit_id")
    n = lines.withColumn("w", F.size(T.words("text")))
    n = n.withColumn("before", F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("total", F.sum("w").over(whole)).withColumn("n_lines", F.count(F.lit(1)).over(whole))
    j = n.join(translations.select("unit_id", "tr_lines", T.words(F.array_join("tr_lines", " ")).alias("all")), "unit_id")
    at = lambda c: F.floor(c.cast("double") / F.greatest("total", F.lit(1)).cast("double") * F.size("all")).cast("int")
    i0, i1 = at(F.col("before")), at(F.col("before") + F.col("w"))
    by_words = F.array_join(F.slice("all", i0 + 1, F.greatest(i1 - i0, F.lit(0))), " ")
    same = F.size("tr_lines") == F.col("n_lines")
    return j.select("unit_id", "line_no", F.when(same, F.get("tr_lines", F.col("line_no") - 1)).otherwise(by_words).alias("translation"))


def padded_slice(steps: DataFrame, units: DataFrame, head: int = 80, least_pad: int = 20) -> DataFrame:
    """The part of a unit's translation around a step: found by its text's first characters, as fractions of the unit's
    characters, padded on both sides by its own length, ``least_pad`` words at least; not found gives the whole.
    """
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    asked = steps.groupBy("unit_id").agg(F.collect_list(F.struct("step_no", squeeze("text").alias("s"))).alias("asked"))
    j = asked.join(units.select("unit_id", squeeze("src").alias("u"), T.words("translation").alias("tr")), "unit_id")

    def around(lo: Column, hi: Column) -> Column:
        return F.array_join(F.slice("tr", lo + 1, F.greatest(hi - lo, F.lit(0))), " ")

    def padded(i0: Column, i1: Column, n: Column) -> Column:
        pad = F.greatest(F.lit(least_pad), i1 - i0)
        return T.bind(around, F.greatest(F.lit(0), i0 - pad), F.least(n, i1 + pad))

    def part(x: Column, length: Column, n: Column, whole: Column) -> Column:
        def found(at: Column) -> Column:
            i0 = F.floor((at - 1) / length * n).cast("int")
            i1 = F.floor(F.least((at - 1 + F.length(x["s"])) / length, F.lit(1.0)) * n).cast("int")
            return F.when((at > 0) & (F.length(x["s"]) > 0), T.bind(lambda i0, i1: padded(i0, i1, n), i0, i1)).otherwise(whole)

        return F.struct(x["step_no"].alias("step_no"), T.bind(found, F.instr(F.col("u"), F.substring(x["s"], 1, head))).alias("translation"))

    # one row a unit, so that its texts are not copied to each of its steps; its length and its whole translation once a unit
    parts = T.bind(lambda *of: F.transform("asked", lambda x: part(x, *of)), F.length("u"), F.size("tr"), F.array_join("tr", " "))
    return j.select("unit_id", F.inline(parts))


def pieces_after(text: str, after: re.Pattern) -> list[str]:
    """The trimmed pieces between the cuts, without empty ones."""
    return [y for x in after.findall(text) if (y := x.strip(" "))]


def phrase_pieces(text: str) -> list[str]:
    """Pieces after hard marks; those of more than 8 words after soft marks; still longer ones in chunks of 6 words."""
    pieces: list[str] = []
    for sentence in pieces_after(text, AFTER_HARD):
        if len(WORD.findall(sentence)) <= MOST_WORDS:
            pieces.append(sentence)
            continue
        for clause in pieces_after(sentence, AFTER_SOFT):
            words = WORD.findall(clause)
            if len(words) <= MOST_WORDS:
                pieces.append(clause)
            else:
                pieces += [" ".join(words[k : k + CHUNK_WORDS]) for k in range(0, len(words), CHUNK_WORDS)]
    return pieces


def merge_runts(pieces: list[str]) -> list[str]:
    """Join pieces of fewer than 3 words to a neighbour, never beyond 8 words: the one before if it is no longer than the one
    after, else that; the first that can be joined goes first, until none fits.

    A join only makes neighbours longer, so a piece that was passed never fits later: one way through with those passed on
    a stack, in time proportional to the pieces.
    """
    passed: list[tuple[str, int]] = []
    ahead = [(p, len(WORD.findall(p))) for p in reversed(pieces)]
    while ahead:
        piece, size = ahead.pop()
        before = passed[-1][1] if passed else MOST_WORDS + 1
        after = ahead[-1][1] if ahead else MOST_WORDS + 1
        if size >= LEAST_WORDS or size + min(before, after) > MOST_WORDS:
            passed.append((piece, size))
        elif before <= after:
            ahead.append((f"{passed.pop()[0]} {piece}", before + size))
        else:
            ahead.append((f"{piece} {ahead.pop()[0]}", size + after))
    return [p for p, _ in passed]


def split_phrases(rows: DataFrame) -> DataFrame:
    """(unit_id, line_no, phrase_no, phrase) of (unit_id, line_no, text); null and blank texts have no phrase.

    Cutting and joining run line by line in Arrow batches: patterns with marks beyond Latin-1 cost the JVM some ten times
    as much. An output batch holds about ``BATCH_CHARS`` characters, so that long lines do not add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            ends = [*np.flatnonzero(np.diff(chars // BATCH_CHARS)) + 1, batch.num_rows]
            for since, until in zip([0, *ends], ends):
                part = batch.slice(since, until - since)
                phrases = [merge_runts(phrase_pieces(x)) if x else [] for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(phrases, pa.list_(pa.string()))], names=["unit_id", "line_no", "phrases"])

    lines = rows.select("unit_id", "line_no", "text")
    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("unit_id", "line_no"))
    cut = lines.mapInArrow(run, f"{kinds}, phrases array<string>")
    return cut.select("unit_id", "line_no", F.posexplode("phrases").alias("p", "phrase")).select("unit_id", "line_no", (F.col("p") + 1).alias("phrase_no"), "phrase")


def align_translation(phrases: DataFrame, translations: DataFrame) -> DataFrame:
    """Deal a line's translation to its phrases: all to a single one, by sentences if as many, else by word quotas in
    proportion to the phrases' words (half-even, one at least; the last takes the rest).
    """
    keys = ["unit_id", "line_no"]
    w, whole = Window.partitionBy(*keys).orderBy("phrase_no"), Window.partitionBy(*keys)
    p = phrases.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("w", F.size(T.words("phrase")))
    p = p.withColumn("total_w", F.sum("w").over(whole)).join(translations.select(*keys, "translation"), keys, "left")
    p = p.withColumn("sentences", F.split(F.trim("translation"), r"(?<=[.!?])\s+")).withColumn("tr", T.words("translation"))
    quota = F.greatest(F.lit(1), F.bround(F.size("tr") * F.col("w") / F.col("total_w")).cast("int"))
    p = p.withColumn("quota", quota)
    p = p.withColumn("before", F.coalesce(F.sum("quota").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    take = F.when(F.col("phrase_no") == F.col("n"), F.size("tr")).otherwise(F.col("quota"))
    by_words = F.array_join(F.slice("tr", F.col("before") + 1, take), " ")
    blank = F.trim(F.coalesce("translation", F.lit(""))) == ""
    text = (
        F.when(blank, UNAVAILABLE).when(F.col("n") == 1, F.trim("translation"))
        .when(F.size("sentences") == F.col("n"), F.get("sentences", F.col("phrase_no") - 1)).otherwise(by_words)
    )
    return p.select(*keys, "phrase_no", F.when(text == "", UNAVAILABLE).otherwise(text).alias("translation"))


def contamination(phrases: DataFrame, most_share: float = 0.05) -> DataFrame:
    """Per unit the phrases, the bad ones, and whether it is clean: none bad or less than ``most_share`` of them."""
    bad = T.phrase_is_contaminated(F.col("translation"), F.col("phrase")).cast("int")
    g = phrases.groupBy("unit_id").agg(F.count(F.lit(1)).alias("phrases"), F.sum(bad).alias("bad"))
    return g.withColumn("clean", F.col("bad") / F.col("phrases") < most_share)


def missing_points(terms: DataFrame, letters: str = T.HEBREW_LETTERS, points: str = T.HEBREW_POINTS) -> DataFrame:
    """Terms in the script without any point."""
    return terms.where(F.col("term").rlike(letters) & ~F.col("term").rlike(points))


def apply_replacements(terms: DataFrame, replacements: DataFrame) -> DataFrame:
    """Put replacement terms in the places (unit_id, step_no, term_pos) they name; blank ones change nothing."""
    keys = ["unit_id", "step_no", "term_pos"]
    new = replacements.select(*keys, F.when(F.trim("term") != "", F.col("term")).alias("_new"))
    return terms.join(new, keys, "left").select(*keys, F.coalesce("_new", "term").alias("term"))


def normalise_enum(value: Column, allowed: list[str], synonyms: dict[str, str], default: str | None = None, prefixes: dict[str, str] | None = None) -> Column:
    """The value if allowed, else its snake-cased form if that is, else the synonym's value, else that of the first listed
    prefix that the snake-cased form has, else the default.
    """
    snake = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_"), r"[^a-z0-9_]", "")
    known = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    begins = F.when(F.lit(False), F.lit(default))
    for prefix, meant in (prefixes or {}).items():
        begins = begins.when(snake.startswith(prefix), meant)
    known = F.element_at(known, snake) if synonyms else F.lit(None)
    return F.when(value.isin(allowed), value).when(snake.isin(allowed), snake).otherwise(F.coalesce(known, begins, F.lit(default)))
