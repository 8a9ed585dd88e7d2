"""Column functions over text. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACES = r"(?U)\s+"
NO_SPACES = r"(?U)\S+"
# Hebrew vowel points and cantillation marks, and letters.
HEBREW_POINTS = r"[֑-ׇ]"
HEBREW_LETTERS = r"[א-ת]"
BLANK_WORDS = ("n/a", "na", "none", "skip", "null")


def bind(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of the values, each computed once a row.

    A column that is named within a lambda is no value but its expression, computed again for every element once the
    optimizer has merged the projections below. As arguments of a lambda of their own the values stand still.
    """
    fields = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(fields), lambda x: body(*[x[f"v{i}"] for i in range(len(values))]))[0]


def strip_markup(text: Column) -> Column:
    """Line breaks become spaces, tags go, white space (also non-breaking) collapses; null stays null."""
    broken = F.regexp_replace(text, r"(?i)<br\s*/?>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(broken, r"<[^>]*>", ""), SPACES, " "))


def words(text: Column) -> Column:
    """The runs of characters that are no white space. Unlike split, which compiles its pattern for every value, this keeps it."""
    return F.regexp_extract_all(text, F.lit(NO_SPACES), F.lit(0))


def strip_points(text: Column, points: str = HEBREW_POINTS) -> Column:
    return F.regexp_replace(text, points, "")


def has_class(text: Column, character_class: str) -> Column:
    return text.rlike(character_class)


def normalise_tokens(text: Column, dropped: str = r"[A-Za-z]", points: str = HEBREW_POINTS) -> Column:
    """Tokens after tags, dropped characters, points and punctuation are gone; white space separates."""
    clean = F.regexp_replace(text, r"<[^>]*>", " ")
    for pattern, into in ((dropped, ""), (points, ""), (r"[^\p{L}\p{N}\s]", " ")):
        clean = F.regexp_replace(clean, pattern, into)
    return words(clean)


def coverage_ratio(source: Column, generated: Column, lookahead: int) -> Column:
    """Share of source tokens matched in order, each within ``lookahead`` tokens of the generated ones after the last match.

    An empty source is fully covered. Both arguments are arrays of strings.
    """
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("hits"))

    def matched(source: Column, generated: Column) -> Column:
        def step(state: Column, token: Column) -> Column:
            place = F.array_position(F.slice(generated, state["at"], F.lit(lookahead)), token).cast("int")
            # the place, 0 if there is none, is searched once
            return bind(lambda p: F.struct((state["at"] + p).alias("at"), (state["hits"] + F.least(p, F.lit(1))).alias("hits")), place)

        return F.aggregate(source, start, step)["hits"]

    hits = bind(lambda s, g: F.when(F.size(s) == 0, 1.0).otherwise(matched(s, g) / F.size(s)), source, generated)
    return F.when(source.isNotNull() & generated.isNotNull(), hits)


def coverage_gate(ratio: Column) -> Column:
    return F.when(ratio < 0.85, "critical").when(ratio < 0.95, "warning").otherwise("ok")


def blank_placeholders(text: Column, placeholders: tuple[str, ...] = BLANK_WORDS) -> Column:
    """Null for blanks and for words that stand for nothing."""
    bare = F.lower(F.trim(text))
    return F.when((bare != "") & ~bare.isin(*placeholders), text)


def length_guard(new: Column, prior: Column, source: Column, note: bool = False) -> Column:
    """A translation that is too long for its source falls back to its first sentence, then to its first words.

    The cap is 2.5 times the source's words, 15 at least; for notes it is 40. Blank texts keep the prior value.
    """
    cap = F.lit(40) if note else F.greatest(F.lit(15), F.floor(F.size(words(source)) * 2.5).cast("int"))
    sentence = F.split(F.trim(new), r"(?<=[.!?])\s+", 2)[0]
    first_words = F.concat(F.array_join(F.slice(words(new), F.lit(1), cap), " "), F.lit("…"))
    fitted = F.when(F.size(words(new)) <= cap, new).when(F.size(words(sentence)) <= cap, sentence).otherwise(first_words)
    return F.when(F.trim(F.coalesce(new, F.lit(""))) == "", prior).otherwise(fitted)


def pad_or_trim(array: Column, n: Column | int, fill: str = "") -> Column:
    """Exactly n elements: the first n, or all and fillers."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(array, F.array_repeat(F.lit(fill), n)), F.lit(1), n)


def phrase_is_contaminated(translation: Column, source: Column) -> Column:
    """A translation of more than three times its source's words, and more than 20, has text that is not its own."""
    return F.size(words(translation)) > F.greatest(F.lit(20), F.size(words(source)) * 3)


def already_aligned(target: Column, phrase: Column, least: float = 0.7) -> Column:
    """Whether more than ``least`` of the target's tokens occur among the phrase's; nothing to find is not aligned."""
    missing = F.array_except(target, phrase)  # hashed and distinct, so the scan below is short
    start = F.struct(F.lit(0).alias("n"), missing.alias("missing"))
    lost = F.aggregate(target, start, lambda s, t: F.struct((s["n"] + F.array_contains(s["missing"], t).cast("int")).alias("n"), s["missing"].alias("missing")))["n"]
    return F.when(F.size(target) == 0, F.lit(False)).otherwise((F.size(target) - lost) / F.size(target) > least)


def truncate_ellipsis(text: Column, n: int = 1800) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def snippet(text: Column, needle: str, context: int = 50, otherwise: int = 120) -> Column:
    """The text around the first hit, case-insensitive, with ellipses where it is cut; without a hit its first characters."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(at - context, F.lit(1))
    stop = F.least(at + len(needle) + context, F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, stop - start), F.when(stop <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, otherwise))


def flag_words(text: Column, listed: list[str]) -> Column:
    """Whether any listed word occurs, case-insensitive, as a whole word."""
    return text.rlike(r"(?i)\b(" + "|".join(listed) + r")\b")


def flatten_segments(raw: Column) -> Column:
    """A text, a list of texts or a list of lists, given as JSON, as one flat list; null and other shapes give none."""
    deep = F.flatten(F.from_json(raw, "array<array<string>>"))
    flat = F.from_json(raw, "array<string>")
    one = F.array(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0])
    shape = F.regexp_extract(raw, r"^\s*(\[\s*\[|\[|\")", 1)
    none = F.expr("cast(array() as array<string>)")
    return F.coalesce(F.when(shape.rlike(r"\[\s*\["), deep).when(shape == "[", flat).when(shape == '"', one), none)
