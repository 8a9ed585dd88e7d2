"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything here is a built-in Spark function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Kind:
    """How spans of one kind are found and scored.

    ``pattern`` is possessive (but for account numbers, whose repeats are bounded) and anchored to the start of a run of its first characters (or to the end of the match
    before), which finds the same leftmost matches as the plain form in linear time and constant stack.
    ``needs`` is a cheap test that a text without matches fails.
    """

    name: str
    pattern: str
    needs: str
    base: bool
    prior: float
    words: str


# Characters of an account number by country, from the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(x.replace(" ", "|") for x in IBAN_LENGTHS.values())
_BY_COUNTRY = "|".join(rf"(?:{x.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, x in IBAN_LENGTHS.items())
_OTHERS = rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_LISTED})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}}"

# The patterns of the base kinds, their limits and their order.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, "mail|contact|write|adresse|correo"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", True, 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", True, 0.7, "card|visa|mastercard|credit|carte|tarjeta|karte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", True, 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", rf"(?<![A-Z0-9])(?:{_BY_COUNTRY}|{_OTHERS})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", False, 0.6, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", False, 0.35, "ssn|social security|tax id|insurance"),
)
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2
CHECKSUM_BONUS = 0.2
THRESHOLD = 0.5
_BLOCK = 512


def _digit_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(code: Column) -> Column:
    """The remainder of an account number whose first four characters go last and whose letters count from 10."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        at = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(at < 58, rest * 10 + at - 48).otherwise(rest * 100 + at - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _confirmed(kind: str, match: Column) -> Column:
    """Whether a match passes its kind's limits and checksum."""
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]", "")
        right_size = F.length(digits).between(14, 19)
        return F.when(right_size, _digit_sum(F.when(right_size, digits).otherwise("0")) % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return _iban_length(match) > 0
    return F.lit(True)


def _iban_length(match: Column) -> Column:
    """How much of a match is an account number: all or nothing where the country's length is known, else up to the
    last end of a word at which mod 97 holds; 0 if nowhere."""

    def confirmed(n: Column) -> Column:
        code = F.regexp_replace(F.substring(match, F.lit(1), n), r"\x20", "")
        right_size = F.length(code).between(15, 34)
        return F.when(right_size, _mod97(F.when(right_size, code).otherwise("GB00")) == 1).otherwise(False)

    whole = F.length(match)
    listed = F.substring(match, 1, 2).isin(_LISTED.split("|"))
    ends = F.when(listed, F.array(whole)).otherwise(
        F.filter(F.sequence(F.lit(15), whole), lambda n: (n == whole) | (F.substring(match, n + 1, F.lit(1)) == " "))
    )
    return F.coalesce(F.array_max(F.filter(ends, confirmed)), F.lit(0))


def _gaps(text: Column, kind: Kind) -> Column:
    """array<struct<gap, near, match>>: each match in order with the number of code points since the one before, and the
    last ``CONTEXT_CHARS`` of these.

    Splitting by the pattern gives the pieces between the matches; texts that fail the kind's cheap test are not
    searched.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def paired(piece: Column, match: Column) -> Column:
        return F.struct(F.length(piece).cast("long").alias("gap"), _last(piece).alias("near"), match.alias("match"))

    none = F.expr("cast(array() as array<struct<gap: bigint, near: string, match: string>>)")
    pairs = F.zip_with(F.split(text, kind.pattern, -1), matches, paired)
    return F.when(text.rlike(kind.needs), F.filter(pairs, lambda x: x["match"].isNotNull())).otherwise(none)


def _last(text: Column) -> Column:
    return F.right(text, F.lit(CONTEXT_CHARS))


def _blocks(gaps: Column) -> Column:
    """The matches with running positions in blocks of bounded size: array<struct<pos, before, out>>, pos the block's length.

    ``before`` holds the code points before the current place, as many as a context has. A text with very many matches
    would otherwise copy one growing array, or look through the whole text, for each of them.
    """

    def add(state: Column, x: Column) -> Column:
        begin = state["pos"] + x["gap"]
        stop = begin + F.length(x["match"])
        before = _last(F.concat(state["before"], x["near"]))
        item = F.struct(begin.alias("start"), stop.alias("stop"), x["match"].alias("match"), before.alias("before"))
        return F.struct(stop.alias("pos"), _last(F.concat(before, x["match"])).alias("before"), F.concat(state["out"], F.array(item)).alias("out"))

    def block(k: Column) -> Column:
        first = k * _BLOCK
        width = F.least(first, F.lit(CONTEXT_CHARS))  # a match has a character at least, so these fill a context
        ahead = F.slice(gaps, F.greatest(first - width, F.lit(0)) + 1, width)
        before = _last(F.array_join(F.transform(ahead, lambda x: F.concat(x["near"], x["match"])), ""))
        none = F.expr("cast(array() as array<struct<start: bigint, stop: bigint, match: string, before: string>>)")
        return F.aggregate(F.slice(gaps, first + 1, F.lit(_BLOCK)), F.struct(F.lit(0).cast("long").alias("pos"), before.alias("before"), none.alias("out")), add)

    last = F.greatest(F.floor((F.size(gaps) - 1) / _BLOCK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), block)


def _shifts(blocks: Column) -> Column:
    """The position at which each block starts."""
    start = F.expr("struct(0L as pos, cast(array() as array<bigint>) as out)")
    return F.aggregate(blocks, start, lambda s, b: F.struct((s["pos"] + b["pos"]).alias("pos"), F.concat(s["out"], F.array(s["pos"])).alias("out")))["out"]


def _spans_of(kind: Kind, rank: int, blocks: Column, shifts: Column) -> Column:
    """The confirmed, scored spans of one kind."""
    prior = kind.prior + (CHECKSUM_BONUS if kind.name in ("card", "iban") else 0.0)

    def scored(x: Column, shift: Column) -> Column:
        stop = x["start"] + _iban_length(x["match"]) if kind.name == "iban" else x["stop"]
        near = F.when(F.lower(x["before"]).rlike(rf"\b(?:{kind.words})\b"), CONTEXT_BONUS).otherwise(0.0)
        score = F.round(F.lit(prior) + near, 2)
        return F.struct((x["start"] + shift).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (stop + shift).alias("stop"), score.alias("score"), F.lit(kind.base).alias("base"))

    def placed(block: Column, shift: Column) -> Column:
        return F.transform(F.filter(block["out"], lambda x: _confirmed(kind.name, x["match"])), lambda x: scored(x, shift))

    return F.filter(F.flatten(F.zip_with(blocks, shifts, placed)), lambda x: x["base"] | (x["score"] >= THRESHOLD))


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add pii_spans: array<struct<start, rank, kind, stop, score, base>>, by start, then kind as listed.

    A regular expression proposes a kind's leftmost non-overlapping matches; a match that fails its limits or its
    checksum (Luhn for cards, mod 97 for account numbers) is dropped without another try. An account number has its
    country's length, so that it ends before a word or number that follows; of countries without a known length, mod 97
    chooses the last word that belongs to it. The score is the
    kind's prior, more if a checksum confirmed it and if a context word stands within the 40 code points before;
    base kinds always stay, the others from a score of 0.5 on. Null and empty texts have no spans. Offsets are code
    points, stop exclusive. Other columns pass; one named pii_spans is replaced.
    """
    # each step is a projection of its own, so that no regular expression runs twice
    name = lambda step, k: f"_pii_{step}_{k.name}"
    staged = docs.withColumn("_pii_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col("_pii_text")
    staged = staged.withColumns({name("gaps", k): _gaps(text, k) for k in KINDS})
    staged = staged.withColumns({name("blocks", k): _blocks(F.col(name("gaps", k))) for k in KINDS})
    staged = staged.withColumns({name("shifts", k): _shifts(F.col(name("blocks", k))) for k in KINDS})
    found = [_spans_of(k, i, F.col(name("blocks", k)), F.col(name("shifts", k))) for i, k in enumerate(KINDS)]
    staged = staged.withColumn("pii_spans", F.array_sort(F.concat(*found)))
    return staged.select(*[c for c in docs.columns if c != "pii_spans"], "pii_spans")


def joined_spans(spans: Column) -> Column:
    """kind:start:stop of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans fall to the first.

    Spans are taken in blocks of bounded size, each of which is written from its own part of the text, so that the work
    for a long text of many spans does not grow with their product.
    """
    last = F.floor((F.size(spans) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(spans, k * _BLOCK + 1, F.lit(_BLOCK)))
    reach = lambda blocks: F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["stop"])))

    def part(block: Column, since: Column, body: Column) -> Column:
        def add(state: Column, x: Column) -> Column:
            between = F.substring(body, (state["pos"] - since + 1).cast("int"), (x["start"] - state["pos"]).cast("int"))
            grown = F.concat(state["out"], between, F.lit("<"), x["kind"], F.lit(">"))
            fresh = x["start"] >= state["pos"]
            return F.struct(F.greatest(state["pos"], x["stop"]).alias("pos"), F.when(fresh, grown).otherwise(state["out"]).alias("out"))

        done = F.aggregate(block, F.struct(since.alias("pos"), F.lit("").alias("out")), add)
        rest = lambda d: F.concat(d["out"], F.substring(body, (d["pos"] - since + 1).cast("int"), F.length(body)))
        return F.transform(F.array(done), rest)[0]

    def whole(pair: Column) -> Column:
        blocks, tops = pair["blocks"], pair["tops"]
        since = lambda k: F.coalesce(F.array_max(F.slice(tops, 1, k)), F.lit(0).cast("long"))

        def of(block: Column, k: Column) -> Column:
            until = F.when(k == F.size(blocks) - 1, F.length(text).cast("long")).otherwise(since(k + 1))
            cut = F.struct(since(k).alias("since"), F.substring(text, (since(k) + 1).cast("int"), (until - since(k)).cast("int")).alias("body"))
            return F.transform(F.array(cut), lambda c: part(block, c["since"], c["body"]))[0]

        return F.array_join(F.transform(blocks, of), "")

    made = F.transform(F.array(F.struct(blocks.alias("blocks"), reach(blocks).alias("tops"))), whole)[0]
    return F.when(F.size(spans) > 0, made).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced; null texts stay null."""
    marked = find_spans(docs, text_col)
    return marked.withColumn(text_col, redacted(F.col(text_col), F.col("pii_spans"))).drop("pii_spans")
