"""I-Match fingerprints: hashes of the terms of middling frequency under many randomised lexicon subsets.

Everything here is a built-in Spark function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from glosswork.llm.ranking import ranked
from glosswork.llm.storage import materialise

_NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class IMatchParams:
    """Terms stay if their share of the documents lies in [least_share, most_share], that is, if their inverse document
    frequency lies in a band. At level l a lexicon subset takes one in ``subsets << l`` terms at random; ``subsets`` is a
    power of two.
    """

    least_share: float = 0.001
    most_share: float = 0.05
    subsets: int = 32
    levels: int = 6
    enough: int = 24


_SLOTS = 1 << 16


def _terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the words (runs of letters and digits, lower-cased)."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, although a lambda in it uses the value many times."""
    return F.transform(F.array(value), body)[0]


def _slot(term: Column) -> Column:
    return term.bitwiseAND(_SLOTS - 1).cast("int")


def lexicon(texts: DataFrame, params: IMatchParams = IMatchParams(), text_col: str = "text") -> DataFrame:
    """One row (slots: array<array<long>>): the terms of the band, each in the slot that its low bits name.

    Every distinct term of every text counts once, by its whole 64-bit hash; counts are partially aggregated before the
    shuffle. A term of the band is in ``least_share`` of the texts at least, so there are at most (mean number of distinct
    terms of a text / least_share) of them, however large the corpus is, and every task can hold them.
    """
    rows = texts.select(F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = texts.count()
    band = counts.where((F.col("df") >= n * params.least_share) & (F.col("df") <= n * params.most_share))
    filled = band.groupBy(_slot(F.col("term")).alias("slot")).agg(F.collect_list("term").alias("terms"))
    slots = [[] for _ in range(_SLOTS)]
    for row in filled.collect():  # bounded as stated above
        slots[row["slot"]] = row["terms"]
    return materialise(texts.sparkSession.createDataFrame([(slots,)], "slots array<array<bigint>>"), "imatch-lexicon")


def with_parts(df: DataFrame, text_col: str, known: DataFrame, out: str, params: IMatchParams = IMatchParams()) -> DataFrame:
    """Add ``out``: array<int>, for each level and subset a hash of the sorted distinct terms in it, 0 without terms.

    A term's first bits draw its subset and how many levels of it the term belongs to, so that the subsets are runs of
    the sorted terms and each level's part of a run is its start. A text without a term in the band keeps all its terms;
    one without any term gets one more number, a hash of the text.
    """
    name = lambda step: f"_{out}_{step}"
    draw = 64 - (params.subsets - 1).bit_length()
    subset = lambda t: F.shiftrightunsigned(t, draw).cast("int")
    column = lambda step: F.col(name(step))

    df = df.withColumn(name("all"), _terms(F.col(text_col))).withColumn(name("slots"), known.select("slots").scalar())
    pair = F.array(F.struct(column("all").alias("terms"), column("slots").alias("slots")))
    in_band = lambda x: F.filter(x["terms"], lambda t: F.array_contains(F.get(x["slots"], _slot(t)), t))
    df = df.withColumn(name("band"), F.transform(pair, in_band)[0])
    df = df.withColumn(name("terms"), F.sort_array(F.when(F.size(column("band")) > 0, column("band")).otherwise(column("all"))))
    n = F.size(column("terms"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    of = lambda i: subset(F.get(column("terms"), i))
    df = df.withColumn(name("starts"), F.filter(places, lambda i: (i == 0) | (of(i) != of(i - 1))))
    run = lambda s, j: F.slice(column("terms"), s + 1, F.coalesce(F.get(column("starts"), j + 1), n) - s)
    df = df.withColumn(name(0), F.transform(column("starts"), run))
    for level in range(1, params.levels):
        first = lambda t: F.shiftrightunsigned(F.shiftleft(t, 64 - draw), 64 - level) == 0  # noqa: B023, E731
        df = df.withColumn(name(level), F.transform(column(level - 1), lambda part: F.filter(part, first)))  # noqa: B023
    every = F.sequence(F.lit(0), F.lit(params.subsets - 1))
    find = lambda drawn: F.transform(every, lambda k: (F.array_position(drawn, k) - 1).cast("int"))
    df = df.withColumn(name("at"), _let(F.transform(column("starts"), of), find))
    digest = lambda part: F.when(F.size(part) == 0, 0).otherwise((F.pmod(F.xxhash64(part), F.lit(65535)) + 1).cast("int"))
    spread = lambda hashes: F.transform(column("at"), lambda i: F.coalesce(F.get(hashes, i), F.lit(0)))
    placed = [_let(F.transform(column(level), digest), spread) for level in range(params.levels)]
    whole = F.when(n == 0, F.array(F.hash(F.col(text_col)))).otherwise(F.expr("cast(array() as array<int>)"))
    return df.withColumn(out, F.concat(*placed, whole)).drop(*[c for c in df.columns if c.startswith(f"_{out}_")])


def fingerprint(parts: Column) -> Column:
    """The parts as a string of numbers."""
    return F.array_join(parts.cast("array<string>"), " ")


def likeness(a: Column, b: Column, params: IMatchParams = IMatchParams()) -> Column:
    """How alike two fingerprints are, 0 to 1: the share of a level's subsets, among those with terms, that agree.

    The level is the one of the smallest subsets in which both together still have ``enough`` subsets with terms, else
    the level of the largest ones. Equal fingerprints give 1; texts without terms are like none but equal ones.
    """
    at = lambda x, level: F.slice(x, level * params.subsets + 1, F.lit(params.subsets))
    full = lambda level: F.size(F.array_remove(at(a, level), 0)) + F.size(F.array_remove(at(b, level), 0))
    level = F.lit(0)
    for deeper in range(1, params.levels):
        level = F.when(full(deeper) >= params.enough, deeper).otherwise(level)
    agree = F.zip_with(at(a, level), at(b, level), lambda p, q: F.when((p == q) & (p != 0), 2).otherwise(0))
    same = F.aggregate(agree, F.lit(0), lambda s, x: s + x)
    return F.when(a == b, 1.0).when(full(0) == 0, 0.0).otherwise(same / full(level))


def _neighbours(rows: DataFrame) -> DataFrame:
    """For every distinct (id, h): the row before it in order, the first following the last, and how many code points
    that one needs of its successor's text.
    """
    thin = rows.select("_id", "_h", F.length("_text").alias("n")).groupBy("_id", "_h").agg(F.max("n").alias("n"))
    placed = materialise(ranked(thin, [], [F.col("_id").asc(), F.col("_h").asc()], "imatch-order"), "imatch-ranks")
    total = placed.count()
    before = placed.select(F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"), F.col("_id").alias("to_id"), F.col("_h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    return placed.select("_id", "_h", "rank").join(before, "rank").drop("rank")


def fingerprint_with_edits(docs: DataFrame, params: IMatchParams = IMatchParams(), id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, text, edited, parts, edited_parts, next_parts) of every row; columns ``carry`` of text and edited may stand in for these two.

    ``edited`` has the last quarter of the code points (rounded down) replaced by the first as many, or all, of the next
    document in ascending id; the first follows the last, and a single document follows itself. Null texts are
    empty; null ids come first. Rows of one id are ordered by a hash of their texts, and rows equal in both count
    as one document in that order, so repeated rows get equal results. Texts are shuffled once: every row sends
    its predecessor the few characters that it needs. Each text is hashed once and its edited form once; the next
    document's parts come from a join of the finished table with itself.
    """
    carry = carry or {"text": F.col("text"), "edited": F.col("edited")}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_id"), text.alias("_text")).withColumn("_h", F.xxhash64("_text"))
    known = lexicon(rows, params, "_text")
    sending = rows.join(materialise(_neighbours(rows), "imatch-neighbours"), ["_id", "_h"])
    sent = sending.select(
        F.col("to_id").alias("_id"), F.col("to_h").alias("_h"), F.expr("substring(_text, 1, need)").alias("head"),
        F.col("_id").alias("next_id"), F.col("_h").alias("next_h"),
    ).dropDuplicates(["_id", "_h"])
    met = rows.join(sent, ["_id", "_h"])
    kept = F.length("_text") - F.floor(F.length("_text") / 4).cast("int")
    met = met.withColumn("edited", F.concat(F.substring(F.col("_text"), F.lit(1), kept), "head"))
    met = with_parts(with_parts(met, "_text", known, "parts", params), "edited", known, "edited_parts", params)
    met = met.withColumnRenamed("_text", "text").select("_id", "_h", "next_id", "next_h", "parts", "edited_parts", *[c.alias(n) for n, c in carry.items()])
    met = materialise(met, "imatch-parts")
    following = met.select(F.col("_id").alias("next_id"), F.col("_h").alias("next_h"), F.col("parts").alias("next_parts")).dropDuplicates(["next_id", "next_h"])
    named = F.when(F.col("_id") != _NULL_ID, F.col("_id")).alias("id")
    return met.join(following, ["next_id", "next_h"]).select(named, *carry, "parts", "edited_parts", "next_parts")
